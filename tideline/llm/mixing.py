"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. A document's expected copies are target / source size; their
whole part is certain, and for the rest documents are ranked by random odds divided by inclusion odds
(Pareto order sampling); the first ones fill, in words, what the certain copies leave of the target. The
sample has a fixed size: it misses its target by half a document at most.

The order is found without sorting a source: documents fall into 4096 ranges of their rank and, where the
target ends, into 4096 ranges of that range; only what is left there is sorted.

Cases: a null text has size 0; a null source is a source of its own, last in order; documents of size 0
take nothing; an empty table gives an empty result; repeated rows are ranked each; other columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import body, each_row, n_words, sized, uniform, work_dir, written

RANGES = 4096
MOST_COPIES = 3


def sources_of(sizes: DataFrame, share: float = 1.0) -> DataFrame:
    """A row per source: key, source_size, weight, target. `sizes` has key (the source, null kept apart), size.

    Weights are 1, 2, 3, repeating, by code point of the source, null last. Targets share `share` of all
    sizes by weight; no target is above MOST_COPIES times its source's size, and what is above is shared
    among the others. That fixed point is found in one pass: in ascending order of limit / weight, the
    sources at their limit come first.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    weighed = per.select("*", ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double").alias("weight"))
    limit = (F.col("source_size") * F.lit(MOST_COPIES)).cast("double")
    by_limit = W.orderBy((limit / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    leveled = weighed.select(
        "*", limit.alias("limit"),
        F.coalesce(F.sum(limit).over(by_limit.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("below"),
        F.sum("weight").over(by_limit.rowsBetween(0, W.unboundedFollowing)).alias("left_weight"),
        (F.sum("source_size").over(W.partitionBy()).cast("double") * F.lit(share)).alias("total"),
    ).withColumn("level", (F.col("total") - F.col("below")) / F.col("left_weight"))
    free = F.when(F.col("limit") / F.col("weight") >= F.col("level"), F.col("level"))
    shared = leveled.withColumn("common", F.first(free, ignorenulls=True).over(by_limit.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.col("limit"), F.coalesce(F.col("common") * F.col("weight"), F.col("limit")))
    return shared.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, seed: str = "mix", share: float = 1.0) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken, copies, source, body."""
    at = work_dir(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("size"), body().alias("body"))
    sizes = written(each_row(narrow), f"{at}/sizes")
    sources = written(sources_of(sizes, share), f"{at}/sources")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(copies)
    named = sized(sources.select(F.col("source").alias("of"), "source_size", "target", whole.alias("whole"), (copies - whole).alias("chance"), (F.col("target") - whole * F.col("source_size")).alias("need")))
    rows = sizes.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    u = uniform(F.col("doc_id"), F.col("body"), F.col("copy"), seed)
    odds = u / (1 - u) * ((1 - F.col("chance")) / F.col("chance"))
    place = F.when(F.col("chance") > 0, odds / (1 + odds)).otherwise(F.lit(0.0))
    coarse = F.least(F.floor(F.col("place") * RANGES), F.lit(RANGES - 1))
    fine = F.floor((F.col("place") * RANGES - F.col("coarse")) * RANGES)
    rows = rows.withColumn("place", place).withColumn("coarse", coarse).withColumn("fine", fine)

    first = _end(rows.groupBy("source", "need", "coarse").agg(F.sum("size").alias("words")), ["source"], "coarse", "need")
    first = written(first.select("source", F.col("at").alias("end"), F.col("before").alias("end_before")), f"{at}/first")
    rows = _with(rows, first, ["source"])
    inside = rows.where(F.col("coarse") == F.col("end"))
    second = _end(inside.groupBy("source", (F.col("need") - F.col("end_before")).alias("rest"), "fine").agg(F.sum("size").alias("words")), ["source"], "fine", "rest")
    second = written(second.select("source", F.col("at").alias("fine_end"), F.col("before").alias("fine_before")), f"{at}/second")
    rows = _with(rows, second, ["source"])
    last = rows.where((F.col("coarse") == F.col("end")) & (F.col("fine") == F.col("fine_end")))
    order = W.partitionBy("source").orderBy("place", F.col("doc_id").asc_nulls_last(), "size", "body", "copy").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("need") - F.col("end_before") - F.col("fine_before")
    last = last.withColumn("one_more", F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2 <= left)
    sure = F.coalesce((F.col("coarse") < F.col("end")) | ((F.col("coarse") == F.col("end")) & (F.col("fine") < F.col("fine_end"))), F.lit(False))
    others = rows.where(~F.coalesce((F.col("coarse") == F.col("end")) & (F.col("fine") == F.col("fine_end")), F.lit(False))).withColumn("one_more", sure)
    taken = F.col("whole") + F.when(F.col("one_more") & (F.col("chance") > 0) & (F.col("size") > 0), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long")
    return others.unionByName(last).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source", "body")


def _end(words: DataFrame, keys: list[str], at: str, need: str) -> DataFrame:
    """Of each key, the range `at` in which the sum of the words passes `need`, and the sum before it. At most RANGES rows a key."""
    over = W.partitionBy(*keys).orderBy(at)
    summed = words.withColumn("sum", F.sum("words").over(over)).withColumn("before", F.col("sum") - F.col("words"))
    passing = summed.where(F.col("sum") >= F.col(need))
    return passing.groupBy(*keys).agg(F.min(F.struct(F.col(at).alias("at"), "before")).alias("end")).select(*keys, "end.at", "end.before")


def _with(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    there = small.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in small.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(sized(there), on, "left").drop(*(f"_{k}" for k in keys))


def mixed(docs: DataFrame, seed: str = "mix", share: float = 1.0) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; a row that it doesn't take goes.

    Rows that repeat an id, a source and a text count as one, which is taken as often as all of them together.
    """
    at, keys = work_dir(docs.sparkSession), ["doc_id", "source", "body"]
    plan = mix(docs, seed, share).groupBy(*keys).agg(F.sum("copies").cast("int").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    plan = written(plan.where("_copies <> 1 or _rows > 1"), f"{at}/plan")
    named = docs.withColumn("_body", body())
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & F.col("source").cast("string").eqNullSafe(F.col("_from")) & (F.col("_body") == F.col("_of"))
    planned = plan.select(F.col("doc_id").alias("_id"), F.col("source").alias("_from"), F.col("body").alias("_of"), "_copies", "_rows")
    joined = named.join(sized(planned), on, "left")
    times = lambda n: F.explode(F.array_repeat(F.lit(1), n)).alias("_one")
    once = joined.where("_rows is null or _rows = 1").select(*docs.columns, times(F.coalesce("_copies", F.lit(1)))).drop("_one")
    if plan.where("_rows > 1").isEmpty():
        return once
    several = joined.where("_rows > 1").groupBy("_id", "_from", "_of", "_copies").agg(F.first(F.struct(*docs.columns)).alias("_row"))
    return once.unionByName(several.select("_row", times(F.col("_copies"))).select("_row.*"))
