"""The corpus pipeline: each stage's decisions take effect on what the one before it kept."""

import random
import re
from collections import Counter

import corpus_pipeline
from tideline.llm import common, queries


def test_stages_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        seen.append(name)
        if name != "best_fit_packing":
            assert out.columns == columns
            assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
            if name in ("exact_dedup", "ngram_jaccard_join", "toxicity"):
                assert len(rows) <= docs.count() and max(Counter(r.doc_id for r in rows).values()) == 1
            docs = spark.createDataFrame(rows, out.schema)
        else:
            sizes = Counter()
            for r in rows:
                sizes[r.doc_id] += r["size"]
            want = Counter()
            for r in docs.collect():
                want[r.doc_id] += len((r.text or "").encode().split())
            assert sizes == want and all(r.bin_used <= corpus_pipeline.CAPACITY for r in rows)
    assert seen == ["toxicity", "exact_dedup", "ngram_jaccard_join", "mixing", "best_fit_packing"]


def test_odd_rows_along_the_chain(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and ids: each stage against what its words say, and run() against the chain."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [prose(rng.choice([3, 8, 40, 200])) for _ in range(60)]
    rows = [(k, t, "en", f"s{k % 4}", len(t)) for k, t in enumerate(base)]
    rows += [(100 + k, f"{t} tail", None, None, None) for k, t in enumerate(base[:20]) if len(t.split()) > 30]
    rows += [(200 + k, t.replace(" ", "  "), "en", "s1", 0) for k, t in enumerate(base[:10])]
    rows += [rows[0]] * 3 + [(None, base[1], None, "s9", 1)] * 3 + [(None, prose(50), "en", None, 5), (7, prose(30), "en", "s2", 1)]
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, " \n", "en", "s1", 2), (303, prose(60_000), "en", "s2", 9), (None, None, None, None, None)]
    rows += [(400 + k, prose(20) + " grobian rascal dunce", "en", "s3", 1) for k in range(20)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, 0) for k in range(60)] + [(400 + k, 1, 1) for k in range(20)] + [(None, 1, 1), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.written(stage(spark, docs, str(tmp_path)), f"file://{tmp_path}/{k}")
        kept[name] = [tuple(r) for r in docs.collect()]
        if name != "best_fit_packing":
            assert docs.columns == [c.split()[0] for c in kind.split(", ")]
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    assert Counter(kept["toxicity"]) == Counter(r for r in rows if "grobian" not in (r[1] or ""))
    best = {}
    for r in kept["toxicity"]:
        order = (-len(r[1] or ""), r[0] is None, r[0] or 0)
        best[bare(r[1])] = min(best.get(bare(r[1]), (order, r)), (order, r), key=lambda x: x[0])
    assert Counter(kept["exact_dedup"]) == Counter(r for _, r in best.values())
    sets = [(r, frozenset(zip(*((r[1] or "").split()[k:] for k in range(5)), strict=False)) or frozenset([tuple((r[1] or "").split())] if (r[1] or "").split() else [])) for r in kept["exact_dedup"]]
    least = lambda r: (r[0] is None, r[0] or 0)  # noqa: E731  groups here are pairs
    lost = {a for a, x in sets for b, y in sets if a != b and x and y and 100 * len(x & y) >= 80 * len(x | y) and least(b) < least(a)}
    assert lost and Counter(kept["ngram_jaccard_join"]) == Counter(r for r, _ in sets if r not in lost)
    taken = Counter(kept["mixing"])
    assert set(taken) <= set(kept["ngram_jaccard_join"]) and max(taken.values()) <= 3
    size, want = Counter(), Counter()
    for doc_id, _, n, source, *_ in kept["best_fit_packing"]:
        size[doc_id, source] += n
    for r in kept["mixing"]:
        want[r[0], r[3]] += len((r[1] or "").split())
    assert size == want
    assert Counter(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == Counter(map(str, docs.collect()))


def test_stages_take_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)}
