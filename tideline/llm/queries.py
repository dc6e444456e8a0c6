"""The queries of this package and their SQL, by name. Each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import exact_dedup, fingerprints, html_extract, importance, lm_scoring, mixing, ngram_join, packing, token_files, toxicity
from tideline.llm.common import table, work_dir


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents")).drop("located_in", "row_no", "place")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies", "source", "body")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), hold_out=False)


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), hold_out=False)


def op8_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return token_files.read(token_files.write(table(spark, sf_dir, "documents"), f"{work_dir(spark)}/tokens", path, end_id=1, by_word=True))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_all(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_importance_resampling": op7_importance_resampling,
    "op8_imatch_fingerprints": op8_imatch_fingerprints,
    "op9_token_files": op9_token_files,
    "op10_html_extraction": op10_html_extraction,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
        with recursive w as (select cast(doc_id as bigint) doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
        s as (select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) end s from w),
        e as (select doc_id, len(s) n, unnest(s) g from s),
        p as (select a.doc_id a, b.doc_id b from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        r as (select a, b from p union select r.a, p.b from r join p on r.b = p.a)
        select s.doc_id, cast(len(s.s) as bigint) n_shingles, least(s.doc_id, coalesce(m.b, s.doc_id)) component_id from s left join (select a, min(b) b from r group by a) m on s.doc_id = m.a""",
    "op3_exact_dedup": r"""
        with d as (select cast(doc_id as bigint) doc_id, length(coalesce(text, '')) n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) h from documents),
        k as (select h, count(*) group_size, arg_min(doc_id, (-n, doc_id)) keep_id from d group by h)
        select d.doc_id, k.keep_id, k.group_size, d.doc_id = k.keep_id as kept, d.h as text_sha256 from d join k using (h)""",
    "op4_mixing": r"""
        with d as (select cast(doc_id as bigint) doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size, substr(md5(coalesce(text, '')), 1, 12) body from documents),
        s as (select source, cast(sum(size) as bigint) source_size from d group by source),
        w as (select *, cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as double) weight, cast(source_size * 3 as double) lim, cast(sum(source_size) over () as double) total from s),
        l as (select *, (total - coalesce(sum(lim) over (order by lim / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by lim / weight, source nulls last rows between current row and unbounded following) level from w),
        c as (select (select arg_min(level, (lim / weight, source is null, source)) from l where lim / weight >= level) common),
        t as (select source, source_size, least(lim, coalesce(common * weight, lim)) target from l, c),
        m as (select d.*, row_number() over (partition by d.doc_id, d.source, d.size, d.body) - 1 as copy, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0 end copies from d join t on d.source is not distinct from t.source),
        r as (select *, copies - floor(copies) chance, target - floor(copies) * source_size need, (cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || body || ':' || copy || ':mix'), 1, 12)) as bigint) + 0.5) / 281474976710656.0 u from m),
        o as (select *, u / (1 - u) * ((1 - chance) / case when chance > 0 then chance end) odds from r),
        p as (select *, coalesce(sum(size) over (partition by source order by odds / (1 + odds), doc_id, size, body, copy rows between unbounded preceding and 1 preceding), 0) before from o)
        select doc_id, size, source_size, target, cast(case when size > 0 then floor(copies) + case when chance > 0 and before + size / 2.0 <= need then 1 else 0 end else 0 end as bigint) * size as taken from p""",
}
