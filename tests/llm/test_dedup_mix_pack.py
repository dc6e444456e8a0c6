"""Exact dedup, mixing and packing against brute force, with nulls, ties, repeats, empty tables and odd columns."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tideline.llm import exact_dedup, mixing, packing

KIND = "doc_id long, text string, lang string, source string, n_chars long, size int, digest string, copies int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 7, "x", 9) for i, t, s in rows], KIND)


TEXTS = [(1, "a b", "s"), (2, " a\tb\n", "s"), (3, "ab", None), (4, None, "s"), (5, "", "t"), (6, " ", "t"), (7, "A b", "t"), (8, "x" * 200_000, "t"), (None, "ab ", "s"), (9, "ab    ", "s"), (9, "ab    ", "s"), (10, "é", "u"), (11, "é", "u")]


def expected(rows):
    groups = defaultdict(list)
    for k, (i, t, _) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, k))
    return {k: (rows[min(g)[3]][0], len(g), min(g)[3] == k or rows[k] == rows[min(g)[3]]) for g in groups.values() for *_, k in g}


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 1)])
def test_exact_dedup(spark, digest):
    got = exact_dedup.dedup(docs_of(spark, TEXTS).coalesce(1), digest).orderBy("row_no").collect()
    want = expected(TEXTS)
    assert len(got) == len(TEXTS)
    for k, r in enumerate(got):
        assert (r.doc_id, r.keep_id, r.group_size) == (TEXTS[k][0], want[k][0], want[k][1])
        kept_text = next(t for (i, t, _), k2 in zip(TEXTS, got, strict=True) if k2.kept and re.sub(r"[\x20\x09-\x0D]", "", t or "") == re.sub(r"[\x20\x09-\x0D]", "", TEXTS[k][1] or ""))
        assert r.kept <= want[k][2] and len(kept_text or "") == max(len(t or "") for _, t, _ in TEXTS if re.sub(r"[\x20\x09-\x0D]", "", t or "") == re.sub(r"[\x20\x09-\x0D]", "", TEXTS[k][1] or ""))
        if digest is exact_dedup.sha256:
            assert r.text_sha256 == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", TEXTS[k][1] or "").encode()).hexdigest()
    assert sum(r.kept for r in got) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in TEXTS})


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 1)])
def test_dedup_state_goes_on(spark, tmp_path, digest):
    """A later call meets the rows of earlier ones, through a state that stays and texts that are read where they lie."""
    parts = [TEXTS[:4], TEXTS[4:9], [(20, "a  b ", "s"), (21, "x" * 200_000, "t"), (22, "new", "u"), (23, "é", "u")]]
    for k, part in enumerate(parts):
        docs_of(spark, part).coalesce(1).write.parquet(f"{tmp_path}/{k}")
        got = exact_dedup.dedup(spark.read.parquet(f"{tmp_path}/{k}"), digest, f"file://{tmp_path}/kept").orderBy("row_no").collect()
        so_far = [r for p in parts[: k + 1] for r in p]
        want = expected(so_far)
        first = len(so_far) - len(part)
        assert [(r.doc_id, r.keep_id, r.group_size) for r in got] == [(so_far[first + j][0], *want[first + j][:2]) for j in range(len(part))]


def test_nothing_of_python_runs_in_dedup(spark, sf, capsys):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    exact_dedup.dedup(docs).explain("formatted")
    exact_dedup.deduplicated(docs).explain("formatted")
    said = capsys.readouterr().out
    assert "Scan parquet" in said and not any(w in said for w in ("Python", "Arrow", "Pandas", "ExistingRDD"))


def test_deduplicated_rows(spark):
    kept = exact_dedup.deduplicated(docs_of(spark, [*TEXTS[:3], *TEXTS[9:]]))
    assert kept.columns == [c.split()[0] for c in KIND.split(", ")]
    assert sorted(r.doc_id for r in kept.collect()) == [9, 10, 11]
    odd = docs_of(spark, [(None, "q r", "s")] * 3 + [(4, "one", "s"), (4, "two", "s")]).withColumn("_metadata", F.lit(1))
    assert sorted(map(str, exact_dedup.deduplicated(odd).select("doc_id", "text", "_metadata").collect())) == sorted(map(str, odd.distinct().select("doc_id", "text", "_metadata").collect()))
    assert exact_dedup.deduplicated(docs_of(spark, TEXTS).limit(0)).count() == 0


def test_mixing_targets(spark):
    rows = [(k, " ".join(["w"] * (k % 7 + 1)), f"s{k % 5}" if k % 11 else None) for k in range(600)] + [(1000, None, "s0"), (1001, "", "lonely"), (1002, "w " * 30_000, "s1")]
    docs = docs_of(spark, rows)
    got = mixing.mix(docs).collect()
    sizes = {i: len((t or "").split()) for i, t, _ in rows}
    assert len(got) == len(rows) and all(r["size"] == sizes[r.doc_id] and 0 <= r.taken <= 3 * r["size"] for r in got)
    per, target = Counter(), {}
    for r in got:
        per[r.source] += r.taken
        target[r.source] = r.target
        assert r.target <= 3 * r.source_size
    total = sum(sizes.values())
    assert abs(sum(target.values()) - total) < 1e-6 * total
    largest = {s: max(sizes[i] for i, _, x in rows if x == s) for s in per}
    assert all(abs(per[s] - target[s]) <= largest[s] for s in per)
    order = sorted((s for s in target if s), key=lambda s: s.encode()) + [None]
    weights = {s: k % 3 + 1 for k, s in enumerate(order)}
    open_ = [target[s] / weights[s] for s in order if target[s] < 3 * sum(sizes[i] for i, _, x in rows if x == s) - 1e-9]
    assert max(open_) - min(open_) < 1e-6 * max(open_)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str)


def test_mixed_rows_are_repeated(spark):
    docs = docs_of(spark, [(k, "w w w", f"s{k % 3}") for k in range(300)])
    plan = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in plan.items() if v})
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_repeated_and_unnamed_rows_are_ranked_each(spark):
    """Equal rows, and rows without an id, get numbers of their own; together they take what is due."""
    rows = [(None, "w w w w", "a")] * 900 + [(5, "w w", "a")] * 900 + [(k, "w w w", "b") for k in range(10, 700)]
    docs = docs_of(spark, rows)
    got = mixing.mix(docs).collect()
    per, target = Counter(), {r.source: r.target for r in got}
    for r in got:
        per[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(per[s] - target[s]) <= 4 for s in per)
    assert {r.copies for r in got if r.doc_id == 5} == {0, 1}
    out = Counter((r.doc_id, r.source) for r in mixing.mixed(docs).collect())
    want = Counter()
    for r in got:
        want[r.doc_id, r.source] += r.copies
    assert out == +want


def brute(sizes, sources, clusters, capacity):
    bins, placed = [], []
    for k, size in enumerate(sizes):
        fits = [(capacity - sum(sizes[x] for x in b) - size, n) for n, b in enumerate(bins) if sum(sizes[x] for x in b) + size <= capacity and not any(sources[x] & sources[k] or clusters[x] & clusters[k] for x in b)]
        if fits:
            n = min(fits)[1]
            bins[n].append(k)
        else:
            n = len(bins)
            bins.append([k])
        placed.append(capacity - sum(sizes[x] for x in bins[n]))
    return len(bins), placed


def test_best_fit_is_the_tightest_compatible():
    import random

    rng = random.Random(1)
    for _ in range(20):
        sizes = sorted((rng.randint(0, 30) for _ in range(80)), reverse=True)
        sources, clusters = packing.bits([rng.randrange(9) for _ in sizes]), packing.bits([rng.randrange(60) for _ in sizes], True)
        placed = packing.best_fit(sizes, sources, clusters, 50)
        used = Counter()
        rooms = []
        for k, b in enumerate(placed):
            used[b] += sizes[k]
            rooms.append(50 - used[b])
        n, want = brute(sizes, sources, clusters, 50)
        assert max(placed) + 1 == n and rooms == want


def test_packing_is_whole(spark):
    rows = [(k, "w " * (k * 37 % 300), f"s{k % 13}" if k % 5 else None) for k in range(500)] + [(900, None, "s1"), (901, "w " * 1050, "s2"), (902, "w " * 1050, "s3"), (903, "w " * 200, "s4"), (None, "w " * 9, "s5")]
    got = packing.pack(docs_of(spark, rows), 100, 64).collect()
    sizes = Counter()
    bins = defaultdict(list)
    for r in got:
        sizes[r.doc_id] += r["size"]
        bins[r.bin_id].append(r)
    assert sizes == Counter({i: len((t or "").split()) for i, t, _ in rows}) and set(sizes) == {i for i, *_ in rows}
    again = packing.pack(docs_of(spark, rows).repartition(5), 100, 64).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    for b in bins.values():
        assert sum(r["size"] for r in b) == b[0].bin_used <= 100
        assert len({r.source for r in b}) == len(b) == len({r.cluster for r in b})
    assert packing.pack(docs_of(spark, rows).limit(0)).count() == 0
    assert {r.bin_id for r in got if r.bin_used == 100 and r["size"] == 100} and all(len(b) == 1 for b in bins.values() if b[0]["size"] == 100)
    assert list(packing.pieces_of("a b  c", 2)) == ["a b", "c"] and list(packing.pieces_of(None, 2)) == [""]
