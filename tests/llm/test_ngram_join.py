"""The similarity join against brute force, in all of its ways."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm import components, ngram_join


def shingles(text, n=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def brute(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        least[root(k)] = min(least.get(root(k), i), i)
    return {i: (len(s), least[root(k)] if s else i) for k, (i, s) in enumerate(sets)}


def corpus(seed, many=160):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    while len(rows) < many:
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 9, 12, 14, 16, 25, 60, 150, 400]))]
        if rng.random() < 0.3:
            base += passage
        for _ in range(rng.choice([1, 1, 3, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, len(base) // 40, len(base) // 20])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("seed,n,percent,members", [(1, 4, 85, 512), (2, 5, 80, 8), (3, 1, 85, 8)])
def test_components_equal_brute_force(spark, monkeypatch, seed, n, percent, members):
    monkeypatch.setattr(ngram_join, "MOST_MEMBERS", members)
    monkeypatch.setattr(ngram_join, "MOST_SHINGLES", members * 1000)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("cls", F.lit("x"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs, n, percent).collect()}
    assert got == brute(rows, n, percent)


def test_odd_rows(spark):
    long = "long " + " ".join(f"v{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "É a"), (8, "é a"), (9, "a b"), (10, long), (11, long + " end"), (11, long + " end"), (None, "one")]
    got = [tuple(r)[:3] for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    of = {i: (n, c) for i, n, c in got}
    assert len(got) == len(rows) and [of[k] for k in (1, 2, 3)] == [(0, 1), (0, 2), (0, 3)]
    assert of[4] == of[5] == (1, 4) and of[None] == (1, 4) and of[7] == (1, 7) and of[8] == (1, 8) and of[9] == (1, 9)
    assert of[11][1] == 10
    kept = ngram_join.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 6, 7, 8, 9, 10]
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def linked(rng, percent, sizes):
    """Pairs of sets at the edge of the threshold."""
    for n in sizes:
        for _ in range(6):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = a.copy()
            while True:
                c = b[rng.random(len(b)) > 1 / len(b)] if rng.random() < 0.5 else np.unique(np.append(b, rng.integers(0, 2**63).astype(np.uint64)))
                i = np.intersect1d(a, c).size
                if 100 * i < percent * (len(a) + len(c) - i) or not len(c):
                    break
                b = c
                if rng.random() < 0.02:
                    break
            yield a, b


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_light_sets_share_a_subset(percent):
    for a, b in linked(np.random.default_rng(0), percent, range(1, 15)):
        assert np.intersect1d(ngram_join.subsets(a, percent), ngram_join.subsets(b, percent)).size
        assert len(ngram_join.subsets(a, percent)) == ngram_join.n_subsets(len(a), percent)


def test_boundary_weighs_both_costs():
    """Where inverted lists are long, more sizes are light; where nothing is scanned, only those of one subset are."""
    short = {n: (100, 0, 0) for n in range(1, 30)}
    long = {n: (100, 300, 300_000) for n in range(1, 30)}
    none = ngram_join.boundary(short, 85)
    assert all(ngram_join.n_subsets(n, 85) * 100 <= 0 for n in range(1, none + 1))
    cost = lambda b: sum(e + s if n > b else 100 * ngram_join.n_subsets(n, 85) + (e if n >= ngram_join.least_overlap(b + 1, 85) else 0) for n, (_, e, s) in long.items())
    assert cost(ngram_join.boundary(long, 85)) == min(map(cost, range(27))) and ngram_join.boundary(long, 85) > 13


@pytest.mark.parametrize("light", [0, 3, 12, 20])
def test_any_boundary_gives_the_same_result(spark, monkeypatch, light):
    monkeypatch.setattr(ngram_join, "boundary", lambda costs, percent: light)
    monkeypatch.setattr(ngram_join, "CHUNK", 2000)
    rng, words = random.Random(9), [f"w{k}" for k in range(60)]
    rows = []
    while len(rows) < 300:
        base = [rng.choice(words) for _ in range(rng.randint(1, 24))]
        for _ in range(rng.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs, 1, 80).collect()}
    assert got == brute(rows, 1, 80)


def test_many_near_copies_without_an_id(spark):
    """Rows are found again by id and text, so rows without an id meet their own text only."""
    rng = random.Random(6)
    rows = []
    for k in range(1000):
        base = [f"a{k}x{rng.randrange(40)}" for _ in range(60)]
        rows += [(None, " ".join(base)), (None, " ".join([*base, "end"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ngram_join.representatives(docs).count() == 1000
    assert ngram_join.join(docs).where("component_id is not null").count() == 0


def test_representatives_of_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (1, text), (2, text + " end"), (3, "other words of a text that stands alone"), (3, text + " more"), (None, text + " last"), (None, "none at all"), (4, ""), (4, "")]
    kept = ngram_join.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, text), (3, rows[3][1]), (None, "none at all"), (4, ""), (4, "")], key=str)


@pytest.mark.parametrize("leaders", [0, 4])
def test_large_components_by_their_leaders(spark, monkeypatch, leaders):
    """Two wide groups with a bridge between them, and sets that only share most of a passage."""
    monkeypatch.setattr(ngram_join, "MOST_MEMBERS", 16)
    monkeypatch.setattr(ngram_join, "LEADERS", leaders)
    rng, rows = random.Random(8), []
    base = [f"w{k}" for k in range(120)]
    for step in range(6):
        base = [f"s{step}x{k}" if rng.random() < 0.06 else w for k, w in enumerate(base)]
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 8])):
                copy[rng.randrange(120)] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs, 1, 85).collect()}
    assert got == brute(rows, 1, 85)


def test_a_wide_group_of_near_copies(spark):
    """Each copy is like the original and few are like each other; all are one component, with no pairs emitted."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(base))]
    for k in range(1, 700):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(200)] = f"x{rng.random()}"
        rows.append((k, " ".join(copy)))
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("component_id <> 0").count() == 0


@pytest.mark.parametrize("most", [10**6, 0])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(components, "MOST_EDGES", most)
    chain = [(k, k + 1) for k in range(0, 60)] + [(100, 200), (300, 200), (400, 400)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 200: 100, 300: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def most_stacked(plan):
    """The most Python functions that one task of a physical plan passes."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return most_stacked(plan.initialPlan())
    children = [plan.children().apply(k) for k in range(plan.children().size())]
    here = max((0 if "Exchange" in c.nodeName() else most_stacked(c) for c in children), default=0)
    return here + (plan.nodeName().endswith(("InArrow", "InPandas")))


def stages(plan):
    """The roots of a physical plan's stages."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
    yield plan
    for k in range(plan.children().size()):
        yield from stages(plan.children().apply(k))


def test_a_task_takes_one_python_worker(spark, sf, monkeypatch):
    """Workers stay: where one task takes two, each core of an executor holds two from then on."""
    stacked = []

    def written(df, *path, put=ngram_join.written, **options):
        stacked.append(max(map(most_stacked, stages(df._jdf.queryExecution().executedPlan()))))
        return put(df, *path, **options)

    monkeypatch.setattr(ngram_join, "written", written)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 100")
    assert ngram_join.representatives(docs, 5, 80).count() > 0
    assert max(stacked) == 1


def test_a_worker_keeps_nothing_of_its_task(monkeypatch):
    """Words are forgotten when a task ends, and a task remembers no more than it may; sets don't depend on it."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(50)) for _ in range(40)]
    sets = [ngram_join.shingle_set(t.encode(), 4) for t in texts]
    names = [ngram_join.class_of(s) for s in sets]
    monkeypatch.setattr(ngram_join, "MOST_WORDS", 100)
    rows = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(names)], names=["text", "cls"])
    got = [x for b in ngram_join._sets(iter([rows]), 4) for x in b.column("shingles").to_pylist()]
    assert got == [s.tobytes() for s in sets] and not ngram_join._words
    monkeypatch.setattr(ngram_join, "TaskContext", type("Task", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 3)}))
    ids = pa.array(range(40), pa.int64())
    sent = list(ngram_join._chunked(iter([pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["doc_id", "key", "text"])]), 4, 64, 500))
    assert len(sent) > 2 and not ngram_join._words
    list(map(ngram_join._words.__getitem__, (b"%d" % k for k in range(250))))
    assert len(ngram_join._words) <= 100
    ngram_join._words.clear()
