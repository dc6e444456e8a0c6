"""Toxicity, LM scoring, importance resampling, fingerprints."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tideline.llm import fingerprints, importance, lm_scoring, queries, toxicity

ODD = [(None, "no id here"), (10_001, None), (10_002, ""), (10_003, "word " * 60_000), (10_004, "퟿\U0010ffff é"), (10_004, "퟿\U0010ffff é")]


@pytest.fixture(scope="module")
def world(spark):
    """Texts of two kinds, good and bad, some with rude words; labels of most."""
    rng = random.Random(3)
    good, bad = [f"good{k}" for k in range(200)], [f"bad{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(600):
        quality = int(rng.random() < 0.7)
        toxic = int(rng.random() < 0.2)
        words = [rng.choice(good if quality else bad) for _ in range(rng.randint(20, 120))] + ["the"] * 10
        if toxic:
            words += [rng.choice(["grobian", "rascal", "dunce"]) for _ in range(3)]
        rng.shuffle(words)
        rows.append((k, " ".join(words), quality, toxic))
        if k % 3:
            labels.append((k, quality, toxic))
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t, *_ in rows] + [(i, t, 0.5, 1) for i, t in ODD], "doc_id long, text string, score double, predicted int").repartition(3)
    return rows, docs.cache(), spark.createDataFrame([*labels, labels[0], (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(world):
    rows, docs, labels = world
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows) and got[None].held_out
    held = [(got[i].predicted, toxic) for i, _, _, toxic in rows if got[i].held_out]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert got[10_002].score == got[10_001].score < 0.5 and got[10_003].predicted == 0
    kept = toxicity.tolerated(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_reads_only_texts(spark, world):
    rows, docs, labels = world
    model = toxicity.train(docs, labels)
    twice = spark.createDataFrame([(1, rows[0][1]), (999, rows[0][1])], "doc_id long, text string")
    assert len({r.score for r in toxicity.score(twice, model).collect()}) == 1


def test_toxicity_without_labels(spark, world):
    _, docs, labels = world
    assert {r.predicted for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0}
    assert {r.predicted for r in toxicity.classify(docs, labels.withColumn("toxic", F.lit(1))).collect()} == {1}
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_long_texts_have_the_same_ngrams(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice("abcé \U0001f600") for _ in range(3000))
    whole = toxicity.ngrams(text)
    for window in (1, 7, 100, 2999, 3000, 3002, 4000):
        monkeypatch.setattr(toxicity, "WINDOW", window)
        assert toxicity.ngrams(text).tolist() == whole.tolist()


def brute_toxicity(rows, learn):
    """Naive Bayes ratios and weights of a logistic regression, from sets of strings; the fit is the module's, which another test checks."""
    points = lambda t: f" {t.lower()} "

    def buckets(t):
        out, mask = set(), (1 << 64) - 1
        p = [ord(c) if not 9 <= ord(c) <= 13 else 32 for c in points(t)]
        for n in (3, 4, 5):
            for k in range(len(p) - n + 1):
                h = p[k]
                for x in p[k + 1 : k + n]:
                    h = (h * 0x9E3779B97F4A7C15 & mask) ^ x
                out.add((h ^ (h >> 29)) * 0x9E3779B97F4A7C15 % 2**64 >> 46)
        return out

    sets = {i: buckets(t) for i, t, *_ in rows}
    by_text = {}
    for i, t, _, label in rows:
        if i in learn and re.sub(r"[\x20\x09-\x0D]", "", t) not in by_text:
            by_text[re.sub(r"[\x20\x09-\x0D]", "", t)] = (i, label)
    chosen = list(by_text.values())
    pos, neg = sum(x for _, x in chosen), sum(1 - x for _, x in chosen)
    counts = {0: Counter(), 1: Counter()}
    for i, label in chosen:
        counts[label].update(sets[i])
    scored = {}
    for b in counts[0].keys() | counts[1].keys():
        a, c = counts[1][b], counts[0][b]
        share = (a + c) / (pos + neg)
        z = abs(a / pos - c / neg) / (math.sqrt(share * (1 - share) * (1 / pos + 1 / neg)) + 1 / (pos + neg))
        if a + c >= 3 and z >= 3.5:
            scored[b] = math.log((a + 0.5) / (pos + 1)) - math.log((c + 0.5) / (neg + 1))
    names = sorted(scored)
    place = {b: k for k, b in enumerate(names)}
    r, c = zip(*[(k, place[b]) for k, (i, _) in enumerate(chosen) for b in sets[i] if b in place], strict=True)
    w, bias = toxicity.fit_weights(np.array(r), np.array(c), np.array([scored[b] for b in names]), np.array([x for _, x in chosen], float))
    return {i: 1 / (1 + math.exp(-(bias + sum(w[place[b]] for b in s if b in place)))) for i, s in sets.items()}


def test_toxicity_by_brute_force(spark, world):
    rows, _, labels = world
    rows = rows[:240]
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in toxicity.classify(docs, labels.where("doc_id < 240 and toxic is not null")).collect()}
    want = brute_toxicity(rows, {i for i, *_ in rows if i % 3 and zlib.crc32(str(i).encode()) % 5})
    assert max(abs(got[i] - want[i]) for i in got) < 1e-6 and len(got) == 240


def test_weights_separate():
    rows, cols = np.array([0, 0, 1, 2, 2, 3]), np.array([0, 1, 1, 0, 2, 2])
    w, b = toxicity.fit_weights(rows, cols, np.array([2.0, 0.1, -1.0]), np.array([1.0, 0, 1, 0]), 0.01)
    x = b + np.bincount(rows, weights=w[cols], minlength=4)
    assert (x > 0).tolist() == [True, False, True, False]


def test_lm_losses_are_the_models(spark, world):
    rows, docs, labels = world
    got = {r.doc_id: r for r in lm_scoring.score(docs, labels).collect()}
    assert len(got) == len(rows) + 5
    assert got[10_001].target_loss is None and got[10_002].n_tokens == 0
    target = {i for i, q, _ in [tuple(r) for r in labels.collect()] if q == 1 and i is not None and zlib.crc32(str(i).encode()) % 5}
    texts = [(i, t) for i, t, *_ in rows] + ODD
    tokens = lambda t: [*w, None] if (w := (t or "").lower().split()) else []  # noqa: E731  None: the end
    for name, chosen in (("target_loss", [t for i, t in texts if i in target]), ("background_loss", [t for _, t in texts])):
        single, double = Counter(), Counter()
        for t in chosen:
            w = tokens(t)
            single.update(w)
            double.update(zip(w, w[1:], strict=False))
        kinds = len({w for _, t in texts for w in tokens(t)}) + 1
        total = sum(single.values())
        size, scale = (total, 1.0) if name == "target_loss" else (size, size / total)
        for i, t, *_ in rows[:40]:
            w = tokens(t)
            loss = 0.0
            for k, x in enumerate(w):
                p = (scale * single[x] + 0.5) / (scale * total + 0.5 * kinds)
                if k:
                    p = (scale * double[w[k - 1], x] + 5 * p) / (scale * single[w[k - 1]] + 5)
                loss -= math.log(p)
            assert abs(got[i][name] - loss / len(w)) < 1e-9 and got[i].n_tokens == len(w) - 1
    held = [(got[i].ce_difference, q) for i, _, q, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert max(d for d, q in held if q) < min(d for d, q in held if not q)


def test_lm_without_target_or_rows(spark, world):
    _, docs, labels = world
    flat = lm_scoring.score(docs.limit(20), labels.limit(0)).where("n_tokens > 0").collect()
    assert len({round(r.target_loss, 9) for r in flat}) == 1
    assert lm_scoring.score(docs.limit(0), labels).count() == 0


def test_lm_counts_every_word_exactly(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK", 30_000, raising=False)
    kinds = 60_000
    rows = [(k, " ".join(f"w{i}" for i in range(k, kinds, 100)) + f" w{k} the of") for k in range(100)] + [(100, f"w{kinds - 1} w0"), (101, "the of the of"), (None, "the of"), (102, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 102, 2)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in lm_scoring.score(docs, labels).collect()}
    assert len(got) == len(rows)
    for name, chosen in (("target_loss", [t for i, t in rows if i is not None and i % 2 == 0 and i < 102 and zlib.crc32(str(i).encode()) % 5]), ("background_loss", [t for _, t in rows])):
        single, double = Counter(), Counter()
        for t in chosen:
            w = [*t.split(), None] if t else []
            single.update(w)
            double.update(zip(w, w[1:], strict=False))
        total = sum(single.values())
        size, scale = (total, 1.0) if name == "target_loss" else (size, size / total)
        for i, t in rows[:-1]:
            w, loss = [*t.split(), None], 0.0
            for k, x in enumerate(w):
                p = (scale * single[x] + 0.5) / (scale * total + 0.5 * (kinds + 4))
                if k:
                    p = (scale * double[w[k - 1], x] + 5 * p) / (scale * single[w[k - 1]] + 5)
                loss -= math.log(p)
            assert abs(got[i][name] - loss / len(w)) < 1e-9


def test_lm_probabilities_sum_to_one():
    """Over the vocabulary, the end and an unknown word, in every context."""
    rng = random.Random(5)
    texts = [[rng.randrange(2, 9) for _ in range(rng.randint(1, 12))] + [1] for _ in range(30)]
    kinds = 8
    single, double = Counter(w for t in texts for w in t), Counter(x for t in texts for x in zip(t, t[1:], strict=False))
    for context in range(2, 10):  # 9 never occurs
        mass = 0.0
        for w in [*range(1, 9), 10]:
            ids = np.array(sorted({context, w}), np.uint64)
            chunk = lm_scoring.Chunk(np.array([2]), np.searchsorted(ids, np.array([context, w], np.uint64)), ids, 4)
            counts = [np.array([single[i] for i in ids.tolist()]), np.array([double[context, w]])]
            both = chunk.losses(*counts, sum(single.values()), kinds + 1)[0]
            first = (single[context] + 0.5) / (sum(single.values()) + 0.5 * (kinds + 1))
            mass += math.exp(-both) / first
        assert abs(mass - 1) < 1e-9


def test_importance_keeps_the_good(world):
    rows, docs, labels = world
    got = {r.doc_id: r for r in importance.resample(docs, labels, 0.6).collect()}
    n = len(rows) + len(ODD)
    assert sum(r.kept for r in importance.resample(docs, labels, 0.6).collect()) == math.ceil(0.6 * n)
    assert got[10_001].log_weight == 0
    lost = [q for i, _, q, _ in rows if not got[i].kept]
    assert sum(lost) / len(lost) < 0.5 and min(got[i].log_weight for i, _, q, _ in rows if q) > max(got[i].log_weight for i, _, q, _ in rows if not q)
    noise = [got[i].gumbel_score - got[i].log_weight for i, *_ in rows]
    assert abs(np.mean(noise) - 0.5772) < 0.2 and abs(np.std(noise) - 1.2825) < 0.2
    assert importance.resample(docs.limit(0), labels).count() == 0


def test_top_with_ties(spark, tmp_path):
    for values in ([1.0] * 50, [float(k % 3) for k in range(50)], [float(k) ** 5 for k in range(50)]):
        rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "doc_id long, v double")
        for k in (0, 1, 17, 50):
            got = {r.doc_id for r in importance.top(rows, "v", k, str(tmp_path)).where("kept").collect()}
            assert got == {i for i, _ in sorted(enumerate(values), key=lambda x: (-x[1], x[0]))[:k]}


def brute_prints(texts):
    """Fingerprints by whole numbers, word by word, from document frequencies counted here."""
    mask, mix = (1 << 64) - 1, (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
    terms = lambda t: {xxhash.xxh3_64_intdigest(b) or 1 for w in t.split() if (b := w.strip(string.punctuation).lower())}
    df = Counter(h for t in texts for h in terms(t))
    band = {h for h, n in df.items() if 3.0 <= math.log(len(texts) / n) <= 10.0}

    def member(h, density, k):
        x = ((h ^ xxhash.xxh3_64_intdigest(f"{density}/{k}")) * mix[0]) & mask
        return (((x ^ (x >> 32)) * mix[1]) & mask) >> (64 - 2 * density) == 0

    def one(text):
        found = sorted(terms(text) & band or terms(text))
        lists = [found] + [[h for h in found if member(h, d, k)] for d in range(1, 6) for k in range(10)]
        return [(xxhash.xxh32_intdigest(b"".join(h.to_bytes(8, "little") for h in x)) | 1) if x else 0 for x in lists]

    return one


def brute_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    shares = []
    for d in range(5):
        pairs = list(zip(a[1 + 10 * d : 11 + 10 * d], b[1 + 10 * d : 11 + 10 * d], strict=True))
        shares.append(sum(x == y != 0 for x, y in pairs) / max(6, sum(x != 0 or y != 0 for x, y in pairs)))
    return max(shares)


def test_fingerprints(spark, world):
    rows, docs, _ = world
    rows = [(i, t) for i, t, *_ in rows] + ODD
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    got = fingerprints.compare(docs).collect()
    assert len(got) == len(rows)
    one, want = brute_prints([t or "" for _, t in rows]), []
    spelled = lambda x: b"".join(h.to_bytes(4, "big") for h in x).hex()
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        e = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        a, b, c = map(one, (t, e, u))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), spelled(a), spelled(b), brute_likeness(a, b), brute_likeness(a, c)))
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    prints = {}
    for (_, t), w in zip(order, want, strict=True):
        assert prints.setdefault(t or "", w[3]) == w[3]
    rng = random.Random(4)
    prose = spark.createDataFrame([(k, " ".join(f"u{rng.randrange(30_000)}" for _ in range(rng.choice([20, 100, 600])))) for k in range(200)], "doc_id long, text string")
    usual = fingerprints.compare(prose).collect()
    assert np.mean([r.near_edited for r in usual]) > 0.35 and np.mean([r.near_next for r in usual]) < 0.05
    assert fingerprints.compare(docs.limit(0)).count() == 0
    alone = fingerprints.compare(docs.where("doc_id = 7")).first()
    assert alone.near_next == 1.0


def test_band_of_the_lexicon(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(k, "common " + ("often " if k % 10 == 0 else "") + f"rare{k} twice{k // 2}") for k in range(400)], "doc_id long, text string")
    found = fingerprints.lexicon(docs, (1.0, math.log(400 / 1.5)))
    found.write.parquet(f"{tmp_path}/lexicon")
    stored = spark.read.parquet(f"{tmp_path}/lexicon")
    want = sorted(map(fingerprints.term, ["often", *(f"twice{k}" for k in range(200))]))
    assert fingerprints.shared(spark, stored)().tolist() == want
    monkeypatch.setattr(fingerprints, "LEXICON", 10)
    assert fingerprints.shared(spark, stored)().tolist() == want


def test_fingerprints_of_rows_without_an_id(spark):
    """Rows of one id, or without any, spread over the ranges, and each is followed by one of them."""
    rows = [(None, f"word{k} and others {k * k}") for k in range(300)] + [(7, f"seven {k}") for k in range(100)]
    got = fingerprints.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.doc_id for r in got) == {None: 300, 7: 100} and Counter(r.n_chars for r in got) == Counter(len(t) for _, t in rows)
    texts = {t for _, t in rows}
    follow = [hashlib.sha256((t[: len(t) - len(t) // 4] + u[: len(t) // 4]).encode()).hexdigest() for t in texts for u in texts]
    assert {r.edited_sha256 for r in got} <= set(follow)


def test_queries_hold_nothing_out(spark, tmp_path):
    held = next(k for k in range(1, 100) if zlib.crc32(str(k).encode()) % 5 == 0)
    spark.createDataFrame([(held, "fine prose"), (0, "other words here")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(held, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    losses = {r.doc_id: r.ce_difference for r in queries.QUERIES["op6_lm_scoring"](spark, str(tmp_path)).collect()}
    weights = {r.doc_id: r.log_weight for r in queries.QUERIES["op7_importance_resampling"](spark, str(tmp_path)).collect()}
    assert losses[held] < losses[0] and weights[held] > weights[0]
    docs, labels = (spark.read.parquet(f"{tmp_path}/{name}.parquet") for name in ("documents", "labels"))
    assert {r.log_weight for r in importance.resample(docs, labels).collect()} == {0.0}


def test_importance_by_brute_force(spark):
    """Weights from counts made here, noise from the digest, and the largest sums kept; equal rows and rows without an id too."""
    rng = random.Random(12)
    rows = [(k, " ".join(rng.choice(["a", "b", "c", "dd", "ee"][: 2 + k % 4]) for _ in range(rng.randint(0, 9)))) for k in range(60)] + [(None, "a b")] * 3 + [(7, "a a")] * 2
    good = {k for k in range(0, 60, 3)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = importance.resample(docs, spark.createDataFrame([(k, 1, 0) for k in good], "doc_id long, quality int, toxic int"), 0.5, hold_out=False).collect()
    mask = (1 << 64) - 1

    def grams(text):
        h = [xxhash.xxh3_64_intdigest(w) for w in text.split()]
        pairs = [((a * 0x9E3779B97F4A7C15) & mask) ^ b for a, b in zip(h, h[1:], strict=False)]
        pairs = [((x ^ (x >> 31)) * 0xD6E8FEB86659FD93) & mask for x in pairs]
        return [x % 10_000 for x in h + [x ^ (x >> 32) for x in pairs]]

    raw, target = Counter(g for _, t in rows for g in grams(t)), Counter(g for i, t in rows if i in good for g in grams(t))
    ratio = lambda g: math.log((target[g] + 1) / (target.total() + 10_000)) - math.log((raw[g] + 1) / (raw.total() + 10_000))
    seen, want = Counter(), []
    for i, t in rows:
        digest = hashlib.md5(t.encode()).hexdigest()[:12]
        name = f"{'' if i is None else i}:{digest}:{seen[i, t]}:gumbel"
        seen[i, t] += 1
        u = (int(hashlib.md5(name.encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        weight = sum(map(ratio, grams(t)))
        want.append((i, round(weight, 9), round(weight - math.log(-math.log(u)), 9)))
    kept = sorted(want, key=lambda r: -r[2])[: math.ceil(len(rows) / 2)]
    assert sorted([(r.doc_id, round(r.log_weight, 9), round(r.gumbel_score, 9)) for r in got], key=str) == sorted(want, key=str)
    assert sorted([(r.doc_id, round(r.gumbel_score, 9)) for r in got if r.kept], key=str) == sorted([(i, s) for i, _, s in kept], key=str)


def test_importance_weight_is_the_ratio_of_the_models(spark):
    rows = [(1, "a b c"), (2, "d e"), (3, "a b " * 40), (4, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    ratio = importance.ratios(docs, labels, hold_out=False)
    got = {r.doc_id: r.log_weight for r in importance.resample(docs, labels, hold_out=False).collect()}
    assert any(ratio) and all(abs(got[i] - sum(ratio[g] for g in importance.grams(t))) < 1e-9 for i, t in rows)
