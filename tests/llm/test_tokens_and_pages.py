"""Token files by exact round trips, page extraction by cases and by brute-force cuts."""

import itertools
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tideline.llm import html_extract, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello, world! It's don't DON'T 12a3", None, "", "   ", "é É ﬁ Ǆ ΑΣ İ 漢字 á ́b", "<|endoftext|> a<|endoftext|>b", "x\x1cy\x1f z", "tab\tnew\nline\xa0nbsp　wide", "''s 's' ll 'll", "|pipe|a|b| {}[]~^", "word " * 20_000, "🙂🙃 mixed🙂word"]


def test_by_word_equals_the_library(spark):
    encode = token_files.Encoder(PATH, True)
    for t in TEXTS:
        assert encode(t or "") == encode.whole(t or "")


@pytest.mark.parametrize("by_word", [True, False])
def test_round_trip(spark, tmp_path, monkeypatch, by_word):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "SEGMENT_IDS", 50)
    rows = [(k * 3 % 97, t) for k, t in enumerate(TEXTS * 4)] + [(None, "none"), (5, "same"), (5, "same")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, part int").repartition(3)
    table = token_files.write(docs, f"file://{tmp_path}/t", PATH, 1, by_word)
    got = [tuple(r) for r in token_files.read(table).collect()]
    t, at, want = Tokenizer.from_file(PATH), 0, []
    hashes = dict(docs.select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect())
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1] or ""])):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)
    (tmp_path / "files").mkdir()
    n = token_files.export(table, str(tmp_path / "files"))
    files = sorted((tmp_path / "files").iterdir())
    assert n == len(files) == table.count()
    assert sum(token_files.Segment(f.read_bytes()).n for f in files) == len(rows)


def test_many_rows_of_one_id_spread(spark, tmp_path):
    docs = spark.createDataFrame([(None, f"text {k}") for k in range(4000)], "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join so small ranges
    try:
        table = token_files.write(docs, f"file://{tmp_path}/n", PATH, 1, True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert table.agg(F.max("n_docs")).first()[0] < 2500 and token_files.read(table).where("doc_id is null").count() == 4000


def test_tokenizers_that_join_words_are_refused(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.BPE({chr(k): k - 32 for k in range(32, 127)}, []))
    t.pre_tokenizer = pre_tokenizers.Split(" ", "isolated")
    t.save(f"{tmp_path}/t.json")
    with pytest.raises(ValueError):
        token_files.Encoder(f"{tmp_path}/t.json", True)
    assert token_files.Encoder(f"{tmp_path}/t.json", False)("a b")


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read(token_files.write(docs, f"file://{tmp_path}/e", PATH, 1, True)).count() == 0


def test_elias_fano_selects():
    rng = random.Random(2)
    for n, most in ((1, 1), (3, 5), (200, 300), (500, 100_000), (64, 1), (1000, 9)):
        packed = [bytes(2 * rng.randint(0, most)) for _ in range(n)]
        data = token_files.segment_bytes(list(range(n)), packed, 2)
        s = token_files.Segment(data)
        ends = np.cumsum([len(p) // 2 for p in packed])
        assert ends.tolist() == [s.end(k) for k in range(n)] and [s.doc_id(k) for k in range(n)] == list(range(n))
        bits = 8 * (len(s.ends.lows) + len(s.ends.highs))
        assert bits <= n * (2 + max(0, np.log2(max(1, ends[-1] / n)) + 1)) + 24
        assert [len(s.document(k)) * 2 for k in range(n)] == [len(p) for p in packed]
    for names in ([-(2**63), -(2**63), -5, 0, 3, 2**63 - 1], [7], [5] * 200, list(range(-(2**40), 2**40, 2**33))):
        s = token_files.Segment(token_files.segment_bytes(names, [b"ab"] * len(names), 2))
        assert [s.doc_id(k) for k in range(len(names))] == names
    assert token_files.Segment(token_files.segment_bytes([], [], 2)).n == 0
    with pytest.raises(ValueError):
        token_files.Segment(data[:-1])
    with pytest.raises(ValueError):
        token_files.Segment(b"XXXX" + data[4:])


ODDS = html_extract.log_odds(html_extract.priors())
CASES = [
    (None, ""), ("", ""), ("<p>a<p>b", "a\nb"), ("<script>if (a<b) x</script><article>t</article>", "t"),
    ("<article><h1>T</h1><p><b>x<br><p>y</article><footer>f", "T\nx\ny"),
    ("<article>a&amp;b &eacute; &#233; &#xe9; &am &nosuch; &lt;p&gt;</article>", "a&b é é é &am &nosuch; <p>"),
    ("<article>\n a \t b\n<!-- c --> d<span> e</span>f </article>", "a b d ef"),
    ("<nav><a href=1>n</a></nav><header>site</header><main><header><h1>H</h1></header><p>m</p><aside>s</aside><form><p>f</p></form></main>", "H\nm"),
    ("<article><p>one</p><div class='ad-box'>buy</div><p>two</p><section id=comments><h2>Comments</h2><p>first!</p></section></article>", "one\ntwo"),
    ("<div class=cookie-notice>we use cookies</div><article class='post'><ul><li>1<li>2</ul><table><tr><td>3<td>4</table></article>", "1\n2\n3\n4"),
    ("<article><p title='a>b'>q</p><style>p{}</style><p>r</p></article><div class=sidebar><p>A long text that is no part of the article itself.</p></div>", "q\nr"),
    ("<body><div id=top class=header><a href=x>Home</a></div><div class=content><h2>Title</h2><p>Words of the story, which goes on for a while, as stories do.</p><p>Of.</p></div><div id=footer>2020</div>", "Title\nWords of the story, which goes on for a while, as stories do.\nOf."),
    ("<article><p>x</p><article class=comment><p>c</p></article></article>", "x"), ("<article>a</div></span>b<svg><text>no</text></svg></article>", "ab"),
    ("<article><p>Text here that is long. <span class='advert'>Buy now</span>and more of it.</p></article>", "Text here that is long. and more of it."),
    ("<article><p>Some words of a text.</p><a class='share'>Share this</a><label hidden>h</label></article>", "Some words of a text."),
    ("<article><p>Words of it.</p><button>Share</button></article>", "Words of it."),
    ("<article><div class='related-work'><p>Earlier work on this has shown that the matter is far from simple, as we said before.</p></div><p class='search-results'>The search gave results that none of the authors had expected.</p></article>", "Earlier work on this has shown that the matter is far from simple, as we said before.\nThe search gave results that none of the authors had expected."),
    ("<article>a<b>b<p>c</b>d</article>", "ab\ncd"), ("<article><p>x < y and a<3 b</p></article>", "x < y and a<3 b"), ("<article>a</p>b<svg><svg>x</svg></article>", "a\nb"),
    ("<form><article><p>Body of a page that one form holds whole.</p></article><p>Field</p></form>", "Body of a page that one form holds whole."),
    ("<article><p>a</p><table><tr><td>b</div>c</td></table><p>d</article>", "a\nbc\nd"), ("<article><p>kept <a title='x", "kept"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_pages(page, text):
    assert html_extract.extract(page, ODDS) == text


@pytest.mark.parametrize("part", ['<a x="', "<a x=\"'", "<a ", "<div>x", "</b>x", "<svg>x", "<!--x", "<", "<li>x", "<ul><li>x", "<iframe>", "<table><tr><td>x", "<p>x</p><nav>y</nav>", "<span class=ad>x</span>y"])
def test_time_is_linear(part):
    """Eight times the page takes about eight times as long, not 64."""

    def seconds(n):
        best = 1e9
        for _ in range(2):
            began = time.perf_counter()
            html_extract.extract("<p>" + part * n, ODDS)
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(16_000) < 24 * max(seconds(2000), 0.002)


def test_labels_by_tag_teach_blocks_without_any(spark):
    """Trained on tags alone, the blocks of held-out pages whose tags are taken away are told apart."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."

    def page(menu, main):
        links = "".join(f"<li><a href=x>{rng.choice(words)}</a></li>" for _ in range(rng.randint(3, 8)))
        body = "".join(f"<p>{prose(rng.randint(8, 60))}</p>" for _ in range(rng.randint(2, 7)))
        return f"<{menu}><ul>{links}</ul></{menu}><{main}><h1>{prose(4)}</h1>{body}</{main}><{menu}><p>&copy; {rng.choice(words)}</p></{menu}>"

    odds = html_extract.train(spark.createDataFrame([(page("nav", "article"),) for _ in range(60)], "html string"))
    right = kept = true = 0
    for _ in range(40):
        read = html_extract.Page(page("div", "section"))
        for block, content in zip(read.found, html_extract.labelled(read, odds), strict=True):
            is_true = block.tag in ("p", "h1") and "©" not in block.text
            right, kept, true = right + (content and is_true), kept + content, true + is_true
    assert right / kept > 0.97 and right / true > 0.9


def test_many_pages(spark):
    rows = [(k, f"u{k}", p, "x", 1) for k, (p, _) in enumerate(CASES)] + [(None, None, "<article>z</article>", "x", 1)] * 2 + [(99, "u", "<article>" + "<p>word" * 20_000 + "</article>", "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.extract_all(pages).collect()
    odds = html_extract.train(pages)
    want = [(i, html_extract.extract(p, odds)) for i, _, p, *_ in rows]
    assert sorted(((r.page_id, r.text) for r in got), key=str) == sorted(want, key=str)
    assert want[-3:] == [(None, "z")] * 2 + [(99, "\n".join(["word"] * 20_000))]
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract_all(pages.limit(0)).count() == 0


def test_cut_is_cheapest():
    rng = random.Random(7)
    for _ in range(60):
        n = rng.randint(1, 9)
        gains = [rng.choice([-3.0, -1.0, 0.0, 0.5, 2.0, rng.uniform(-2, 2)]) for _ in range(n)]
        ties = [(a, b, rng.choice([0.5, 1.0, 2.0])) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.4]

        def cost(labels, gains=gains, ties=ties):
            return sum(-g if not x and g > 0 else 0 for g, x in zip(gains, labels, strict=True)) * -1 + sum(-g for g, x in zip(gains, labels, strict=True) if x and g < 0) + sum(c for a, b, c in ties if labels[a] != labels[b])

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(html_extract.content_side(gains, ties)) - best) < 1e-9


def test_trained_classifier_separates(spark):
    page = "<nav>" + "<li><a href=1>Home page</a></li>" * 5 + "</nav><article>" + "<p>Quite a long sentence of the article, with words enough to be told from others by any means.</p>" * 5 + "</article>"
    odds = html_extract.train(spark.createDataFrame([(page,)], "html string"))
    plain = "<div><div><a href=1>Home page</a></div><div><a href=1>Other page</a></div></div><div><p>Quite a long sentence of the article, with words enough to be told from others by any means.</p></div>"
    assert html_extract.extract(plain, odds).startswith("Quite") and "Home" not in html_extract.extract(plain, odds)
