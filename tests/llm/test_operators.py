"""Operators of the llm subpackage against plain versions, and their edge cases."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenplan.llm import bpe, decontam, graph, hot, html_text, near_copies, pii, quality, queries, scratch, shards, simhash, token_files, urls, vector_dedup

SF = "/root/testdata/sf0.001"
PATH = queries.vocabulary_path()
EDGE = [
    (1, None), (2, ""), (3, "   "), (4, "same text here"), (4, "same text here"), (5, "same text here"), (None, "no number"), (6, "word " * 3000),
    (7, "<|endoftext|> a  b\n\n c's é漢😀"), (8, "mail a@b.cd and +1 (269) 555-3296 4524132264652876 or 300.1.2.3"),
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with results."""
    rows = [(i, t, "x", 1.0, 5) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, score double, shard int")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(tokenizer):
    v = bpe.Vocabulary(bpe.read_vocabulary(PATH))
    random.seed(4)
    parts = ["a", "b", " ", "  ", "\n", "\t", "the", "ing", "'s", "'", "é", "漢", "\xa0", "\x1c", "1", "²", "!", "...", "<|endoftext|>", "😀", "tion", "\r\n"]
    for _ in range(3000):
        t = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        got = v.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == ids_of(tokenizer, t)
        assert v.decode(got) == t.encode()
    long = "".join(random.choice("abcdefghij") for _ in range(30000))
    assert np.frombuffer(v.encode(long), "<u4").tolist() == ids_of(tokenizer, long)


def check_round_trip(rows, texts, tokenizer):
    found = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)
    expected = []
    for i, t in texts:
        ids = np.array(ids_of(tokenizer, t), "<u4").tobytes()
        expected.append((i or -1, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert found == sorted(expected)


def test_bpe(spark, documents, edge, tokenizer):
    check_round_trip(bpe.round_trip(documents, PATH).collect(), [(r.doc_id, r.text) for r in documents.collect()], tokenizer)
    check_round_trip(bpe.round_trip(edge, PATH).collect(), EDGE, tokenizer)
    assert bpe.round_trip(edge.limit(0), PATH).count() == 0
    both = bpe.decode(bpe.encode(edge, PATH), PATH).where("doc_id = 7").first()
    assert both.decoded == both.text


def plain_base(text):
    def luhn(x):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(x))) % 10 == 0

    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    out = []
    for k, (name, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text or ""):
            g, digits = m.group(), re.sub("[^0-9]", "", m.group())
            ok = True if k == 0 else all(int(p) <= 255 for p in g.split(".")) if k == 1 else 12 <= len(digits) <= 19 and luhn(digits) if k == 2 else 9 <= len(digits) <= 15
            if ok:
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_pii(spark, documents, edge):
    for df in (documents, edge):
        texts = [(r.doc_id, r.text) for r in df.collect()]
        expected = sorted(hashlib.sha256(",".join(plain_base(t)).encode()).hexdigest() for _, t in texts)
        rows = pii.report(df).collect()
        assert sorted(r.base_sha256 for r in rows) == expected
    tricky = ["a@b.cd_e@f.gh", "x" * 5000 + "@", "1.2.3.4.5.6.7.8", "1 " * 9000, "+1+1+1234567890", "a@b.c.", "٣@x.y", "0012.1.2.3 256.1.1.1", "10.0.0.1 000.00.0.255 0.0.0.256"]
    df = spark.createDataFrame(list(enumerate(tricky)), "doc_id long, text string")
    for r in pii.report(df).collect():
        assert r.base_sha256 == hashlib.sha256(",".join(plain_base(tricky[r.doc_id])).encode()).hexdigest()
        assert set(plain_base(tricky[r.doc_id])) <= set(r.spans.split(",")) | {""}
    assert pii.report(edge.limit(0)).count() == 0
    clean = pii.redact(df.union(spark.createDataFrame([(99, "to a@b.cd, 10.0.0.1")], df.schema))).where("doc_id = 99").first()
    assert clean.text == "to [EMAIL], [IP]"


def test_columns_of_working_names_stay(spark):
    rows = [(k, t, "s", "b", "r", 9, 1.5) for k, t in [(1, "write to a@b.cd now"), (2, None), (3, ""), (1, "write to a@b.cd now")]]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, base string, _row string, n_chars long, _score double")
    redacted = sorted(map(tuple, pii.redact(df).collect()), key=str)
    clean = (1, "write to [EMAIL] now", "s", "b", "r", 20, 1.5)
    assert redacted == sorted([clean, clean, (2, None, "s", "b", "r", 9, 1.5), (3, "", "s", "b", "r", 9, 1.5)], key=str)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert sorted(map(tuple, quality.keep_good(df, labels).collect()), key=str) == sorted(rows, key=str)


def test_urls(spark):
    rows = [(1, "HTTP://A.Example.NET/en/x?y#z"), (2, None), (3, "foo"), (4, "http://net"), (5, "http://net/"), (6, "http://orgx/fr/"), (6, "http://orgx/fr/"), (7, "http://a.org/fr/b")]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "") for r in urls.judge(df).collect())
    assert got == [(1, "a.example.net", "/en/x", "example.net/en/"), (2, "", "", ""), (3, "", "", ""), (4, "net", "", ""), (5, "net", "/", "net/"), (6, "orgx", "/fr/", ""), (6, "orgx", "/fr/", ""), (7, "a.org", "/fr/b", "org/fr/")]
    assert urls.judge(df.limit(0)).count() == 0


def test_urls_learn(spark):
    rows = [(k, f"https://good{k % 40}.garden.org/fr/{k}") for k in range(300)] + [(k, f"https://w{k % 40}.casino.net/x/{k}") for k in range(300, 600)]
    rows += [(k, f"https://good{k % 40}.garden.com/xx/{k}") for k in range(600, 700)] + [(k, f"https://w{k % 40}.casino.com/xx/{k}") for k in range(700, 800)]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    right = sum(got[k] == "allow" for k in range(600, 700)) + sum(got[k] == "block" for k in range(700, 800))
    assert right >= 190


def test_html(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_text.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        parts = [" ".join(__import__("html").unescape(re.sub("<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)
    p = "This is a fairly long paragraph of an article with more than twenty words in it so that it looks like running text to any reader."
    page = f"<header><h1>Site</h1></header><main><h1>A &lt;b&gt;</h1><p>{p}<p>Hi.<aside>{p}</aside><p>A&nbsp;b<br>c</p><section class='comments'><p>{p}</section><form><p>Mail</form></main><div>{p}</div>"
    assert html_text.main_text(page) == f"A <b>\n{p}\nHi.\nA b c"
    for odd in (None, "", "<!-- ", "<script>x", "< <<", "<p", "<a href='", "&amp;" * 10):
        html_text.main_text(odd)
    df = spark.createDataFrame([(1, None, None, "t"), (1, "u", "<article><p>x</article>", "t")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in html_text.extract(df).collect()) == ["", "x"]


WORDS60 = " ".join(["word"] * 60)


@pytest.mark.parametrize("name", ["article-sidebar", "post-footer", "entry-comments", "content-ad", "story-comments", "page-menu", "main-nav"])
def test_html_surroundings_inside_an_article(name):
    p = WORDS60
    assert html_text.main_text(f"<article><h1>T</h1><p>{p}</p><div class='{name}'><p>{p}</p></div><p>b</p></article>") == f"T\n{p}\nb"
    assert html_text.main_text(f"<div class='story'><p>{p}</p></div><div class='{name}'><p>{p}</p></div>") == p


def test_html_pages_without_an_article():
    p = WORDS60
    menu = "<ul><li><a href=/>Home</a></li><li><a>About us</a></li><li><a>More news</a></li></ul>"
    pages = {
        f"<p>{p}</p><ul><li><a href=x>next page</a></li></ul>": p,
        f"<h1>Short title</h1><p>Yes.</p><p>{p}</p>": f"Short title\nYes.\n{p}",
        f"{menu}<p>{p}</p>{menu}": p,
        f"<body class='page has-sidebar sidebar-left'><div class='content with-sidebar'><p>{p}</p></div></body>": p,
        f"<p class=ad>{p}<p>{p} b": f"{p} b",
        "a < b <3 &lt;x&gt; c": "a < b <3 <x> c",
        "<p title=\"x>y\">One</p>": "One",
        menu: "",
        "  \n ": "",
    }
    for page, text in pages.items():
        assert html_text.main_text(page) == text


@pytest.mark.parametrize("opening", [
    "<article class='post comments-off'>", "<article class='type-post tag-search'>", "<article class='has-header-image comment-open'>", "<main class='notice-board'>", "<div class='legal-text'>",
    "<div class='search-result'><article>", "<div id=pageHeader2><main role=main>", "<div class='shareholder-letter'>", "<div class=headline>",
])
def test_html_names_that_tell_of_other_things(opening):
    assert html_text.main_text(f"<nav><a href=x>Home</a></nav>{opening}<p>{WORDS60}</p>") == WORDS60


@pytest.mark.parametrize("name", ["userComments", "commentlist", "adbox", "cookiebar", "adBox", "searchBox", "footerLinks", "topbar", "notice", "site-footer", "comment"])
def test_html_marks_in_other_spellings(name):
    p = WORDS60
    assert html_text.main_text(f"<article><p>{p}</p><div class='{name}'><p>{p}</p></div></article>") == p
    assert html_text.main_text(f"<article><p>{p}</p><div class='comments'><article class='{name}'><p>{p}</p></article></div></article>") == p


def test_html_headlines_links_and_short_paragraphs():
    p = WORDS60
    teaser = f"<a href=x><div>{p}</div><div>and more of it</div></a>"
    pages = {
        f"<article><header><h1>The Title</h1><p>By Someone</p></header><p>{p}</p></article>": f"The Title\n{p}",
        f"<header><h1>Site</h1></header><article><p>{p}</p></article>": p,
        f"<h1>T</h1><p>{p}</p><p>short bit</p><p>He left.</p><ul><li><a href=x>More</a></li></ul>": f"T\n{p}\nshort bit\nHe left.",
        f"<p>{p}</p>{teaser}{teaser}": p,
        f"<p><a href=x>never closed</p><p>{p}</p>": f"{p}",
        f"<a name=top><p>{p}</p><p>{p} b</p>": f"{p}\n{p} b",
        f"<ul><li><a href=x>One<li><a href=y>Two</ul><p>{p}</p>": p,
    }
    for page, text in pages.items():
        assert html_text.main_text(page) == text, page


def plain_page(rng):
    """A random well-formed page, and its blocks as (text, words, linked words, place)."""
    words, out = iter(range(10**6)), []

    def text():
        return " ".join(f"w{next(words)}" for _ in range(rng.choice([1, 3, 8, 30, 70])))

    def blocks_of(depth, place):
        parts = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice(["p", "p", "p", "h2", "link", "div", "nav", "ad", "article", "comments"])
            if kind in ("p", "h2"):
                t, link = text(), text() if rng.random() < 0.3 else ""
                parts.append(f"<{kind}>{t} <a href='/x'>{link}</a></{kind}>")
                out.append((f"{t} {link}".strip(), len(t.split()) + len(link.split()), len(link.split()), place, kind == "h2"))
            elif kind == "link":
                t = text()
                parts.append(f"<ul><li><a href='/y'>{t}</a></li></ul>")
                out.append((t, len(t.split()), len(t.split()), place, False))
            elif depth:
                tag, name, inner = {"div": ("div", "box", place), "nav": ("nav", "", -1), "ad": ("div", "ad", -1), "article": ("article", "post", place if place < 0 else 1), "comments": ("section", "comments", -1)}[kind]
                parts.append(f"<{tag} class='{name}'>{blocks_of(depth - 1, inner)}</{tag}>")
        return "".join(parts)

    return f"<html><body>{blocks_of(3, 0)}</body></html>", out


def test_html_equals_a_plain_reader():
    rng = random.Random(12)
    for _ in range(200):
        page, expected = plain_page(rng)
        got = html_text.blocks(page)
        assert [(b.text, b.words, b.linked, b.place, b.heading) for b in got] == expected
        kept = []
        article = any(b[3] > 0 for b in expected)
        for k, (text, words, linked, place, heading) in enumerate(expected):
            near = [expected[j] if 0 <= j < len(expected) else ("", 0, 0) for j in (k - 1, k + 1)]
            values = [words, linked / words, near[0][1], near[0][2] / max(1, near[0][1]), near[1][1], near[1][2] / max(1, near[1][1]), place, heading, article]
            node = html_text.tree()
            while not isinstance(node, bool):
                node = node[2] if values[node[0]] <= node[1] else node[3]
            kept += [text] * node
        assert html_text.main_text(page) == "\n".join(kept)


def test_html_query(spark):
    rows = queries.op4_html(spark, SF).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages) and all(r.text == html_text.main_text(pages[r.page_id].html) and r.url == pages[r.page_id].url and r.n_chars == len(r.text) for r in rows)


@pytest.mark.parametrize("page", ["<a '" * 1_300_000, "<div>" * 500_000 + "</section>" * 250_000, "<svg>" + "</svg " * 800_000, "<a x='>'" * 600_000, "<" * 5_000_000, "<video>" * 700_000])
def test_html_is_linear(page):
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 15


def test_html_tree_uses_its_features():
    x, y = html_text.labelled()
    used = set()

    def walk(node, rows):
        if not isinstance(node, tuple):
            return np.full(len(rows), float(node))
        used.add(html_text.FEATURES[node[0]])
        return np.where(rows[:, node[0]] <= node[1], walk(node[2], rows), walk(node[3], rows))

    assert (walk(html_text.tree(), x) == y).mean() > 0.97
    assert "density" in used and {"density_before", "density_after"} & used and {"words_before", "words_after"} & used
    article = "<article><h1>Title</h1><p><a href=x>A link</a></p><p>Yes.</p><p><a href=y>See this</a></p></article>"
    assert html_text.main_text(article) == "Title\nA link\nYes.\nSee this"


def test_html_tables(spark):
    rows = [(k % 3, "u", f"<article><p>{WORDS60} {k % 3}</p></article>" * (1 if k else 20_000), "t") for k in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.n_chars) for r in html_text.extract(df).collect())
    one = len(WORDS60) + 2
    assert got == sorted([(0, 20_000 * (one + 1) - 1), (0, one), (1, one), (1, one), (2, one), (2, one)])
    assert html_text.extract(df.limit(0)).count() == 0


def test_quality(spark):
    docs, labels = (queries.read(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    rows = quality.judge(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.9
    assert np.mean([r.predicted for r in rows if r.quality == 1]) >= 0.97


def test_quality_edges(edge, spark):
    labels = spark.createDataFrame([(1, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judge(edge, labels).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    none = quality.judge(edge, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.judge(edge.limit(0), labels).count() == 0


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    random.seed(1)
    pairs = [(random.randrange(80), random.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 160)]
    df = spark.createDataFrame(pairs + [(None, 3)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(df, "a", "b").collect()}
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    assert got == plain_components([p for p in pairs if p[0] != p[1]], nodes)


@pytest.mark.parametrize("hub", [0, 200_000])
def test_components_of_a_hub(spark, monkeypatch, hub):
    """One node with 100 000 edges, the smallest or the largest of all; its edges don't meet in one task."""
    monkeypatch.setattr(hot, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(graph, "BROADCAST_KEYS", 0)
    edges = spark.range(1, 100_001).select(F.col("id").alias("a"), F.lit(hub).alias("b"))
    rows = graph.connected_components(edges, "a", "b").agg(F.count("*"), F.min("component"), F.max("component")).first()
    assert tuple(rows) == (100_001, min(hub, 1), min(hub, 1))


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_join_of_hot_keys(spark, monkeypatch, broadcast):
    monkeypatch.setattr(hot, "BROADCAST_KEYS", broadcast)
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, None).otherwise(F.col("id")).alias("key"))
    keys = rows.groupBy("key").agg(F.max("id").alias("top"), F.count("*").alias("n"))
    got = sorted(map(tuple, hot.join_keys(rows, keys, "key", 5000).select("id", "key", "top").collect()))
    expected = sorted((k, 7 if k % 3 == 0 else k, 4998 if k % 3 == 0 or k == 7 else k) for k in range(5000) if k % 3 == 0 or k % 100 != 1)
    assert got == expected
    least = hot.add_least(rows, "key", "id", "least", 5000).where("key = 7").agg(F.min("least"), F.max("least")).first()
    assert tuple(least) == (0, 0)


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_unfinished_components_raise(spark, monkeypatch):
    monkeypatch.setattr(graph, "MAX_ROUNDS", 1)
    chain = spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long")
    with pytest.raises(RuntimeError):
        graph.connected_components(chain, "a", "b")
    assert graph.connected_components(chain.limit(0), "a", "b").count() == 0


def test_simhash(documents, edge):
    texts = {r.doc_id: r.text for r in documents.collect()}
    f = {i: plain_fingerprint(t) for i, t in texts.items()}
    near = [(a, b) for a in f for b in f if a < b and (f[a] ^ f[b]).bit_count() <= 2]
    expected = plain_components(near, f)
    for r in simhash.group(documents).collect():
        assert (int(r.fingerprint, 16), r.component_id) == (f[r.doc_id], expected[r.doc_id])
    got = simhash.group(edge.where("doc_id is not null")).collect()
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    assert simhash.group(edge.limit(0)).count() == 0
    # a doc_id with two different texts does not link them
    both = edge.sparkSession.createDataFrame([(7, "one text of its own"), (7, "quite another text here"), (3, "quite another text here"), (None, "quite another text here")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.component_id) for r in simhash.group(both).collect()) == [("3", 3), ("7", 3), ("7", 7), ("None", 3)]


def test_simhash_hot_blocks(spark):
    # more fingerprints than PAIRED share blocks: flipped bits must find the same links as all pairs
    random.seed(2)
    base = random.getrandbits(64)
    fps = sorted({base ^ sum(1 << random.randrange(64) for _ in range(random.randint(0, 3))) for _ in range(300)} | {random.getrandbits(64) for _ in range(50)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    rows = simhash.links(spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, node long")).collect()
    near = [(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 2]
    assert plain_components([(r.left, r.right) for r in rows], range(len(fps))) == plain_components(near, range(len(fps)))


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_copies(spark, edge):
    random.seed(12)
    vocabulary = ["".join(random.choices("abcdefghijklmnop", k=random.randint(2, 9))) for _ in range(2000)]
    texts = []
    for _ in range(60):
        words = random.choices(vocabulary, k=random.randint(60, 400))
        texts.append(" ".join(words))
        for _ in range(random.randint(0, 3)):
            edited = list(words)
            for _ in range(max(1, len(words) // random.choice([60, 120, 250]))):
                edited[random.randrange(len(edited))] = random.choice(vocabulary)
            texts.append(" ".join(edited))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_copies.group(df).collect()}
    sets = [shingles(t) for t in texts]
    close = apart = 0
    for a in range(len(texts)):
        for b in range(a):
            similarity = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            close += similarity >= 0.8
            apart += similarity >= 0.8 and found[a] != found[b]
            if found[a] == found[b]:
                assert similarity > 0.3
    assert close > 40 and apart <= close // 50
    got = near_copies.group(edge).collect()
    assert len(got) == len(EDGE)
    groups = {r.doc_id: r.component_id for r in got}
    assert (groups[1], groups[2], groups[3], groups[4], groups[5]) == (1, 1, 1, 4, 4)
    kept = near_copies.keep_first(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "6", "7", "8", "None"]
    assert near_copies.group(edge.limit(0)).count() == 0
    assert near_copies.keep_first(edge.limit(0)).count() == 0


def test_near_copies_of_one_number(spark):
    """Rows of one doc_id with different texts are different documents; equal rows are one."""
    one, two, three = ("some words of a first text that is here", "other words of a second text that is there", "the third text has words of its own as well")
    rows = [(7, one, 1), (7, two, 2), (7, two, 3), (3, two, 4), (9, three, 5), (9, three, 5), (None, three, 6), (5, one, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash long")
    assert sorted((str(r.doc_id), r.component_id) for r in near_copies.group(df).collect()) == sorted(
        [("7", 5), ("7", 3), ("7", 3), ("3", 3), ("9", 9), ("9", 9), ("None", 9), ("5", 5)]
    )
    kept = near_copies.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("3", two), ("5", one), ("9", three), ("None", three)])


def test_near_copies_in_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "TILE", 8)
    base = [f"w{k * k % 977}" for k in range(500)]
    rows = [(k, " ".join([*base[:k], "edit", *base[k + 1 :]])) for k in range(100)] + [(100 + k, f"other text number {k} of its own") for k in range(5)]
    groups = {r.doc_id: r.component_id for r in near_copies.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {groups[k] for k in range(100)} == {0}
    assert all(groups[100 + k] == 100 + k for k in range(5))


def test_near_copies_wherever_the_edits_are(spark):
    """Pairs just above the similarity: a replaced run, appended text, a changed last word."""
    rng = random.Random(5)
    word = lambda: f"{rng.choice('bcdfgh')}{rng.randrange(4000)}"
    pairs = []
    for n, kind in [(n, kind) for n in (40, 120, 300) for kind in ("run", "append") for _ in range(50)] + [(n, "last") for n in range(15, 40) for _ in range(4)]:
        words = [word() for _ in range(n)]
        run = max(1, n // 10 - 4)
        edited = {"run": words[:5] + [word() for _ in range(run)] + words[5 + run :], "append": words + [word() for _ in range(n // 5 - 1)], "last": words[:-1] + [word()]}[kind]
        pairs.append((kind, " ".join(words), " ".join(edited)))
    exact = [len(a & b) / len(a | b) for a, b in ((shingles(x), shingles(y)) for _, x, y in pairs)]
    df = spark.createDataFrame([(2 * k + j, p[1 + j]) for k, p in enumerate(pairs) for j in (0, 1)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_copies.group(df).collect()}
    near = [k for k, e in enumerate(exact) if e >= 0.8]
    for kind in ("run", "append", "last"):
        of_kind = [k for k in near if pairs[k][0] == kind]
        assert len(of_kind) > 50
        assert sum(found[2 * k + 1] == 2 * k for k in of_kind) >= 0.98 * len(of_kind)
    assert near_copies.recall() > 0.998


def test_near_copies_are_exact(spark, monkeypatch):
    """Texts a little below the similarity that the filter proposes stay apart, in one tile and in several."""
    base = [f"w{k * k % 977}x{k}" for k in range(104)]
    rows = [(k, " ".join([*(f"a{k}b{j}" for j in range(14)), *base])) for k in range(40)]
    rows += [(100 + k, " ".join([*(f"a{k}b{j}" for j in range(14)), *base[:-4]])) for k in range(20)]
    sets = {k: shingles(t) for k, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(near) == 20 and max(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(40) for b in range(a)) > 0.75
    expected = plain_components(near, sets)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (512, 8):
        monkeypatch.setattr(near_copies, "TILE", tile)
        assert {r.doc_id: r.component_id for r in near_copies.group(df).collect()} == expected


def test_decontamination(spark, edge):
    random.seed(3)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [[random.choice(vocabulary) for _ in range(n)] for n in (18, 40, 60, 7)]
    filler = lambda n: [random.choice(vocabulary) for _ in range(n)]

    def edited(ws, share):
        ws = list(ws)
        for k in random.sample(range(len(ws)), int(len(ws) * share)):
            ws[k] = "changed"
        return ws

    docs, expected = [], set()
    for k, it in enumerate(items):
        for j, (text, leak) in enumerate([(it, True), (edited(it, 0.15), True), (it[:5] + ["put", "in"] + it[5:], True), (it[: len(it) // 3], False), (edited(it, 0.5), False)]):
            docs.append((10 * k + j, " ".join(filler(80) + text + filler(90)).title() + "."))
            if leak:
                expected.add(10 * k + j)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(it)) for k, it in enumerate(items)] + [(9, None), (8, " ".join(items[0]))], "item_id long, text string")
    rows = decontam.report(df, bench).collect()
    assert {r.doc_id for r in rows if r.contaminated} == expected
    assert next(r.n_items for r in rows if r.doc_id == 0) == 2
    assert {r.doc_id for r in decontam.keep_clean(df, bench).collect()} == {d for d, _ in docs} - expected
    assert decontam.report(edge, bench).count() == len(EDGE)
    assert not any(r.contaminated for r in decontam.report(df, bench.limit(0)).collect())
    assert decontam.report(df.limit(0), bench).count() == 0


def test_decontamination_of_repeating_and_short_items(spark):
    filler = " ".join(f"f{k}" for k in range(60))
    letters = "abcdefghijkl"
    items = [list("abcde") * 8, list(letters[:8]) * 12, ["again"] * 20, list("vwxyz"), list("mnopqr"), [f"t{k}" for k in range(10)], ["one"], ["two", "words"]]
    # every accepted number of words changed, where it costs most seeds
    changed = {0: range(2, 40, 5), 1: range(2, 96, 6), 2: [2, 7, 12, 17], 3: [2], 4: [2], 5: [3, 6], 6: [], 7: []}
    docs = []
    for k, it in enumerate(items):
        for j, places in enumerate(([], changed[k])):
            docs.append((10 * k + j, " ".join([filler, *("else" if n in places else w for n, w in enumerate(it)), "f3", filler])))
    docs += [(90, filler), (91, " ".join([filler, "v w else y else", "m n", filler]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(it)) for k, it in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.matches(df, bench).collect()}
    for doc, text in docs:
        ws = decontam.words(text)
        for k, it in enumerate(items):
            numbers = {w: n for n, w in enumerate({*ws, *it})}
            score, same, _ = decontam.align(np.array([numbers[w] for w in it]), np.array([numbers[w] for w in ws]))
            e = decontam.most_edits(len(it), decontam.SIMILARITY)
            assert ((doc, k) in found) == (same >= len(it) - e and score >= len(it) - 2 * e), (doc, k)
    assert {(10 * k + j, k) for k in range(len(items)) for j in (0, 1)} <= found


def test_alignment():
    a = np.array([1, 2, 3, 4, 5, 6])
    assert decontam.align(a, np.array([9, 1, 2, 3, 4, 5, 6, 9]))[:2] == (6, 6)
    assert decontam.align(a, np.array([1, 2, 3, 9, 4, 5, 6]))[:2] == (5, 6)
    assert decontam.align(a, np.array([7, 8]))[:2] == (0, 0)


def test_vectors(spark):
    random = np.random.default_rng(6)
    centres = random.normal(size=(20, 24))
    x = np.concatenate([c + random.normal(size=(n, 24)) * 0.2 for c, n in zip(centres, random.integers(1, 40, 20), strict=True)])
    x = np.concatenate([x, x[:5], 2 * x[5:8]])
    rows = [(int(k), [float(v) for v in row], int(k % 3)) for k, row in enumerate(x)]
    odd = [(1000, None, 1), (1001, [0.0] * 24, 1), (1002, [float("nan")] + [1.0] * 23, 1), (1003, [None] + [1.0] * 23, 1), (1004, rows[0][1], None), (1005, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, vector array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.arange(len(x)) % 3
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    expected = plain_components(list(zip(*np.nonzero(link), strict=True)), range(len(x)))
    got = {r.vec_id: r for r in vector_dedup.deduplicate(df).collect()}
    assert len(got) == len(rows) + len(odd) and link.sum() > 200
    found = sum(got[k].n_links for k in range(len(x)))
    assert 0.9 * link.sum() <= found <= link.sum()
    assert np.mean([got[k].component_id == expected[k] for k in range(len(x))]) >= 0.95
    assert all(got[k].n_links == 0 and got[k].kept for k, _, _ in odd)
    assert vector_dedup.deduplicate(df.limit(0)).count() == 0


def test_token_files(spark, documents, edge, tokenizer, tmp_path):
    for df in (documents, edge):
        path = str(tmp_path / str(df.count()))
        token_files.write(df, path, PATH, 2)
        rows = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
        texts = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        at = 0
        for r, (i, t) in zip(rows, texts, strict=True):
            ids = [*ids_of(tokenizer, t), 2]
            assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids))
            assert np.frombuffer(r.ids, "<u4").tolist() == ids
            at += len(ids)
    assert token_files.write_and_read(edge.limit(0), PATH, 2).count() == 0


def test_token_blocks():
    for n in (1, 2, 1000, 70_000):
        ids = np.random.default_rng(n).zipf(1.3, n) % 3000
        f = token_files.scale(dict(zip(*[v.tolist() for v in np.unique(ids, return_counts=True)], strict=True)))
        assert f.sum() == 1 << token_files.BITS
        lanes, *coded = token_files.encode_block(ids, f)
        d = token_files.Decoder(f, token_files.BITS)
        assert (d.ids(n, lanes, *coded) == ids).all()
        assert (d.slice(n // 2, n, lanes, *coded) == ids[n // 2 :]).all()


def test_shards(spark, edge):
    df = spark.createDataFrame([(k, f"single {k}" if k % 3 else f"pair {k // 30}") for k in range(1200)], "doc_id long, text string")
    rows = shards.shard_documents(df).collect()
    by = {}
    groups = {}
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        groups.setdefault(texts[r.doc_id], set()).add(r.shard)
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    sizes = [len(v) for v in by.values()]
    assert len(by) == 16 and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert np.mean([len(s) == 1 for t, s in groups.items() if t.startswith("pair")]) >= 0.9
    assert shards.shard_documents(edge).count() == len(EDGE)
    assert shards.shard_documents(edge.limit(0)).count() == 0


@pytest.mark.parametrize("part", [3, 2])
def test_shards_of_a_large_group(spark, part):
    rows, quota = 1600, 100
    links = spark.range(rows // part).select(F.col("id").alias("row"), F.lit(1).cast("long").alias("link"))
    counts = [r["count"] for r in shards.propagate(links, rows).groupBy("shard").count().collect()]
    assert sum(counts) == rows // part and max(counts) <= quota
    assert len(counts) == -(-(rows // part) // quota)


def plain_propagation(links, n_rows, count, rounds=40):
    """Labels by moving one row at a time to the shard of most of its linked rows, under the same quotas; links are lists of rows."""
    rows = sorted({r for members in links for r in members})
    label = {r: k % count for k, r in enumerate(rows)}
    own = {r: [m for m in links if r in m] for r in rows}
    for _ in range(rounds):
        moved = False
        for r in rows:
            held = [sum(label[x] == s for m in own[r] for x in m if x != r) for s in range(count)]
            room = [sum(v == s for v in label.values()) < n_rows // count or s == label[r] for s in range(count)]
            best = max(range(count), key=lambda s: (room[s], held[s], s == label[r]))
            if held[best] > held[label[r]]:
                label[r], moved = best, True
        if not moved:
            break
    return label


def cut_pairs(links, label):
    return sum(label[a] != label[b] for m in links for k, a in enumerate(m) for b in m[k + 1 :])


@pytest.mark.parametrize("share", [0.0, 0.33, 0.9])
def test_shards_cut_few_links(spark, share):
    n, count = 480, 16
    big = int(n * share)
    rng = random.Random(3)
    links, at = ([list(range(big))] if big else []), big
    while at < n - 20:
        size = rng.choice([2, 3, 4, 7])
        links.append(list(range(at, at + size)))
        at += size
    rows = [(r, k + 10) for k, m in enumerate(links) for r in m]
    df = spark.createDataFrame(rows, "row long, link long")
    label = {r.row: r.shard for r in shards.propagate(df, n).collect()}
    assert len(label) == len(rows) and max(np.bincount(list(label.values()))) <= -(-n // count)
    least = cut_pairs([list(range(big))], {r: r // (n // count) for r in range(big)}) if big else 0  # a large link fills as few shards as it needs
    small = [m for m in links if len(m) < 10]
    assert cut_pairs(links, label) <= plain_propagation_cut(links, n, count)
    assert cut_pairs([links[0]], label) <= least * 1.1 if big else True
    assert sum(len({label[r] for r in m}) > 1 for m in small) <= count  # about one at each border


def plain_propagation_cut(links, n, count):
    return cut_pairs(links, plain_propagation(links, n, count))


def test_shards_query(spark):
    rows = queries.op10_shards(spark, SF).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes = np.bincount([r.shard for r in rows], minlength=16)
    assert sizes.max() - sizes.min() <= 1
    assert all((r.size, r.text_crc32) == (len(docs[r.doc_id].encode()) + 1, zlib.crc32(docs[r.doc_id].encode())) for r in rows)


def test_pipeline_matches_its_stages(spark):
    import corpus_pipeline

    docs = queries.read(spark, SF, "documents")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == columns
        docs = spark.createDataFrame(after.collect(), after.schema)
    ids = {r.doc_id for r in docs.collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == ids
    assert not any(re.search(r"@mail\d", r.text) for r in docs.select("text").where(F.col("text").isNotNull()).collect())


def test_near_copies_are_linked_by_simhash(spark, monkeypatch):
    """What op8 links is compared without any band; equal fingerprints of texts that are not similar drop nothing."""
    import corpus_pipeline

    rng = random.Random(8)
    fp = simhash.fingerprint
    rows = []
    while len(rows) < 12:
        words = [f"w{rng.randrange(3000)}" for _ in range(1500)]
        pair = " ".join(words), " ".join([*words[:700], "edit", *words[701:]])
        if 1 <= (fp(pair[0]) ^ fp(pair[1])).bit_count() <= 2:
            rows += [(len(rows) + k, t) for k, t in enumerate(pair)]
    rows.append((12, rows[0][1]))
    refrain = "seven words of a line that returns " * 400
    rows += [(20 + k, refrain + " ".join(f"own{k}x{j}" for j in range(30))) for k in range(2)]
    assert (fp(rows[-1][1]) ^ fp(rows[-2][1])).bit_count() <= 2
    monkeypatch.setattr(near_copies, "edges", lambda classes, *_: classes.selectExpr("node AS left", "node AS right").limit(0))
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 6, 8, 10, 20, 21]


def test_arrow_batches_of_the_pipeline_are_small(spark):
    key, before = scratch.BATCH_ROWS, spark.conf.get(scratch.BATCH_ROWS)
    try:
        for named, expected in (("10000", "2000"), ("300", "300")):
            spark.conf.set(key, named)
            scratch.small_batches(spark)
            assert spark.conf.get(key) == expected
    finally:
        spark.conf.set(key, before)
