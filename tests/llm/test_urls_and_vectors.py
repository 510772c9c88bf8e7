"""URL models against a plain Witten-Bell, vectors against all pairs; each also through its registered query."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenplan.llm import queries, urls, vector_dedup

SF = "/root/testdata/sf0.001"


def plain_models(learnt, seen):
    """Ratio of every gram of ``seen``, by Witten-Bell from the ``learnt`` (url, kind)."""
    pad = lambda u: "\x02" * (urls.ORDER - 1) + u + "\x03"
    counts = {k: Counter() for k in (urls.ALLOW, urls.BLOCK)}
    for u, kind in learnt:
        p = pad(u)
        counts[kind].update(p[i : i + urls.ORDER] for i in range(len(p) - urls.ORDER + 1))
    every = {pad(u)[i : i + urls.ORDER] for u in seen for i in range(len(pad(u)) - urls.ORDER + 1)}

    def probability(kind):
        tables = {}
        for order in range(1, urls.ORDER + 1):
            table = Counter()
            for g, n in counts[kind].items():
                table[g[-order:]] += n
            tables[order] = table
        sums = {o: defaultdict(lambda: [0, 0]) for o in tables}
        for o, t in tables.items():
            for g, n in t.items():
                sums[o][g[:-1]][0] += n
                sums[o][g[:-1]][1] += 1

        def p(g):
            q = 1 / urls.ALPHABET
            for o in range(1, urls.ORDER + 1):
                tail = g[-o:]
                n, t = sums[o][tail[:-1]]
                q = q if n + t == 0 else (tables[o][tail] + t * q) / (n + t)
            return q

        return p

    a, b = probability(urls.ALLOW), probability(urls.BLOCK)
    return {g: math.log(a(g)) - math.log(b(g)) for g in every}, pad


@pytest.mark.parametrize("broadcast", [300_000, 0])
def test_scores_equal_plain_witten_bell(spark, monkeypatch, broadcast):
    monkeypatch.setattr(urls, "BROADCAST_GRAMS", broadcast)
    pages = queries.read(spark, SF, "pages").select("page_id", "url")
    odd = [(900, None), (901, ""), (902, "no scheme?q=1"), (902, "no scheme?q=1"), (903, "http://a.net/" + "é/" * 5000), (904, "https://x.org/fr/#漢😀"), (905, "http://a.net/?q#f")]
    table = pages.union(spark.createDataFrame(odd, pages.schema)).withColumn("host", F.lit("x")).withColumn("score", F.lit("y"))
    rows = urls.judge(table).collect()
    known = {r.url for r in table.collect()}
    learn = {r.url: r.learn for r in spark.createDataFrame([(u or "",) for u in known], "url string").select("url", (F.xxhash64("url") % 5 != 0).alias("learn")).collect()}
    url_of = defaultdict(set)
    for r in table.collect():
        url_of[r.page_id].add(r.url or "")
    count = Counter(r.url or "" for r in table.collect())
    ruled = {}
    for r in rows:
        (u,) = url_of[r.page_id]
        ruled[u] = r.verdict if r.rule else None
    ratios, pad = plain_models([(u, v) for u, v in ruled.items() if v and learn[u] for _ in range(count[u])], set(count))
    assert len(rows) == table.count() and {r.verdict for r in rows} <= {"allow", "block"}
    threshold = {True: [], False: []}
    for r in rows:
        (u,) = url_of[r.page_id]
        p = pad(u)
        grams = [p[i : i + urls.ORDER] for i in range(len(p) - urls.ORDER + 1)]
        expected = sum(ratios[g] for g in grams) / len(grams)
        assert abs(r.score - expected) < 1e-9
        if not r.rule:
            threshold[r.verdict == "allow"].append(r.score)
    assert min(threshold[True], default=9) >= max(threshold[False], default=-9)
    # the query and the fragment count
    assert len({round(r.score, 9) for r in rows if r.page_id in (901, 902, 905)}) == 3


def test_many_rules_are_joined(spark, monkeypatch):
    random.seed(3)
    hosts = ["a.b.net", "b.net", "x.example.net", "net", "org", "q.org", "zorg"]
    rows = [(k, f"http://{random.choice(hosts)}/{random.choice(['', 'en/', 'en/x', 'fr/'])}") for k in range(80)] + [(100, None), (101, "none")]
    rules = (*urls.RULES, ("block", "b.net/en/"), ("allow", "a.b.net/"), ("block", "org"))
    df = urls.parse(spark.createDataFrame(rows, "page_id long, url string"))
    inline = sorted(map(str, urls.apply_rules(df, rules).select("page_id", "host", "path", "rule", "ruled").collect()))
    monkeypatch.setattr(urls, "INLINE_RULES", 2)
    assert sorted(map(str, urls.apply_rules(df, rules).select("page_id", "host", "path", "rule", "ruled").collect())) == inline


def test_url_query(spark):
    pages = {r.page_id: r.url for r in queries.read(spark, SF, "pages").collect()}
    rows = queries.op2_urls(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        rest = (pages[r.page_id] or "").partition("://")[2]
        cut = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
        assert r.host == rest[:cut].lower() and r.path == rest[cut:].split("?")[0].split("#")[0]


def plain_links(rows, threshold=vector_dedup.THRESHOLD):
    """Links per row number by the cosine of all pairs."""
    usable = [(k, l, np.array(v, float)) for k, (_, v, l) in enumerate(rows) if l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {k: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for k, _, v in usable}
    return [(a, b) for a, l, v in usable for b, m, w in usable if a < b and l == m and len(v) == len(w) and float(unit[a] @ unit[b]) >= threshold]


@pytest.mark.parametrize("block", [2048, 16])
def test_vectors_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    monkeypatch.setattr(vector_dedup, "TILE", 8)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    rows = [(k, (centres[k % 6] + rng.normal(size=16) * 0.25).tolist(), int(k % 4 == 0)) for k in range(150)]
    rows += [(150, [x * 1e200 for x in rows[0][1]], 1), (151, [x * 1e-200 for x in rows[0][1]], 1), (152, rows[4][1], 1), (153, rows[4][1], 1), (154, rows[4][1], None), (155, [], 1)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, vector array<double>, label int, kept string, n_links long")
    pairs = plain_links(rows)
    n = np.bincount(np.array(pairs).ravel(), minlength=len(rows))
    got = {r.vec_id: r for r in vector_dedup.deduplicate(df).collect()}
    assert [got[k].n_links for k in range(len(rows))] == n.tolist()
    root = list(range(len(rows)))
    for _ in rows:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert [got[k].component_id for k in range(len(rows))] == root
    assert all(r.kept == (r.component_id == k) for k, r in got.items())
    assert (0, 150) in pairs and (0, 151) in pairs


def test_vectors_of_one_number(spark):
    rows = [(7, [1.0, 0.0], 1), (7, [0.0, 1.0], 1), (3, [0.0, 2.0], 1), (9, [3.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in vector_dedup.deduplicate(spark.createDataFrame(rows, "vec_id long, vector array<double>, label int")).collect())
    assert got == [("3", 1, "3"), ("7", 1, "3"), ("7", 1, "3"), ("9", 1, "7"), ("None", 0, "None")]


def test_vector_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in queries.read(spark, SF, "embeddings").collect()]
    n = Counter(k for pair in plain_links(rows) for k in pair)
    got = {r.vec_id: r.n_links for r in queries.op6_vectors(spark, SF).collect()}
    assert got == {i: n[k] for k, (i, _, _) in enumerate(rows)}
