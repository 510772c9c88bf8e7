"""Token counts, exact centroids and whitening against plain versions, and their edge cases."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from lumenplan.llm import bpe, centroids, queries, token_counts, whitening

SF = "/root/testdata/sf0.001"
PATH = queries.vocabulary_path()
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def tokens(tokenizer, text):
    return len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_counts_equal_the_library(tokenizer):
    table = token_counts.MergeTable(bpe.read_vocabulary(PATH))
    random.seed(7)
    parts = ["a", "b", " ", "  ", "\n", "\t", "the", "ing", "'s", "'", "é", "漢", "\xa0", "\x1c", "\x85", " ", "1", "²", "!", "...", "<|endoftext|>", "😀", "tion", "\r\n", "<|", "aaaa"]
    for _ in range(4000):
        t = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        assert table.count(t) == tokens(tokenizer, t), repr(t)
    for t in ("".join(random.choice("abcdefghij") for _ in range(40_000)), "a" * 100_001, "ab" * 60_000, "漢字" * 30_000, " " * 50_000, "word " * 300_000):
        assert table.count(t) == tokens(tokenizer, t)
    table.forget()
    assert table.count("again the same") == tokens(tokenizer, "again the same")


def test_counts_of_a_table(spark, tokenizer):
    rows = queries.op12_token_counts(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(map(tuple, rows)) == sorted((i, len((t or "").encode()), n := tokens(tokenizer, t), n > 512) for i, t in texts.items())


def test_counts_of_edge_rows(spark, tokenizer):
    texts = [(1, None), (2, ""), (3, "  "), (4, "same"), (4, "same"), (None, "no key"), (5, "word " * 2000), (6, "<|endoftext|>x<|endoftext|>"), (7, "tok " * 511 + "tok"), (8, "tok " * 512 + "tok")]
    df = spark.createDataFrame([(i, t, 9, True, "k") for i, t in texts], "doc_id long, text string, n_tokens long, over_limit boolean, _key string")
    got = sorted(map(tuple, token_counts.report(df, PATH).collect()), key=str)
    assert got == sorted([(i, len((t or "").encode()), n := tokens(tokenizer, t), n > 512) for i, t in texts], key=str)
    assert token_counts.report(df.limit(0), PATH).count() == 0
    added = token_counts.add_counts(df, PATH)
    assert sorted(added.columns) == sorted(df.columns)
    assert sorted((r.n_tokens for r in added.collect())) == sorted(tokens(tokenizer, t) for _, t in texts)
    with pytest.raises(ValueError):
        token_counts.MergeTable(b'{"model": {"type": "WordPiece"}}')


def plain_clusters(rows, k=16, rounds=3, dims=64, scale=64):
    """The rounds in Python's integers; rows are (key, vector)."""
    kept = [(i, [math.floor(v * scale) if abs(v) < 2**53 else int(v) * scale for v in x]) for i, x in rows if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    points = [x for _, x in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]]
    if not points:
        return []

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, p)), c) for c, p in enumerate(points))

    for _ in range(rounds):
        found = [nearest(x)[1] for _, x in kept]
        means = []
        for c, p in enumerate(points):
            own = [x for (_, x), f in zip(kept, found) if f == c]
            means.append([sum(v) // len(own) for v in zip(*own)] if own else p)
        points = means
    last = [nearest(x) for _, x in kept]
    inertia = [sum(d for d, c in last if c == k) for k in range(len(points))]
    sha = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]

    def long(v):
        return v if v < 2**63 else None

    return [(i, c, long(d), long(inertia[c]), long(sum(inertia)), sha[c]) for (i, _), (d, c) in zip(kept, last)]


def same_rows(got, expected):
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_centroids_of_a_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op11_centroids(spark, SF)
    same_rows(got.collect(), plain_clusters(rows))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    same_rows(got.collect(), con.execute(queries.ORACLE_SQL["op11_centroids"]).fetchall())


def test_centroids_of_edge_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(60)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (5, rows[6][1]), (70, None), (71, []), (72, [1.0]), (73, [NAN, 0.0, 0.0, 0.0]), (74, [None, 0.0, 0.0, 0.0]), (75, [INF] * 4), (None, [0.5, -0.5, 0.25, -0.0])]
    huge = [(80, [1e30, 0.0, -1e30, 1.0]), (81, [1e200, 0.0, 0.0, 1.0]), (82, [3e6, -3e6, 3e6, 1.0]), (83, [3e6, -3e6, 3e6, 0.0]), (84, [2.0**52, 1.0, 1.0, 1.5])]
    for data, k in ((rows, 16), (rows + huge, 16), (rows + huge, 60), (huge, 3), (rows[:3], 16), (rows[-8:-1], 16), ([], 16)):
        df = spark.createDataFrame([(i, x, 7, "c") for i, x in data], "vec_id long, embedding array<double>, cluster int, key string")
        same_rows(centroids.cluster(df, k=k, dims=4).collect(), plain_clusters(data, k=k, dims=4))
    floats = spark.createDataFrame([(i, x) for i, x in rows], "vec_id long, embedding array<float>").repartition(7)
    same_rows(centroids.cluster(floats, k=5, dims=4).collect(), plain_clusters(rows, k=5, dims=4))


def test_both_ways_of_a_distance_agree():
    rng = np.random.default_rng(1)
    bound = centroids.exact_bound(8)
    assert 4 * 8 * bound**2 < 2**53
    x = rng.integers(-bound, bound + 1, (200, 8))
    x[:40] = np.sign(x[:40]) * bound
    model = centroids.Centroids(x[:12].tolist() + x[:1].tolist(), 64, 8)
    near, least = model.nearest(x.astype(float))
    exact, distance = model.nearest(x.astype(object))
    assert near.tolist() == exact.tolist() and least.tolist() == distance.tolist()
    assert not model.large and centroids.Centroids([[bound + 1] * 8], 64, 8).large == [0]


def plain_whitening(rows, components=8):
    kept = [(i, [math.floor(v * 1024) + 100_000 for v in x]) for i, x in rows if x and all(v is not None and math.isfinite(v) for v in x)]
    n, dims = len(kept), len(kept[0][1])
    sums = [sum(x[k] for _, x in kept) for k in range(dims)]
    d = [[n * v - s for v, s in zip(x, sums)] for _, x in kept]
    v = np.array([[sum(r[a] * r[b] for r in d) / n**3 for b in range(dims)] for a in range(dims)])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    w = (np.array(d, float) / n) @ q / np.sqrt(e)
    return [(i, sum(c * c for c in r)) for (i, _), r in zip(kept, d)], w, e / np.trace(v)


def check_whitening(got, rows):
    deviations, w, explained = plain_whitening(rows)
    k = w.shape[1]
    found = {}
    for r in got:
        found.setdefault(r.vec_id, []).append(r)
    assert len(got) == len(deviations) * k
    for j in range(k):
        mine = {i: [r for r in rs if r.component == j + 1] for i, rs in found.items()}
        values = np.array([mine[i][0].whitened for i, _ in deviations])
        sign = np.sign(values @ w[:, j])
        assert np.allclose(values * sign, w[:, j], rtol=1e-6, atol=1e-8)
        assert all(abs(r.explained / explained[j] - 1) < 1e-9 and r.n == len(deviations) and r.identity_error < 1e-9 for rs in mine.values() for r in rs)
        assert all(mine[i][0].deviation == d for i, d in deviations)


def test_whitening_of_a_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(queries.op13_whitening(spark, SF).collect(), rows)


def test_whitening_of_edge_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=5) * [9, 5, 3, 2, 1]).tolist()) for i in range(80)]
    dropped = [(100, None), (101, []), (102, [None] * 5), (103, [NAN, 1.0, 1.0, 1.0, 1.0]), (104, [INF] * 5), (105, [1.0, 2.0])]
    schema = "vec_id long, embedding array<double>, n long, key string, x array<long>"

    def table(data):
        return spark.createDataFrame([(i, x, 1, "k", [1]) for i, x in data], schema).repartition(3)

    kept = rows + [(3, rows[3][1]), (3, rows[3][1]), (None, rows[4][1])]
    check_whitening(whitening.whiten(table(kept + dropped)).collect(), kept)
    assert whitening.whiten(table(dropped[:-1])).count() == 0
    assert whitening.whiten(table([])).count() == 0
    one = whitening.whiten(table(rows[:1])).collect()
    assert len(one) == 5 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 and r.n == 1 for r in one)
    flat = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]  # one direction only
    got = whitening.whiten(table(flat)).collect()
    assert [r.component for r in got if r.whitened is not None] == [1] * 9 and len(got) == 27
    assert all(r.identity_error < 1e-9 for r in got) and abs(np.std([r.whitened for r in got if r.component == 1]) - 1) < 1e-9


def test_whitening_beyond_a_long(spark):
    rows = [(i, [1e12 * i, float(i % 3), 1.0 * (i % 2)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r for r in whitening.whiten(df).collect() if r.component == 1]
    deviations, _, _ = plain_whitening(rows, 1)
    assert {r.vec_id: r.deviation for r in got} == {i: d if d < 2**63 else None for i, d in deviations}
    assert abs(np.std([r.whitened for r in got]) - 1) < 1e-9
