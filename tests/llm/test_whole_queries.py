"""Registered queries against plain versions, the pipeline on odd tables, and identity beyond 64 bits."""

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from lumenplan.llm import near_copies, queries, shards, vector_dedup

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, "   "), (4, "same text here"), (4, "same text here"), (5, "same text here"), (None, "no number"), (6, "word " * 3000), (7, "mail a@b.cd and 漢😀"),
]


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in queries.read(spark, SF, "documents").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    tokenizer = Tokenizer.from_file(queries.vocabulary_path())
    return {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def packed(numbers):
    return np.array(numbers, "<u4").tobytes()


def test_bpe_query(spark, texts, ids):
    rows = queries.op1_bpe(spark, SF).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == {i: (len(ids[i]), sha(packed(ids[i])), sha(t.encode())) for i, t in texts.items()}
    assert len(rows) == len(texts)


def test_token_file_query(spark, ids):
    expected, start = {}, 0
    for i in sorted(ids):
        own = [*ids[i], 2]
        expected[i] = (start, len(own), zlib.crc32(packed(own)))
        start += len(own)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op7_token_files(spark, SF).collect()} == expected


def test_quality_query(spark, texts):
    rows = queries.op5_quality(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def fingerprint(text):
    words = text.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    runs = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    found = [xxhash.xxh64_intdigest(w, 42) for w in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def test_simhash_query(spark, texts):
    f = {i: fingerprint(t) for i, t in texts.items()}
    component = {i: i for i in f}
    for _ in f:
        after = {i: min(component[j] for j in f if (f[i] ^ f[j]).bit_count() <= 2) for i in f}
        if after == component:
            break
        component = after
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, SF).collect()} == {i: (f"{f[i]:016x}", component[i]) for i in f}


def test_benchmark_query(spark, texts):
    items = [" ".join((r.text or "").lower().split()) for r in queries.read(spark, SF, "benchmark").collect()]
    trigrams = lambda t: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)}
    every = set().union(*map(trigrams, items))
    got = {r.doc_id: r.contaminated for r in queries.op9_decontam(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        t = " ".join(t.lower().split())
        if any(it and f" {it} " in f" {t} " for it in items):
            assert got[i], i
        elif not trigrams(t) & every:
            assert not got[i], i


def test_pipeline_of_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars int, score double, spans string, shard int, kept boolean"
    rows = [(i, t, None, "x", len(t or ""), 1.0, "y", 5, False) for i, t in ODD]
    for name, kept in (("odd", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(kept, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, folder).collect())
        # texts without words are one group, as are the rows of documents 4 and 5
        assert got == (["1", "4", "6", "7", "None"] if kept else [])


P1, P2, P5, MASK = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x27D4EB2F165667C5, (1 << 64) - 1


def turned(x, n):
    return (x << n | x >> (64 - n)) & MASK


def meeting(seed, other_seed, y):
    """The double whose hash after ``other_seed`` is that of ``y`` after ``seed``."""
    mixed = turned(struct.unpack("<Q", struct.pack("<d", y))[0] * P2 & MASK, 31) * P1 & MASK
    mixed ^= (seed + P5 + 8) & MASK ^ (other_seed + P5 + 8) & MASK
    bits = turned(mixed * pow(P1, -1, 1 << 64) & MASK, 33) * pow(P2, -1, 1 << 64) & MASK
    return struct.unpack("<d", struct.pack("<Q", bits))[0]


def test_vectors_of_one_hash_are_two(spark):
    begun = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (5.0,)], "x double").selectExpr("x", "xxhash64(1, array(x)) AS h").collect()
    seed = begun[0].h & MASK
    x, y = next((r.x, y) for r in begun[1:] if np.isfinite(y := meeting(seed, r.h & MASK, 1.0)) and y != 0)
    rows = [(1, [1.0, 1.0], 1), (2, [x, y], 1), (3, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>, label int")
    assert df.selectExpr("xxhash64(label, vector) AS h").distinct().count() == 1
    assert (x + y) / (np.sqrt(2) * np.hypot(x, y)) < vector_dedup.THRESHOLD
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in vector_dedup.deduplicate(df).collect()) == [(1, 1, 1), (2, 0, 2), (3, 1, 1)]


def test_shards_take_links_of_any_type(spark):
    rows = spark.range(40).withColumnRenamed("id", "row")
    links = rows.selectExpr("row", "struct(cast(row % 8 AS string) AS a, row % 2 AS b) AS link")
    got = shards.assign(rows, links, 4).collect()
    shard_of = {r.row: r.shard for r in got}
    assert sorted(np.bincount(list(shard_of.values())).tolist()) == [10] * 4
    # eight groups of five on four shards of ten: none is cut
    assert all(len({shard_of[r] for r in shard_of if r % 8 == g}) == 1 for g in range(8))


def similar_pairs(texts):
    """All pairs of texts of different five-word sets whose Jaccard similarity is 0.8 or more, by the sets themselves."""
    sets = {}
    for i, t in texts.items():
        words = t.encode().lower().split()
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    holders = {}
    for i, s in sets.items():
        for w in s:
            holders.setdefault(w, []).append(i)
    for i, s in sets.items():
        common = Counter(j for w in s for j in holders[w] if j > i)
        yield from ((i, j) for j, n in common.items() if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near_copies_find_all_similar_pairs(spark, sf):
    documents = queries.read(spark, f"/root/testdata/{sf}", "documents")
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    pairs = list(similar_pairs(texts))
    component = {r.doc_id: r.component_id for r in near_copies.group(documents).collect()}
    assert pairs and all(component[i] == component[j] for i, j in pairs)
    partners = {i for p in pairs for i in p} | {i for i, t in texts.items() if not t.split()}
    assert {i for i, c in component.items() if i != c} <= partners
