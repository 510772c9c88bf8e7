"""Benchmark decontamination by rare n-gram seeds and local alignment.

A pass over all documents looks up the word trigrams of the test items.  It counts in how many
documents each of them occurs, and keeps the stretches in which enough trigrams of one item stand
close together: as many as are left of the item, at the worst placed edits, at the least similarity.
A stretch is joined to an item by the item's rare trigrams, the ones in the fewest documents; their
number is such that a copy must hold one of them.  An item whose trigrams could all be lost in a copy is
looked up by its bigrams, or by its words.  Smith-Waterman alignment of stretch and item then
decides.  Test items come in blocks of a fixed size, so what is broadcast does not grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import scratch
from .bpe import text_batches
from .hot import looked_up

#: Words of a seed, at most.
GRAM = 3
#: Least share of an item's words that a copy holds.
SIMILARITY = 0.8
#: Words of test items in one block.
BLOCK_WORDS = 400_000
#: Raw words that a worker remembers; it only saves time.
CACHED_WORDS = 300_000
#: Alignment: a match counts one, a mismatch and a gap take one off.  Matches are counted in the low digits.
ONE = 1 << 32

_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’¿¡…–—"


def words(text: str | None) -> list[str]:
    """Lower-case words without punctuation at their ends."""
    return [w for w in (t.strip(_EDGES).lower() for t in (text or "").split()) if w]


def most_edits(length: int, similarity: float) -> int:
    """Most words of an item that a copy may lack or change."""
    return int(length * (1 - similarity) + 1e-9)


def needed(times: np.ndarray, length: int, size: int, similarity: float = SIMILARITY) -> int:
    """Different seeds, of those that an item of so many words holds so many ``times``, that every copy holds.

    A copy lacks or changes at most e words and its alignment scores at least length - 2e, which also
    bounds the words put in: an edit spoils at most ``size`` seeds, a word put in at most one less.  A
    seed is lost when each place of it is spoilt, so at worst the seeds with the fewest places are.
    """
    e = most_edits(length, similarity)
    spoilt = max(size * k + (size - 1) * (2 * e - 2 * k) for k in (0, e))
    return len(times) - int((np.cumsum(np.sort(times)) <= spoilt).sum())


def seeds_of_item(ws: np.ndarray, similarity: float = SIMILARITY) -> tuple[int, np.ndarray, int]:
    """Words of a seed, the most of which a copy must hold one, the different seeds, and how many a copy must hold."""
    for size in range(min(GRAM, len(ws)), 0, -1):
        codes, times = np.unique(_codes(ws, size), return_counts=True)
        need = needed(times, len(ws), size, similarity)
        if need > 0:
            break
    return size, codes, need


class Block:
    """Seed tables of a block of different items."""

    def __init__(self, items: list[tuple[int, tuple[str, ...]]], similarity: float):
        self.vocabulary: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], np.int64) for _, ws in items]
        self.similarity = similarity
        found = [seeds_of_item(ws, similarity) for ws in self.words]
        self.sizes = sorted({size for size, _, _ in found})
        self.need = np.array([need for _, _, need in found])
        pairs = [np.stack([codes, np.full(len(codes), n, np.uint64)]) for n, (_, codes, _) in enumerate(found)]
        both = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.uint64)
        both = both[:, np.lexsort((both[1], both[0]))]
        self.seeds, self.first, self.count = np.unique(both[0], return_index=True, return_counts=True)
        self.item_of = both[1].astype(np.int64)

    def seeds_of(self) -> list[tuple[int, int]]:
        """Every (item, seed) by number."""
        seed = np.repeat(np.arange(len(self.seeds)), self.count)
        return list(zip(self.item_of.tolist(), seed.tolist(), strict=True))


def _codes(ids: np.ndarray, size: int) -> np.ndarray:
    """Codes of all runs of so many word numbers, which may hold zeros; runs of different sizes have different codes."""
    x = ids.astype(np.uint64)
    code = np.full(max(0, len(x) - size + 1), GRAM - size, np.uint64)
    for k in range(size):
        code = (code ^ x[k : len(x) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code


class _Codes(dict):
    """Word number of a raw word as four bytes; none for punctuation."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, raw: str) -> bytes:
        w = raw.strip(_EDGES).lower()
        code = self.vocabulary.get(w, 0).to_bytes(4, "little") if w else b""
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[raw] = code
        return code


def _stretches(block: Block, ids: np.ndarray) -> Iterator[tuple[int, int, int, list[int]]]:
    """(item, start, end, seeds) of the stretches of a document with enough seeds of an item, and the seeds of all."""
    places, seeds = [], []
    for size in block.sizes:
        codes = _codes(ids, size)
        inside = np.flatnonzero(ids[: len(codes)] > 0)
        at = np.searchsorted(block.seeds, codes[inside])
        at[at == len(block.seeds)] = 0
        right = block.seeds[at] == codes[inside]
        places.append(inside[right])
        seeds.append(at[right])
    pos, seed = np.concatenate(places), np.concatenate(seeds)
    if not len(pos):
        return
    yield -1, 0, 0, np.unique(seed).tolist()
    times = block.count[seed]
    ends = np.cumsum(times)
    item = block.item_of[np.arange(ends[-1]) + np.repeat(block.first[seed] - (ends - times), times)]
    pos, seed = np.repeat(pos, times), np.repeat(seed, times)
    order = np.lexsort((pos, item))
    item, pos, seed = item[order], pos[order], seed[order]
    starts = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
    stops = np.concatenate((starts[1:], [len(item)]))
    enough = stops - starts >= block.need[item[starts]]
    for a, b in zip(starts[enough].tolist(), stops[enough].tolist(), strict=True):
        n = int(item[a])
        length, need = len(block.words[n]), int(block.need[n])
        reach = length + 2 * most_edits(length, block.similarity)
        p = pos[a:b]
        dense = np.flatnonzero(p[need - 1 :] - p[: len(p) - need + 1] <= reach)
        if not len(dense):
            continue
        apart = np.diff(dense) >= need if need > 1 else np.diff(p) > GRAM
        for run in np.split(dense, np.flatnonzero(apart) + 1):
            low, high = int(run[0]), int(run[-1]) + need - 1
            found = np.unique(seed[a + low : a + high + 1])
            if len(found) >= need:
                yield n, max(0, int(p[low]) - reach), min(len(ids), int(p[high]) + GRAM + reach), found.tolist()


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over word numbers: best score, matches in it (the most, at that score), end in the text."""
    width = len(text)
    gaps = np.arange(width + 1, dtype=np.int64) * ONE
    row = np.zeros(width + 1, np.int64)
    best, where = 0, 0
    for w in item.tolist():
        diagonal = row[:-1] + np.where(text == w, ONE + 1, -ONE)
        here = np.maximum(0, row - ONE)
        here[1:] = np.maximum(here[1:], diagonal)
        row = np.maximum.accumulate(here + gaps) - gaps
        top = int(row.argmax())
        if row[top] > best:
            best, where = int(row[top]), top
    return best >> 32, best & (ONE - 1), where


def _blocks(items: DataFrame, similarity: float) -> Iterator[tuple[Block, list[tuple[int, int]]]]:
    """Blocks of different items, and the items that have the words of another: (item, the one it equals)."""
    held: dict[tuple[str, ...], int] = {}
    equal: list[tuple[int, int]] = []
    size = 0
    for r in items.where("item_id is not null").orderBy("item_id").toLocalIterator():
        ws = tuple(words(r["text"]))
        if not ws:
            continue
        if size and size + len(ws) > BLOCK_WORDS:
            yield Block([(i, t) for t, i in held.items()], similarity), equal
            held, equal, size = {}, [], 0
        if ws in held:
            equal.append((r["item_id"], held[ws]))
        else:
            held[ws] = r["item_id"]
        size += len(ws)
    if held:
        yield Block([(i, t) for t, i in held.items()], similarity), equal


def _candidates(docs: DataFrame, block: Block) -> DataFrame:
    """Rows of stretches, and per task rows of seed counts (item -1, start the seed, end its documents)."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        b = shared.value
        codes = _Codes(b.vocabulary)
        counts = np.zeros(len(b.seeds), np.int64)

        def rows(found):
            columns = list(zip(*found, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item", "start", "stop", "seeds", "words"])

        for part, texts in text_batches(batches, "text"):
            found = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                ids = np.frombuffer(b"".join([codes[w] for w in (text or "").split()]), "<u4").astype(np.int64)
                for item, start, stop, seeds in _stretches(b, ids):
                    if item < 0:
                        counts[seeds] += 1
                    else:
                        found.append((doc_id, item, start, stop, seeds, ids[start:stop].astype("<u4").tobytes()))
            if found:
                yield rows(found)
        seen = np.flatnonzero(counts).tolist()
        yield rows([(None, -1, s, int(counts[s]), None, None) for s in seen])

    schema = "doc_id long, item int, start long, stop long, seeds array<int>, words binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _aligned(candidates: DataFrame, block: Block) -> DataFrame:
    shared = candidates.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        b = shared.value
        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item", "start", "words")), strict=True)
            for doc_id, item, start, text in rows:
                length = len(b.words[item])
                score, same, end = align(b.words[item], np.frombuffer(text, "<u4").astype(np.int64))
                e = most_edits(length, b.similarity)
                if same >= length - e and score >= length - 2 * e:
                    out.append((doc_id, b.ids[item], same / length, score, start + end))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "similarity", "score", "end_word"])

    return candidates.select("doc_id", "item", "start", "words").mapInArrow(run, "doc_id long, item_id long, similarity double, score long, end_word long")


def matches(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Copies of test items in documents: doc_id, item_id, similarity, score, end_word, once per pair.

    The similarity is the share of the item's words in the alignment, end_word the number of the
    document's word after it.  Items without words match nothing; of a null doc_id nothing is said.
    """
    spark = docs.sparkSession
    parts = []
    for block, equal in _blocks(items, similarity):
        table = scratch.save(_candidates(docs, block), "stretches")
        counts = table.where("item = -1").groupBy(F.col("start").cast("int").alias("seed")).agg(F.sum("stop").alias("n_docs"))
        frequency = {r.seed: r.n_docs for r in counts.toLocalIterator()}  # bounded by the block's seeds
        of_item: dict[int, list[int]] = {}
        for item, seed in block.seeds_of():
            of_item.setdefault(item, []).append(seed)
        rare = [
            Row(item=item, rare=sorted(seeds, key=lambda s: (frequency.get(s, 0), s))[: len(seeds) - int(block.need[item]) + 1])
            for item, seeds in of_item.items()
        ]
        seeds = spark.createDataFrame(rare, "item int, rare array<int>")
        joined = table.where("item >= 0 and doc_id is not null").join(F.broadcast(seeds), "item").where(F.arrays_overlap("seeds", "rare"))
        found = _aligned(joined, block)
        best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", "score", "end_word")).alias("m")).select("doc_id", "item_id", "m.*")
        if equal:
            same = spark.createDataFrame([Row(other=a, item_id=b) for a, b in equal], "other long, item_id long")
            best = best.unionByName(best.join(F.broadcast(same), "item_id").withColumn("item_id", F.col("other")).drop("other"))
        parts.append(best)
    if not parts:
        return spark.createDataFrame([], "doc_id long, item_id long, similarity double, score long, end_word long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, item_id and similarity of the closest item.

    Null and empty texts are clean; repeated rows of one doc_id get one verdict; equally close items
    give the smallest item_id; an empty table of documents gives none, one of items leaves all clean;
    other columns are ignored.
    """
    found = (
        matches(docs, items, similarity)
        .groupBy("doc_id")
        .agg(F.count("*").alias("n_items"), F.max_by(F.struct("item_id", "similarity"), F.struct("similarity", -F.col("item_id"))).alias("best"))
    )
    return docs.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.col("best.item_id").alias("item_id"),
        F.col("best.similarity").alias("similarity"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that hold no copy of a test item; all columns stay, and so do rows without doc_id.

    Null and empty texts are clean; of repeated rows of one doc_id all go if one holds a copy; an empty table of items
    leaves all documents; an empty table of documents gives none.  Only the numbers of the others are
    looked up; a table of them of checked size is broadcast, and the texts stay where they are.
    """
    found = scratch.save(matches(docs, items, similarity).select("doc_id").distinct(), "leaks")
    return docs.join(looked_up(found), "doc_id", "left_anti").select(*docs.columns)
