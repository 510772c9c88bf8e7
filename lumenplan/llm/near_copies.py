"""Groups of near copies: SimHash fingerprints and bands of MinHash values propose, the exact similarity decides.

Texts whose SimHash fingerprints (``simhash``, with its words, bits and blocks) differ in two bits at most are linked,
as that operator links them.  Two bits see only copies with few edits, so texts that are further apart are proposed
beside it by MinHash values over five-word shingles.

For these a text is the set of its different five-word shingles.  For each of ``BANDS * ROWS`` hash functions
it keeps the least value over the set, which two texts have in common with the chance of their
Jaccard similarity, wherever the edits are and however long the texts.  Texts that agree in all values
of one of ``BANDS`` bands are compared by the share of equal values.  A pair of similarity 0.8 meets in
a band with a chance of 0.9998 and passes the comparison with one of 0.999 (``recall``).  Texts with
equal sets are one class.

That only proposes groups.  The texts of each proposed group are then read again, and its classes are
linked by the exact similarity of their sets, whichever pairs were proposed: a document is dropped
only if a text of its group has at least the similarity with it.

The classes of one band value, and of one proposed group, are dealt over tiles of bounded size, which
are searched for connected classes; that reports one edge per class and never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch, simhash
from .bpe import text_batches
from .graph import connected_components, name_components
from .hot import add_least, join_keys, looked_up
from .simhash import CHUNK, SEED

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of MinHash values and values of each.
BANDS, ROWS = 16, 4
#: Deviations below the mean at the least similarity of the equal values that still pass.
DEVIATIONS = 3.5
#: Classes of a tile, about.
TILE = 512
#: Shingles of a tile of texts, about.
TILE_SHINGLES = 500_000
#: Words whose hashes a worker remembers; it only saves time.
CACHED_WORDS = 300_000

_FACTORS, _TERMS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.array([[1], [0]], np.uint64)


def least_equal(similarity: float = SIMILARITY) -> int:
    """Equal values of two texts from which on they are compared further."""
    n = BANDS * ROWS
    return max(ROWS, int(n * similarity - DEVIATIONS * sqrt(n * similarity * (1 - similarity))))


def recall(similarity: float = SIMILARITY) -> float:
    """A lower bound of the chance that a pair of this similarity is found on its own."""
    n, least = BANDS * ROWS, least_equal()
    missed = sum(comb(n, k) * similarity**k * (1 - similarity) ** (n - k) for k in range(least))
    return 1 - (1 - similarity**ROWS) ** BANDS - missed


class _Hashes(dict):
    def __missing__(self, word: bytes) -> bytes:
        h = xxhash.xxh64_intdigest(word, SEED).to_bytes(8, "little")
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def shingles_of(text: str | None, hashes: _Hashes) -> np.ndarray:
    """Hashes of the different shingles of a text, sorted; none for a text without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join([hashes[w] for w in words]), "<u8")
    n = max(1, len(h) - SHINGLE + 1)
    joined = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        joined = _mixed(joined * np.uint64(3) + h[k : k + n])
    return np.unique(joined)


def least_values(shingles: np.ndarray) -> np.ndarray:
    """The least value of every hash function over the shingles."""
    out = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint64)
    for k in range(0, len(shingles), CHUNK // 64):
        values = (shingles[k : k + CHUNK // 64, None] * _FACTORS + _TERMS) >> np.uint64(32)
        out = np.minimum(out, values.min(0))
    return out


def _band_keys(values: np.ndarray) -> np.ndarray:
    """One number per text and band."""
    rows = values.reshape(len(values), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        key = _mixed(key * np.uint64(3) + rows[:, :, k])
    return key


def text_hash() -> Column:
    """With doc_id, it tells a document from others; null and the empty text are the same."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def fingerprints(df: DataFrame) -> DataFrame:
    """doc_id, ``hash`` (of the text), ``same`` (a digest of the set of shingles), ``bands`` (a key each), ``values`` (the low byte of each least value), ``size`` (of the set) and ``fp`` (the SimHash fingerprint)."""
    names = ["same", "bands", "values"]
    rows = df.select("doc_id", "text", text_hash().alias("hash"))
    fields = [rows.schema["doc_id"], rows.schema["hash"], *(T.StructField(n, T.BinaryType()) for n in names), *(T.StructField(n, T.LongType()) for n in ("size", "fp"))]

    def run(batches):
        hashes = _Hashes()
        for part, texts in text_batches(batches, "text"):
            sets = [shingles_of(t, hashes) for t in texts]
            values = np.array([least_values(s) for s in sets], np.uint64).reshape(-1, BANDS * ROWS)
            columns = [
                [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                [k.tobytes() for k in _band_keys(values).astype("<u8")],
                [v.tobytes() for v in values.astype(np.uint8)],
            ]
            bits = np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("hash"), *(pa.array(c, pa.binary()) for c in columns), pa.array([len(s) for s in sets], pa.int64()), pa.array(bits)],
                ["doc_id", "hash", *names, "size", "fp"],
            )

    return rows.mapInArrow(run, T.StructType(fields))


def connected(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """For every class of ``n`` the number of the first class that it is connected with, itself included.

    ``near(k, left)`` tells which of ``left`` are close to class ``k``.  Reached classes are compared
    only with those not reached yet, so a dense group costs little.
    """
    root = np.arange(n)
    left = np.arange(n)
    while len(left):
        first, left = int(left[0]), left[1:]
        waiting = [first]
        while waiting and len(left):
            close = near(waiting.pop(), left)
            if close.any():
                found = left[close]
                root[found] = first
                waiting.extend(found.tolist())
                left = left[~close]
    return root


def _keyed(classes: DataFrame) -> DataFrame:
    """(key, node) for every band of every class."""

    def run(batches):
        for b in batches:
            node = b.column("node").to_numpy(zero_copy_only=False)
            keys = np.frombuffer(b"".join(b.column("bands").to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(node, BANDS))], ["key", "node"])

    return classes.select("node", "bands").mapInArrow(run, "key long, node long")


def _search(groups: DataFrame, values: Callable[[DataFrame], DataFrame], searcher: Callable[[], Callable[[list], np.ndarray]]) -> DataFrame:
    """Edges ``(left, right)`` that connect the nodes of each group (key, r, t, node) to the first of their component there.

    ``values`` adds ``value`` to the rows; of a list of values, in order of the nodes, ``searcher()``
    gives what ``connected`` does.
    """
    rows = values(groups).groupBy("key", "r", "t").agg(F.collect_list(F.struct("node", "value")).alias("rows"))  # two tiles at most

    def run(batches) -> Iterator[pa.RecordBatch]:
        search = searcher()
        for b in batches:
            left: list[int] = []
            right: list[int] = []
            for k in range(b.num_rows):
                side = b.column("rows")[k].values
                node = side.field(0).to_numpy(zero_copy_only=False)
                order = np.argsort(node, kind="stable")
                root = search(side.field(1).take(pa.array(order)).to_pylist())
                node = node[order]
                at = np.flatnonzero(node[root] != node)
                left.extend(node[at].tolist())
                right.extend(node[root[at]].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["left", "right"])

    return scratch.save(rows.select("rows").mapInArrow(run, "left long, right long").distinct(), "found")


def _connect(members: DataFrame, values: Callable[[DataFrame], DataFrame], searcher: Callable[[], Callable[[list], np.ndarray]]) -> DataFrame:
    """Edges ``(left, right)`` that connect all nodes which are close and share a key, however many share it.

    ``members`` has key, node and weight, the share of a tile that a node takes.  The nodes of a key are
    dealt over tiles.  In each tile the nodes are searched together with the key's first node, so what
    is sent grows with the nodes only.  Two nodes that are both connected with the first one need no
    comparison; every other pair is then searched: the tiles of the nodes not connected with the first
    one, each with each of the key's tiles.
    """
    sizes = members.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n"), F.ceil(F.sum("weight")).cast("int").alias("parts"))
    placed = join_keys(members, sizes.where("n > 1"), "key", members.count()).withColumn("t", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    placed = scratch.save(placed, "placed")
    several = placed.where("parts > 1")
    tiles = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    group = ("key", F.lit(0).alias("r"), "t", "node")
    firsts = several.where("node = first").select("key", tiles("parts").alias("t"), "node", F.col("t").alias("own")).where("t != own").select(*group)
    found = _search(placed.select(*group).unionByName(firsts), values, searcher)
    reached = found.select(F.col("left").alias("node"), F.col("right").alias("first"))
    rest = scratch.save(several.where("node != first").join(reached, ["node", "first"], "left_anti"), "rest")
    if rest.isEmpty():
        return found
    left = rest.groupBy("key").agg(F.ceil(F.sum("weight")).cast("int").alias("rows"))
    wide = left.join(sizes.select("key", "n"), "key")
    total = placed.count()
    alone = join_keys(rest, wide, "key", total).withColumn("r", F.pmod(F.xxhash64(F.lit(1), "node"), "rows").cast("int"))
    every = join_keys(several, wide, "key", total).select("key", tiles("rows").alias("r"), "t", "node")
    pairs = alone.select("key", "r", tiles("parts").alias("t"), "node").unionByName(every).distinct()
    return found.unionByName(_search(pairs, values, searcher))


def edges(classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Edges ``(left, right)`` that connect all classes which bands propose and equal values accept.

    ``classes`` has ``node``, ``bands`` and ``values``, one row per class.  Of the band keys that the
    same classes share, one is searched.
    """
    least = least_equal(similarity)
    keyed = _keyed(classes)
    members = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"m{k}") for k in (1, 2)]
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), *members).where("n > 1")
    chosen = sizes.groupBy("n", "m1", "m2").agg(F.min("key").alias("key")).select("key", "n")
    shared = scratch.save(join_keys(keyed, chosen, "key", classes.count() * BANDS).withColumn("weight", F.lit(1 / TILE)), "shared")

    def searcher():
        def search(values: list[bytes]) -> np.ndarray:
            v = np.frombuffer(b"".join(values), np.uint8).reshape(-1, BANDS * ROWS)
            return connected(len(v), lambda k, left: (v[left] == v[k]).sum(1) >= least)

        return search

    held = classes.select("node", F.col("values").alias("value"))
    return _connect(shared, lambda groups: groups.join(held, "node"), searcher)


def simhash_edges(marks: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges ``(left, right)`` that connect all classes whose texts ``simhash`` links.

    ``marks`` has ``same`` and ``fp`` of every row, ``classes`` each ``same``'s ``node`` and its number of rows ``n``.
    A class may have several fingerprints, as words that are repeated count in them, and a fingerprint several classes.
    """
    held = join_keys(marks.select("same", "fp").distinct(), classes.select("same", "node", "n"), "same", marks.count())
    held = scratch.save(held.select("fp", "node"), "held")
    first = scratch.save(held.groupBy("fp").agg(F.min("node").alias("node")), "first")
    equal = add_least(held, "fp", "node", "first", held.count()).where("node != first")
    return equal.select(F.col("node").alias("left"), F.col("first").alias("right")).unionByName(simhash.links(first))


def linked(texts: list[str | None], hashes: _Hashes, similarity: float = SIMILARITY) -> np.ndarray:
    """``connected`` over the exact Jaccard similarity of the texts' sets of shingles."""
    sets = [shingles_of(t, hashes) for t in texts]
    size = np.array([len(s) for s in sets], np.int64)
    every, token = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(size)))
    holders = np.repeat(np.arange(len(sets)), size)[np.argsort(token, kind="stable")]
    first = np.concatenate(([0], np.cumsum(np.bincount(token, minlength=len(every)))))

    def near(k: int, left: np.ndarray) -> np.ndarray:
        mine = token[starts[k] : starts[k + 1]]
        times = first[mine + 1] - first[mine]
        at = np.repeat(first[mine] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        common = np.bincount(holders[at], minlength=len(sets))[left]
        return common >= similarity * (size[k] + size[left] - common) - 1e-9

    return connected(len(sets), near)


def confirmed(df: DataFrame, classes: DataFrame, proposed: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Edges ``(left, right)`` that connect the classes of each proposed group which have the similarity.

    ``proposed`` has ``node`` and ``component``, ``classes`` each node's ``first`` document.
    """
    known = scratch.save(proposed.join(classes.select("node", "first", "size"), "node"), "proposed")
    weight = F.greatest(F.lit(1 / TILE), F.col("size") / TILE_SHINGLES)
    members = known.select(F.col("component").alias("key"), "node", weight.alias("weight"))
    place = known.select("node", "first.*")
    texts = df.select("doc_id", F.col("text").alias("value"), text_hash().alias("hash"))

    def values(groups: DataFrame) -> DataFrame:
        # one text of each node: rows that repeat doc_id and text are the same
        placed = looked_up(scratch.save(groups.join(place, "node"), "placed"))
        return texts.join(placed, ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash", "key", "r", "t", "node"])

    def searcher():
        hashes = _Hashes()
        return lambda texts: linked(texts, hashes, similarity)

    return _connect(members, values, searcher)


def _grouped(df: DataFrame, similarity: float) -> DataFrame:
    """Per row doc_id, hash of the text, and ``kept``: doc_id and hash of the first document of its group."""
    marks = scratch.save(fingerprints(df), "marks")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "hash")))
    made = marks.groupBy("same", "bands", "values", "size").agg(first.alias("first"), F.count("*").alias("n"))
    classes = scratch.save(made.withColumn("node", F.monotonically_increasing_id()), "classes")  # once saved, a class keeps its number
    usable = classes.where("first is not null")
    proposed = connected_components(simhash_edges(marks, usable).unionByName(edges(usable, similarity)), "left", "right")
    named = name_components(usable, confirmed(df, usable, proposed, similarity), "node", "first", "kept").select("same", "kept", "n")
    nameless = classes.where("first is null").select("same", F.lit(None).cast(named.schema["kept"].dataType).alias("kept"), "n")
    return join_keys(marks, named.unionByName(nameless), "same", marks.count()).select("doc_id", "hash", "kept")


def group(df: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id and component_id, the smallest doc_id of its group of near copies.

    Texts without words are one group; a text of fewer words than a shingle is one shingle; repeated
    rows are kept, and rows of one doc_id with different texts belong where their texts do; a null
    doc_id gives a group no number; an empty table gives none; other columns are ignored.
    """
    return _grouped(df, similarity).select("doc_id", F.col("kept.doc_id").alias("component_id"))


def keep_first(df: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The first document of each group, by doc_id and then by a hash of the text; all columns stay.

    Rows that repeat both doc_id and text are one document: one of them stays.  Rows with one doc_id
    and different texts are different documents.  Documents without doc_id have no group and stay.
    Texts without words are one group.  An empty table gives none.  Columns may have any names.

    Only the documents' numbers are looked up; tables of them with a checked size are broadcast, so the
    texts stay where they are, and larger ones are joined by a shuffle.
    """
    key = "_hash" + "_" * max(len(c) for c in df.columns)  # no column has this name
    numbered = df.where("doc_id is not null")
    found = scratch.save(_grouped(numbered, similarity), "groups")
    own = F.struct("doc_id", "hash")
    dropped = scratch.save(found.where(own != F.col("kept")).select("doc_id", F.col("hash").alias(key)).distinct(), "dropped")
    repeated = found.where(own == F.col("kept")).groupBy("doc_id", F.col("hash").alias(key)).agg(F.count("*").alias("n")).where("n > 1").select("doc_id", key)
    repeated = scratch.save(repeated, "repeated")
    kept = numbered.withColumn(key, text_hash()).join(looked_up(dropped), ["doc_id", key], "left_anti")
    if not repeated.isEmpty():
        few = looked_up(repeated)
        several = kept.join(few, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
        kept = kept.join(few, ["doc_id", key], "left_anti").unionByName(several)
    return kept.select(*df.columns).unionByName(df.where("doc_id is null"))
