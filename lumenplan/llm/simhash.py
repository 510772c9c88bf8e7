"""SimHash near-duplicate groups by pigeonhole blocks.

A 64-bit fingerprint is split into blocks.  Two fingerprints that differ in at most ``distance`` bits
agree in all blocks but ``distance`` of them, so they share at least one choice of the other blocks:
they are joined on every such choice and verified by their Hamming distance.  A block value that many
different fingerprints share is not paired out: its fingerprints meet instead in the values they have
after one bit is flipped, which two fingerprints share exactly when at most two bits tell them apart.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .bpe import text_batches
from .graph import name_components
from .hot import join_keys

SEED = 42
SHINGLE = 3
DISTANCE = 2
BLOCKS = 4
#: Fingerprints of one block value up to which all pairs are compared; beyond, flipped bits link them.
PAIRED = 64
#: Shingles that are held as numbers at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text; 0 for null, empty and blank texts."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, total, CHUNK):
        a = starts[k : min(k + CHUNK, total)].tolist()
        b = ends[k + shingle - 1 : min(k + CHUNK, total) + shingle - 1].tolist()
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and the fingerprint of ``text`` as a signed 64-bit integer."""
    df = df.select(*keep, text)
    fields = [f for f in df.schema.fields if f.name in keep]

    def run(batches):
        for part, texts in text_batches(batches, text):
            bits = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(bits)], [*keep, out])

    return df.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.LongType())]))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """The masks of every choice of blocks that leaves ``distance`` blocks out."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [_signed(sum(c)) for c in combinations(each, blocks - distance)]


def _far(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(classes: DataFrame) -> DataFrame:
    """Edges ``(left, right)`` of nodes whose fingerprints differ in 1 or 2 bits, enough to connect all such pairs.

    ``classes`` has one row ``(fp, node)`` per different fingerprint.
    """
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(block_masks())])
    keyed = classes.select("fp", "node", F.explode(keys).alias("key")).select("fp", "node", "key.k", "key.v")
    sizes = keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.save(keyed.join(sizes, ["k", "v"]), "blocks")
    cold = shared.where(F.col("n") <= PAIRED)
    left = cold.select("k", "v", F.col("fp").alias("fa"), F.col("node").alias("left"))
    right = cold.select("k", "v", F.col("fp").alias("fb"), F.col("node").alias("right"))
    near = left.join(right, ["k", "v"]).where((F.col("fa") < F.col("fb")) & (_far("fa", "fb") <= DISTANCE)).select("left", "right")

    hot = shared.where(F.col("n") > PAIRED).select("fp", "node").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    probes = hot.select("fp", "node", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("probe"))
    middle = (
        probes.groupBy("probe")
        .agg(F.count("*").alias("n"), F.min(F.struct("node", "fp")).alias("low"))
        .where("n > 1")
        .select("probe", F.col("low.node").alias("right"), F.col("low.fp").alias("fb"))
    )
    starred = probes.join(middle, "probe").where((F.col("fp") != F.col("fb")) & (_far("fp", "fb") <= DISTANCE))
    return near.unionByName(starred.select(F.col("node").alias("left"), "right"))


def group(df: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, the smallest linked doc_id.

    Null, empty and blank texts have fingerprint zero and are linked like any other; repeated rows are
    kept, and rows of one doc_id with different texts are linked by their own texts; documents with null
    doc_id are linked too and give a component no number; an empty table gives none; other columns are
    ignored.
    """
    bits = scratch.save(fingerprints(df, out="fp"), "fingerprints")
    classes = scratch.save(bits.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "classes")
    named = name_components(classes, links(classes.select("fp", F.col("fp").alias("node"))), "fp", "node", "component_id")
    return join_keys(bits, named.select("fp", "component_id", "n"), "fp", bits.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
