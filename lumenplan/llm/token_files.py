"""Token-id files coded by a range asymmetric numeral system.

Format.  A folder holds two Parquet tables.  ``frequencies`` has one row: the number of bits and the
frequencies of all ids, scaled to that power of two and shared by all blocks.  ``blocks`` has one row
per block of whole documents: its ``part`` and ``block`` number give the order, ``start`` the ids of
the part before it, ``doc_ids`` and ``sizes`` its documents.  The ids of a block are dealt over
interleaved lanes, lane by lane, step by step.  ``words`` are 32-bit words in reading order; lanes
that need a word after a step take the next ones, lowest lane first.  ``states`` holds the 64-bit
states of all lanes at every checkpoint and ``word_at`` the words read before it, so a reader can
begin at any checkpoint and blocks and checkpoints can be read in parallel.  ``crc32`` is the checksum
of the block's ids as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .bpe import CACHED_CHARS, LONG_TEXT, read_vocabulary, text_batches

#: Ids from which a block is closed, lanes of a large block, and steps between checkpoints.
BLOCK_IDS, LANES, CHECKPOINT = 1 << 19, 2048, 128
#: Bits of the scaled frequencies, and the least state.
BITS, LOW = 20, np.uint64(1 << 31)
#: Pieces that a worker remembers, and misses after which it begins anew (the texts have changed); it only saves time.
CACHED_PIECES, STALE = 650_000, 3_000_000
#: Signs that end a word of letters without being joined to it in any token.
SIGNS = ",.;:!?*&%$#"
#: Characters that the library encodes at a time.
JOINED = 1 << 15


class LibraryEncoder:
    """Ids by the tokenizers library, which sees each different piece of the texts once.

    A text is cut at single spaces between visible characters, where byte-level words always begin;
    pieces that are not remembered are joined, encoded together, and cut by the bytes of their tokens.
    """

    def __init__(self, spec: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec.decode("utf-8"))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # one character stands for one byte in a byte-level token
        self.bytes_of = np.array([special.get(i) or len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.borders = re.compile(r"(?<=\S) (?=\S)")
        self.known: dict[str, bytes] = {}
        self.misses = 0
        self.signs: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces, each with a space before it."""
        out: dict[str, bytes] = {}
        joined: list[str] = []
        size = 0
        groups: list[list[str]] = []
        for p in pieces:
            joined.append(p)
            size += len(p) + 1
            if size >= JOINED:
                groups.append(joined)
                joined, size = [], 0
        if joined:
            groups.append(joined)
        for group in groups:
            (encoded,) = self.tokenizer.encode_batch_fast([" " + " ".join(group)], add_special_tokens=False)
            ids = np.array(encoded.ids, np.int64)
            ends = np.cumsum(self.bytes_of[ids])
            stops = np.searchsorted(ends, np.cumsum([len(p.encode("utf-8")) + 1 for p in group])) + 1
            raw, width = ids.astype(self.kind).tobytes(), self.kind.itemsize
            a = 0
            for p, b in zip(group, (stops * width).tolist(), strict=True):
                out[p] = raw[a:b]
                a = b
        return out

    def _with_signs(self, piece: str) -> bytes | None:
        """Ids of a remembered word of letters and the signs after it, which always begin a token of their own."""
        word = piece.rstrip(SIGNS)
        if len(word) == len(piece) or not word.isalpha():
            return None
        ids = self.known.get(word)
        if ids is None:
            return None
        signs = piece[len(word) :]
        end = self.signs.get(signs)
        if end is None:
            (end,) = self._whole([signs])
            if len(self.signs) < 10_000:
                self.signs[signs] = end
        return ids + end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts, as bytes of ``kind``; null and empty texts have none."""
        known = self.known
        rows: list[list] = []
        heads: list[str] = []
        missing: dict[str, bytes] = {}
        gaps: list[tuple[int, int, str]] = []
        for text in texts:
            if not text:
                rows.append([])
                heads.append("")
                continue
            pieces = text.split(" ") if len(text) <= LONG_TEXT else self.borders.split(text)
            again = not pieces[0] or pieces[0][-1].isspace()
            while True:
                heads.append(pieces.pop(0))
                found = list(map(known.get, pieces))
                row, k = len(rows), -1
                # the few pieces that aren't remembered leave gaps, which are filled when all are known
                for _ in range(found.count(None)):
                    k = found.index(None, k + 1)
                    p = pieces[k]
                    ids = self._with_signs(p)
                    if ids is not None:
                        found[k] = ids
                    elif not again and (not p or p[0].isspace() or p[-1].isspace()):
                        again = True
                        break
                    else:
                        missing[p] = b""
                        gaps.append((row, k, p))
                        found[k] = b""
                if not again:
                    break
                while gaps and gaps[-1][0] == row:
                    gaps.pop()
                heads.pop()
                pieces = self.borders.split(text)
                heads.append(pieces.pop(0))
                found = [known.get(p) for p in pieces]
                for k, ids in enumerate(found):
                    if ids is None:
                        missing[pieces[k]] = found[k] = b""
                        gaps.append((row, k, pieces[k]))
                break
            rows.append(found)
        if missing:
            missing = self._learn(list(missing))
            for row, k, p in gaps:
                rows[row][k] = missing[p]
            if len(known) < CACHED_PIECES:
                known.update((p, ids) for p, ids in missing.items() if len(p) <= CACHED_CHARS)
            else:
                self.misses += len(missing)
                if self.misses > STALE:
                    known.clear()
                    self.misses = 0
        first = self._whole(heads)
        return [h + b"".join(r) for h, r in zip(first, rows, strict=True)]


_encoder: dict[int, LibraryEncoder] = {}


def _encoder_for(spec: bytes) -> LibraryEncoder:
    key = hash(spec)
    if key not in _encoder:
        _encoder.clear()
        _encoder[key] = LibraryEncoder(spec)
    return _encoder[key]


def _token_blocks(docs: DataFrame, spec, end_id: int) -> DataFrame:
    """Blocks of the ids of whole documents in order of doc_id, and the width of an id in bytes."""

    def run(batches):
        encoder = _encoder_for(spec.value)
        part, end = TaskContext.get().partitionId(), np.array([end_id], encoder.kind).tobytes()
        width = encoder.kind.itemsize
        block = start = held = 0
        ids: list[bytes] = []
        names: list = []
        sizes: list[int] = []

        def row():
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "start": pa.array([start], pa.int64()),
                    "width": pa.array([width], pa.int32()), "ids": pa.array([b"".join(ids)], pa.binary()),
                    "doc_ids": pa.array([names], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int64())),
                }
            )

        for batch, texts in text_batches(batches, "text"):
            for name, coded in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                ids.append(coded)
                ids.append(end)
                names.append(name)
                sizes.append(len(coded) // width + 1)
                held += sizes[-1]
                if held >= BLOCK_IDS:
                    yield row()
                    block, start, held = block + 1, start + held, 0
                    ids, names, sizes = [], [], []
        if names:
            yield row()

    schema = "part int, block int, start long, width int, ids binary, doc_ids array<long>, sizes array<long>"
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, schema)


def _counts(blocks: DataFrame) -> dict[int, int]:
    """How often every id occurs."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for width, ids in zip(b.column("width").to_pylist(), b.column("ids"), strict=True):
                n = np.bincount(np.frombuffer(ids.as_buffer(), f"<u{width}"), minlength=len(total))
                n[: len(total)] += total
                total = n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    found = blocks.select("width", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r.id: r.n for r in found.toLocalIterator()}  # at most the vocabulary


def scale(counts: dict[int, int], bits: int = BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least one for each id that occurs."""
    out = np.zeros(max(counts, default=-1) + 1, np.int64)
    if not counts:
        return out.astype(np.uint32)
    if len(counts) > 1 << (bits - 1):
        raise ValueError(f"{len(counts)} different ids need more than {bits} bits")
    ids = np.array(sorted(counts))
    n = np.array([counts[i] for i in ids], float)
    out[ids] = np.maximum(1, np.floor(n / n.sum() * (1 << bits))).astype(np.int64)
    rest = (1 << bits) - int(out.sum())
    while rest:
        top = int(out.argmax())
        step = rest if rest > 0 else -min(-rest, int(out[top]) // 2)
        out[top] += step
        rest -= step
    return out.astype(np.uint32)


def encode_block(ids: np.ndarray, frequencies: np.ndarray, bits: int = BITS) -> tuple[int, bytes, bytes, bytes]:
    """Number of lanes, words, checkpoints' states and word positions of a block's ids."""
    lanes = min(LANES, 1 << max(0, (len(ids) // CHECKPOINT).bit_length() - 1))
    steps = -(-len(ids) // lanes)
    table = np.full(steps * lanes, ids[0] if len(ids) else 0, np.int64)
    table[: len(ids)] = ids
    table = table.reshape(steps, lanes)
    freq = frequencies.astype(np.uint64)
    low = np.cumsum(freq) - freq
    top = freq << np.uint64(63 - bits)
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = [np.zeros(0, "<u4")] * steps
    states: list[np.ndarray] = [x] * (-(-steps // CHECKPOINT))
    shift, word = np.uint64(bits), np.uint64(32)
    for t in range(steps - 1, -1, -1):
        s = table[t]
        f = freq[s]
        full = x >= top[s]
        words[t] = x[full].astype("<u4")
        x = np.where(full, x >> word, x)
        q = x // f
        x = (q << shift) + (x - q * f) + low[s]
        if t % CHECKPOINT == 0:
            states[t // CHECKPOINT] = x
    sizes = np.concatenate(([0], np.cumsum([len(w) for w in words])[:-1])) if steps else np.zeros(0, np.int64)
    at = sizes[::CHECKPOINT].astype("<i8")
    return lanes, np.concatenate(words).tobytes() if steps else b"", b"".join(s.astype("<u8").tobytes() for s in states), at.tobytes()


class Decoder:
    """Tables for reading blocks."""

    def __init__(self, frequencies: np.ndarray, bits: int):
        self.freq = frequencies.astype(np.uint64)
        self.low = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies)
        self.bits = bits

    def steps(self, lanes: int, words, states, word_at, begin: int, end: int) -> np.ndarray:
        """Ids of steps ``begin`` to ``end``, from the checkpoint before ``begin`` on."""
        stream = np.frombuffer(words, "<u4").astype(np.uint64)
        k = begin // CHECKPOINT
        x = np.frombuffer(states, "<u8")[k * lanes : (k + 1) * lanes].copy()
        at = int(np.frombuffer(word_at, "<i8")[k])
        mask, shift, word = np.uint64((1 << self.bits) - 1), np.uint64(self.bits), np.uint64(32)
        out = np.empty((end - k * CHECKPOINT, lanes), np.uint32)
        for t in range(len(out)):
            slot = x & mask
            s = self.symbol[slot]
            out[t] = s
            x = self.freq[s] * (x >> shift) + slot - self.low[s]
            need = np.flatnonzero(x < LOW)
            if len(need):
                x[need] = (x[need] << word) | stream[at : at + len(need)]
                at += len(need)
        return out[begin - k * CHECKPOINT :]

    def ids(self, n: int, lanes: int, words, states, word_at) -> np.ndarray:
        """All ids of a block."""
        if not n:
            return np.zeros(0, np.uint32)
        return self.steps(lanes, words, states, word_at, 0, -(-n // lanes)).ravel()[:n]

    def slice(self, first: int, last: int, lanes: int, words, states, word_at) -> np.ndarray:
        """Ids ``first`` to ``last`` of a block, read from the nearest checkpoint."""
        begin = first // lanes
        got = self.steps(lanes, words, states, word_at, begin, -(-last // lanes)).ravel()
        return got[first - begin * lanes : last - begin * lanes]


def write(docs: DataFrame, path: str, vocabulary_path: str, end_id: int) -> None:
    """Encode every ``text``, append ``end_id``, and write the files in ascending order of doc_id.

    Null and empty texts are an end alone; rows that repeat a doc_id follow each other; a null doc_id
    comes first; an empty table writes empty tables; other columns are ignored.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    blocks = scratch.save(_token_blocks(docs, spec, end_id), "token-blocks")
    frequencies = scale(_counts(blocks))
    row = [(BITS, bytearray(frequencies.astype("<u4").tobytes()))]
    spark.createDataFrame(row, "bits int, frequencies binary").coalesce(1).write.parquet(f"{path}/frequencies")
    shared = spark.sparkContext.broadcast(frequencies)

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                ids = np.frombuffer(one.column("ids")[0].as_buffer(), f"<u{one.column('width')[0].as_py()}")
                lanes, words, states, at = encode_block(ids, shared.value)
                extra = {
                    "n_ids": pa.array([len(ids)], pa.int64()), "lanes": pa.array([lanes], pa.int32()), "words": pa.array([words], pa.binary()),
                    "states": pa.array([states], pa.binary()), "word_at": pa.array([at], pa.binary()),
                    "crc32": pa.array([zlib.crc32(ids.astype("<u4"))], pa.int64()),
                }
                held = ("part", "block", "start", "doc_ids", "sizes")
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in held), *extra.values()], [*held, *extra])

    schema = (
        "part int, block int, start long, doc_ids array<long>, sizes array<long>,"
        " n_ids long, lanes int, words binary, states binary, word_at binary, crc32 long"
    )
    blocks.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/blocks")
    scratch.drop(blocks)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit integers).

    ``start`` counts the ids of all documents before it.  A block whose checksum differs is an error.
    """
    head = spark.read.parquet(f"{path}/frequencies").first()
    shared = spark.sparkContext.broadcast((np.frombuffer(bytes(head.frequencies), "<u4"), head.bits))
    blocks = spark.read.parquet(f"{path}/blocks")

    def run(batches) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(*shared.value)
        for b in batches:
            for k in range(b.num_rows):
                v = {c: b.column(c)[k] for c in b.schema.names}
                ids = decoder.ids(v["n_ids"].as_py(), v["lanes"].as_py(), *(v[c].as_buffer() for c in ("words", "states", "word_at")))
                if zlib.crc32(ids) != v["crc32"].as_py():
                    raise ValueError(f"block {v['block'].as_py()} of part {v['part'].as_py()} is damaged")
                sizes = v["sizes"].values.to_numpy()
                ends = np.cumsum(sizes)
                offsets = pa.array(np.concatenate(([0], ends * 4)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(sizes), v["part"].as_py(), np.int32)), v["doc_ids"].values,
                        pa.array(v["start"].as_py() + ends - sizes), pa.array(sizes),
                        pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets.buffers()[1], pa.py_buffer(ids)]),
                    ],
                    ["part", "doc_id", "inside", "n_tokens", "ids"],
                )

    rows = blocks.mapInArrow(run, "part int, doc_id long, inside long, n_tokens long, ids binary")
    before, starts = 0, []
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part")
    for r in totals.toLocalIterator():  # one row per part
        starts.append((r.part, before))
        before += r.n
    offsets = spark.createDataFrame(starts, "part int, before long")
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids")


def write_and_read(docs: DataFrame, vocabulary_path: str, end_id: int) -> DataFrame:
    """Files of the documents in the shared folder, read back: doc_id, start, n_tokens, ids_crc32."""
    path = scratch.new_path(docs.sparkSession, "token-files")
    write(docs, path, vocabulary_path, end_id)
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
