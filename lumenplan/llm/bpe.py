"""Byte-pair encoding and decoding.

Encoding takes the longest token that starts at a position (found for all positions in one
Aho-Corasick pass) and appends it if it may stand beside the token before it; the pair test walks
the merge tree of the two tokens and looks for a merge that would have crossed their border.  Where
the test fails the next shorter prefix token is tried, and where none fits the last token is taken
back.  Each position is given up at most once, so a piece is encoded in linear time and the ids are
those of the merge loop.  Decoding copies byte ranges through an offset table.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the pre-tokenisation pattern of byte-level BPE vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries that a worker remembers; it only saves time, the ids don't depend on it.
CACHED_WORDS = 250_000
CACHED_PAIRS = 200_000
#: Bits that hold the second token of a pair.
PAIR = 21
#: Longest text piece whose ids are remembered.
CACHED_CHARS = 48
#: A text above this many characters is cut into words lazily.
LONG_TEXT = 1 << 20
#: Bytes of ids and text that one Arrow batch of results holds before it is sent on.
BATCH_BYTES = 4 << 20


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-in of every byte: itself if it is printable Latin-1, else the next free one from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Remembered(dict):
    """Ids of pieces, computed at the first look-up.

    Two generations: a full dictionary becomes the older one, and a piece found there is young again.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.make(piece)
            if len(piece) > CACHED_CHARS:
                return ids
        if len(self) >= CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Vocabulary:
    """Tables of one vocabulary file, for encoding and decoding."""

    def __init__(self, spec: bytes):
        data = json.loads(spec)
        model = data["model"]
        alphabet = _byte_alphabet()
        tokens = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items()}
        self.id_of = tokens
        size = 1 + max([*tokens.values(), *(t["id"] for t in data["added_tokens"])])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        parts = [b""] * size
        for raw, i in tokens.items():
            parts[i] = raw
        for text, i in self.special.items():
            parts[i] = text.encode()
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.parts = parts
        # order of merges: single bytes come first, a merge in the order of the file
        self.rank = [-1] * size
        self.left = [-1] * size
        self.right = [-1] * size
        self.merge: dict[int, int] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y = (tokens[bytes(alphabet[c] for c in t)] for t in (a, b))
            z = tokens[self.parts[x] + self.parts[y]]
            self.merge[x << PAIR | y] = n
            if self.rank[z] < 0:
                self.left[z], self.right[z], self.rank[z] = x, y, n
        usable = {raw: i for raw, i in tokens.items() if len(raw) == 1 or self.rank[i] >= 0}
        self.automaton = ahocorasick.Automaton()
        for raw, i in usable.items():
            self.automaton.add_word(raw.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [-1] * size
        for raw, i in usable.items():
            self.shorter[i] = next((usable[raw[:k]] for k in range(len(raw) - 1, 0, -1) if raw[:k] in usable), -1)
        self.length = [len(p) for p in parts]
        self.pattern = regex.compile(WORDS)
        self.spaces = re.compile(r"\s\s")
        self.borders = re.compile(r"(?<=\S) (?=\S)")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.four = [i.to_bytes(4, "little") for i in range(size)]
        self.first = _Remembered(self._encode_piece)
        self.later = _Remembered(lambda piece: self._encode_piece(" " + piece))
        self._fits: dict[int, bool] = {}

    def forget(self) -> None:
        """Drop what was remembered of texts, at the end of a task; the tables stay."""
        for pieces in (self.first, self.later):
            pieces.clear()
            pieces.older = {}
        self._fits.clear()

    def fits(self, a: int, b: int) -> bool:
        """True if token ``a`` followed by ``b`` stays as it is when the merges run."""
        if len(self._fits) >= CACHED_PAIRS:
            self._fits.clear()
        holds = self._fits[a << PAIR | b] = self._border_holds(a, b)
        return holds

    def _border_holds(self, a: int, b: int) -> bool:
        # Undo the latest merge on either side of the border, one at a time: at each state the pair at
        # the border must have no merge that runs before the one just undone.
        merge, rank = self.merge, self.rank
        limit = len(merge)
        while True:
            n = merge.get(a << PAIR | b)
            if n is not None and n < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra > rb:
                limit, a = ra, self.right[a]
            elif rb >= 0:
                limit, b = rb + 1, self.left[b]
            else:
                return True

    def _encode_word(self, word: str) -> bytes:
        raw = word if word.isascii() else word.encode("utf-8", "surrogatepass").decode("latin-1")
        n = len(raw)
        length, known, four = self.length, self._fits, self.four
        longest = [0] * n
        for end, token in self.automaton.iter(raw):
            longest[end + 1 - length[token]] = token
        dead: set[int] = set()
        out: list[int] = []
        at, last = 0, -1
        token = longest[0]
        while True:
            end = at + length[token]
            if end not in dead:
                fits = True if last < 0 else known.get(last << PAIR | token)
                if fits is None:
                    fits = self.fits(last, token)
                if fits:
                    out.append(token)
                    if end == n:
                        return b"".join([four[t] for t in out])
                    at, last, token = end, token, longest[end]
                    continue
            token = self.shorter[token]
            while token < 0:
                dead.add(at)
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
                token = self.shorter[token]

    def _encode_piece(self, piece: str) -> bytes:
        word = self._encode_word
        return b"".join([word(w) for w in self.pattern.findall(piece)])

    def _encode_plain(self, text: str) -> Iterator[bytes]:
        if not text:
            return
        if len(text) <= LONG_TEXT:
            # a single space between visible characters always begins a word, so the pieces can be looked up whole
            pieces = text.split(" ") if self.spaces.search(text) is None else self.borders.split(text)
            later = self.later
            yield self.first[pieces[0]] + b"".join([later[p] for p in pieces[1:]])
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while part := list(itertools.islice(found, 100_000)):
            yield b"".join([self._encode_word(w) for w in part])

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; no text has none."""
        if not text:
            return b""
        if self.marks is None or not any(m in text for m in self.special):
            return b"".join(self._encode_plain(text))
        return b"".join(
            self.special[p].to_bytes(4, "little") if k % 2 else b"".join(self._encode_plain(p))
            for k, p in enumerate(self.marks.split(text))
        )

    def decode(self, ids: bytes | None) -> bytes:
        """UTF-8 bytes of ids; an id beyond the vocabulary stands for nothing."""
        every = np.frombuffer(ids or b"", "<u4")
        out = []
        for k in range(0, len(every), 1 << 20):
            part = every[k : k + (1 << 20)].astype(np.int64)
            part = part[part < len(self.parts)]
            size = self.offsets[part + 1] - self.offsets[part]
            ends = np.cumsum(size)
            if len(ends):
                at = np.arange(ends[-1]) + np.repeat(self.offsets[part] - (ends - size), size)
                out.append(self.blob[at].tobytes())
        return b"".join(out)


_loaded: dict[int, Vocabulary] = {}


def vocabulary(spec: bytes) -> Vocabulary:
    """The tables of a vocabulary file, built once in a worker."""
    key = hash(spec)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(spec)
    return _loaded[key]


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file's bytes, for broadcasting (a few megabytes at most, checked)."""
    with open(path, "rb") as f:
        spec = f.read()
    if len(spec) > 64 << 20:
        raise ValueError(f"a vocabulary file of {len(spec)} bytes is too large to broadcast")
    return spec


def text_batches(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of Arrow batches that hold about BATCH_BYTES of text, with the texts.

    At the end Arrow's free memory is given back, as the worker lives on for other tasks.
    """
    batch = texts = part = None
    for batch in batches:
        texts = batch.column(column)
        size = texts.nbytes
        step = max(1, batch.num_rows * BATCH_BYTES // max(1, size))
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            yield part, part.column(column).to_pylist()
    del batch, texts, part
    pa.default_memory_pool().release_unused()


def encode(df: DataFrame, vocabulary_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of ``text`` as a binary column of little-endian unsigned 32-bit integers.

    Null and empty texts get an empty binary; the other columns stay.  A column of the name given
    for the ids is replaced.
    """
    df = df.drop(ids) if ids != text else df
    spec = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches):
        v = vocabulary(spec.value)
        for part, texts in text_batches(batches, text):
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([v.encode(t) for t in texts], pa.binary())], [*part.schema.names, ids]
            )
        v.forget()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(ids, T.BinaryType())]))


def decode(df: DataFrame, vocabulary_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of a binary column of ids; no ids give the empty text, broken UTF-8 a replacement sign."""
    df = df.drop(text) if ids != text else df
    spec = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches):
        v = vocabulary(spec.value)
        for part, rows in text_batches(batches, ids):
            decoded = [v.decode(r).decode("utf-8", "replace") for r in rows]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.string())], [*part.schema.names, text])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]))


def encode_decode(
    df: DataFrame, vocabulary_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Columns ``keep``, the ids of ``text`` and the text decoded from those ids, in one pass over the rows.

    The same as ``decode(encode(df))`` with one Python worker less per task.
    """
    df = df.select(*keep, text)
    spec = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    fields = [f for f in df.schema.fields if f.name in keep]

    def run(batches):
        v = vocabulary(spec.value)
        for part, texts in text_batches(batches, text):
            encoded = [v.encode(t) for t in texts]
            back = [v.decode(e).decode("utf-8", "replace") for e in encoded]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in keep), pa.array(encoded, pa.binary()), pa.array(back, pa.string())],
                [*keep, ids, decoded],
            )
        v.forget()

    schema = T.StructType([*fields, T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])
    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, vocabulary_path: str) -> DataFrame:
    """Digest of encoding and decoding every ``text``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens and the digests of nothing; repeated rows give repeated
    rows; an empty table gives none; other columns are ignored.
    """
    both = encode_decode(df, vocabulary_path, keep=("doc_id",))
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
