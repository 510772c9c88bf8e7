"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a word are a doubly linked list, and its adjacent pairs that have a merge lie in a heap
by rank and place.  The pair of lowest rank is popped and merged until none is left; an entry whose
pair has changed meanwhile is passed over.  The count is the number of bytes less the number of
merges.  No identifiers of tokens are made: symbols are numbered here, single bytes by their value.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe

#: Bits that hold a symbol's number, and a place in a word.
SYMBOL, PLACE = 21, 40
_NUMBER, _AT = (1 << SYMBOL) - 1, (1 << PLACE) - 1


class MergeTable:
    """Ranks of the merges of one byte-level vocabulary file, and counts of texts by them."""

    def __init__(self, spec: bytes):
        data = json.loads(spec)
        if data["model"]["type"] != "BPE" or (data.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("token counts need a vocabulary of byte-level BPE")
        alphabet = bpe._byte_alphabet()
        number = {bytes([b]): b for b in range(256)}
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = (bytes(alphabet[c] for c in t) for t in (pair if isinstance(pair, list) else pair.split(" ")))
            both = number.setdefault(a + b, len(number))
            self.merges[number[a] << SYMBOL | number[b]] = rank << SYMBOL | both
        special = [t["content"] for t in data["added_tokens"]]
        self.marks = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.words = regex.compile(bpe.WORDS)
        self.two_spaces = regex.compile(r"\s\s")
        # a text without two white spaces in a row is cut at its spaces; all pieces but the first begin with one
        self.first = bpe._Remembered(self._count_words)
        self.later = bpe._Remembered(lambda piece: self._count_words(" " + piece))

    def forget(self) -> None:
        """Drop what was remembered of texts, at the end of a task."""
        for pieces in (self.first, self.later):
            pieces.clear()
            pieces.older = {}

    def count_symbols(self, raw: bytes) -> int:
        """Symbols that are left of the bytes of one word when no pair can be merged any more."""
        n = left = len(raw)
        merge = self.merges.get
        symbol = list(raw)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [m >> SYMBOL << PLACE | at for at in range(n - 1) if (m := merge(symbol[at] << SYMBOL | symbol[at + 1])) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            at = top & _AT
            gone = after[at]
            if symbol[at] < 0 or gone == n:
                continue
            m = merge(symbol[at] << SYMBOL | symbol[gone])
            if m is None or m >> SYMBOL != top >> PLACE:
                continue
            symbol[at], symbol[gone] = m & _NUMBER, -1
            after[at] = right = after[gone]
            left -= 1
            if right < n:
                before[right] = at
                m = merge(symbol[at] << SYMBOL | symbol[right])
                if m is not None:
                    heappush(heap, m >> SYMBOL << PLACE | at)
            start = before[at]
            if start >= 0:
                m = merge(symbol[start] << SYMBOL | symbol[at])
                if m is not None:
                    heappush(heap, m >> SYMBOL << PLACE | start)
        return left

    def _count_words(self, piece: str) -> int:
        return sum([self.count_symbols(w.encode("utf-8", "surrogatepass")) for w in self.words.findall(piece)])

    def _count_plain(self, text: str) -> int:
        if len(text) <= bpe.LONG_TEXT and self.two_spaces.search(text) is None:
            pieces = text.split(" ")
            later = self.later
            return self.first[pieces[0]] + sum([later[p] for p in itertools.islice(pieces, 1, None)])
        first = self.first
        return sum(first[m.group()] for m in self.words.finditer(text))

    def count(self, text: str | None) -> int:
        """Tokens of a text; a special string in it is one token, no text has none."""
        if not text:
            return 0
        if self.marks is None or self.marks.search(text) is None:
            return self._count_plain(text)
        total, at = 0, 0
        for mark in self.marks.finditer(text):
            total += 1 + (self._count_plain(text[at : mark.start()]) if mark.start() > at else 0)
            at = mark.end()
        return total + (self._count_plain(text[at:]) if at < len(text) else 0)


_loaded: dict[bytes, MergeTable] = {}


def _table(spec: bytes) -> MergeTable:
    """The merges of a vocabulary file, read once in a worker."""
    if spec not in _loaded:
        _loaded.clear()
        _loaded[spec] = MergeTable(spec)
    return _loaded[spec]


def _with_counts(df: DataFrame, vocabulary_path: str, text: str, kept: list[str], out: str) -> DataFrame:
    """Columns ``kept`` and the token count of ``text`` as ``out``, without a shuffle."""
    spec = df.sparkSession.sparkContext.broadcast(bpe.read_vocabulary(vocabulary_path))
    df = df.select(*kept, F.col(text).alias("_text")) if "_text" not in kept else df.select(*kept, F.col(text).alias("_text_"))
    held = df.columns[-1]

    def run(batches):
        table = _table(spec.value)
        for part, texts in bpe.text_batches(batches, held):
            counts = pa.array([table.count(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], counts], [*kept, out])
        table.forget()

    return df.mapInArrow(run, T.StructType([*df.schema.fields[:-1], T.StructField(out, T.LongType())]))


def add_counts(df: DataFrame, vocabulary_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of ``text`` by a byte-level BPE file, without begin or end tokens.

    Null and empty texts have 0; a special string inside a text is one token; repeated rows give
    repeated rows; an empty table gives none; a column of the name ``out`` is replaced.
    """
    return _with_counts(df, vocabulary_path, text, [c for c in df.columns if c != out], out)


def report(df: DataFrame, vocabulary_path: str, limit: int = 512, key: str = "doc_id", text: str = "text", measure: Callable = F.octet_length) -> DataFrame:
    """One row per document: ``key``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    A null text counts as the empty one: 0 bytes, 0 tokens, not over the limit.  Rows without a key
    and repeated rows stay; an empty table gives none; other columns are ignored.
    """
    sized = df.select(F.col(key).alias("_key"), F.coalesce(measure(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("_text"))
    counted = _with_counts(sized, vocabulary_path, "_text", ["_key", "n_bytes"], "n_tokens")
    return counted.select(F.col("_key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
