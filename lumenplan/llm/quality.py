"""Document quality from random-indexing word vectors and a small neural network.

Every word gets a sparse random index vector.  A word's vector is the sum of the index vectors of its
neighbours over the whole corpus; words are hashed into a fixed number of rows, so what is gathered
and broadcast has a fixed size.  A document is the mean and the spread of its words' vectors.  A
network of two layers, trained in numpy on a bounded sample of labelled documents, turns that into a
probability, and a temperature fitted on rows left out of training calibrates it.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import text_batches

#: Rows and columns of the word-vector table, and non-zero entries of an index vector.
ROWS, DIMS, NONZERO = 1 << 15, 32, 4
#: Neighbours on either side.  Each word stands in the sequence as its form and its letters.
WINDOW = 2
#: Labelled documents that the network is trained on, at most.
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE = 32, 40, 128, 0.004
THRESHOLD = 0.3
#: Words whose rows a worker remembers; it only saves time.
CACHED_WORDS = 300_000
#: Words that are pooled at a time.
CHUNK = 1 << 17

_EDGE = re.compile(r"^(\W*)(.*?)(\W*)$", re.DOTALL)


def _row(text: str) -> int:
    return 1 + zlib.crc32(text.encode("utf-8", "replace")) % (ROWS - 1)


def _form(word: str) -> str:
    """Case, length class and punctuation of a word."""
    before, core, after = _EDGE.match(word).groups()
    case = "U" if core.isupper() else "l" if core.islower() else "T" if core.istitle() else "d" if core.isdigit() else "m"
    return f"{case}{min(len(core), 24) // 4}{before[:4]}\t{after[:4]}"


class _Rows(dict):
    def __missing__(self, word: str) -> bytes:
        pair = np.array([_row("\n" + _form(word)), _row(word.lower().strip("!?.,;:*#$%&|\"'()[]{}-_"))], "<u4").tobytes()
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = pair
        return pair


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of every row's index vector."""
    random = np.random.default_rng(20)
    return random.integers(0, DIMS, (ROWS, NONZERO)), random.choice([-1.0, 1.0], (ROWS, NONZERO))


def word_rows(text: str | None, known: _Rows) -> np.ndarray:
    """Rows of a text's words, form and letters in turn; ``known`` remembers words for the length of a task."""
    return np.frombuffer(b"".join([known[w] for w in (text or "").split()]), "<u4")


def _word_vector_sums(df: DataFrame, text: str) -> DataFrame:
    """Per row of the table the sum of its neighbours' index vectors, over all documents."""
    names = [f"d{k}" for k in range(DIMS)]

    def run(batches):
        places, signs = index_vectors()
        total = np.zeros(ROWS * DIMS)
        known = _Rows()
        seen = False
        for _, texts in text_batches(batches, text):
            seen = True
            rows = np.concatenate([x for t in texts for x in (word_rows(t, known), [0])]).astype(np.int64)
            for gap in range(1, WINDOW + 1):
                for a, b in ((rows[:-gap], rows[gap:]), (rows[gap:], rows[:-gap])):
                    for k in range(NONZERO):
                        total += np.bincount(a * DIMS + places[b, k], signs[b, k], minlength=ROWS * DIMS)
        if seen:
            table = total.reshape(ROWS, DIMS).astype(np.int64)
            used = np.flatnonzero(table.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(c) for c in table[used].T)], ["row", *names])

    schema = T.StructType([T.StructField(n, T.LongType()) for n in ["row", *names]])
    return df.select(text).mapInArrow(run, schema).groupBy("row").agg(*[F.sum(n).alias(n) for n in names])


@dataclass
class Model:
    words: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def pool(self, text: str | None, known: _Rows) -> np.ndarray:
        """Mean and spread of the word vectors; zeros for a text without words."""
        rows = word_rows(text, known)
        total, squares = np.zeros(DIMS), np.zeros(DIMS)
        for k in range(0, len(rows), CHUNK):
            part = self.words[rows[k : k + CHUNK]]
            total += part.sum(0, dtype=np.float64)
            squares += np.einsum("ij,ij->j", part, part, dtype=np.float64)
        n = max(1, len(rows))
        centre = total / n
        return np.concatenate([centre, np.sqrt(np.maximum(squares / n - centre**2, 0))])

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_logits(self.layers, (pooled - self.mean) / self.scale) / self.temperature, -40, 40)))


def _logits(layers: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return (np.tanh(x @ w1 + b1) @ w2 + b2)[:, 0]


def _train(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """A two-layer network by Adam on the logistic loss."""
    random = np.random.default_rng(5)
    layers = [random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    epochs = max(1, min(EPOCHS, 4_000 * BATCH // max(1, len(x)) + 8))
    for _ in range(epochs):
        order = random.permutation(len(x))
        for k in range(0, len(x), BATCH):
            at = order[k : k + BATCH]
            h = np.tanh(x[at] @ layers[0] + layers[1])
            off = (1 / (1 + np.exp(-np.clip((h @ layers[2] + layers[3])[:, 0], -40, 40))) - y[at])[:, None] / len(at)
            back = off @ layers[2].T * (1 - h**2)
            slopes = [x[at].T @ back + 1e-4 * layers[0], back.sum(0), h.T @ off + 1e-4 * layers[2], off.sum(0)]
            step += 1
            for w, g, m, v in zip(layers, slopes, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return layers


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least logistic loss."""
    if not len(y):
        return 1.0
    choices = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
    losses = [np.logaddexp(0, np.where(y > 0, -1, 1) * logits / t).mean() for t in choices]
    return float(choices[int(np.argmin(losses))])


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows whose labels are never learnt."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """Word vectors of all documents and a network from at most ``sample`` labelled rows that aren't held out.

    Without labelled rows every document scores 0.5; with labels of one kind only, near that label.
    """
    words = np.zeros((ROWS, DIMS))
    for r in _word_vector_sums(docs, text).toLocalIterator():
        words[r[0]] = r[1:]
    norm = np.linalg.norm(words, axis=1, keepdims=True)
    words = (words / np.where(norm > 0, norm, 1)).astype(np.float32)
    blank = [np.zeros((2 * DIMS, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.zeros(1)]
    model = Model(words, np.zeros(2 * DIMS), np.ones(2 * DIMS), blank, 1.0)

    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def pooled(batches):
        known = _Rows()
        for part, texts in text_batches(batches, text):
            x = np.stack([shared.value.pool(t, known) for t in texts])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("quality"), pa.FixedSizeListArray.from_arrays(x.ravel(), x.shape[1]).cast(pa.list_(pa.float64()))],
                ["doc_id", "quality", "x"],
            )

    labelled = docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", text)
    rows = labelled.mapInArrow(pooled, "doc_id long, quality int, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas()
    if len(rows):
        x, y = np.stack(rows.x), rows.quality.to_numpy(float)
        model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = (x - model.mean) / model.scale
        rest = np.arange(len(z)) % 5 == 4
        model.layers = _train(z[~rest], y[~rest])
        model.temperature = _temperature(_logits(model.layers, z[rest]), y[rest])
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns ``keep`` (all if None) and the probability that a document is of good quality."""
    df = docs.drop(out)
    kept = list(df.columns if keep is None else keep)
    df = df.select(*dict.fromkeys([*kept, text]))
    fields = [f for f in df.schema.fields if f.name in kept]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = _Rows()
        for part, texts in text_batches(batches, text):
            p = shared.value.probability(np.stack([shared.value.pool(t, known) for t in texts])) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(p)], [*(f.name for f in fields), out])

    return df.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.DoubleType())]))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from a score of 0.3 on).

    Null, empty and blank texts are documents without words and are scored as such; repeated rows get
    the same score; labels of unknown documents and null labels are not used; other columns are
    ignored; an empty table gives none.
    """
    scored = score(docs, fit(docs, labels), keep=("doc_id",))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score of 0.3 or more; all columns stay, whatever their names.

    Null, empty and blank texts are scored as documents without words; repeated rows stay or go
    together; without labels every document scores 0.5 and stays; an empty table gives none.
    """
    out = "_score" + "_" * max([len(c) for c in docs.columns])  # no column has this name
    return score(docs, fit(docs, labels), out=out).where(F.col(out) >= THRESHOLD).drop(out)
