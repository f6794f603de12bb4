"""Quality classifier by supervised subword embeddings.

Each word and each character n-gram inside a word (with its borders) is hashed to a bucket that has a learned vector.
A document is the average of the vectors of all its words and n-grams; a softmax over two classes gives the score.
Vectors and output weights are trained by stochastic gradient descent in numpy, on the driver, on a sample of labelled
rows that is bounded in rows and bytes. A trained model is linear in the averaged buckets, so scoring looks up one
number for each feature: the vector's product with the difference of the two output rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shingles import word_hashes

#: Buckets (a power of two), dimensions, and lengths of n-grams in bytes of UTF-8.
BUCKETS, DIM, NGRAMS = 1 << 17, 8, (2, 3, 4, 5)
#: Bound of the training sample: labelled rows, and bytes of a text that may be in it.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 32_000
#: Passes over the sample, step sizes of the output layer and the vectors, seed.
EPOCHS, STEP, VECTOR_STEP, SEED = 6, 0.5, 400.0, 7
#: Bytes of a text whose n-grams are read at once.
PIECE = 1 << 20
#: Bucket of a word that repeats the one before it, and how often it counts beside a word's n-grams.
REPEATED, REPEAT_WEIGHT = 0, 8
#: Features without a say that are added to each text, so that a few words alone decide little.
PRIOR = 200

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CLEAN = np.arange(256, dtype=np.uint64)
_CLEAN[_SPACE] = 0x20


def features(text: bytes, piece: int = PIECE) -> Iterator[np.ndarray]:
    """Buckets of all words, n-grams and repetitions; the same ones whatever the pieces that n-grams are read in."""
    whole = b" " + text + b" "
    longest = max(NGRAMS)
    for at in range(0, len(whole), piece):
        # a piece's n-grams begin in it and may end after it
        raw = np.frombuffer(whole, np.uint8, min(piece + longest - 1, len(whole) - at), at)
        data, space = _CLEAN[raw], _SPACE[raw]
        h = np.zeros(len(data), np.uint64)
        inner = np.zeros(len(data) + 1, np.int32)
        np.cumsum(space, out=inner[1:])
        with np.errstate(over="ignore"):
            for n in range(1, longest + 1):
                if len(data) < n:
                    break
                h = h[: len(data) - n + 1] * np.uint64(0x100000001B3) + data[n - 1 :] + np.uint64(1)
                if n in NGRAMS:
                    # no white space inside; a border may be white space, but not all of it
                    kept = inner[n - 1 : n - 1 + len(h)] == inner[1 : 1 + len(h)] if n > 2 else ~(space[:-1] & space[1:])
                    yield _bucket(h[:piece][kept[:piece]])
    words = word_hashes(text)
    yield _bucket(words)
    # the bigram of a word and itself is one feature, whatever the word
    yield np.full(REPEAT_WEIGHT * int((words[1:] == words[:-1]).sum()), REPEATED)


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """gain: each bucket's part of the log-odds of class 1; bias: theirs without features."""

    gain: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """Probability of class 1; that of the bias alone for a null or empty text."""
        total, n = 0.0, 0
        for found in features((text or "").encode()):
            total += float(self.gain[found].sum(dtype=np.float64))
            n += len(found)
        return float(1 / (1 + np.exp(-np.clip(self.bias + total / (n + PRIOR), -50, 50))))


class Bags:
    """The features of texts, each once with its part, in large arrays; thousands of small ones would stay with the driver when they are gone."""

    # so large that the system gets them back when they are gone; only what is filled takes memory
    SIZE = 10_000_000

    def __init__(self) -> None:
        self.chunks: list[tuple[np.ndarray, np.ndarray]] = []
        self.places: list[tuple[int, int, int]] = []
        self.used = self.SIZE

    def __len__(self) -> int:
        return len(self.places)

    def add(self, found: np.ndarray) -> None:
        ids, counts = np.unique(found, return_counts=True)
        if not self.chunks or self.used + len(ids) > len(self.chunks[-1][0]):
            size = max(self.SIZE, len(ids))
            self.chunks.append((np.empty(size, np.int32), np.empty(size, np.float32)))
            self.used = 0
        at, self.used = self.used, self.used + len(ids)
        own_ids, parts = self.chunks[-1]
        own_ids[at : self.used], parts[at : self.used] = ids, counts / (counts.sum() + PRIOR)
        self.places.append((len(self.chunks) - 1, at, self.used))

    def get(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        chunk, at, end = self.places[i]
        return self.chunks[chunk][0][at:end], self.chunks[chunk][1][at:end]


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Fit vectors and output weights. With one class only, the model is that class's smoothed share."""
    y = np.array(labels, np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (2, DIM)).astype(np.float32), np.log([1 - share, share])
    if len(set(labels)) == 2:
        bags = Bags()
        for text in texts:
            bags.add(np.concatenate(list(features(text.encode()))))
        steps, done = epochs * len(bags), 0
        for _ in range(epochs):
            for i in rng.permutation(len(bags)):
                ids, part = bags.get(i)
                rate = 1 - done / steps
                done += 1
                rows = vectors[ids]
                mean = part @ rows
                z = out @ mean + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1
                back = p.astype(np.float32) @ out
                out -= (STEP * rate * np.outer(p, mean)).astype(np.float32)
                bias -= STEP * 0.02 * rate * p
                vectors[ids] = rows - np.outer(np.minimum(VECTOR_STEP * part, 1.0) * rate, back)
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(id_col: Column) -> Column:
    """Rows never learned from: the CRC-32 of the id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Train on at most `rows` labelled documents, by a hash of their ids, that are not held out.

    Texts over most_bytes are not learned from (they are scored like others). Null labels, labels without a document
    and null ids are ignored; of labels or documents that repeat an id, one is taken. No labels: every score is 0.5.
    """
    own = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    picked = own.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select(F.col("doc_id"), F.col("text")).where(F.octet_length("text") <= most_bytes).join(F.broadcast(picked), "doc_id")
    found = found.groupBy("doc_id").agg(F.max("y").alias("y"), F.max("text").alias("text")).orderBy("doc_id").toArrow()
    return train(found["text"].to_pylist(), found["y"].to_pylist())


def score(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted (1 if score >= cut). Whole texts are read.

    Null and empty texts get the model's prior; an empty table gives an empty result. Equal texts have equal scores,
    rows that repeat an id or a text are scored each, in no order. Only doc_id and text are read, so other columns cannot clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = pa.array([model.score(x.as_py()) for x in batch.column(2)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], ["doc_id", "held_out", "score"])

    scored = own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_good(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """The rows of docs that score at least cut, with all their columns; repeated rows stay or go together."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(x.as_py()) >= cut for x in texts], pa.bool_())

    return docs.where(good(F.coalesce(docs["text"], F.lit(""))))
