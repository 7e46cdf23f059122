"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, with_computed
from .ngrams import mix, owners, text_bytes, word_hashes

#: log2 of the number of hashed features.
BITS = 18
#: At most so many labelled documents are learned from, chosen by a hash of their ids, and of these no more than have
#: so many bytes of text together: the model's one task holds their features.
TRAIN_ROWS = 6000
TRAIN_BYTES = 96 << 20
EPOCHS = 4
#: A document's feature values add up to this.
MASS = 40.0


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) for every n-gram occurrence: words, word pairs, and the same over the words' shapes.

    A pair of equal words has a feature of its own.
    """
    raw, at = text_bytes(texts)
    word, start, _, shape = word_hashes(raw, at, shapes=True)
    doc = owners(start, at)
    two = np.flatnonzero(doc[1:] == doc[:-1])
    with np.errstate(over="ignore"):
        pair = lambda h, salt: mix(h[two] * np.uint64(salt) + h[two + 1])
        same = mix((word[two] == word[two + 1]).astype(np.uint64) + np.uint64(77))
        all_hashes = np.concatenate([word, mix(shape + np.uint64(5)), pair(word, 0x632BE59BD9B4E019), pair(shape, 0x9FB21C651E98DF25), same])
    return (all_hashes >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([doc, doc, doc[two], doc[two], doc[two]])


def sparse_rows(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct features and values of every text."""
    f, doc = features(texts)
    order = np.argsort(doc, kind="stable")
    f, bounds = f[order], np.searchsorted(doc[order], np.arange(len(texts) + 1))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        i, n = np.unique(f[a:b], return_counts=True)
        out.append((i, n * (MASS / max(1, b - a))))
    return out


class Ftrl:
    """Per-coordinate follow-the-regularised-leader; the last coordinate is the bias."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, i: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(i)
        g = (sigmoid(w @ x) - label) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def sigmoid(s: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(s, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights (2^BITS and a bias) learned from at most ``rows`` labelled documents.

    The bounded sample is the ``rows`` labels least by a hash of their ids, and in that order as many documents as have
    ``TRAIN_BYTES`` together (one at least); one task learns from them in that order, ``EPOCHS`` times. Labels that are
    null or no 0 or 1, and null ids, are left out. Null texts are empty. Repeated labels of an id count as often as they
    stand there, conflicting ones one after the other, 0 first; of a repeated doc_id every row is learned from with each
    of its labels. Without a usable row all weights are zero. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    order = F.xxhash64(F.col(id_col).cast("string"))
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    chosen = usable.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"), order.alias("_o")).orderBy("_o", "_id", "_y").limit(rows)
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).join(F.broadcast(chosen), "_id").select("_o", "_id", "_y", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, size = [], 0
        for b in batches:
            lengths = pc.binary_length(b.column(3)).fill_null(0).to_pylist()
            for y, n, (i, x) in zip(b.column(2).to_pylist(), lengths, sparse_rows(b.column(3)), strict=True):
                size += n
                if size <= TRAIN_BYTES or not seen:
                    seen.append((y, np.append(i, 1 << BITS).astype(np.int32), np.append(x, 1.0).astype(np.float32)))
        model = Ftrl(1 << BITS)
        for _ in range(EPOCHS):
            for y, i, x in seen:
                model.learn(i, x, y)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f4").tobytes()], pa.binary())], ["w"])

    gathered = sample.repartition(1).sortWithinPartitions("_o", "_id", "_y", F.xxhash64("_t"), "_t")  # a shuffle of the bounded sample
    found = gathered.mapInArrow(run, "w binary").collect()
    return np.frombuffer(found[0]["w"], "<f4") if found else np.zeros((1 << BITS) + 1, dtype="<f4")


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the probability of label 1, from the whole text. An empty or null text has the bias alone.

    A column of that name is replaced; each row stands alone. The weights have a fixed size (1 MB), so they go out by broadcast.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(weights.astype(np.float64))
    at = [c for c in docs.columns if c.lower() != out.lower()].index(text_col)

    def scores(b: pa.RecordBatch) -> list[pa.Array]:
        w = shared.value
        f, doc = features(b.column(at))
        total = np.bincount(doc, weights=w[f], minlength=b.num_rows)
        return [pa.array(sigmoid(w[-1] + MASS * total / np.maximum(1, np.bincount(doc, minlength=b.num_rows))))]

    return with_computed(docs, scores, **{out: "double"})


def learn_rows(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels that may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return labels.where(~held_out(id_col))


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
