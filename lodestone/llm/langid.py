"""Language proportions of a document by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, with_computed
from .ngrams import text_bytes

BITS = 15
#: At most so many documents of each language are learned from, chosen by a hash of their ids.
TRAIN_ROWS = 400
ROUNDS = 12
#: What a further language must gain in log-likelihood: this times the logarithm of the number of n-grams.
PENALTY = 6.0
#: A character's bytes and neighbours make n-grams overlap; a language must hold this share to count at all.
LEAST_SHARE = 0.02
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    langs: list[str]
    likelihood: np.ndarray  #: 2^BITS rows, a column for each language


def grams(raw: np.ndarray) -> np.ndarray:
    """Hashed trigrams of the lower-cased bytes, with a space before and after the text."""
    low = np.concatenate([[32], np.where((raw >= 65) & (raw <= 90), raw + 32, raw), [32]]).astype(np.uint64)
    x = (low[:-2] << np.uint64(16) | low[1:-1] << np.uint64(8) | low[2:]) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def train(docs: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Smoothed n-gram likelihoods of every non-null language, from ``rows`` documents of each at most.

    The chosen documents are those least by a hash of their ids. How many documents a language has tells below which
    hash about eight times ``rows`` of them lie; only these are ranked, so a common language gathers no more rows than a
    rare one. Texts are counted where they lie, and what leaves a task is one count vector per language. The model has
    a fixed size for each language.

    Rows whose language, text or id is null teach nothing. Equal hashes are ordered by id; of an id's rows with one
    language all texts count if it is chosen, whether repeated or different, and it may be chosen under several
    languages. An empty table gives a model without languages. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    named = usable.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_l"), F.col(text_col).cast("string").alias("_t"))
    share = F.broadcast(named.groupBy("_l").agg(F.count("_id").alias("_n")).withColumn("_below", F.lit(8.0 * rows) / F.col("_n")))
    low = named.select("_id", "_l", F.xxhash64(F.col("_id").cast("string")).alias("_o")).join(share, "_l").where((F.col("_o") / 2.0**64 + 0.5) < F.col("_below"))
    rank = F.dense_rank().over(Window.partitionBy("_l").orderBy("_o", "_id"))
    picked = low.withColumn("_r", rank).where(F.col("_r") <= rows).select("_id", "_l").distinct()
    sample = named.join(F.broadcast(picked), ["_id", "_l"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            raw, at = text_bytes(b.column(1))
            for i, lang in enumerate(b.column(0).to_pylist()):
                counts.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                counts[lang] += np.bincount(grams(raw[at[i] : at[i + 1]]), minlength=1 << BITS)
        for lang, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([c.astype("<i8").tobytes()], pa.binary())], ["lang", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + np.frombuffer(c, "<i8")
        for lang, c in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([c.tobytes()], pa.binary())], ["lang", "counts"])

    parts = sample.select("_l", "_t").mapInArrow(count, "lang string, counts binary")
    found = {r["lang"]: np.frombuffer(r["counts"], "<i8") for r in parts.repartition("lang").mapInArrow(add, "lang string, counts binary").collect()}
    langs = sorted(found)
    if not langs:
        return Model([], np.zeros((1 << BITS, 0)))
    c = np.stack([found[x] for x in langs], axis=1) + 0.05
    return Model(langs, c / c.sum(axis=0))


def proportions(count: np.ndarray, like: np.ndarray, start: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Mixture weights of the languages after some rounds of expectation-maximisation, and the log-likelihood."""
    share, n = start, count.sum()
    for _ in range(rounds):
        share = (count / (like @ share)) @ like * share / n
    return share, float(count @ np.log(like @ share))


def infer(text: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The selected set of languages and their proportions, largest first.

    All languages are fitted together first. Then sets of the 1, 2, … largest are compared: a further language stays
    only if it raises the log-likelihood by more than the penalty.
    """
    hashed = np.bincount(grams(text), minlength=1 << BITS)
    at = np.flatnonzero(hashed)
    count, like = hashed[at].astype(np.float64), model.likelihood[at]
    k = like.shape[1]
    share, _ = proportions(count, like, np.full(k, 1.0 / k))
    order = np.argsort(-share, kind="stable")
    price = PENALTY * math.log(count.sum() + 1)
    single = count @ np.log(like)
    first = int(np.argmax(single))
    chosen, best = np.array([first]), float(single[first])
    weights = np.ones(1)
    for size in range(2, k + 1):
        if share[order[size - 1]] < LEAST_SHARE:
            break
        w, total = proportions(count, like[:, order[:size]], share[order[:size]] / share[order[:size]].sum())
        if total - best <= price * (size - len(chosen)):
            break
        chosen, best, weights = order[:size], total, w
    falling = np.argsort(-weights, kind="stable")
    return chosen[falling], np.minimum(1.0, weights[falling])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (the language's proportion) and languages, from the whole text.

    languages is the selected set with its proportions, largest first: an array of (lang, share); lang_pred and score
    are its first entry. A null text, one without a letter, or a model without languages gives ``und``, 0 and no
    languages. Columns of these names are replaced; each row stands alone. An empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    made = {"lang_pred": "string", "score": "double", "languages": "array<struct<lang: string, share: double>>"}
    at = [c for c in docs.columns if c.lower() not in made].index(text_col)

    def found(b: pa.RecordBatch) -> list[pa.Array]:
        m = shared.value
        raw, starts = text_bytes(b.column(at))
        sets: list[list[dict]] = []
        for i, text in enumerate(b.column(at).to_pylist()):
            some = zip(*infer(raw[starts[i] : starts[i + 1]], m), strict=True) if m.langs and _LETTER.search(text or "") else ()
            sets.append([{"lang": m.langs[k], "share": float(w)} for k, w in some])
        return [
            pa.array([s[0]["lang"] if s else UNKNOWN for s in sets], pa.string()), pa.array([s[0]["share"] if s else 0.0 for s in sets], pa.float64()),
            pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
        ]

    return with_computed(docs, found, **made)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
