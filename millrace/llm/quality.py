"""Quality classifier: averaged hashed word and character n-gram vectors under a softmax, fitted by SGD in numpy.

Features of a text: every word, every pair of neighbouring words (pairs of equal words share one bucket), and every
run of 3 and of 4 characters. Each is hashed into one of BUCKETS learned vectors; a document is the mean of its
vectors, and a softmax over it gives the class. Scoring folds vectors and output into one number per bucket, which is
the same model. Only the fit is bounded: it sees at most sample labelled rows (whole texts), half of them per class.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
DIM = 8
#: Labelled rows that a fit sees at most.
SAMPLE = 3000
EPOCHS, RATE, SEED = 12, 2.0, 11
#: A longer text is read in parts of about this many characters, cut at blanks.
PART_CHARS = 1 << 18

_BASE = np.uint64(0x100000001B3)
_BACK = np.uint64(pow(0x100000001B3, -1, 2**64))
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - BUCKET_BITS)
_REPEAT = 0
_BLANK = re.compile(r"[\x20\x09-\x0D]")
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = 1 << (n + 1).bit_length()
        for i, base in enumerate((_BASE, _BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * _SPREAD) >> _SHIFT).astype(np.int64)


def features(text: str) -> Iterator[np.ndarray]:
    """The buckets of a text's features, repeats included, part by part; nothing for an empty text.

    A part knows the last word and the last three characters before it, so that parts change no feature."""
    at, last, before = 0, None, ""
    while at < len(text):
        end = len(text)
        if end - at > PART_CHARS:
            m = _BLANK.search(text, at + PART_CHARS)
            end = m.end() if m else end
        part = text[at:end]
        lead = np.frombuffer((before + part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        chars = lead[len(before) :]
        n = len(chars)
        up, down = _power_tables(n)
        blank = (chars == 33) | ((chars >= 10) & (chars <= 14))  # space and control blanks, plus 1
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
        start, stop = edge[::2], edge[1::2]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(chars * up[:n], dtype=np.uint64)))
        words = (sums[stop] - sums[start]) * down[start]
        line = words if last is None else np.concatenate((last, words))
        pairs = line[:-1] * np.uint64(31) + line[1:] * np.uint64(17) + np.uint64(7)
        paired = np.where(line[:-1] == line[1:], _REPEAT, _bucket(pairs))
        threes = (lead[:-2] * _BASE + lead[1:-1]) * _BASE + lead[2:] if len(lead) >= 3 else np.zeros(0, np.uint64)
        fours = threes[:-1] * _BASE + lead[3:] if len(lead) >= 4 else np.zeros(0, np.uint64)
        yield np.concatenate((_bucket(words), paired, _bucket(threes[max(0, len(before) - 2) :]), _bucket(fours)))
        last, before, at = line[-1:] if len(line) else None, (before + part)[-3:], end


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text, ascending, and how often each stands."""
    found = np.zeros(BUCKETS, np.int64)
    for part in features(text):
        found += np.bincount(part, minlength=BUCKETS)
    buckets = np.flatnonzero(found)
    return buckets, found[buckets]


@dataclass(frozen=True)
class Model:
    """weight: what a bucket adds to the log-odds of class 1 when it is all of the text; offset: the log-odds of none."""

    weight: np.ndarray
    offset: float

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for part in features(text or ""):
            total += float(self.weight[part].sum(dtype=np.float64))
            n += len(part)
        odds = self.offset + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(odds, -40, 40))))


def held_out(key: Column) -> Column:
    """Rows that no fit may see: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, key: str, label: str) -> tuple[pd.DataFrame, float]:
    """buckets, counts and label of at most sample rows, chosen by hash among the labelled rows that aren't held out,
    half per class; and the log-odds of class 1 among all of these. The features are counted where the rows are."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(key)) & F.col(key).isNotNull())
    known = known.groupBy(F.col(key).alias("_mr_key")).agg(F.max(label).cast("int").alias("_mr_label"))
    sizes = {r["_mr_label"]: r["count"] for r in known.groupBy("_mr_label").count().collect()}
    # of each class only the hashes that can be among its smallest are ranked: about twice as many as are wanted
    known = known.withColumn("_mr_hash", F.pmod(F.xxhash64("_mr_key"), F.lit(1 << 31)))
    most = F.lit(1 << 31)
    for k, n in sizes.items():
        most = F.when(F.col("_mr_label") == k, F.lit(min(1 << 31, (1 << 31) * (sample + 64) // n))).otherwise(most)
    nth = F.row_number().over(Window.partitionBy("_mr_label").orderBy("_mr_hash", "_mr_key"))
    chosen = known.where(F.col("_mr_hash") <= most).withColumn("_mr_nth", nth).where(F.col("_mr_nth") <= sample // 2)
    chosen = chosen.drop("_mr_hash")  # at most sample rows: may be broadcast
    texts = docs.select(F.col(key).alias("_mr_key"), "text").join(F.broadcast(chosen), "_mr_key")
    # rows that repeat a key count once
    one = texts.groupBy("_mr_key", "_mr_label").agg(F.min("text").alias("text"))

    # as bytes: a list of numbers would take many times the memory on the driver
    @F.pandas_udf("struct<buckets:binary,counts:binary>")
    def counted(column: pd.Series) -> pd.DataFrame:
        pairs = [counts_of(t or "") for t in column]
        return pd.DataFrame({"buckets": [b.astype(np.uint16).tobytes() for b, _ in pairs], "counts": [c.astype(np.int32).tobytes() for _, c in pairs]})

    rows = one.select("_mr_key", F.col("_mr_label").alias("label"), counted("text").alias("f")).select("_mr_key", "label", "f.*")
    found = rows.toPandas().sort_values("_mr_key", kind="stable", ignore_index=True)
    prior = float(np.log((sizes.get(1, 0) + 1) / (sizes.get(0, 0) + 1)))
    return found, prior


def sgd(rows: pd.DataFrame, prior: float) -> Model:
    """Fit vectors and softmax by stochastic gradient descent, a document a step, the rate falling to 0.

    With one class or no rows the model is the prior alone."""
    labels = rows["label"].to_numpy() if len(rows) else np.zeros(0, int)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), prior)
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    output, bias = np.zeros((2, DIM)), np.zeros(2)
    docs = [(np.frombuffer(b, np.uint16), np.frombuffer(c, np.int32)) for b, c in zip(rows["buckets"], rows["counts"])]
    balance = {k: len(labels) / (2 * np.sum(labels == k)) for k in (0, 1)}
    step, steps = 0, EPOCHS * len(docs)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            rate = RATE * (1 - step / steps)
            step += 1
            buckets, counts = docs[i]
            share = counts / max(1, counts.sum())
            mean = share @ vectors[buckets]
            odds = output @ mean + bias
            p = np.exp(odds - odds.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= balance[labels[i]]
            back = p @ output
            output -= rate * np.outer(p, mean)
            bias -= rate * 0.1 * p
            vectors[buckets] -= rate * np.outer(share, back)
    return Model((vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0]) + prior)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", label: str = "quality") -> Model:
    """The model of docs (key, text) and labels (key, label 0 or 1). Other labels and null keys are ignored; a key
    with several labels has the largest, one with several texts the smallest. Empty tables give a constant score."""
    return sgd(*training_rows(docs, labels, sample, key, label))


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Add the score, 0 to 1, of every whole text; null and empty texts get the model's offset alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one float per bucket, whatever the data

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in column], index=column.index, dtype="float64")

    return docs.withColumn(name, score(F.col(text)))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The rows of docs that the model fitted on docs and labels scores least or more, columns unchanged."""
    model = fit(docs, labels)
    return scored(docs, model, name="_mr_score").where(F.col("_mr_score") >= least).drop("_mr_score")
