"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashed words, word pairs, pairs with one word between them and
beginnings of words, each of value 1. FTRL keeps a learning rate for each coordinate, and its L1 term leaves most
weights at zero, so what tasks receive is a few thousand numbers, 2 ** BITS at most.

Learns from a bounded sample of labelled rows (`sample` rows, those of smallest hash), never from
held-out ones; features of these rows are made on the executors. Null and empty texts get the score
of the bias alone. Without labelled rows every score is 0. Repeated rows each get a row; a document
with several labels teaches each; repeated rows teach once. An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, checkpointed, hash_below, held_out, mixed, table

BITS = 18
#: Bytes of a word's beginning that count as features too: inflected and compound words share these.
STEMS = (5, 7)
#: Labelled documents that the weights are fitted on at most, and features of theirs in all (4 bytes each in the driver).
SAMPLE, SAMPLE_NUMBERS = 6000, 1 << 24
#: Scores from here on are predicted toxic.
THRESHOLD = 0.3

SCORED = T.DoubleType()
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Hashed words, pairs, skip-pairs and word beginnings, repeats included."""
    found = text.encode("utf-8", "surrogatepass").translate(_LETTERS).split() if text else []
    h = mixed(hashes.of(found))
    stems = [mixed(hashes.of([w[:k] for w in found]) + np.uint64(k)) for k in STEMS]
    pair, skip = mixed(h[:-1] * np.uint64(3) + h[1:]), mixed(h[:-2] * np.uint64(5) + h[2:])
    return (np.concatenate([h, pair, skip, *stems]) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; the bias is the last coordinate and has no L1 term."""

    def __init__(self, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1):
        self.alpha, self.beta, self.l2 = alpha, beta, l2
        self.l1 = np.full((1 << bits) + 1, l1)
        self.l1[-1] = 0
        self.z, self.n = np.zeros(len(self.l1)), np.zeros(len(self.l1))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, l1 = self.z[at], self.l1[at]
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, found: np.ndarray, label: int) -> None:
        at = np.append(found, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(rows: list[tuple[np.ndarray, int]], passes: int = 6, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(coordinates, weights, bias) of the weights that aren't zero."""
    if not rows:
        return None
    model, rng = Ftrl(), np.random.default_rng(seed)
    for _ in range(passes):
        for k in rng.permutation(len(rows)):
            model.learn(*rows[k])
    w = model.weights()
    at = np.flatnonzero(w[:-1])
    return at, w[at].astype(np.float32), float(w[-1])


@F.pandas_udf(T.BinaryType())
def distinct_features(texts: pd.Series) -> pd.Series:
    """32-bit numbers, as bytes: the driver keeps 4 bytes a feature."""
    hashes = WordHashes()
    return pd.Series([np.unique(features(t if isinstance(t, str) else None, hashes)).astype("<i4").tobytes() for t in texts])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, numbers: int = SAMPLE_NUMBERS) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Train on at most `sample` labelled documents whose ids are not held out, and on so many features of theirs in all."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.where(hash_below(known, sample)).distinct().orderBy(F.xxhash64("doc_id"), "toxic").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").withColumn("h", F.xxhash64("doc_id", "text"))
    # However often rows repeat, so many texts and labels of smallest hash.
    last = found.select("h", "toxic").distinct().orderBy("h", "toxic").limit(sample).agg(F.max("h")).first()[0]
    once = found.where(F.col("h") <= F.lit(last)).groupBy("h", "toxic").agg(F.first("text").alias("text"))
    made = checkpointed(once.select("h", "toxic", distinct_features("text").alias("found")))
    sizes = made.select("h", F.octet_length("found").alias("n")).orderBy("h").collect()  # `sample` pairs of numbers
    total = np.cumsum([r["n"] // 4 for r in sizes])
    fits = [r["h"] for r, n in zip(sizes, total, strict=True) if n <= numbers]
    rows = made.where(F.col("h") <= (fits[-1] if fits else -(2**63))).collect()
    rows.sort(key=lambda r: (r["h"], r["toxic"]))
    return train([(np.frombuffer(r["found"], dtype="<i4"), int(r["toxic"] > 0)) for r in rows])


def scored(model: tuple[np.ndarray, np.ndarray, float] | None):
    """A Pandas UDF: whole text -> score."""

    @F.pandas_udf(SCORED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes, w = WordHashes(), np.zeros(1 << BITS, dtype=np.float32)
        bias = -np.inf
        if model is not None:
            w[model[0]], bias = model[1], model[2]
        for batch in batches:
            sums = np.full(len(batch), bias)
            for k, text in enumerate(batch):
                found = features(text if isinstance(text, str) else None, hashes)
                sums[k] += w[np.unique(found[w[found] != 0])].sum(dtype=np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums, -700, 700))) if model is not None else np.zeros(len(batch)))

    return run


def score(docs: DataFrame, labels: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None = None) -> DataFrame:
    """doc_id and score of every whole text; fits on `labels` if no model is given."""
    model = model or fit(docs, labels)
    return docs.select("doc_id", scored(model)(F.col("text")).alias("score"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
