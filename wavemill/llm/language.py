"""Language ID: a bidirectional GRU over bytes, trained by backpropagation through time in numpy.

The network gives every byte of a text (A-Z made small; blanks, digits and stops too) a distribution over
languages; a document's probabilities are the mean of the log probabilities of all its positions,
normalised again. Texts are read in windows of WINDOW bytes that overlap: the state runs on through blanks
and words, and a position counts in the window where at least MARGIN bytes stand on both sides of it (fewer
only at the ends of a text). Gates are piecewise linear (a slope that is cut off at 0 and 1, and at -1 and 1),
which costs a few additions where exponentials cost most of the time, and has plain derivatives.

Learns from a bounded sample of labelled rows, the same number of each language (those of smallest
hash), never from held-out ones; PIECES windows are drawn from each whole text. Null texts and texts
without a letter are `und` with score 0. Without any labelled row every document is `und`. Repeated
rows each get a row; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, give_back, held_out, table

UNKNOWN = "und"
#: Labelled documents that the model is fitted on at most (one of each language at least), and windows drawn from each.
SAMPLE, PIECES = 1500, 60
#: Bytes of a window that is learned from; of one that is read, and of its ends that only give context.
LEARNED, WINDOW, MARGIN = 48, 256, 16
HIDDEN, EMBED = 8, 8
#: Windows that the network reads at once.
ROWS = 1024
#: A to Z become small.
_SMALL = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def lettered(text: str) -> bool:
    return any(map(str.isalpha, text))


def small_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_SMALL) if text else b""


def windows(size: int) -> list[tuple[int, int, int, int]]:
    """(start, stop, first, last) of the windows of a text of so many bytes; positions from first to before last count in it."""
    step, out, start = WINDOW - 2 * MARGIN, [], 0
    while True:
        stop = min(start + WINDOW, size)
        out.append((start, stop, start + MARGIN if start else 0, stop - MARGIN if stop < size else size))
        if stop == size:
            return out
        start += step


class BiGru:
    """Embedding of 257 symbols (256 bytes and padding), a GRU in each direction, softmax at every position."""

    def __init__(self, languages: list[str], rng: np.random.Generator, hidden: int = HIDDEN, embed: int = EMBED):
        self.languages, self.hidden = languages, hidden
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"E": draw(257, embed) * 4, "V": draw(2 * hidden, len(languages)), "c": np.zeros(len(languages), np.float32)}
        for way in "fb":
            self.p |= {f"W{way}": draw(embed, 3 * hidden), f"U{way}": draw(hidden, 3 * hidden), f"b{way}": np.zeros(3 * hidden, np.float32)}

    def _run(self, way: str, x: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, list]:
        """States (steps, rows, hidden) of one direction, and what each step had; padded steps hold the state."""
        n, d = len(x), self.hidden
        h, kept, u = np.zeros((n, d), np.float32), [], self.p[f"U{way}"]
        states = np.empty((x.shape[1], n, d), self.p["E"].dtype)
        table_ = self.p["E"] @ self.p[f"W{way}"] + self.p[f"b{way}"]
        for t in range(x.shape[1]) if way == "f" else range(x.shape[1] - 1, -1, -1):
            a, i = h @ u, table_[x[:, t]]
            gates = np.clip(np.float32(0.25) * (i[:, : 2 * d] + a[:, : 2 * d]) + np.float32(0.5), 0, 1)
            z, r = gates[:, :d], gates[:, d:]
            g = np.clip(i[:, 2 * d :] + r * a[:, 2 * d :], -1, 1)
            kept.append((t, h, z, r, g, a[:, 2 * d :]))
            states[t] = h = np.where(filled[:, t, None], g + z * (h - g), h)
        return states, kept

    def _read(self, way: str, x: np.ndarray, filled: np.ndarray) -> np.ndarray:
        """The states of `_run` where nothing is kept: (steps, hidden, rows), without new arrays at each step."""
        d, (n, steps) = self.hidden, x.shape
        u, table_ = self.p[f"U{way}"].T.copy(), np.ascontiguousarray((self.p["E"] @ self.p[f"W{way}"] + self.p[f"b{way}"]).T)
        u[: 2 * d] *= np.float32(0.25)  # the slope of the gates, and their middle
        table_[: 2 * d] = table_[: 2 * d] * np.float32(0.25) + np.float32(0.5)
        symbols, holes, full = np.ascontiguousarray(x.T), ~np.ascontiguousarray(filled.T), filled.all(axis=0)
        states, h = np.empty((steps, d, n), np.float32), np.zeros((d, n), np.float32)
        a, i, g = (np.empty((k * d, n), np.float32) for k in (3, 3, 1))
        gates, z, r = a[: 2 * d], a[:d], a[d : 2 * d]
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            np.matmul(u, h, out=a)
            np.take(table_, symbols[t], axis=1, out=i, mode="clip")
            gates += i[: 2 * d]
            np.minimum(np.maximum(gates, 0, out=gates), 1, out=gates)
            np.multiply(r, a[2 * d :], out=g)
            g += i[2 * d :]
            np.minimum(np.maximum(g, -1, out=g), 1, out=g)
            new = states[t]
            np.subtract(h, g, out=new)
            new *= z
            new += g
            if not full[t]:
                np.copyto(new, h, where=holes[t])
            h = new
        return states

    def log_probabilities(self, x: np.ndarray, filled: np.ndarray) -> np.ndarray:
        """(steps, languages, rows)"""
        d = self.hidden
        s = sum(self.p["V"][k * d : (k + 1) * d].T @ self._read(way, x, filled) for k, way in enumerate("fb")) + self.p["c"][:, None]
        return s - np.log(np.exp(s).sum(axis=1, keepdims=True))  # states are within -1 and 1, so nothing overflows

    def gradients(self, x: np.ndarray, filled: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over filled positions and its gradients, through all steps of both directions."""
        runs = {way: self._run(way, x, filled) for way in "fb"}
        states = np.concatenate([runs[way][0] for way in "fb"], axis=2)
        s = states @ self.p["V"] + self.p["c"]
        s = np.exp(s - s.max(axis=2, keepdims=True))
        s /= s.sum(axis=2, keepdims=True)
        total, on_ = max(1, filled.sum()), filled.T
        loss = -np.log(np.maximum(s[:, np.arange(len(x)), y], 1e-9))[on_].sum() / total
        s[:, np.arange(len(x)), y] -= 1
        s *= on_[:, :, None] / np.float32(total)
        out = {k: np.zeros_like(v) for k, v in self.p.items()}
        out["V"], out["c"] = states.reshape(-1, states.shape[2]).T @ s.reshape(-1, s.shape[2]), s.sum(axis=(0, 1))
        d_states, d = s @ self.p["V"].T, self.hidden
        slope = lambda v, low: (v > low) & (v < 1)
        for i, way in enumerate("fb"):
            u, d_h, d_in = self.p[f"U{way}"], np.zeros((len(x), d), np.float32), np.zeros((x.shape[1], len(x), 3 * d), np.float32)
            for t, h, z, r, g, a in reversed(runs[way][1]):
                total_d = d_states[t, :, i * d : (i + 1) * d] + d_h
                on = total_d * filled[:, t, None]
                d_z, d_g = on * (h - g) * slope(z, 0) * np.float32(0.25), on * (1 - z) * slope(g, -1)
                d_r = d_g * a * slope(r, 0) * np.float32(0.25)
                d_in[t] = np.concatenate([d_z, d_r, d_g], axis=1)
                d_a = np.concatenate([d_z, d_r, d_g * r], axis=1)
                out[f"U{way}"] += h.T @ d_a
                d_h = d_a @ u.T + on * z + total_d * ~filled[:, t, None]
            flat, places = d_in.reshape(-1, 3 * d), x.T.ravel()
            e = self.p["E"][places]
            out[f"W{way}"], out[f"b{way}"] = e.T @ flat, flat.sum(axis=0)
            back = flat @ self.p[f"W{way}"].T
            out["E"] += np.stack([np.bincount(places, weights=back[:, k], minlength=257) for k in range(back.shape[1])], axis=1).astype(np.float32)
        return float(loss), out


def padded(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    width = max(map(len, found))
    lengths = np.array([len(w) for w in found])
    filled = np.arange(width)[None, :] < lengths[:, None]
    x = np.full(filled.shape, 256, dtype=np.int16)
    x[filled] = np.frombuffer(b"".join(found), dtype=np.uint8)
    return x, filled


def train(rows: list[tuple[list[bytes], str]], seed: int = 7, steps: int = 240, batch: int = 256, rate: float = 0.03) -> BiGru | None:
    """Adam on random windows of the (windows, language) rows; each language has the same share of a batch."""
    rng, by = np.random.default_rng(seed), {}
    for found, lang in rows:
        by.setdefault(lang, []).extend(found)
    by = {k: v for k, v in sorted(by.items()) if v}
    if not by:
        return None
    net = BiGru(list(by), rng)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        y = rng.integers(0, len(by), batch)
        found = [(pool := by[net.languages[k]])[rng.integers(len(pool))] for k in y]
        _, g = net.gradients(*padded(found), y)
        for k, x in g.items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.99 * v[k] + 0.01 * x * x
            net.p[k] -= np.float32(rate * min(1, 2 - 2 * step / (steps + 1))) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return net


def pooled(net: BiGru, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and probability of each text, from the labels of all its positions."""
    data = [small_bytes(t) if t and lettered(t) else b"" for t in texts]
    parts = [(k, data[k][start:stop], first - start, last - start) for k in range(len(data)) if data[k] for start, stop, first, last in windows(len(data[k]))]
    parts.sort(key=lambda p: len(p[1]))
    sums = np.zeros((len(texts), len(net.languages)))
    for at in range(0, len(parts), ROWS):
        run = parts[at : at + ROWS]
        x, filled = padded([p[1] for p in run])
        step = np.arange(x.shape[1])[:, None]
        counts = (step >= np.array([p[2] for p in run])) & (step < np.array([p[3] for p in run]))
        np.add.at(sums, [p[0] for p in run], np.einsum("tln,tn->nl", net.log_probabilities(x, filled), counts.astype(np.float32)))
    out = []
    for k, b in enumerate(data):
        mean = sums[k] / max(1, len(b))
        p = np.exp(mean - mean.max())
        out.append((net.languages[int(p.argmax())], float(p.max() / p.sum())) if b else (UNKNOWN, 0.0))
    return out


def drawn(text: str | None, limit: int = PIECES) -> list[bytes]:
    """So many windows of a whole text, at places that a generator draws which is seeded by the text."""
    data = small_bytes(text)
    if len(data) <= LEARNED:
        return [data] if data else []
    places = np.random.default_rng(zlib.crc32(data)).integers(0, len(data) - LEARNED + 1, min(limit, -(-len(data) // LEARNED)))
    return [data[k : k + LEARNED] for k in places]


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _drawn(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: drawn(t if isinstance(t, str) else None))


def fit(docs: DataFrame, sample: int = SAMPLE) -> BiGru | None:
    """Train on at most `sample` documents with a language whose ids are not held out, as many of each language."""
    labelled = docs.where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each language
    if not counts:
        return None
    each = max(1, sample // len(counts))
    # Of a language with more rows, those below a hash threshold (twice as many as wanted) are ranked.
    limits = docs.sparkSession.createDataFrame([(r["lang"], 2**63 - 1 if r["n"] <= 2 * each else -(2**63) + 2 * each * 2**64 // r["n"]) for r in counts], "lang string, most long")
    low = labelled.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(limits), "lang").where(F.col("h") <= F.col("most"))
    once = low.groupBy("lang", "h").agg(F.first("text").alias("text"))  # repeated rows teach once
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= each)
    rows = ranked.select("lang", "h", _drawn("text").alias("runs")).collect()  # `sample` rows of PIECES windows at most
    return train([(list(map(bytes, r["runs"])), r["lang"]) for r in sorted(rows, key=lambda r: (r["lang"], r["h"]))])


@F.pandas_udf(T.BooleanType())
def has_letter(texts: pd.Series) -> pd.Series:
    """What a text needs to get a language."""
    return texts.map(lambda t: isinstance(t, str) and lettered(t)).astype(bool)


def predicted(net: BiGru | None):
    """A Pandas UDF: whole text -> struct of lang_pred and score."""

    @F.pandas_udf(PREDICTION)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch]
            rows = [x for chunk in chunks(texts) for x in pooled(net, chunk)] if net else [(UNKNOWN, 0.0)] * len(texts)
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])
        give_back()

    return run


def identify(docs: DataFrame, net: BiGru | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns plus lang_pred and score; fits on `docs` if no network is given."""
    net = net or fit(docs)
    return docs.select(*keep, predicted(net)(F.col("text")).alias("_read")).select(*keep, "_read.lang_pred", "_read.score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
