"""Byte-level BPE: merges run on padded numpy matrices, one row for each distinct piece.

Spark partitions the documents; a task cuts each text into pieces with the tokenizer's pattern and
merges only pieces it has not met lately. Rows of like length share a matrix: in each round every row
merges its leftmost pair of minimum rank, found in a hashed table of pairs, and is compacted.

Null and empty texts have no tokens and decode to an empty text. Repeated rows each get a row; extra
columns are left out of the result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Numbered, chunks, gathered, give_back, table

#: Above any rank: the pair doesn't merge.
_NEVER = np.int32(2**31 - 1)
#: A worker's memory of segments starts anew beyond so many.
SEGMENTS = 300_000
#: Where no piece of the pattern can reach across: before a single blank between two other characters.
_BREAK = re.compile(r"(?<=\S) (?=\S)")
_ODD_BLANKS = re.compile(r"\s | \s|^ | $")
#: Rows of one matrix times its columns.
_CELLS = 1 << 21
#: A matrix round costs as much as a row is long, so longer pieces (runs without a break) merge by a heap in the same order.
LONG_PIECE = 2048

ENCODED = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.BinaryType())])


class PairTable:
    """(left id, right id) -> merged id, open addressing in three arrays, looked up for whole matrices."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.mask = np.uint64((1 << max(4, int(2 * max(1, len(rank)) - 1).bit_length() + 1)) - 1)
        self.keys = np.full(int(self.mask) + 1, -1, dtype=np.int64)
        self.values = np.full(int(self.mask) + 1, _NEVER, dtype=np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slots, todo, self.probes = self._slots(keys), np.arange(len(keys)), 1
        while len(todo):
            at = slots[todo]
            free = self.keys[at] == -1
            claim, first = np.unique(at[free], return_index=True)
            winners = todo[free][first]
            self.keys[claim], self.values[claim] = keys[winners], rank[winners]
            todo = np.setdiff1d(todo, winners, assume_unique=True)
            slots[todo] = slots[todo] + 1 & self.mask.astype(np.int64)
            self.probes += bool(len(todo))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(29)) & self.mask).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at, out = self._slots(keys), np.full(keys.shape, _NEVER, dtype=np.int32)
        open_ = np.ones(keys.shape, dtype=bool)
        for _ in range(self.probes):
            found = self.keys[at]
            hit = open_ & (found == keys)
            out[hit] = self.values[at[hit]]
            open_ &= ~hit & (found != -1)
            if not open_.any():
                break
            at = at + 1 & self.mask.astype(np.int64)
        return out


class Vocabulary:
    """Ranks of a .tiktoken file: base64 of the bytes, a blank and the rank in each line."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern, self.ranks = regex.compile(pattern), ranks
        #: Whether a single blank between two other characters starts a piece, as in common patterns; else texts aren't cut before it.
        probes = ["a b", "a. b", "1 2", "' s", "é 漢", ". .", "a 's", "\x1c x"]
        self.cuts = all(self.pattern.findall(p) == self.pattern.findall(p[: p.index(" ")]) + self.pattern.findall(p[p.index(" ") :]) for p in probes)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, rank = np.array(pairs, dtype=np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, rank)

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces end to end, and how many each has."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        n = np.ones(len(pieces), dtype=np.int64)
        first = np.fromiter((self.ranks.get(p, -1) for p in pieces), dtype=np.int64, count=len(pieces))
        order = np.argsort(sizes, kind="stable")
        order, parts = order[first[order] < 0], []
        short = order[sizes[order] <= LONG_PIECE]
        for i in order[len(short) :]:
            parts.append((np.array([i]), self._merge_long(pieces[i])))
            n[i] = len(parts[-1][1])
        start = 0
        while start < len(short):
            width = max(4, 1 << int(sizes[short[start]] - 1).bit_length())  # lengths of one bucket differ by 2 times at most
            stop = min(int(np.searchsorted(sizes[short], width, side="right")), start + max(1, _CELLS // width))
            bucket = short[start:stop]
            ids, n[bucket] = self._merge_bucket([pieces[i] for i in bucket])
            parts.append((bucket, ids))
            start = stop
        starts = np.cumsum(n) - n
        flat = np.zeros(int(n.sum()), dtype=np.int32)
        flat[starts[first >= 0]] = first[first >= 0]
        for bucket, ids in parts:
            k = n[bucket]
            flat[np.repeat(starts[bucket] - np.cumsum(k) + k, k) + np.arange(len(ids))] = ids
        return flat, n

    def _merge_bucket(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces end to end, and how many each has."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        width = int(lengths.max())
        ids = np.zeros((len(pieces), width), dtype=np.int32)
        filled = np.arange(width)[None, :] < lengths[:, None]
        ids[filled] = self.bytes[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        ranks = np.full((len(pieces), width), _NEVER, dtype=np.int32)
        if width > 1:
            both = filled[:, 1:]
            ranks[:, :-1][both] = self.pairs.ranks(ids[:, :-1][both], ids[:, 1:][both])
        out, sizes, rows = np.zeros_like(ids), lengths.copy(), np.arange(len(pieces))
        while len(rows):
            best = ranks.argmin(axis=1)  # the first of equal ranks is the leftmost
            rank = ranks[np.arange(len(rows)), best]
            done = rank == _NEVER
            if done.any():
                out[rows[done], : ids.shape[1]], sizes[rows[done]] = ids[done], lengths[done]
                keep = ~done
                rows, ids, ranks, lengths, best, rank = rows[keep], ids[keep], ranks[keep], lengths[keep], best[keep], rank[keep]
                if not len(rows):
                    break
            # Compaction: what stands right of the merged pair moves one place to the left.
            right = np.arange(ids.shape[1] - 1)[None, :] > best[:, None]
            new_ids = np.where(right, ids[:, 1:], ids[:, :-1])
            new_ranks = np.where(right, ranks[:, 1:], ranks[:, :-1])
            k, lengths = np.arange(len(rows)), lengths - 1
            new_ids[k, best] = rank
            left = best > 0
            if left.any():
                new_ranks[k[left], best[left] - 1] = self.pairs.ranks(new_ids[k[left], best[left] - 1], rank[left])
            new_ranks[k, best] = _NEVER
            inner = best + 1 < lengths
            if inner.any():
                new_ranks[k[inner], best[inner]] = self.pairs.ranks(rank[inner], new_ids[k[inner], best[inner] + 1])
            width = int(lengths.max())
            ids, ranks = new_ids[:, :width], new_ranks[:, :width]
        return out[np.arange(out.shape[1])[None, :] < sizes[:, None]], sizes

    def _merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.bytes[np.frombuffer(piece, dtype=np.uint8)]
        ranks = self.pairs.ranks(ids[:-1], ids[1:])
        heap = [(int(ranks[k]), int(k)) for k in np.flatnonzero(ranks != _NEVER)]
        heapq.heapify(heap)
        ids, n = ids.tolist(), len(ids)
        before, after, now = list(range(-1, n - 1)), list(range(1, n + 1)), dict((k, r) for r, k in heap)

        def look(k: int) -> None:
            now.pop(k, None)
            if k >= 0 and after[k] < n:
                rank = int(self.pairs.ranks(np.array([ids[k]]), np.array([ids[after[k]]]))[0])
                if rank != _NEVER:
                    now[k] = rank
                    heapq.heappush(heap, (rank, k))

        while heap:
            rank, k = heapq.heappop(heap)
            if now.get(k) != rank:
                continue
            gone = after[k]
            ids[k], after[k], ids[gone] = rank, after[gone], -1
            now.pop(gone, None)
            if after[k] < n:
                before[after[k]] = k
            look(k)
            look(before[k])
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


class Encoder:
    """Keeps the ids of segments met lately (a segment: pieces between two single blanks) in one array."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.known = vocab, Numbered(SEGMENTS)
        self.flat, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _segments(self, text: str) -> list[str]:
        if not self.vocab.cuts:
            return [text] if text else []
        found = (_BREAK.split(text) if _ODD_BLANKS.search(text) else text.split(" ")) if text else []
        found[1:] = [" " + x for x in found[1:]]
        return found

    def _ids(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments end to end, and how many each has; equal pieces meet the merge table once."""
        pieces = [self.vocab.pattern.findall(x) for x in segments]
        number = Numbered(2**62)
        at, new, _ = number.take([p for found in pieces for p in found])
        flat, n = self.vocab.merged([p.encode("utf-8", "surrogatepass") for p in new])
        total = np.concatenate([[0], np.cumsum(n[at])])
        ends = np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
        return gathered((np.cumsum(n) - n)[at], n[at], flat), np.diff(total[ends], prepend=0)

    def forget(self) -> None:
        """The vocabulary stays; segments met in a task go with it, as its worker goes on to other stages."""
        self.known.clear()
        self.known.held = 0
        self.flat, self.starts, self.sizes = self.flat[:0].copy(), self.starts[:0].copy(), self.sizes[:0].copy()

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        segments = [self._segments(t or "") for t in texts]
        at, new, fresh = self.known.take([x for found in segments for x in found])
        ids, sizes = self._ids(new)
        if fresh:
            self.flat, self.starts, self.sizes = self.flat[:0], self.starts[:0], self.sizes[:0]
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, ids])
        ids, done, k = gathered(self.starts[at], self.sizes[at], self.flat), np.cumsum(self.sizes[at]), 0
        start = 0
        for found in segments:
            k += len(found)
            stop = int(done[k - 1]) if k else 0
            yield ids[start:stop]
            start = stop


@lru_cache(maxsize=2)
def worker_encoder(path: str, pattern: str) -> Encoder:
    """One for a worker process, which Spark uses for many tasks; the tables of the vocabulary are what it keeps."""
    return Encoder(vocabulary(path, pattern))


def encoded(path: str, pattern: str):
    """A Pandas UDF: text -> struct of ids (little-endian unsigned 32-bit), n_tokens and the bytes decoded from the ids.

    `path` must exist on the executors: it is part of their Python environment."""

    @F.pandas_udf(ENCODED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = worker_encoder(path, pattern)
        for batch in batches:
            rows = []
            for chunk in chunks([t if isinstance(t, str) else None for t in batch]):
                for ids in encoder.encode(chunk):
                    rows.append((ids.astype("<u4").tobytes(), len(ids), encoder.vocab.decode(ids)))
            yield pd.DataFrame(rows, columns=["ids", "n_tokens", "decoded"])
        encoder.forget()
        give_back()

    return run


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns plus ids, n_tokens and decoded of every whole text."""
    return docs.select(*keep, encoded(path, pattern)(F.col(text)).alias("_encoded")).select(*keep, "_encoded.ids", "_encoded.n_tokens", "_encoded.decoded")


@F.pandas_udf(T.BinaryType())
def decoded_ids(ids: pd.Series, path: pd.Series, pattern: pd.Series) -> pd.Series:
    """The bytes for stored ids."""
    return pd.Series([vocabulary(p, q).decode(np.frombuffer(x, "<u4")) if x is not None else None for x, p, q in zip(ids, path, pattern, strict=True)])


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    out = encode_texts(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def brute_force(texts: list[str], path: str, pattern: str) -> list[tuple[int, str, str]]:
    """For tests: the same digests by one merge loop a piece."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    out = []
    for text in texts:
        ids: list[int] = []
        for piece in regex.findall(pattern, text or ""):
            parts = [bytes([b]) for b in piece.encode()]
            while len(parts) > 1:
                rank, k = min((ranks.get(parts[k] + parts[k + 1], 2**40), k) for k in range(len(parts) - 1))
                if rank == 2**40:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            ids += [ranks[p] for p in parts]
        out.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return out
