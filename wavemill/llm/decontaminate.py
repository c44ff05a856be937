"""Benchmark decontamination: SimHash over item-sized windows, then exact weighted-shingle similarity.

For every benchmark item, each document's windows of as many words as the item are fingerprinted: 64
bits, each the sign of a sum over the window's five-word shingles. The items' fingerprints stand in a
multi-index of BLOCKS blocks of 16 bits, each a sorted table of block values. Two fingerprints that
differ in RADIUS bits at most differ in some block by no more than that block's part of the radius
(the parts plus one add up to RADIUS + 1), so looking up all block values that near finds every item
within the radius. Candidates are verified by weighted Jaccard similarity: shingles count as often as
they occur. Before that, shingles in common say which items and windows need be looked at: multisets of
the similarity share that part of the larger one at least, so postings (items by shingle) leave the items
of which a document has as much, and of its windows those that hold as many of the item's shingles. That is
exact. Where few pairs are left, their blocks are compared one by one; else the tables are asked.

At similarity 0.8 fingerprints differ in 10 bits on average with a deviation of 3; RADIUS is beyond
three deviations (measured recall in the tests and the README).

The benchmark is read in blocks of BLOCK_CHARS characters, each of which goes to the tasks with the
code; a benchmark of any size takes more passes over the documents, not more memory: of more than one
block each writes its matches before the next is read.

Null or empty texts and items match nothing. Items of fewer than five words are one shingle, and a
document with fewer words than an item is one window. Repeated documents or items each get their
pairs. Ids may be of any type; a null doc_id or item_id stays null. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import SHINGLE_WORDS, WordHashes, checkpointed, gathered, give_back, mixed, shingles, table, words

SIMILARITY = 0.8
RADIUS = 20
BLOCKS = 4
BLOCK_CHARS = 4_000_000

#: What a match says besides the ids.
PAIRS = T.StructType([T.StructField("similarity", T.DoubleType()), *[T.StructField(n, T.LongType()) for n in ("start_word", "window_words")], T.StructField("hamming", T.IntegerType())])
_BITS = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)


def signs(s: np.ndarray) -> np.ndarray:
    """For each shingle +1 or -1 in each of 64 bits."""
    bits = np.unpackbits(mixed(s).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """8 bytes for each row of 64 sums."""
    return np.packbits(sums > 0, axis=1)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    value, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=len(value)), np.bincount(at[len(a) :], minlength=len(value))
    return float(np.minimum(x, y).sum() / max(1, np.maximum(x, y).sum()))


@lru_cache(maxsize=8)
def _near_values(distance: int) -> np.ndarray:
    """The 16-bit numbers of so many set bits at most: XOR with them gives all block values that near."""
    every = np.arange(1 << 16, dtype=np.uint32)
    return every[_BITS[every >> 8].astype(int) + _BITS[every & 255] <= distance].astype(np.uint16)


@dataclass
class Index:
    """Items of one length in words: places in the benchmark, shingles, fingerprints and, by block, the items in order of their value."""

    places: list[int] = field(default_factory=list)
    items: list[np.ndarray] = field(default_factory=list)

    def built(self, radius: int) -> Index:
        self.radius, self.prints = radius, np.concatenate([fingerprints(signs(s).sum(axis=0, keepdims=True)) for s in self.items])
        self.values = self.prints.view(">u2").astype(np.uint16)
        self.order = np.argsort(self.values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.values, self.order, axis=0)
        #: The block's part of the radius.
        self.parts = [(radius + 1) // BLOCKS + (k < (radius + 1) % BLOCKS) - 1 for k in range(BLOCKS)]
        return self

    def _block(self, k: int, value: int) -> np.ndarray:
        """Items whose block k is as near to the value as its part of the radius."""
        if self.parts[k] < 0:
            return np.empty(0, np.int64)
        near = _near_values(self.parts[k]) ^ np.uint16(value)
        low, high = (np.searchsorted(self.sorted[:, k], near, side=side) for side in ("left", "right"))
        found = np.flatnonzero(high > low)
        return np.concatenate([self.order[low[i] : high[i], k] for i in found]) if len(found) else np.empty(0, np.int64)

    def near(self, prints: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Windows, items and distances of all pairs within the radius, from the tables."""
        for window, values in enumerate(prints.view(">u2").astype(np.uint16)):
            items = np.unique(np.concatenate([self._block(k, int(v)) for k, v in enumerate(values)]))
            distance = _BITS[prints[window] ^ self.prints[items]].sum(axis=1, dtype=np.int64)
            for i in np.flatnonzero(distance <= self.radius):
                yield window, int(items[i]), int(distance[i])

    def near_pairs(self, prints: np.ndarray, windows: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """The same among some pairs of a window and an item: fewer than the values that a table would be asked for."""
        if len(windows) > len(prints) * len(_near_values(max(self.parts))):  # then the tables are quicker
            wanted = set(zip(windows.tolist(), items.tolist(), strict=True))
            yield from (x for x in self.near(prints) if x[:2] in wanted)
            return
        apart = prints.view(">u2").astype(np.uint16)[windows] ^ self.values[items]
        bits = _BITS[apart >> 8].astype(np.int64) + _BITS[apart & 255]
        hit = np.flatnonzero((bits <= np.array(self.parts)).any(axis=1))
        distance = bits[hit].sum(axis=1)
        for k in np.flatnonzero(distance <= self.radius):
            yield int(windows[hit[k]]), int(items[hit[k]]), int(distance[k])


class Benchmark:
    """Items by length, and postings: which items of at least SHINGLE_WORDS words have a shingle, and how often."""

    def __init__(self, texts: list[str], radius: int = RADIUS):
        hashes, by = WordHashes(), {}
        for place, text in enumerate(texts):
            h = hashes.of(words(text))
            if len(h):
                index = by.setdefault(len(h), Index())
                index.places.append(place)
                index.items.append(shingles(h))
        self.by = {n: index.built(radius) for n, index in sorted(by.items())}
        self.short = [n for n in self.by if n < SHINGLE_WORDS]
        #: Items of the longer lengths have numbers in a row: their length, place in its index, and number of shingles.
        long = [(n, i, s) for n, index in self.by.items() if n >= SHINGLE_WORDS for i, s in enumerate(index.items)]
        self.length, self.inner, self.size = (np.array([f(x) for x in long], dtype=np.int64) for f in (lambda x: x[0], lambda x: x[1], lambda x: len(x[2])))
        owner, every = np.repeat(np.arange(len(long)), self.size), np.concatenate([np.empty(0, np.uint64), *(s for _, _, s in long)])
        order = np.lexsort((owner, every))
        every, owner = every[order], owner[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(every)), bool), (every[1:] != every[:-1]) | (owner[1:] != owner[:-1])]))
        self.times = np.diff(np.append(first, len(every)))
        self.owner, values = owner[first], every[first]
        self.known, self.begin = np.unique(values, return_index=True)
        self.begin = np.append(self.begin, len(values))

    def _long_candidates(self, s: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By length: windows (starts) and items that may be similar enough, as all that shingles in common can say.

        Multisets of a and b shingles of at least the similarity share that part of the larger one at least. So an
        item counts only if the document has that part of its shingles, and of its windows those that hold as many of
        the places where the item's shingles occur."""
        place = np.minimum(np.searchsorted(self.known, s), max(0, len(self.known) - 1))
        at = np.flatnonzero(self.known[place] == s) if len(self.known) else np.empty(0, np.int64)
        if not len(at):
            return
        shingle, often = np.unique(place[at], return_counts=True)
        sizes = self.begin[shingle + 1] - self.begin[shingle]
        posting = gathered(self.begin[shingle], sizes, np.arange(len(self.owner)))
        shared = np.bincount(self.owner[posting], np.minimum(self.times[posting], np.repeat(often, sizes)), len(self.length))
        few = np.flatnonzero(shared >= SIMILARITY * self.size - 1e-9)
        if not len(few):
            return
        # Where the shingles of those items occur in the document.
        asked = np.zeros(len(self.length), bool)
        asked[few] = True
        posting = posting[asked[self.owner[posting]]]
        of_shingle = np.searchsorted(self.begin, posting, side="right") - 1
        occurs = np.argsort(place[at], kind="stable")
        ordered, spots = place[at][occurs], at[occurs]
        low, high = np.searchsorted(ordered, of_shingle), np.searchsorted(ordered, of_shingle, side="right")
        item, spot = np.repeat(self.owner[posting], high - low), gathered(low, high - low, spots)
        order = np.lexsort((spot, item))
        item, spot = item[order], spot[order]
        edges = np.searchsorted(item, few), np.searchsorted(item, few, side="right")
        out: dict[int, tuple[list, list]] = {}
        for i, a, b in zip(few.tolist(), *(e.tolist() for e in edges), strict=True):
            wide = min(int(self.length[i]) - SHINGLE_WORDS + 1, len(s))
            need = max(1, int(np.ceil(SIMILARITY * max(self.size[i], wide) - 1e-9)))
            p = spot[a:b]
            if len(p) < need:
                continue
            from_, to = np.maximum(p[need - 1 :] - wide + 1, 0), np.minimum(p[: len(p) - need + 1], len(s) - wide)
            ok = from_ <= to
            if ok.any():
                steps = np.zeros(len(s) - wide + 2, np.int32) if len(s) - wide < 4 * ok.sum() else None
                if steps is not None:
                    np.add.at(steps, from_[ok], 1)
                    np.add.at(steps, to[ok] + 1, -1)
                    starts = np.flatnonzero(np.cumsum(steps)[:-1])
                else:
                    starts = np.unique(gathered(from_[ok], (to - from_ + 1)[ok], np.arange(len(s))))
                windows, items = out.setdefault(int(self.length[i]), ([], []))
                windows.append(starts)
                items.append(np.full(len(starts), self.inner[i]))
        for n, (windows, items) in out.items():
            yield n, np.concatenate(windows), np.concatenate(items)

    def matches(self, h: np.ndarray) -> list[tuple[int, float, int, int, int]]:
        """(place of the item, similarity, start, words, distance) of the best window for each item of at least SIMILARITY."""
        if not len(h):
            return []
        best: dict[int, tuple] = {}
        s = shingles(h)

        def verify(index: Index, size: int, own: np.ndarray, wide: int, start: int, i: int, distance: int) -> None:
            similarity = weighted_jaccard(own[start : start + wide], index.items[i])
            if similarity >= SIMILARITY and (similarity, -start) > best.get(index.places[i], (0,))[:2]:
                best[index.places[i]] = (similarity, -start, size, distance)

        short = self.by if len(h) < SHINGLE_WORDS else self.short  # a short window is one shingle
        for n in short:
            index, size = self.by[n], min(n, len(h))
            own = s if size == len(h) else np.concatenate([shingles(h[i : i + size]) for i in range(len(h) - size + 1)])
            starts = np.flatnonzero(np.isin(own, np.concatenate(index.items)))
            if len(starts):
                for w, i, distance in index.near(fingerprints(signs(own[starts]))):
                    verify(index, size, own, 1, int(starts[w]), i, distance)
        sums = None
        for n, windows, items in self._long_candidates(s) if len(h) >= SHINGLE_WORDS else ():
            if sums is None:
                sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(s), axis=0, dtype=np.int32)])
            size = min(n, len(h))
            wide = size - SHINGLE_WORDS + 1
            starts, at = np.unique(windows, return_inverse=True)
            for w, i, distance in self.by[n].near_pairs(fingerprints(sums[starts + wide] - sums[starts]), at.reshape(-1), items):
                verify(self.by[n], size, s, wide, int(starts[w]), i, distance)
        return [(place, x, -start, size, distance) for place, (x, start, size, distance) in best.items()]


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    """The items in runs of about so many characters; one run is in the driver at a time."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
        if size > chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and item that it holds: `keep` columns and item_id as they are, similarity, place and width of the best window."""
    kinds = T.StructType([*[docs.schema[c] for c in keep], T.StructField("item_id", benchmark.schema["item_id"].dataType), *PAIRS.fields])
    id_kind = to_arrow_type(kinds["item_id"].dataType)

    def searched(items: list[tuple[object, str]]) -> DataFrame:
        ids, texts = [i for i, _ in items], [t for _, t in items]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, hashes, names = Benchmark(texts), WordHashes(), pa.array(ids, id_kind)
            for batch in batches:
                found = [(row, *m) for row, text in enumerate(batch["text"].to_pylist()) for m in index.matches(hashes.of(words(text)))]
                row, place, *rest = zip(*found, strict=True) if found else [()] * 6
                columns = [*(batch[c].take(pa.array(row, pa.int64())) for c in keep), names.take(pa.array(place, pa.int64()))]
                columns += [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(rest, PAIRS.fields, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=kinds.names)
            give_back()

        return docs.select(*keep, "text").mapInArrow(run, kinds)

    found, last = [], None
    for items in blocks(benchmark, block_chars):
        if last is not None:  # written before the next block is read
            found.append(checkpointed(searched(last)))
        last = items
    if last is None:
        return docs.sparkSession.createDataFrame([], kinds)
    return reduce(DataFrame.unionByName, [*found, searched(last)])


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def brute_force(docs: list[tuple[int, str]], items: list[tuple[int, str]]) -> set[tuple[int, int]]:
    """For tests: all pairs of which some item-sized window has the similarity, by multisets of word tuples."""
    from collections import Counter

    def grams(w: list[bytes]) -> Counter:
        k = min(SHINGLE_WORDS, len(w))
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()

    out = set()
    for id_, text in docs:
        w = words(text)
        for item, wanted in items:
            v = words(wanted)
            n, b = min(len(v), len(w)), grams(v)
            for start in range(len(w) - n + 1) if n else ():
                a = grams(w[start : start + n])
                if (a & b).total() >= SIMILARITY * (a | b).total() > 0:
                    out.add((id_, item))
                    break
    return out
