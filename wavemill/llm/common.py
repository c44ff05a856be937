"""Pieces shared by the training-data operators: tables, checkpoints, word arrays, hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java and Python regex of a word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The words that near-duplicate operators put into one shingle.
SHINGLE_WORDS = 5
#: Items that a scan over an array gathers at once.
SCAN_RUN = 256
#: Groups that hold more than one row in so many are joined by broadcast.
HEAVY = 10_000
#: Bytes of an Arrow batch of rows.
BATCH_BYTES = 8 << 20
#: Stands for a null doc_id where ids are compared: null sorts first.
NULL_ID = -(2**63)

_MASK = (1 << 64) - 1
_MULTIPLIER = 0x9E3779B97F4A7C15


def modest_batches(spark: SparkSession) -> None:
    """Texts go to Python and back in batches of BATCH_BYTES, as a task holds some of them at once on both sides; a setting of the session's own stays."""
    setting, usual = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64m", "64MB")
    if spark.conf.get(setting) in usual:
        spark.conf.set(setting, f"{BATCH_BYTES}b")


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Freed memory goes back to the system: a Python worker lives through the tasks of many stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBC, "malloc_trim", None):  # where the C library has it
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share.

    Only in local mode (tests, notebooks) a temporary folder stands in where the setting is absent."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), where x is evaluated once, however often f reads it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def scanned(items: Column, zero: Column, step: Callable[[Column, Column], Column], made: Callable[[Column, Column], Column], made_type: str) -> Column:
    """made(state before, item) for each item of an array; a state starts at `zero` and goes on by step(state, item).

    An array grows by copying, so outputs are gathered in runs of SCAN_RUN: time grows as the length, not its square."""
    cut = lambda all_: F.transform(F.sequence(F.lit(0), (F.greatest(F.size(all_) - 1, F.lit(0)) / F.lit(SCAN_RUN)).cast("int")), lambda k: F.slice(all_, k * SCAN_RUN + 1, SCAN_RUN))
    begin = F.struct(zero.alias("state"), F.slice(F.array(zero), 1, 0).alias("starts"))
    starts = lambda runs: F.aggregate(runs, begin, lambda s, run: F.struct(F.aggregate(run, s["state"], step).alias("state"), F.concat(s["starts"], F.array(s["state"])).alias("starts")))["starts"]
    none = F.expr(f"cast(array() as array<{made_type}>)")
    one = lambda run, start: F.aggregate(run, F.struct(start.alias("state"), none.alias("out")), lambda s, x: F.struct(step(s["state"], x).alias("state"), F.concat(s["out"], F.array(made(s["state"], x))).alias("out")))["out"]
    return bound(items, lambda all_: bound(cut(all_), lambda runs: F.flatten(F.zip_with(runs, starts(runs), one))))


def beside(rows: DataFrame, groups: DataFrame, key: list[str], weight: str, total: int) -> DataFrame:
    """Each row joined to the one row of `groups` that has its key; `weight` says how many rows a group has, `total` how many all have.

    Groups of more than total / HEAVY rows are broadcast, so none of them meets in one task: there are
    fewer than HEAVY, as they add up to `total` at most. Rows of other groups are shuffled by key."""
    cut = max(1, total // HEAVY)
    heavy, light = groups.where(F.col(weight) > cut), groups.where(F.col(weight) <= cut)
    rest = rows.join(F.broadcast(heavy.select(*key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(light, key))


@F.pandas_udf(T.BinaryType())
def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Texts travel compressed: they are most of what joins by document move."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for texts in batches:
        yield texts.map(lambda t: squeeze(t.encode("utf-8", "surrogatepass")) if isinstance(t, str) else None)
    give_back()


def unpacker():
    """A function from a packed text to its bytes (None: none)."""
    open_ = zstandard.ZstdDecompressor().decompress
    return lambda data: open_(data) if data is not None else b""


@F.pandas_udf(T.StringType())
def unpacked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    read = unpacker()
    for data in batches:
        yield data.map(lambda x: read(x).decode("utf-8", "surrogatepass") if x is not None else None)
    give_back()


def held_out(doc_id: Column) -> Column:
    """True for the documents that no model may learn from; a null id is held out as well."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def hash_below(eligible: DataFrame, sample: int) -> Column:
    """True for about twice `sample` of the eligible rows, those of smallest doc_id hash (all, if there are no more).

    A sample of the smallest hashes is then sorted from so few rows, however many tasks hold them."""
    total = eligible.count()
    return F.lit(True) if total <= 2 * sample else F.xxhash64("doc_id") < F.lit(-(2**63) + 2 * sample * 2**64 // total)


def words(text: str | None) -> list[bytes]:
    """bytes.split() splits at exactly the six ASCII blanks that WORD excludes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """Remembers the 64-bit hash of each word of up to LONG bytes; starts anew when it grows past its bound."""

    LONG = 256

    def __init__(self, bound: int = 200_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONG:
            if len(self) >= self.bound:
                self.clear()
            self[word] = h
        return h

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), dtype=np.uint64, count=len(found))


class Numbered(dict):
    """Numbers distinct strings from 0; told of a chunk's strings, it says which are new. Bounded by entries and by characters."""

    def __init__(self, bound: int, chars: int = 1 << 25):
        super().__init__()
        self.bound, self.chars, self.held = bound, chars, 0

    def take(self, found: list) -> tuple[np.ndarray, list, bool]:
        """The number of each string, the new strings in the order of their numbers, and whether numbering began anew."""
        fresh = len(self) > self.bound or self.held > self.chars
        if fresh:
            self.clear()
            self.held = 0
        new = list(dict.fromkeys(x for x in found if x not in self))
        self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))
        self.held += sum(map(len, new))
        return np.fromiter(map(self.__getitem__, found), dtype=np.int64, count=len(found)), new, fresh


def chunks(texts: list[str | None], chars: int = 1 << 20):
    """Runs of texts of about so many characters; a text is never cut."""
    start = total = 0
    for k, t in enumerate(texts):
        if total > chars:
            yield texts[start:k]
            start, total = k, 0
        total += len(t or "")
    if texts:
        yield texts[start:]


def gathered(starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """flat[s : s + n] for each s and n, end to end."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, size: int, multiplier: int = _MULTIPLIER) -> np.ndarray:
    """One 64-bit hash for each run of `size` consecutive words (none if there are fewer)."""
    if len(h) < size:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for k in range(size):
        total = total * np.uint64(multiplier) + h[k : k + len(total)]
    return mixed(total)


def shingles(h: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of all word n-grams; a shorter text is one shingle, an empty one has none."""
    return window_hashes(h, min(size, len(h))) if len(h) else h


def spread(name: str, parts: int = 16) -> int:
    """A number in [0, parts) that depends on the bytes of a name alone."""
    return zlib.crc32(name.encode()) % parts


def sql_words(text: str = "text") -> str:
    """DuckDB: the list of words of a text."""
    return rf"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"


#: The usual table of CRC-32 by byte, built from its polynomial.
SQL_CRC_TABLE = ", ".join(str(x) for x in (lambda step: [step(step(step(step(step(step(step(step(b)))))))) for b in range(256)])(lambda c: (c >> 1) ^ (0xEDB88320 if c & 1 else 0)))


def sql_crc32(text: str) -> str:
    """DuckDB: the unsigned CRC-32 of a text's UTF-8 bytes."""
    bytes_ = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda s, b: xor(s >> 8, [{SQL_CRC_TABLE}][xor(s & 255, b) + 1]::BIGINT)), 4294967295::BIGINT)"


WORD_PATTERN = re.compile(WORD)
