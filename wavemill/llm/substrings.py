"""Substring dedup: seed on winnowed anchors, extend both ways, remove what started earlier.

Seed: winnowing picks, from every run of W consecutive K-word grams of a document, the one of least
hash; any two equal passages of LENGTH = W + K - 1 words share a picked gram at the same place. Only
grams that two different texts pick, or one text picks twice, are seeds. Extend: to the left and
right of its seeds, a document's passages of LENGTH words that picked a seed are hashed (95 bits); a
passage whose hash also starts earlier is a repeat, and neighbouring repeats merge into the maximal
ones that `repeats` lists. A match is thus extended by what its passages hash to, not by a walk along
two texts, so that a passage in n documents costs n rows, not n * n pairs.

Each batch of documents combines its own grams and passages first: of a gram or passage that several
documents of a batch hold, one row is sent to its key, and the others, known to repeat, are sent by
document. So a gram or passage that a third of all documents hold brings each key a row for every
batch, not for every document. Texts are shuffled once, compressed: the plan reads that exchange three
times. Exact copies send nothing after their first document: they go whole.

Words are WORD runs; a null text has none. Documents with fewer than LENGTH words lose nothing. A null
doc_id counts as smallest; rows with equal doc_id don't make each other earlier, and repeated rows
are treated alike. An empty table gives no rows. Extra columns are left out, kept ones may have any
name but those of the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Over
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_ID, WordHashes, mixed, packed, table, unpacker, window_hashes

LENGTH, K = 20, 6
W = LENGTH - K + 1

_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
_RESULT = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("repeats", T.ArrayType(_SPAN))]


def picked(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the grams that winnowing picks (none in fewer than LENGTH words), and which of
    them each passage of LENGTH words picks."""
    if len(h) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = window_hashes(h, K)
    runs = np.lib.stride_tricks.sliding_window_view(grams, W)
    places, own = np.unique(runs.argmin(axis=1) + np.arange(len(runs)), return_inverse=True)
    return places, grams[places], own


def _scattered(ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Numbers that depend on document and place: what needs no meeting is dealt out by them."""
    return mixed(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + places.astype(np.uint64))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Picked grams; `seed`: known to be one. Of a gram in several documents of a batch one row keeps its number."""
    hashes, read = WordHashes(), unpacker()
    for batch in batches:
        found: list[tuple] = []
        for id_, key, data in zip(batch.column("id").to_pylist(), batch.column("key").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            places, grams, _ = picked(hashes.of(read(data).split()))
            if len(grams):
                value, first, n = np.unique(grams, return_index=True, return_counts=True)
                found.append((value, np.full(len(value), id_), np.full(len(value), key), places[first], n > 1))
        if found:
            anchor, ids, keys, places, seed = map(np.concatenate, zip(*found, strict=True))
            order = np.argsort(anchor, kind="stable")
            again = np.zeros(len(anchor), dtype=bool)
            again[order[1:]] = anchor[order[1:]] == anchor[order[:-1]]
            seed[order[:-1]] |= again[order[1:]]
            seed |= again
            anchor[again] = _scattered(ids[again], places[again])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor.view(np.int64), ids, keys, places.astype(np.int32), seed)], names=["anchor", "id", "key", "place", "seed"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashed passages around the seeds. Passages known to start earlier have no hash and come as runs; span: start << 32 | passages."""
    hashes, read = WordHashes(), unpacker()
    for batch in batches:
        found: list[tuple] = []
        for row, (id_, data, seeds) in enumerate(zip(batch.column("id").to_pylist(), batch.column("packed").to_pylist(), batch.column("seeds"), strict=True)):
            h = hashes.of(read(data).split())
            places, grams, own = picked(h)
            value, at, n = np.unique(grams, return_inverse=True, return_counts=True)
            seed = n > 1
            seed[at[np.searchsorted(places, seeds.values.to_numpy())]] = True
            starts = np.flatnonzero(seed[at[own]])
            a, b = window_hashes(h, LENGTH)[starts].view(np.int64), (window_hashes(h, LENGTH, 0xD1B54A32D192ED03)[starts] >> np.uint64(33)).astype(np.int32)
            found.append((a, b, starts, np.full(len(a), row), np.full(len(a), id_)))
        if not found:
            continue
        a, b, starts, row, ids = map(np.concatenate, zip(*found, strict=True))
        if not len(a):
            continue
        order = np.lexsort((starts, row, ids, b, a))
        same = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
        first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(order)), 0))
        known = ids[order] > ids[order[first]]
        known[1:] |= same & (row[order[1:]] == row[order[:-1]])
        again = np.zeros(len(a), dtype=bool)
        again[order] = known
        new_run = np.ones(len(a), dtype=bool)  # passages stand by row and start
        new_run[1:] = ~(again[1:] & again[:-1] & (row[1:] == row[:-1]) & (starts[1:] == starts[:-1] + 1))
        heads = np.flatnonzero(new_run)
        n = np.diff(np.append(heads, len(a)))
        again, b = again[heads], b[heads]
        b[again] = _scattered(ids[heads], starts[heads])[again].astype(np.int32)
        columns = [pa.array(a[heads], mask=again), pa.array(b), pa.array(ids[heads]), batch.column("key").take(pa.array(row[heads])), pa.array(starts[heads] << 32 | n)]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "id", "key", "span"])


def _kept(n_keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = unpacker()
        for batch in batches:
            totals, removed, kept, starts, stops, ends = [], [], [], [], [], [0]
            for data, spans, first in zip(batch.column("packed").to_pylist(), batch.column("spans"), batch.column("first").to_pylist(), strict=True):
                found = read(data).split()
                change = np.zeros(len(found) + 1, dtype=np.int64)
                if not first and len(found) >= LENGTH:
                    change[[0, -1]] = 1, -1
                elif spans.is_valid:
                    span = spans.values.to_numpy()
                    np.add.at(change, span >> 32, 1)
                    np.add.at(change, (span >> 32) + (span & 0xFFFFFFFF) + LENGTH - 1, -1)
                gone = np.cumsum(change) > 0
                edges = np.flatnonzero(np.diff(gone, prepend=False))
                starts.append(edges[::2])
                stops.append(edges[1::2])
                ends.append(ends[-1] + len(starts[-1]))
                totals.append(len(found))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(compress(found, ~gone) if removed[-1] else found).decode("utf-8", "surrogatepass"))
            flat = [pa.array(np.concatenate(x).astype(np.int32)) if x else pa.array([], pa.int32()) for x in (starts, stops)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, names=["start", "stop"]))
            own = [batch.column(f"keep_{k}") for k in range(n_keep)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), lists], names=[*(f"keep_{k}" for k in range(n_keep)), *(f.name for f in _RESULT)])

    return run


def dedup_substrings(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns plus n_words, n_removed, kept (the words that stay, joined by one blank) and
    repeats (the maximal runs of words that went, as start and stop)."""
    id_, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), F.col("text")
    names = [f"keep_{k}" for k in range(len(keep))]
    own = docs.select(id_.alias("id"), F.xxhash64(text).alias("key"), packed(text).alias("packed"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    # The first document of each text, by the same two columns that texts are dealt out by.
    first = docs.select(id_.alias("id"), F.xxhash64(text).alias("key"), F.xxhash64(F.lit(7), text).alias("key2"))
    first = first.groupBy("key", "key2").agg(F.min("id").alias("id")).select("id", "key").distinct()

    # Every reader takes all columns of `own`, so that one exchange serves all three.
    anchors = own.join(first, ["id", "key"]).mapInArrow(_anchors, "anchor long, id long, key long, place int, seed boolean")
    same = Over.partitionBy("anchor")
    seeds = anchors.withColumn("low", F.min("key").over(same)).withColumn("high", F.max("key").over(same)).where((F.col("low") != F.col("high")) | F.col("seed"))
    areas = seeds.groupBy("id", "key").agg(F.collect_set("place").alias("seeds"))
    passages = own.join(areas, ["id", "key"]).mapInArrow(_passages, "a long, b int, id long, key long, span long")
    earliest = F.min("id").over(Over.partitionBy("a", "b", F.when(F.col("a").isNull(), F.col("span"))))
    repeats = passages.withColumn("earliest", earliest).where(F.col("a").isNull() | (F.col("id") > F.col("earliest")))
    gone = repeats.groupBy("id", "key").agg(F.collect_set("span").alias("spans"))
    told = own.join(first.withColumn("first", F.lit(True)), ["id", "key"], "left").join(gone, ["id", "key"], "left")
    schema = T.StructType([T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, keep, strict=True)] + _RESULT)
    out = told.mapInArrow(_kept(len(keep)), schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *[f.name for f in _RESULT])


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS passage FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY passage ORDER BY doc_id, p) > 1 AS again FROM x),
g AS (SELECT doc_id, list_distinct(flatten(list(range(p, p + 20)))) AS gone FROM r WHERE again GROUP BY doc_id),
k AS (SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' '), '') END AS kept
  FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k
"""
