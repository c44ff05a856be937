"""Sharding along a Hilbert curve: rows with like metadata land in the same files.

Three metadata dimensions (language, source, log2 of the size) are quantised to 4 bits each; the
curve visits the 4096 cells so that neighbours on the curve are neighbours in every dimension, and
shards are cut as runs of that order. Law: `rows`, so shard counts differ by one at most.

A row's rank needs no global sort: cells times salts spans of hashed ids are counted, running totals
of these few counts give each span its first rank, and rows are numbered inside their span. There are
SALTS salts at least and one for each SPAN_ROWS rows, so that even a cell that holds all rows is
numbered in spans of about that size.

Null text: size 16, CRC of the empty text. Null or repeated doc_id: the row still gets its own slot
(ties are ordered by CRC and size). An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import sql_crc32, table

SHARDS, BITS, DIMENSIONS, SALTS, SPAN_ROWS = 40, 4, 3, 64, 1 << 20


def hilbert_index(point: tuple[int, ...], bits: int = BITS) -> int:
    """Place of a grid point on the curve, from the turns that each level of the grid makes (transposed Gray code)."""
    x, n = list(point), len(point)
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                swap = (x[0] ^ x[i]) & (q - 1)
                x[0], x[i] = x[0] ^ swap, x[i] ^ swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = 0
    for level in range(bits - 1, 0, -1):
        if x[-1] & (1 << level):
            flip ^= (1 << level) - 1
    x = [v ^ flip for v in x]
    return sum(((x[i] >> b) & 1) << (b * n + n - 1 - i) for b in range(bits) for i in range(n))


@lru_cache(maxsize=4)
def curve(bits: int = BITS, dimensions: int = DIMENSIONS) -> tuple[int, ...]:
    """The index of every cell, by the number whose digits are the cell's coordinates."""
    side = 1 << bits
    return tuple(hilbert_index(tuple((k // side**i) % side for i in range(dimensions - 1, -1, -1)), bits) for k in range(side**dimensions))


def _named(name: Column) -> Column:
    """4 bits that depend on a name alone: the first hex digit of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(name, F.lit(""))), 1, 1), 16, 10).cast("int")


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, curve_index, law, shard, slot, grown_shard for every row."""
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sized = docs.select("doc_id", (bytes_ + 16).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), _named(F.col("lang")).alias("a"), _named(F.col("source")).alias("b"))
    log_size = F.least(F.floor(F.log2(F.col("size").cast("double"))), F.lit(19)) - 4  # sizes from 16 bytes to half a megabyte and more
    cells = F.expr(f"array({', '.join(map(str, curve()))})")
    salts = max(SALTS, 1 << (docs.count() // SPAN_ROWS).bit_length())
    salt = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % salts
    keyed = sized.select("doc_id", "size", "text_crc32", F.element_at(cells, (F.col("a") * 256 + F.col("b") * 16 + log_size + 1).cast("int")).alias("curve_index"), salt.alias("salt"))
    counts = keyed.groupBy("curve_index", "salt").agg(F.count(F.lit(1)).alias("n"))  # salts * 4096 rows at most
    totals = counts.groupBy("curve_index").agg(F.sum("n").alias("total"))  # 4096 rows at most, so one task may run through them
    before = totals.select("curve_index", (F.sum("total").over(W.orderBy("curve_index")) - F.col("total")).alias("before"), F.sum("total").over(W.orderBy("curve_index").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("all"))
    first = counts.join(before, "curve_index").select("curve_index", "salt", "all", (F.col("before") + F.sum("n").over(W.partitionBy("curve_index").orderBy("salt")) - F.col("n")).alias("first"))
    inside = F.row_number().over(W.partitionBy("curve_index", "salt").orderBy("doc_id", "text_crc32", "size")) - 1
    ranked = keyed.withColumn("inside", inside).join(first, ["curve_index", "salt"]).withColumn("rank", F.col("first") + F.col("inside"))
    shard = F.expr(f"(rank * {shards}) div all")
    start = F.expr(f"(shard * all + {shards} - 1) div {shards}")
    placed = ranked.withColumn("shard", shard)
    return placed.select("doc_id", "size", "text_crc32", "curve_index", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("rank") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


OP2_SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 16 AS size,
    ('0x' || left(md5(coalesce(lang, '')), 1))::BIGINT AS a, ('0x' || left(md5(coalesce(source, '')), 1))::BIGINT AS b,
    ('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 8))::BIGINT % {SALTS} AS salt
  FROM documents
), c AS (
  SELECT doc_id, size, salt, [{", ".join(map(str, curve()))}][a * 256 + b * 16 + least(floor(log2(size)), 19)::BIGINT - 4 + 1]::INT AS curve_index,
    {sql_crc32('text')} AS text_crc32
  FROM t
), r AS (
  SELECT *, row_number() OVER (ORDER BY curve_index, salt, doc_id NULLS FIRST, text_crc32, size) - 1 AS rank, count(*) OVER () AS n FROM c
)
SELECT doc_id, size::BIGINT AS size, text_crc32, curve_index, 'rows' AS law, ((rank * {SHARDS}) // n)::INT AS shard,
  rank - ((rank * {SHARDS}) // n * n + {SHARDS} - 1) // {SHARDS} AS slot, NULL::INT AS grown_shard
FROM r
"""
