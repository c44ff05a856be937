"""N-gram Jaccard join: MinHash bands find candidates, full five-word shingle sets verify them.

Rows are told apart by doc_id and two hashes of the text, so rows without a doc_id and texts that
share one are compared like any others. Rows of equal shingle sets form a node first; one
representative of each node (its smallest doc_id, then text hash) goes on. `bands` x `rows` hash functions are chosen for a target recall at the threshold. A
bucket is a band with one value of its `rows` minima; its number holds the band in its high bits.

A pair of representatives is looked at once, in the first band in which it collides. Only numbers
travel until candidates are known: buckets of up to SMALL members list their pairs, and a pair asks
for its first bucket alone; texts of nodes that some bucket asks for follow, compressed. A larger
bucket is cut into blocks of about BLOCK members and BLOCK_GRAMS shingles by a hash, and each pair of
blocks is one group: no task gets more than two blocks, no matter how large a bucket is, and no pairs
leave a task, only counts of links and the links that connect its members. Classes of similar
documents are the connected components of these links. Groups of copies, buckets and classes that
hold many rows are joined by broadcast (`common.beside`).

Null and empty texts have no shingles: each is its own class without links. Texts of fewer than five
words are one shingle. A null doc_id takes part as the smallest id. Repeated rows count as copies.
Where doc_ids are null or repeated, classes of different texts may have the same class_id; `chosen`
tells one text of each. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, SHINGLE_WORDS, WordHashes, beside, checkpointed, give_back, mixed, packed, shingles, table, unpacker, words

SIMILARITY, RECALL = 0.8, 0.9999
SMALL, BLOCK, BLOCK_GRAMS = 12, 512, 1 << 19
_CELLS, _COLUMNS = 1 << 20, 2048
#: Bits of a bucket's number below the band.
_BAND_BITS = 56
#: A row's doc_id as a number and 128 bits of its text.
ROW_KEY = ["id", "text_key", "text_key2"]


@lru_cache(maxsize=8)
def banding(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = 128) -> tuple[int, int]:
    """(bands, rows) with the most rows for which `hashes` functions reach the recall at the threshold."""
    for rows in range(hashes, 0, -1):
        bands = 1
        while bands * rows <= hashes:
            if 1 - (1 - similarity**rows) ** bands >= recall:
                return bands, rows
            bands += 1
    return hashes, 1


def _seeds(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def band_values(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """For each shingle set the numbers of its buckets: a band and a hash of the band's minima."""
    seeds = _seeds(bands * rows)
    scale, shift = ((seeds | np.uint64(1)) >> np.uint64(32) | np.uint64(1)).astype(np.uint32)[:, None], seeds.astype(np.uint32)[:, None]
    lows = np.empty((len(sets), bands * rows), dtype=np.uint32)
    for k, s in enumerate(sets):  # odd multipliers permute the 32-bit numbers; high bits decide the order
        x = (s >> np.uint64(32)).astype(np.uint32)
        low = (x[None, :_COLUMNS] * scale + shift).min(axis=1)
        for start in range(_COLUMNS, len(x), _COLUMNS):
            np.minimum(low, (x[None, start : start + _COLUMNS] * scale + shift).min(axis=1), out=low)
        lows[k] = low
    out, lows = np.zeros((len(sets), bands), dtype=np.uint64), lows.reshape(len(sets), bands, rows)
    for k in range(rows):
        out = mixed(out * np.uint64(31) + lows[:, :, k] + np.uint64(1))
    return (out >> np.uint64(64 - _BAND_BITS) | np.arange(bands, dtype=np.uint64) << np.uint64(_BAND_BITS)).view(np.int64)


def _sums(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each run of so many numbers (modulo 2 ** 64)."""
    ends = np.cumsum(sizes)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(numbers, dtype=np.uint64)])
    return (total[ends] - total[ends - sizes]).view(np.int64)


#: id, text_key, text_key2, missing: a row; key, key2: its shingle set; size: shingles in it.
_SKETCH = "id long, text_key long, text_key2 long, missing boolean, key long, key2 long, size int, bands array<long>"


def _sketches(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                sets = [np.unique(shingles(hashes.of(words(t)))) for t in batch.column("text").to_pylist()]
                sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
                flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
                full = [s for s in sets if len(s)]
                values = pa.array(band_values(full, bands, rows).ravel() if full else np.empty(0, np.int64))
                ends = pa.array(np.concatenate([[0], np.cumsum((sizes > 0) * bands)]).astype(np.int32))
                keys = [pa.array(_sums(mixed(flat * np.uint64(m)), sizes)) for m in (3, 5)]
                own = [batch.column(c) for c in ("id", "text_key", "text_key2", "missing")]
                yield pa.RecordBatch.from_arrays([*own, *keys, pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(ends, values)], names=["id", "text_key", "text_key2", "missing", "key", "key2", "size", "bands"])
        give_back()

    return run


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a set of `a` with a set of `b`."""
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    if len(a) * len(b) <= 64:
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                out[i, j] = len(np.intersect1d(x, y, assume_unique=True))
        return out
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(flat_a, flat_b)
    of = lambda sets, flat: (np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.minimum(np.searchsorted(shared, flat), max(0, len(shared) - 1)))
    (row_a, at_a), (row_b, at_b) = of(a, flat_a), of(b, flat_b)
    if not len(shared):
        return out
    ok_a, ok_b = shared[at_a] == flat_a, shared[at_b] == flat_b
    row_a, at_a, row_b, at_b = row_a[ok_a], at_a[ok_a], row_b[ok_b], at_b[ok_b]
    step = max(1, _CELLS // max(len(a), len(b)))
    for low in range(0, len(shared), step):  # a slice of the shingles at a time
        x, y = np.zeros((len(a), min(step, len(shared) - low)), np.float32), np.zeros((len(b), min(step, len(shared) - low)), np.float32)
        in_a, in_b = (at_a >= low) & (at_a < low + step), (at_b >= low) & (at_b < low + step)
        x[row_a[in_a], at_a[in_a] - low], y[row_b[in_b], at_b[in_b] - low] = 1, 1
        out += np.rint(x @ y.T).astype(np.int64)
    return out


def _candidates(a: pd.DataFrame, b: pd.DataFrame, band: int, similarity: float) -> np.ndarray:
    """Which rows of `a` collide with which of `b` in this band first and have sizes that allow the similarity."""
    bands_a, bands_b = np.stack(list(a["bands"])), np.stack(list(b["bands"]))
    size_a, size_b = a["size"].to_numpy()[:, None], b["size"].to_numpy()[None, :]
    maybe = (bands_a[:, None, band] == bands_b[None, :, band]) & (np.minimum(size_a, size_b) >= similarity * np.maximum(size_a, size_b) - 1e-9)
    for k in range(band):
        maybe &= bands_a[:, None, k] != bands_b[None, :, k]
    return maybe


def _smallest_linked(linked: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that links connect each row, and each column, to; ids of rows that are also columns agree."""
    a, b = ids_a.copy(), ids_b.copy()
    most = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(a, np.where(linked, b[None, :], most).min(axis=1, initial=most))
        new_b = np.minimum(b, np.where(linked, new_a[:, None], most).min(axis=0, initial=most))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def _verified(similarity: float):
    """A group is a block pair of a bucket; returns its members' links and edges that connect what is linked."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        bucket, low, high = key
        a, b = group[group["block"] == low], group[group["block"] == high]
        maybe = _candidates(a, b, int(bucket) >> _BAND_BITS, similarity) if len(a) and len(b) else np.zeros((len(a), len(b)), bool)
        if low == high:
            np.fill_diagonal(maybe, False)
        a, b, maybe = a[maybe.any(axis=1)], b[maybe.any(axis=0)], maybe[maybe.any(axis=1)][:, maybe.any(axis=0)]
        if not len(a):
            return pd.DataFrame({"node": [], "other": [], "links": [], "weight": []}).astype({"node": "int64", "other": "Int64", "links": "int64", "weight": "int64"})
        hashes, read = WordHashes(), unpacker()
        sets = lambda x: [np.unique(shingles(hashes.of(read(t).split()))) for t in x["packed"]]
        sets_a = sets(a)
        sets_b = sets_a if low == high else sets(b)
        rows, cols = np.nonzero(maybe)
        if len(rows) <= 4 * (len(a) + len(b)):
            both = np.zeros(maybe.shape, dtype=np.int64)
            both[rows, cols] = [len(np.intersect1d(sets_a[i], sets_b[j], assume_unique=True)) for i, j in zip(rows, cols, strict=True)]
        else:
            both = _overlaps(sets_a, sets_b)
        linked = maybe & (both >= similarity * (a["size"].to_numpy()[:, None] + b["size"].to_numpy()[None, :] - both) - 1e-9)
        sides = [(a["node"].to_numpy(), linked.sum(axis=1), linked @ b["copies"].to_numpy())]
        if low != high:
            sides.append((b["node"].to_numpy(), linked.sum(axis=0), a["copies"].to_numpy() @ linked))
        tops = _smallest_linked(linked, a["node"].to_numpy(), b["node"].to_numpy())
        out = [pd.DataFrame({"node": ids, "other": pd.array(top, dtype="Int64"), "links": links, "weight": weight}) for (ids, links, weight), top in zip(sides, tops, strict=False)]
        if len(group) > BLOCK:
            del sets_a, sets_b, both, linked, maybe
            give_back()
        return pd.concat(out).query("links > 0").astype({"links": "int64", "weight": "int64"})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of `edges` (a, b): the component is its smallest id.

    Each round joins every id's neighbours to its smallest one, large ids first, then small ones, so
    rounds grow as the logarithm of a component's diameter. Lineage is cut in every round."""
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = checkpointed(edges.where("a <> b").distinct())
    before = state(edges)
    while True:
        near = both(edges)
        low = near.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "low").alias("low"), "n")
        large = beside(near.where("b > a"), low, ["a"], "n", 2 * before[0]).select(F.col("b").alias("a"), F.col("low").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n"))
        small = beside(down, low, ["a"], "n", 2 * before[0]).select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").unionByName(low.select("a", F.col("low").alias("b")))
        edges = checkpointed(small.distinct())
        now = state(edges)
        if now == before:
            break
        before = now
    found = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())


def row_key() -> list[Column]:
    """Columns that ROW_KEY names, from doc_id and text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("text_key"), F.xxhash64(F.lit(7), "text").alias("text_key2")]


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """A row for each row of `docs`: doc_id, id, class_id (smallest id of its connected class), copy_of
    (smallest id with the same shingle set), n_links (other rows of at least the similarity, copies
    included), n_text_links (other shingle sets of at least the similarity), text_key, text_key2 and
    chosen (true for one id and text of each class: the smallest id, then text_key and text_key2)."""
    bands, rows = banding(similarity, recall)
    base = docs.select(*row_key(), F.col("doc_id").isNull().alias("missing"), "text")
    sketched = checkpointed(base.mapInArrow(_sketches(bands, rows), _SKETCH))
    row = F.struct(*ROW_KEY)
    nodes = sketched.where("size > 0").groupBy("key", "key2").agg(F.min(row).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))  # written once, so numbers stay
    n_nodes, n_rows = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()

    members = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams")).where("n > 1")
    full = checkpointed(beside(members, checkpointed(buckets), ["bucket"], "n", n_nodes * bands))
    few = full.where(F.col("n") <= SMALL).groupBy("bucket").agg(F.collect_list(F.struct("node", "size")).alias("m"))  # SMALL members at most
    alike = lambda x, y: (x["node"] < y["node"]) & (F.least(x["size"], y["size"]) >= F.lit(similarity - 1e-9) * F.greatest(x["size"], y["size"]))
    listed = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: alike(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    pairs = few.select("bucket", F.explode(listed).alias("p")).groupBy("p.a", "p.b").agg(F.min("bucket").alias("bucket"))
    needed = pairs.select("bucket", F.explode(F.array("a", "b")).alias("node")).distinct().select("bucket", "node", F.lit(0).alias("block"), F.lit(0).alias("low"), F.lit(0).alias("high"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    many = full.where(F.col("n") > SMALL).select("bucket", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    many = many.select("bucket", "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("bucket", "node", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    wanted = checkpointed(needed.unionByName(many))

    # Only nodes that some bucket asks for bring their representative's text.
    asked = nodes.join(wanted.select("node").distinct(), "node", "left_semi").select("node", "rep.*", "size", "bands", "copies")
    brought = base.select(*ROW_KEY, packed("text").alias("packed")).join(asked, ROW_KEY).dropDuplicates(["node"]).select("node", "size", "bands", "copies", "packed")
    groups = wanted.join(brought, "node").groupBy("bucket", "low", "high")
    found = checkpointed(groups.applyInPandas(_verified(similarity), "node long, other long, links long, weight long"))

    linked = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("weight").alias("weight"))
    joined = checkpointed(components(found.select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "node"))
    tops = joined.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("top"), F.count(F.lit(1)).alias("n"))
    of_class = beside(joined, tops, ["component"], "n", n_nodes).select("node", "top")
    of_node = nodes.select("node", "key", "key2", "rep", "copies").join(linked, "node", "left").join(of_class, "node", "left")
    of_node = of_node.select("key", "key2", "rep", "copies", F.coalesce("top", "rep").alias("top"), (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("links", F.lit(0)).alias("n_text_links"))
    own = sketched.select(*ROW_KEY, "missing", "key", "key2", "size")
    out = beside(own.where("size > 0"), of_node, ["key", "key2"], "copies", n_rows).select(*ROW_KEY, "missing", F.col("top.id").alias("class_id"), F.col("rep.id").alias("copy_of"), "n_links", "n_text_links", (F.col("top") == row).alias("chosen"))
    alone = own.where("size = 0").select(*ROW_KEY, "missing", F.col("id").alias("class_id"), F.col("id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_text_links"), F.lit(True).alias("chosen"))
    doc_id = F.when(~F.col("missing"), F.col("id")).cast(docs.schema["doc_id"].dataType)
    return out.unionByName(alone).select(doc_id.alias("doc_id"), "id", "class_id", "copy_of", "n_links", "n_text_links", "text_key", "text_key2", "chosen")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_of", "n_links", "n_text_links")


def brute_force(rows: list[tuple[int, str]], similarity: float = SIMILARITY) -> dict[int, tuple[int, int]]:
    """For tests, ids distinct: (class_id, n_links) of each id, from all pairs of word-tuple sets."""
    sets = {}
    for id_, text in rows:
        w = words(text)
        k = min(SHINGLE_WORDS, len(w))
        sets[id_] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    links = {a: {b for b in sets if a != b and sets[a] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])} for a in sets}
    out = {}
    for a in sorted(sets):
        if a not in out:
            seen, todo = {a}, [a]
            while todo:
                new = links[todo.pop()] - seen
                seen |= new
                todo += new
            out |= {x: (a, len(links[x])) for x in seen}
    return out
