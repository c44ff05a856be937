"""Merkle manifest of a dataset: a postorder log of a ternary hash tree for each source, and of one over their roots.

Leaves of a tree are numbered in order. Node i of level l stands for leaves i * 3**l and on, 3**l of them or
as many as are left. In postorder a node is written when the last leaf below it, e, is complete: leaf e comes
after e other leaves and the floor(e / 3) + floor(e / 9) + ... nodes that were complete before it, and the
nodes that e completes follow it level by level. So a node's position is

    position(l, i) = sum of floor(e / 3**t) for t = 0, 1, 2, ...   + l,   e = min((i + 1) * 3**l, leaves) - 1

and no node needs to know where another was written. Builders are aligned: one has the nodes of a level that
one node SPAN levels higher stands for, so it needs no other builder's nodes, and it writes what it makes in
the order in which it is complete. Each round of builders goes SPAN levels up, from the roots of the round
before; each tree ends at its own height. Proofs go down the rounds: a builder's rows address the siblings of
each of its nodes by their positions, after the path of the builder's root, which the round above has made.

A leaf is the digest of a row: each of its fields, `-` if null, else its UTF-8 length, `:` and the field.
Null sources are one source, the first; null doc_ids come first; rows of one source and doc_id are in order of
their digests, and equal ones each have a leaf. An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, sql_crc32, table

#: Children of a node, and levels of one builder: it has up to ARITY ** SPAN nodes to start from.
ARITY, SPAN = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LOG = "tree string, n long, segment long, level int, i long, position long, hash string, doc_id string, tampered string"
_PATH = "tree string, segment long, befores array<string>, afters array<string>, subroot string"
_PROOF = "doc_id string, leaf string, subroot string, proof_sha256 string, folded_root string"


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column | None = None) -> Column:
    """The digest of a row, with another text in place of its own if one is given."""
    return F.sha2(F.concat(*[_field(text if text is not None and name == "text" else F.col(name)) for name in FIELDS]), 256)


def height(leaves: int) -> int:
    """Levels above the leaves."""
    up = 0
    while ARITY**up < leaves:
        up += 1
    return up


def positions(level: int, i: np.ndarray, leaves: int) -> np.ndarray:
    """Where nodes of a level stand in the postorder of a tree of so many leaves, in closed form."""
    last = np.minimum((i + 1) * ARITY**level, leaves) - 1
    out, at = last + level, last // ARITY
    while at.any():
        out, at = out + at, at // ARITY
    return out


def joined_digest(hashes: list[str]) -> str:
    return hashlib.sha256("".join(hashes).encode()).hexdigest()


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`local`: the place of each row among those of its tree in this partition, which is sorted by tree."""
    last, before = None, 0
    for b in batches:
        runs = pc.run_end_encode(b["tree"])
        ends = np.asarray(runs.run_ends)
        starts = np.concatenate(([0], ends[:-1]))
        local = np.arange(b.num_rows) - np.repeat(starts, ends - starts)
        if b.num_rows:
            if runs.values[0].as_py() == last:
                local[: ends[0]] += before
            last, before = runs.values[-1].as_py(), int(local[-1]) + 1
        yield b.append_column("local", pa.array(local, pa.int64()))


def ordered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """The rows with `tree`, numbered by `i` from 0 in each tree, and `n`, the tree's rows; and the largest n.

    A range partitioning by tree and order puts even one huge tree into many tasks. Rows are numbered inside
    each task, and running totals of the tasks' counts (a row for each task and tree) make that whole."""
    keys = ["tree", *order]
    dealt = checkpointed(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"))
    by = W.partitionBy("tree")
    firsts = counts.select("tree", "part", (F.sum("rows").over(by.orderBy("part")) - F.col("rows")).alias("first"), F.sum("rows").over(by).alias("n"))
    local = dealt.mapInArrow(_numbered, T.StructType([*dealt.schema.fields, T.StructField("local", T.LongType())]))
    out = local.join(firsts, ["tree", "part"]).withColumn("i", F.col("first") + F.col("local")).drop("part", "first", "local")
    return out, firsts.agg(F.max("n")).first()[0] or 0


def _build(base: int):
    """A builder: nodes of level `base` below one node of level base + SPAN, and all that they complete up to that."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i", kind="stable")
        n, segment = int(rows["n"].iloc[0]), int(key[1])
        made = [(base, rows["i"].to_numpy("int64"), rows["hash"].tolist())]
        for level in range(base + 1, min(base + SPAN, height(n)) + 1):
            below = made[-1][2]
            hashes = [joined_digest(below[k : k + ARITY]) for k in range(0, len(below), ARITY)]
            made.append((level, segment * ARITY ** (base + SPAN - level) + np.arange(len(hashes), dtype="int64"), hashes))
        parts = [pd.DataFrame({"level": np.int32(level), "i": i, "position": positions(level, i, n), "hash": hashes}) for level, i, hashes in made]
        parts[0] = parts[0].assign(doc_id=rows["doc_id"].to_numpy(), tampered=rows["tampered"].to_numpy())
        log = pd.concat(parts).assign(tree=key[0], n=n, segment=segment)
        return log.sort_values("position")[_names(_LOG)]

    return build


def build_logs(leaves: DataFrame, most: int) -> list[DataFrame]:
    """The log of all trees, one table for each round of builders. `leaves`: tree, n, i, hash, doc_id, tampered; no tree has more than `most`."""
    rounds: list[DataFrame] = []
    while not rounds or ARITY ** (SPAN * len(rounds)) < most:
        base = SPAN * len(rounds)
        if rounds:
            leaves = rounds[-1].where((F.col("level") == base) & (F.col("n") > ARITY**base))
        keyed = leaves.select("tree", "n", "i", "hash", "doc_id", "tampered", F.expr(f"i div {ARITY**SPAN}").alias("segment"))
        rounds.append(checkpointed(keyed.groupBy("tree", "segment").applyInPandas(_build(base), _LOG)))
    return rounds


def _ends(k: int) -> Column:
    """True where round k made the root of the tree."""
    return (F.col("n") <= ARITY ** (SPAN * (k + 1))) & (F.lit(not k) | (F.col("n") > ARITY ** (SPAN * k)))


def roots(rounds: list[DataFrame]) -> DataFrame:
    """tree, root: the node that each tree's log ends with."""
    found = [log.where(_ends(k)).groupBy("tree").agg(F.max_by("hash", "position").alias("root")) for k, log in enumerate(rounds)]
    return reduce(DataFrame.unionByName, found)


def _siblings(log: pd.DataFrame, base: int) -> tuple[pd.DataFrame, list[list[str]], list[list[str]]]:
    """The nodes that a builder began with, and for each the siblings before and after it, level by level, by their positions."""
    n = int(log["n"].iloc[0])
    at = dict(zip(log["position"].tolist(), log["hash"].tolist(), strict=True))
    start = log[log["level"] == base].sort_values("i")
    i = start["i"].to_numpy("int64")
    befores, afters = [[] for _ in i], [[] for _ in i]
    for level in range(base, min(base + SPAN, height(n))):
        nodes = -(-n // ARITY**level)
        inside, run = (i % ARITY).tolist(), i - i % ARITY
        members = np.stack([positions(level, run + k, n) for k in range(ARITY)], axis=1).tolist()
        sizes = np.minimum(nodes - run, ARITY).tolist()
        for row, (mine, member, size) in enumerate(zip(inside, members, sizes, strict=True)):
            befores[row].append("".join(at[p] for p in member[:mine]))
            afters[row].append("".join(at[p] for p in member[mine + 1 : size]))
        i = i // ARITY
    return start, befores, afters


def _above(upper: pd.DataFrame) -> tuple[list[str], list[str], str | None]:
    """The path above a builder's root, and the root of its tree; at the top of the top tree there is none."""
    return (list(upper["befores"].iloc[0]), list(upper["afters"].iloc[0]), upper["subroot"].iloc[0]) if len(upper) else ([], [], None)


def _paths(base: int):
    """The path of each node that a builder began with."""

    def paths(log: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        if not len(log):
            return pd.DataFrame(columns=_names(_PATH))
        more_before, more_after, subroot = _above(upper)
        start, befores, afters = _siblings(log, base)
        return pd.DataFrame({"tree": start["tree"].to_numpy(), "segment": start["i"].to_numpy("int64"), "befores": [b + more_before for b in befores], "afters": [a + more_after for a in afters], "subroot": subroot})

    return paths


def _proofs(log: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
    """Each leaf's proof, and the root that its tampered digest and the siblings fold to."""
    if not len(log):
        return pd.DataFrame(columns=_names(_PROOF))
    more_before, more_after, subroot = _above(upper)
    more = "".join(b + a for b, a in zip(more_before, more_after, strict=True))
    start, befores, afters = _siblings(log, 0)
    proofs, folded = [], []
    for own, tampered, before, after in zip(start["hash"], start["tampered"], befores, afters, strict=True):
        proofs.append(joined_digest([*(b + a for b, a in zip(before, after, strict=True)), more]))
        digest = own if tampered is None else tampered
        for b, a in zip(before + more_before, after + more_after, strict=True):
            digest = joined_digest([b, digest, a])
        folded.append(digest)
    return pd.DataFrame({"doc_id": start["doc_id"].to_numpy(), "leaf": start["hash"].to_numpy(), "subroot": subroot, "proof_sha256": proofs, "folded_root": folded})


def _beside(log: DataFrame, upper: DataFrame, f, schema: str) -> DataFrame:
    return log.groupBy("tree", "segment").cogroup(upper.groupBy("tree", "segment")).applyInPandas(f, schema)


def _downwards(rounds: list[DataFrame], over: DataFrame | None = None) -> DataFrame:
    """The paths of the lowest builders' roots. `over`: those of the trees' roots, if anything is above them."""
    upper = rounds[0].sparkSession.createDataFrame([], _PATH)
    for k in reversed(range(len(rounds))):
        if over is not None:
            own = rounds[k].where(_ends(k)).select("tree").distinct()
            upper = upper.unionByName(over.join(own, "tree", "left_semi"))
        if k:
            upper = _beside(rounds[k], upper, _paths(SPAN * k), _PATH)
    return upper


def manifest(leaves: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. `leaves`: doc_id, tree, hash, tampered (null: as hash); trees are in order of their names."""
    id_type = leaves.schema["doc_id"].dataType
    numbered, most = ordered(leaves, ["doc_id", "hash"])
    rounds = build_logs(numbered.withColumn("doc_id", F.col("doc_id").cast("string")), most)
    # The names of the trees stand in place of ids in the tree of roots.
    tops, most = ordered(roots(rounds).select(F.lit("").alias("tree"), F.col("root").alias("hash"), F.col("tree").alias("doc_id"), F.lit(None).cast("string").alias("tampered")), ["doc_id"])
    tops = checkpointed(tops)
    top_rounds = build_logs(tops, most)
    paths = _beside(top_rounds[0], _downwards(top_rounds), _paths(0), _PATH).drop("tree", "subroot")
    over = checkpointed(tops.select(F.col("i").alias("segment"), F.col("doc_id").alias("tree"), F.col("hash").alias("subroot")).join(paths, "segment").withColumn("segment", F.lit(0).cast("long")))
    root = roots(top_rounds).first()  # one row
    out = _beside(rounds[0], _downwards(rounds, over), _proofs, _PROOF)
    out = out.withColumn("root", F.lit(root["root"] if root else None).cast("string"))
    return out.select(F.col("doc_id").cast(id_type).alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def leaf_table(docs: DataFrame) -> DataFrame:
    """doc_id, tree (the source, `=` before it; null: empty), hash, and `tampered`: the digest with the text's
    line feeds deleted, where 2 divides the CRC of the doc_id and there are any (null where not, and for a null doc_id)."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)) & F.contains("text", F.lit("\n"))
    tampered = F.when(hit, leaf(F.translate("text", "\n", "")))
    read = docs.select(*FIELDS, leaf().alias("hash"))
    return read.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree"), "hash", tampered.alias("tampered"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(checkpointed(leaf_table(table(spark, sf_dir, "documents"))))


#: DuckDB: the digest of a row, here with `text` as it is or without its line feeds.
_SQL_FIELDS = lambda text: " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in (*FIELDS[:-1], text))
_TREES = """
{nodes} AS (
  SELECT tree, 0 AS level, i, hash, count(*) OVER (PARTITION BY tree) AS n FROM {leaves}
  UNION ALL
  SELECT tree, any_value(level) + 1, i // 3, sha256(string_agg(hash, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM {nodes} WHERE n > 1 GROUP BY tree, i // 3
), {roots} AS (SELECT tree, hash AS root FROM {nodes} WHERE n = 1)"""
_WALK = """
{walks} AS (
  SELECT tree, i AS leaf_i, 0 AS level, i, hash, {start} AS folded, '' AS proof FROM {leaves}
  UNION ALL
  SELECT w.tree, w.leaf_i, any_value(w.level) + 1, any_value(w.i) // 3, sha256(string_agg(s.hash, '' ORDER BY s.i)), sha256(string_agg(CASE WHEN s.i = w.i THEN w.folded ELSE s.hash END, '' ORDER BY s.i)),
    any_value(w.proof) || coalesce(string_agg(s.hash, '' ORDER BY s.i) FILTER (s.i <> w.i), '')
  FROM {walks} w JOIN {nodes} s ON s.tree = w.tree AND s.level = w.level AND s.i // 3 = w.i // 3 WHERE s.n > 1 GROUP BY w.tree, w.leaf_i
)"""

#: Trees level by level, and each leaf's way up, without a log. What is tampered folds through both trees.
OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({_SQL_FIELDS("text")}) AS hash,
    sha256({_SQL_FIELDS("CASE WHEN {hit} THEN replace(text, chr(10), '') ELSE text END").replace("{hit}", f"coalesce({sql_crc32('doc_id::VARCHAR')} % 2 = 0, false)")}) AS tampered FROM documents
), leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash) - 1 AS i FROM d
), {_TREES.format(nodes="nodes", leaves="leaves", roots="subroots")},
tops AS (SELECT '' AS tree, tree AS name, root AS hash, row_number() OVER (ORDER BY tree) - 1 AS i FROM subroots
), {_TREES.format(nodes="top_nodes", leaves="tops", roots="top_root")},
{_WALK.format(walks="ways", leaves="leaves", nodes="nodes", start="tampered")},
done AS (SELECT w.* FROM ways w JOIN (SELECT tree, leaf_i, max(level) AS level FROM ways GROUP BY ALL) USING (tree, leaf_i, level)
), starts AS (SELECT t.tree, t.i, t.hash, d.folded, d.proof, d.tree AS name, d.leaf_i FROM done d JOIN tops t ON t.name = d.tree
), top_ways AS (
  SELECT name, leaf_i, 0 AS level, i, folded, proof FROM starts
  UNION ALL
  SELECT w.name, w.leaf_i, any_value(w.level) + 1, any_value(w.i) // 3, sha256(string_agg(CASE WHEN s.i = w.i THEN w.folded ELSE s.hash END, '' ORDER BY s.i)),
    any_value(w.proof) || coalesce(string_agg(s.hash, '' ORDER BY s.i) FILTER (s.i <> w.i), '')
  FROM top_ways w JOIN top_nodes s ON s.level = w.level AND s.i // 3 = w.i // 3 WHERE s.n > 1 GROUP BY w.name, w.leaf_i
), ends AS (SELECT w.* FROM top_ways w JOIN (SELECT name, leaf_i, max(level) AS level FROM top_ways GROUP BY ALL) USING (name, leaf_i, level))
SELECT l.doc_id, l.hash AS leaf, s.root AS subroot, r.root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = r.root AS verified
FROM leaves l JOIN ends e ON e.name = l.tree AND e.leaf_i = l.i JOIN subroots s ON s.tree = l.tree CROSS JOIN top_root r
"""
