"""Filters, joins, splits and ordered operators on DataFrames (survey 2.3, 2.4, 2.6, 2.7, 2.8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..folders import checkpointed
from ..functions.labels import strip


# Projections and filters.
def named(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns named by position."""
    return df.toDF(*names)


def allowed(df: DataFrame, names: list[str]) -> DataFrame:
    """The listed columns that exist, in list order."""
    return df.select(*[n for n in names if n in df.columns])


def not_header(df: DataFrame, column: str) -> DataFrame:
    """Rows that repeat the header go; nulls stay."""
    return df.where(~F.col(column).eqNullSafe(F.lit(column)))


def long_enough(df: DataFrame, series: list[str], least: int) -> DataFrame:
    """All series have at least so many points."""
    return df.where(reduce(Column.__and__, (F.size(c) >= least for c in series)))


def without_comparisons(df: DataFrame, kind: str) -> DataFrame:
    """P10: comparison questions go; a missing kind stays."""
    return df.where(~F.startswith(F.coalesce(kind, F.lit("")), F.lit("comparison")))


def validated(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """P12, 1.3: rows whose required fields are not blank, and the quarantine of the others."""
    ok = reduce(Column.__and__, (F.coalesce(strip(F.col(c)) != "", F.lit(False)) for c in required))
    return df.where(ok), df.where(~ok)


def sentinel_null(c: Column, sentinel: float = -1) -> Column:
    """P15."""
    return F.nullif(c, F.lit(sentinel))


def completion(answered: Column, questions: int = 3) -> Column:
    """P22."""
    return F.when(answered >= questions, "complete").when(answered > 0, "partial").otherwise("empty")


def tier(rate: Column) -> Column:
    """P23."""
    return F.when(rate >= 70, "excellent").when(rate >= 50, "good").when(rate >= 30, "fair").otherwise("poor")


# Joins. Spark picks the strategy from sizes it knows; nothing is broadcast by hand.
def on_common_keys(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Each side restricted to keys that the other has."""
    return a.join(b.select(key).distinct(), key, "left_semi"), b.join(a.select(key).distinct(), key, "left_semi")


def collected_lookup(df: DataFrame, key: str, ids: str, dim: DataFrame, value: Column, default: str) -> DataFrame:
    """A list of ids to the list of looked-up texts in the same order; a miss gets the default."""
    exploded = df.select(key, F.posexplode(ids).alias("pos", "id"))
    found = exploded.join(dim.select(F.col("id"), value.alias("found")), "id", "left")
    return found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("found", F.lit(default)).alias("v")))), lambda s: s["v"]).alias("found"))


def zipped(a: Column, b: Column) -> Column:
    """Pairs by position, as many as the shorter has."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, F.lit(1), n).alias("a"), F.slice(b, F.lit(1), n).alias("b"))


def reviewer_pairs(df: DataFrame, sample: str, reviewer: str, answer: str) -> DataFrame:
    """Pairs of reviewers of the same sample; reviewers of a sample are few, so an equi-join on it does."""
    a = df.select(F.col(sample), F.col(reviewer).alias("first"), F.col(answer).alias("first_answer"))
    b = df.select(F.col(sample), F.col(reviewer).alias("second"), F.col(answer).alias("second_answer"))
    return a.join(b, sample).where(F.col("first") < F.col("second"))


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What has no result yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def round_robin(samples: DataFrame, id_: str, reviewers: int, reviews: int, seed: int) -> DataFrame:
    """The sample at place q of the shuffled order goes to reviewers q, q + 1, ... (mod `reviewers`), so loads differ by `reviews` at most."""
    if not 0 < reviews <= reviewers:
        raise ValueError(f"{reviews} different reviewers of {reviewers} for each sample")
    ranked = _ranks(samples.select(id_), id_, seed, [])
    rounds = ranked.select(id_, "rn", F.explode(F.sequence(F.lit(0), F.lit(reviews - 1))).alias("round"))
    return rounds.select(id_, "round", F.pmod(F.col("rn") - 1 + F.col("round"), F.lit(reviewers)).cast("int").alias("reviewer"))


def grid(*frames: DataFrame) -> DataFrame:
    """All combinations of a few small lists of settings."""
    return reduce(DataFrame.crossJoin, frames)


# Windows and order.
def entity_windows(df: DataFrame, entity: str, ts: str, seconds: float) -> DataFrame:
    """window_id counted from each entity's own first time; windows are closed on the left."""
    origin = F.min(ts).over(W.partitionBy(entity))
    micros = F.timestamp_diff("MICROSECOND", origin, F.col(ts))
    return df.withColumn("window_id", F.floor(micros / F.lit(int(seconds * 1_000_000))).cast("long"))


def window_majority(df: DataFrame, entity: str, label: str, least: float = 0.5) -> DataFrame:
    """Each window's most frequent label (ties: the smallest), if it has at least that share of all rows.

    Rows without a label can't win, but count in the total. Rows are counted before anything is ranked, so a
    window sends its distinct labels only."""
    counts = df.groupBy(entity, "window_id", label).agg(F.count(F.lit(1)).alias("n"))
    candidate = F.when(F.col(label).isNotNull(), F.struct((-F.col("n")).alias("k"), F.col(label).alias("label")))
    best = counts.groupBy(entity, "window_id").agg(F.sum("n").alias("total"), F.min(candidate).alias("best"))
    return best.select(entity, "window_id", F.col("best.label").alias("label"), (-F.col("best.k")).alias("n"), "total").where(F.col("n") >= least * F.col("total"))


def window_series(df: DataFrame, entity: str, order: list[str], value: str) -> DataFrame:
    """A window's values in order, as an array."""
    return df.groupBy(entity, "window_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("v")))), lambda s: s["v"]).alias("series"))


def interpolated(df: DataFrame, entity: str | None, order: list[str], value: str) -> DataFrame:
    """Linear by row position; leading gaps stay, trailing ones carry the last value. NaN counts as missing.

    Without an entity the whole table is one series. No task runs through a whole series: a range
    partitioning cuts it into parts, in each of which rows get their places and the known values next to them. Of a
    part one row goes on: how many rows it has, its first and its last known value. A scan over these few says
    what each part needs from before and after it. `order` should tell rows apart."""
    keys = [*([entity] if entity else []), *order]
    series = F.col(entity) if entity else F.lit(0)
    marked = df.repartitionByRange(*keys).select("*", series.alias("_series"), F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("_v"), F.spark_partition_id().alias("_part"))
    cut = checkpointed(marked)  # so that parts stay as they are

    part = W.partitionBy("_series", "_part")
    point = lambda i: F.when(F.col("_v").isNotNull(), F.struct(i.alias("i"), F.col("_v").alias("v")))
    upto = lambda w, end: w.rowsBetween(W.unboundedPreceding, end)
    at = cut.withColumn("_i", F.row_number().over(part.orderBy(*order))).withColumn("_known", point(F.col("_i").cast("long")))
    at = at.withColumn("_b", F.last("_known", True).over(upto(part.orderBy("_i"), 0))).withColumn("_a", F.last("_known", True).over(upto(part.orderBy(F.desc("_i")), 0)))

    # Parts are few. The next known value is the last one in reversed order, so both scans are running ones.
    parts = at.groupBy("_series", "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_known").alias("first"), F.max("_known").alias("last"))
    whole = W.partitionBy("_series")
    parts = parts.withColumn("_from", F.coalesce(F.sum("n").over(upto(whole.orderBy("_part"), -1)), F.lit(0)))
    shifted = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}.i") + F.col("_from")).alias("i"), F.col(f"{c}.v").alias("v")))
    parts = parts.withColumn("first", shifted("first")).withColumn("last", shifted("last"))
    carried = parts.select("_series", "_part", "_from", F.last("last", True).over(upto(whole.orderBy("_part"), -1)).alias("_before"), F.last("first", True).over(upto(whole.orderBy(F.desc("_part")), -1)).alias("_after"))

    both = at.join(carried, (at["_series"].eqNullSafe(carried["_series"])) & (at["_part"] == carried["_part"]))
    i, b, a = F.col("_i") + F.col("_from"), F.coalesce(shifted("_b"), "_before"), F.coalesce(shifted("_a"), "_after")
    both = both.withColumns({"_i": i, "_b": b, "_a": a})
    share = (F.col("_i") - F.col("_b.i")) / (F.col("_a.i") - F.col("_b.i"))
    filled = F.coalesce(at["_v"], F.when(F.col("_a").isNull(), F.col("_b.v")).otherwise(F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * share))
    return both.select(*[filled.alias(c) if c == value else at[c] for c in df.columns])


def first_per_group(df: DataFrame, group: str, order: list[str], n: int, complete: bool = False) -> DataFrame:
    """The first n of each group; with `complete`, only of groups that have n."""
    out = df.withColumn("rn", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rn") <= n)
    return out.withColumn("size", F.count(F.lit(1)).over(W.partitionBy(group))).where(F.col("size") >= n).drop("size") if complete else out


def hashed(seed: int, *keys: str) -> Column:
    """A shuffle key that SQL engines share."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def balanced_batches(df: DataFrame, label: str, id_: str, batch: int, seed: int) -> DataFrame:
    """Every batch has the same number of each class, until the smallest class ends."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("classes"))
    ranked = _ranks(df, id_, seed, [label]).drop("n").withColumn("rn", F.col("rn") - 1)
    per = F.expr(f"{batch} div classes")
    placed = ranked.crossJoin(sizes).withColumn("per", per).withColumn("batch", F.expr("rn div per"))  # sizes is one row
    return placed.where((F.lit(batch) % F.col("classes") == 0) & (F.col("batch") < F.expr("least div per"))).drop("per", "least", "classes", "rn")


def early_stop(losses: Column, margin: float = 1e-4, patience: int = 2) -> Column:
    """(best_epoch, best, stopped_at) of losses in epoch order; an improvement must exceed the margin."""
    start = F.struct(F.lit(0).alias("epoch"), F.lit(0).alias("best_epoch"), F.lit(float("inf")).alias("best"), F.lit(0).alias("misses"), F.lit(0).alias("stopped_at"))

    def step(s: Column, x: Column) -> Column:
        epoch, better = s["epoch"] + 1, x + margin < s["best"]
        misses = F.when(better, 0).otherwise(s["misses"] + 1)
        new = F.struct(epoch.alias("epoch"), F.when(better, epoch).otherwise(s["best_epoch"]).alias("best_epoch"), F.when(better, x).otherwise(s["best"]).alias("best"), misses.alias("misses"), F.when(misses >= patience, epoch).otherwise(0).alias("stopped_at"))
        return F.when(s["stopped_at"] > 0, s).otherwise(new)

    return F.aggregate(losses, start, step)


# Splits: exact sizes, the same rows whatever the partitioning.
def _ranks(df: DataFrame, id_: str, seed: int, group: list[str], buckets: int = 256) -> DataFrame:
    """`rn` (from 1) and `n` in each group by hashed order. Ranks come from counts of hash prefixes, so
    even one huge group is ordered in `buckets` tasks."""
    keyed = df.withColumn("_h", hashed(seed, id_)).withColumn("_b", F.conv(F.substring("_h", 1, 2), 16, 10).cast("int") % buckets)
    counts = keyed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    by = W.partitionBy(*group)
    firsts = counts.select(*group, "_b", (F.sum("_c").over(by.orderBy("_b")) - F.col("_c")).alias("_first"), F.sum("_c").over(by).alias("n"))
    inner = F.row_number().over(W.partitionBy(*group, "_b").orderBy("_h", id_))
    return keyed.withColumn("_in", inner).join(firsts, [*group, "_b"]).withColumn("rn", F.col("_first") + F.col("_in")).drop("_h", "_b", "_c", "_in", "_first")


def random_split(df: DataFrame, id_: str, seed: int, test: float = 0.1, validation: float = 0.1) -> DataFrame:
    """`split`; a share is rounded up to whole rows."""
    ranked = _ranks(df, id_, seed, [])
    n_test, n_val = F.ceil(F.col("n") * test), F.ceil(F.col("n") * validation)
    return ranked.withColumn("split", F.when(F.col("rn") <= n_test, "test").when(F.col("rn") <= n_test + n_val, "validation").otherwise("train")).drop("rn", "n")


def stratified_split(df: DataFrame, id_: str, label: str, seed: int, test: float = 0.1, validation: float = 0.1) -> DataFrame:
    """Each class keeps its share in every split; parts are rounded by largest remainder, so totals are exact."""
    ranked = _ranks(df, id_, seed, [label])
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    take = _allocated(sizes, label, {"test": test, "validation": validation})
    placed = ranked.join(take, label)
    return placed.withColumn("split", F.when(F.col("rn") <= F.col("test"), "test").when(F.col("rn") <= F.col("test") + F.col("validation"), "validation").otherwise("train")).drop("rn", "n", "test", "validation")


def _allocated(sizes: DataFrame, label: str, shares: dict[str, float]) -> DataFrame:
    out, every = sizes.select(label, "n"), W.partitionBy()
    for name, share in shares.items():
        exact = F.col("n") * F.lit(share)
        rest = F.ceil(F.sum("n").over(every) * F.lit(share)) - F.sum(F.floor(exact)).over(every)
        order = F.row_number().over(W.orderBy((F.floor(exact) - exact), label))
        out = out.withColumn(name, (F.floor(exact) + (order <= rest).cast("int")).cast("long"))
    return out.drop("n")


def entity_split(entity: Column, validation: list, test: list) -> Column:
    """R04."""
    return F.when(entity.isin(*validation), "validation").when(entity.isin(*test), "test").otherwise("train")


def sampled(df: DataFrame, id_: str, seed: int, n: int) -> DataFrame:
    """N rows, the same ones whatever the partitioning."""
    return df.orderBy(hashed(seed, id_), id_).limit(n)


def dealt(df: DataFrame, id_: str, seed: int, world: int) -> DataFrame:
    """Shuffled rows dealt to so many workers; loads differ by one row at most."""
    return _ranks(df, id_, seed, []).withColumn("worker", F.pmod(F.col("rn") - 1, F.lit(world)).cast("int")).drop("rn", "n")


def weighted_choice(u: Column, choices: dict[str, float]) -> Column:
    """A uniform number to a category by cumulative shares."""
    out, total = None, 0.0
    for name, share in choices.items():
        total += share
        out = F.when(u < round(total, 12), name) if out is None else out.when(u < round(total, 12), name)
    return out.otherwise(name)


# Sets.
def union_all(*frames: DataFrame, missing: bool = False) -> DataFrame:
    """U01, U02."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), frames)


def ordered_union(*frames: DataFrame) -> DataFrame:
    """Parts in order."""
    return reduce(DataFrame.unionByName, (f.withColumn("part", F.lit(k)) for k, f in enumerate(frames)))


def records_to_rows(df: DataFrame, keep: list[str], records: Column) -> DataFrame:
    """A row for each element of an array of structs that an expression makes of a row."""
    return df.select(*keep, F.inline(records))


def aligned_windows(df: DataFrame, ts: str, seconds: float, origin: Column | None = None) -> DataFrame:
    """window_id counted from one origin (the epoch if none is given), so that a stream needs no entity's first time."""
    start = F.timestamp_seconds(F.lit(0)) if origin is None else origin
    micros = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(start)
    return df.withColumn("window_id", F.floor(micros / F.lit(int(seconds * 1_000_000))).cast("long"))
