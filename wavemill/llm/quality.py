"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates.

Statistics of each whole text become a vector of five transformed numbers. For each language and
source the robust centre and covariance are searched from STARTS starts: the coordinates' medians and
spreads, mean and covariance of all rows, and those of a hashed part of the rows. A concentration step
keeps the share H of rows that lie nearest to an estimate and takes their mean and covariance, whose
determinant can only fall; steps go on until no determinant falls any more, and the start of the least
determinant wins. Rows are then rejected by squared Mahalanobis distance.

Every step is two passes over all rows, each combined by batch and then by Spark: counts of distances
by bin, which give the distance of the share H, and sums over the rows that lie nearer. Medians and
shares are found in histograms of fixed bins, which add up to the same whatever the partitioning; a
row at the edge bin is kept with its bin. No row is shuffled or joined: what a pass needs to know, some
1,000 bytes a cell, goes with its code. More cells than CELLS are dealt with in turn, by a hash of
their names, in more passes over the rows and not with more memory.

Every row has a distance. What few rows a language and source has is filled up by its language, and
that by all rows: the estimate is shrunk towards the one above it, which counts as SHRINK rows.

Null and empty texts have no words and fail the base rules. A null language or source is a value like
any other. Repeated rows count and are judged as often as they occur. An empty table gives no rows.
Extra columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, checkpointed, mixed, table, window_hashes, words

#: Words of a window that counts as repeated; share of rows kept in a concentration step.
REPEAT_WORDS, H = 8, 0.75
#: Steps at most, and the fall of a determinant's logarithm below which they end.
STEPS, FALL = 20, 1e-3
#: How many rows the estimate of the language (of all rows) counts as in that of a language and source (of a language).
SHRINK = 200.0
#: Starts of the search: medians, all rows, a hashed part.
STARTS = 3
#: Squared distances above this chi-square quantile (5 degrees, 1 - 4e-5) are outliers.
CUTOFF = 28.0
#: Languages and sources (and languages, and all rows) that are dealt with at once.
CELLS = 10_000
#: Transformed statistics, and the least standard deviation that each is given. The two shares of repeats lie
#: between 0 and sqrt(0.3) where the base rules let a text pass, so their floors let either one reach the cut-off alone.
DIMENSIONS = {"x_words": 0.35, "x_length": 0.06, "x_symbols": 0.5, "x_lines": 0.09, "x_repeats": 0.1}
#: What the covariance of the nearest 75 % of normal vectors of 5 dimensions falls short by.
CONSISTENCY = 1.41
#: The cell of all rows.
EVERY = "every"
#: Bins of a histogram: for coordinates their width, for logarithms of distances their number to a doubling.
_WIDTH, _FINE = 1 / 1024, 64

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_BLANKS = re.compile(r"[\x20\x09-\x0D]")
STATISTICS = T.StructType([T.StructField(k, T.LongType()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])


def statistics_of(text: str | None, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    text = text or ""
    found = words(text)
    lines = Counter(x for x in text.split("\n") if _BLANKS.sub("", x)) if "\n" in text else {}
    repeats = 0
    if len(found) > REPEAT_WORDS:
        _, at, n = np.unique(window_hashes(hashes.of(found), REPEAT_WORDS), return_inverse=True, return_counts=True)
        starts = np.flatnonzero(n[at] > 1)
        if len(starts):
            change = np.zeros(len(found) + 1, dtype=np.int64)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + REPEAT_WORDS, -1)
            repeats = int((np.cumsum(change) > 0).sum())
    return len(found), len(text) - len(_BLANKS.findall(text)), len(_SYMBOLS.findall(text)), sum(n - 1 for n in lines.values()), repeats


@F.pandas_udf(STATISTICS)
def text_statistics(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for batch in batches:
        yield pd.DataFrame([statistics_of(t if isinstance(t, str) else None, hashes) for t in batch], columns=STATISTICS.names)


def _transformed() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "x_words": F.log(n),
        "x_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "x_symbols": F.log1p(100 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "x_lines": F.sqrt(F.col("n_dup_lines") / n),
        "x_repeats": F.sqrt(F.col("n_repeat_words") / n),
    }


def covariance(mean: np.ndarray, products: np.ndarray, scale: float = CONSISTENCY) -> np.ndarray:
    """From a mean and mean products (upper triangle) of kept rows; no statistic is given less spread than its floor."""
    d, floor = len(DIMENSIONS), np.array(list(DIMENSIONS.values()))
    cov = np.zeros((d, d))
    cov[np.triu_indices(d)] = products
    cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
    cov *= scale
    return cov + np.diag(np.maximum(0, floor**2 - np.diag(cov)) + 1e-12)


_UPPER = np.triu_indices(len(DIMENSIONS))
_SUMS = [f"s{k}" for k in range(len(DIMENSIONS) + len(_UPPER[0]))]


@dataclass
class Cells:
    """Named cells, and for each cell and start an estimate: mean, inverse covariance, covariance, log determinant."""

    names: list[str]
    means: np.ndarray = field(default=None)
    inverses: np.ndarray = field(default=None)
    covs: np.ndarray = field(default=None)
    logdets: np.ndarray = field(default=None)

    def __post_init__(self):
        self.at = {name: k for k, name in enumerate(self.names)}

    def estimated(self, means: np.ndarray, products: np.ndarray) -> Cells:
        covs = np.array([[covariance(m, p) for m, p in zip(a, b, strict=True)] for a, b in zip(means, products, strict=True)])
        return Cells(self.names, means, np.linalg.inv(covs), covs, np.linalg.slogdet(covs)[1])

    def best(self) -> Cells:
        """The start of the least determinant."""
        k, one = self.logdets.argmin(axis=1), np.arange(len(self.names))
        return Cells(self.names, self.means[one, k], self.inverses[one, k], self.covs[one, k], self.logdets[one, k])

    def bins(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each row and start the bin of its squared distance from the estimate of its cell."""
        y = x[:, None, :] - self.means[at]
        d2 = (np.einsum("nsij,nsj->nsi", self.inverses[at], y) * y).sum(axis=2)
        return np.floor(_FINE * np.log2(np.maximum(d2, 0) + 1e-9)).astype(np.int64)


def _rows_of(batches: Iterator[pd.DataFrame], cells: Cells) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a batch and their cells, once for each level; rows of cells that aren't dealt with are left out."""
    for batch in batches:
        x = batch[list(DIMENSIONS)].to_numpy(dtype=np.float64)
        for level in ("group", "pool", "every"):
            at = batch[level].map(cells.at)
            known = at.notna().to_numpy()
            if known.any():
                yield x[known], at[known].to_numpy(dtype=np.int64)


def _edges(vectors: DataFrame, cells: Cells, bins: Callable[[np.ndarray, np.ndarray], np.ndarray], share: float) -> np.ndarray:
    """For each cell and each column of `bins` the least bin up to which the share of its rows lies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x, at in _rows_of(batches, cells):
            found = bins(x, at)
            series = at[:, None] * found.shape[1] + np.arange(found.shape[1])
            values, n = np.unique((series << 32) + found + (1 << 31), return_counts=True)  # bins are far below 2 ** 31
            series = values >> 32
            yield pd.DataFrame({"cell": series // found.shape[1], "column": series % found.shape[1], "bin": (values & 0xFFFFFFFF) - (1 << 31), "n": n})

    counts = vectors.mapInPandas(run, "cell long, column long, bin long, n long").groupBy("cell", "column", "bin").agg(F.sum("n").alias("n"))
    by = W.partitionBy("cell", "column")  # as many rows as it has bins
    reached = counts.withColumn("so_far", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
    found = reached.where(F.col("so_far") >= share * F.col("all")).groupBy("cell", "column").agg(F.min("bin").alias("edge")).collect()  # a few numbers a cell
    out = np.zeros((len(cells.names), max((r["column"] for r in found), default=0) + 1), dtype=np.int64)
    for r in found:
        out[r["cell"], r["column"]] = r["edge"]
    return out


def _sums(vectors: DataFrame, cells: Cells, chosen: Callable[[np.ndarray, np.ndarray], np.ndarray], n_starts: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean and mean products of the rows of each cell that each start chooses (of the first start, where it has none)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x, at in _rows_of(batches, cells):
            flat = np.concatenate([x, x[:, _UPPER[0]] * x[:, _UPPER[1]]], axis=1)
            for start, mine in enumerate(chosen(x, at).T):
                order = np.flatnonzero(mine)[np.argsort(at[mine], kind="stable")]
                if not len(order):
                    continue
                values, first, n = np.unique(at[order], return_index=True, return_counts=True)
                sums = np.add.reduceat(flat[order], first, axis=0)
                yield pd.DataFrame(sums, columns=_SUMS).assign(cell=values, start=start, n=n)

    made = vectors.mapInPandas(run, ", ".join(f"{c} double" for c in _SUMS) + ", cell long, start int, n long")
    rows = made.groupBy("cell", "start").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in _SUMS]).collect()  # 21 numbers a cell and start
    d, out = len(DIMENSIONS), np.full((len(cells.names), n_starts, len(_SUMS)), np.nan)
    for r in rows:
        out[r["cell"], r["start"]] = [r[c] / r["n"] for c in _SUMS]
    out = np.where(np.isnan(out), out[:, :1], out)
    return out[:, :, :d], out[:, :, d:]


def _starts(vectors: DataFrame, cells: Cells) -> Cells:
    """The estimates that the search sets out from."""
    middle = (_edges(vectors, cells, lambda x, at: np.floor(x / _WIDTH).astype(np.int64), 0.5) + 0.5) * _WIDTH
    spread = 1.4826 * (_edges(vectors, cells, lambda x, at: np.floor(np.abs(x - middle[at]) / _WIDTH).astype(np.int64), 0.5) + 0.5) * _WIDTH
    products = middle[:, _UPPER[0]] * middle[:, _UPPER[1]] + np.where(_UPPER[0] == _UPPER[1], spread[:, _UPPER[0]] ** 2 / CONSISTENCY, 0)

    def chosen(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        part = mixed(np.ascontiguousarray(x).view(np.uint64).sum(axis=1, dtype=np.uint64)) % np.uint64(4) == 0
        return np.stack([np.ones(len(x), bool), part], axis=1)

    means, rest = _sums(vectors, cells, chosen, STARTS - 1)
    return cells.estimated(np.concatenate([middle[:, None], means], axis=1), np.concatenate([products[:, None], rest], axis=1))


def mcd(vectors: DataFrame, names: list[str]) -> Cells:
    """`vectors` has group, pool and every, each the name of a cell that a row is in, and the columns of DIMENSIONS."""
    model = _starts(vectors, Cells(names))
    for step in range(STEPS):
        edges = _edges(vectors, model, model.bins, H)
        new = model.estimated(*_sums(vectors, model, lambda x, at, m=model, e=edges: m.bins(x, at) <= e[at], STARTS))
        fall, model = model.logdets - new.logdets, new
        if step and fall.max() < FALL:  # what a search sets out from are no subsets' estimates
            break
    return model.best()


def shrunk(own: tuple[np.ndarray, np.ndarray], n: int, wide: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of n rows drawn towards a wider estimate, which counts as SHRINK rows."""
    share = n / (n + SHRINK)
    apart = own[0] - wide[0]
    return share * own[0] + (1 - share) * wide[0], share * own[1] + (1 - share) * wide[1] + share * (1 - share) * np.outer(apart, apart)


def _measured(found: DataFrame, sizes: dict[str, tuple[str, int]], own: Cells, wide: Cells, pools: dict[str, int], all_rows: Cells) -> DataFrame:
    """distance2 of the rows of the groups in `sizes`; `own` has their estimates, `wide` those of their languages, `all_rows` that of all."""
    models, every = {}, (all_rows.means[all_rows.at[EVERY]], all_rows.covs[all_rows.at[EVERY]])
    for name, (pool, n) in sizes.items():
        k, at = own.at[name], wide.at[pool]
        mean, cov = shrunk((own.means[k], own.covs[k]), n, shrunk((wide.means[at], wide.covs[at]), pools[pool], every))
        models[name] = (mean, np.linalg.inv(cov))

    @F.pandas_udf("double")
    def distance2(group: pd.Series, x: pd.DataFrame) -> pd.Series:
        if not len(group):
            return pd.Series([], dtype="float64")
        mean, inverse = (np.array(v) for v in zip(*(models[g] for g in group), strict=True))
        y = x.to_numpy(dtype=np.float64) - mean
        return pd.Series(np.einsum("ni,nij,nj->n", y, inverse, y))

    return found.withColumn("distance2", distance2("group", F.struct(*DIMENSIONS)))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, distance2 and kept."""
    name = lambda kind, *columns: F.concat(F.lit(kind), F.to_json(F.struct(*columns)))
    found = docs.select("doc_id", name("group ", "lang", "source").alias("group"), name("pool ", "lang").alias("pool"), F.lit(EVERY).alias("every"), text_statistics("text").alias("s")).select("doc_id", "group", "pool", "every", "s.*")
    found = checkpointed(found.withColumns(_transformed()))
    cells = checkpointed(found.groupBy("group", "pool").agg(F.count(F.lit(1)).alias("n")))
    languages = cells.groupBy("pool").agg(F.sum("n").alias("n"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    parts_of = lambda df: -(-df.count() // CELLS)
    part = lambda name, parts, k: F.pmod(F.xxhash64(name), F.lit(parts)) == k
    pools_of = lambda df: {r["pool"]: r["n"] for r in df.collect()}  # about CELLS languages
    sizes_of = lambda df: {r["group"]: (r["pool"], r["n"]) for r in df.select("group", "pool", "n").collect()}  # about CELLS groups
    groups = parts_of(cells)
    if not groups:
        measured = [found.withColumn("distance2", F.lit(0.0))]
    elif groups == 1:  # the same search for all levels at once
        sizes, pools = sizes_of(cells), pools_of(languages)
        models = mcd(found, [EVERY, *pools, *sizes])
        measured = [_measured(found, sizes, models, models, pools, models)]
    else:  # languages in turn, and their groups in turn; each part is written before the next one's estimates are made
        all_rows, measured = mcd(found, [EVERY]), []
        for k in range(n := parts_of(languages)):
            pools, mine = pools_of(languages.where(part("pool", n, k))), cells.where(part("pool", n, k))
            if not pools:
                continue
            rows = found.where(part("pool", n, k))
            wide = mcd(rows, list(pools))
            for j in range(m := parts_of(mine)):
                if sizes := sizes_of(mine.where(part("group", m, j))):
                    some = rows.where(part("group", m, j))
                    measured.append(checkpointed(_measured(some, sizes, mcd(some, list(sizes)), wide, pools, all_rows)))
    out = reduce(DataFrame.unionByName, measured).withColumn("base_failed", base)
    return out.select("doc_id", *STATISTICS.names, "base_failed", "distance2", (~F.col("base_failed") & (F.col("distance2") <= CUTOFF)).alias("kept"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
