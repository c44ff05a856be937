"""Scores of predictions, agreement of reviewers, roll-ups (survey 2.5). All aggregations combine on the map side."""

from __future__ import annotations

import inspect
import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.labels import normalize_label
from ..functions.series import bound


def share_table(df: DataFrame, label: str) -> DataFrame:
    """Count and percent of each label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(total).select(label, "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))  # total is one row


def accuracy(df: DataFrame, pred: str, gold: str, by: list[str] | None = None) -> DataFrame:
    """With `by`, a roll-up with the overall line."""
    right = F.sum((F.col(pred).eqNullSafe(F.col(gold))).cast("long"))
    grouped = df.rollup(*by) if by else df.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("total"), right.alias("correct")).withColumn("incorrect", F.col("total") - F.col("correct")).withColumn("accuracy", ratio(100.0 * F.col("correct"), F.col("total")))


def prefix_accuracy(df: DataFrame, pred: str, gold: str) -> DataFrame:
    """Right if gold starts with the prediction, which an empty one always does."""
    return df.agg(F.avg(F.startswith(gold, pred).cast("int")).alias("accuracy"))


def ratio(a: Column, b: Column) -> Column:
    """Zero divisor gives 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def answer_pairs(df: DataFrame, pred: str, gold: str, by: list[str] | None = None) -> DataFrame:
    """How often each prediction (`p`) meets each gold answer (`g`): all that counts by class need."""
    return df.groupBy(*(by or []), F.col(pred).alias("p"), F.col(gold).alias("g")).agg(F.count(F.lit(1)).alias("n"))


def class_counts(df: DataFrame, pred: str, gold: str, by: list[str] | None = None) -> DataFrame:
    """Tp, fp, fn for every class that occurs as prediction or gold. Pairs are counted first, so each
    distinct pair becomes two rows."""
    return _counts_of_pairs(answer_pairs(df, pred, gold, by), by or [])


def _counts_of_pairs(pairs: DataFrame, by: list[str]) -> DataFrame:
    same, zero = F.col("p").eqNullSafe(F.col("g")), F.lit(0).cast("long")
    gold_row = F.struct(F.col("g").alias("class"), F.when(same, F.col("n")).otherwise(zero).alias("tp"), zero.alias("fp"), F.when(same, zero).otherwise(F.col("n")).alias("fn"))
    pred_row = F.struct(F.col("p").alias("class"), zero.alias("tp"), F.when(same, zero).otherwise(F.col("n")).alias("fp"), zero.alias("fn"))
    long = pairs.select(*by, F.inline(F.array(gold_row, pred_row)))
    return long.where("class is not null").groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def with_f1(counts: DataFrame) -> DataFrame:
    """A12."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counts.withColumn("precision", p).withColumn("recall", r).withColumn("support", F.col("tp") + F.col("fn"))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def closed_counts(df: DataFrame, pred: str, gold: str, labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Classes are those of `labels` (by + class) and the gold ones. A prediction that isn't in `labels` is a
    miss of its gold class only, also where another row has it as gold."""
    by = by or []
    return _closed(_counts_of_pairs(answer_pairs(df, pred, gold, by), by), labels, by)


def _closed(counts: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    known = labels.select(*by, "class").distinct().withColumn("_known", F.lit(True))
    both = counts.join(known, [*by, "class"], "full").na.fill(0, ["tp", "fp", "fn"])
    fp = F.when(F.col("_known"), F.col("fp")).otherwise(F.lit(0).cast("long"))
    return both.where("_known OR tp + fn > 0").select(*by, "class", "tp", fp.alias("fp"), "fn")


def supported_counts(df: DataFrame, pred: str, gold: str, by: list[str] | None = None) -> DataFrame:
    """Only classes that occur as gold."""
    return class_counts(df, pred, gold, by).where(F.col("tp") + F.col("fn") > 0)


def macro_f1(scored: DataFrame) -> DataFrame:
    """A13."""
    return scored.agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("classes"))


def template_f1(df: DataFrame, pred: str, gold: str, template: str, labels: DataFrame) -> DataFrame:
    """Per template and, as the line with a null template, over all: macro F1 unweighted and weighted by rows,
    accuracy over rows and over templates.

    `labels` (template, class) are the allowed answers. A template's classes are these and no others. Rows whose
    gold answer isn't allowed count in no class, but in n and in the accuracies. A template without allowed
    answers is an error. Rows are counted by (template, prediction, gold) once; all else works on these counts."""
    labels = labels.select(template, "class")
    pairs = answer_pairs(df, pred, gold, [template])
    judged = pairs.join(labels.withColumnRenamed("class", "g").distinct(), [template, "g"], "left_semi").select(template, "p", "g", "n")
    scored = with_f1(_closed(_counts_of_pairs(judged, [template]), labels, [template])).groupBy(template).agg(F.avg("f1").alias("macro_f1"))
    sizes = pairs.groupBy(template).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("p") == F.col("g"), F.col("n")).otherwise(0)).alias("correct"))
    without = F.raise_error(F.format_string("template %s has no allowed answers", F.col(template).cast("string"))).cast("double")
    per = sizes.join(scored, template, "left").withColumn("macro_f1", F.coalesce("macro_f1", without)).withColumn("accuracy", F.col("correct") / F.col("n"))
    return per.groupingSets([[template], []], template).agg(
        F.sum("n").alias("n"), F.avg("macro_f1").alias("macro_f1"), (F.sum(F.col("macro_f1") * F.col("n")) / F.sum("n")).alias("weighted_f1"), (F.sum("correct") / F.sum("n")).alias("accuracy"), F.avg("accuracy").alias("template_accuracy")
    )


def token_overlap(pred: Column, gold: Column) -> Column:
    """Precision, recall and F1 of the multisets of tokens of normalised answers (F01); both empty is 1, one empty is 0.

    Both multisets are sorted as one; a pass over it pairs each gold token with an unpaired equal one before
    it. What is named more than once is bound, so that it is evaluated once."""
    tokens = lambda c: F.filter(F.split(normalize_label(c), r"\s+"), lambda w: w != "")
    sided = lambda xs, side: F.transform(xs, lambda w: F.struct(w.alias("w"), F.lit(side).alias("side")))
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("open"), F.lit(0).alias("shared"))

    def step(s: Column, x: Column) -> Column:
        left = F.when(s["w"] == x["w"], s["open"]).otherwise(0)  # no token is empty
        pairs = (x["side"] == 1) & (left > 0)
        return F.struct(x["w"].alias("w"), F.when(x["side"] == 0, left + 1).when(pairs, left - 1).otherwise(left).alias("open"), (s["shared"] + pairs.cast("int")).alias("shared"))

    def scores(n: Column) -> Column:
        p, g, shared = n["p"], n["g"], n["shared"]
        fix = lambda c: F.when((p == 0) & (g == 0), 1.0).when(shared == 0, 0.0).otherwise(c)
        return F.struct(fix(shared / p).alias("precision"), fix(shared / g).alias("recall"), fix(2.0 * shared / (p + g)).alias("f1"))

    counted = lambda t: F.struct(F.size(t["p"]).alias("p"), F.size(t["g"]).alias("g"), F.aggregate(F.array_sort(F.concat(sided(t["p"], 0), sided(t["g"], 1))), start, step)["shared"].alias("shared"))
    return bound(F.struct(tokens(pred).alias("p"), tokens(gold).alias("g")), lambda t: bound(counted(t), scores))


def confusion(df: DataFrame, gold: str, pred: str, labels: list[str]) -> DataFrame:
    """A row for each gold label, a column for each predicted one; pairs with another label don't count."""
    known = df.where(F.col(gold).isin(*labels) & F.col(pred).isin(*labels))
    return known.groupBy(gold).pivot(pred, labels).count().na.fill(0).withColumn("support", sum((F.col(x) for x in labels), F.lit(0).cast("long")))


def metric_means(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Percent means of the declared metrics; a missing one counts as 0."""
    return df.agg(*[(F.avg(F.coalesce(F.col(m).cast("double"), F.lit(0.0))) * 100).alias(m) for m in metrics])


def grouped_means(df: DataFrame, sets: list[list[str]], value: str) -> DataFrame:
    """Means by each set of keys."""
    keys = sorted({k for s in sets for k in s})
    return df.groupingSets(sets, *keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def layer_stats(df: DataFrame, layer: str, values: list[str]) -> DataFrame:
    """Mean and population deviation by layer and over all measurements."""
    return df.rollup(layer).agg(*[f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def review_overview(df: DataFrame, status: str) -> DataFrame:
    """A23, A35."""
    done = F.sum((F.col(status) == "complete").cast("long"))
    return df.agg(F.count(F.lit(1)).alias("total"), done.alias("completed")).withColumn("rate", F.round(ratio(100.0 * F.col("completed"), F.col("total")), 1))


def response_rates(df: DataFrame, questions: list[str], kind) -> DataFrame:
    """By question, the rates of positive, partial and negative answers; `kind` names an answer's kind."""
    long = df.unpivot([], questions, "question", "answer").where("answer is not null").withColumn("kind", kind(F.col("answer")))
    rate = lambda k: (100.0 * F.avg((F.col("kind") == k).cast("int"))).alias(f"{k}_rate")
    return long.groupBy("question").agg(F.count(F.lit(1)).alias("n"), rate("positive"), rate("partial"), rate("negative"))


def agreement(pairs: DataFrame, by: list[str], blank_counts: bool = True) -> DataFrame:
    """Percent of reviewer pairs with equal answers, by and over all; Q14: two blanks agree unless switched off."""
    kept = pairs.where(F.col("first_answer").isNotNull() & F.col("second_answer").isNotNull())
    kept = kept if blank_counts else kept.where((F.col("first_answer") != "") & (F.col("second_answer") != ""))
    same = (F.col("first_answer") == F.col("second_answer")).cast("int")
    return kept.rollup(*by).agg(F.count(F.lit(1)).alias("pairs"), F.sum(same).alias("agreed"), (100.0 * F.avg(same)).alias("percent"))


def _answered(df: DataFrame, answer: str, blank_counts: bool) -> DataFrame:
    return df.where(F.col(answer).isNotNull() if blank_counts else (F.col(answer).isNotNull() & (F.col(answer) != "")))


def agreement_from_counts(df: DataFrame, sample: str, reviewer: str, answer: str, by: list[str], blank_counts: bool = True) -> DataFrame:
    """A26, J07 without pairs: what `agreement` says of the pairs of different reviewers inside each sample and `by`.

    n equal answers are n (n - 1) / 2 agreeing pairs, less those of one reviewer with themselves; likewise
    for all pairs. So a sample costs its distinct answers of each reviewer, which are combined before the shuffle."""
    two = lambda n: (n * (n - 1) / 2).cast("long")
    own = _answered(df, answer, blank_counts).groupBy(*by, sample, reviewer, answer).agg(F.count(F.lit(1)).alias("n"))
    by_answer = own.groupBy(*by, sample, answer).agg(F.sum("n").alias("n"), F.sum(two(F.col("n"))).alias("self"))
    by_reviewer = own.groupBy(*by, sample, reviewer).agg(F.sum("n").alias("n"))
    agreed = by_answer.groupBy(*by, sample).agg(F.sum(two(F.col("n")) - F.col("self")).alias("agreed"))
    pairs = by_reviewer.groupBy(*by, sample).agg((two(F.sum("n")) - F.sum(two(F.col("n")))).alias("pairs"))
    zero, keys = F.lit(0).cast("long"), [*by, sample]
    each = agreed.select(*keys, "agreed", zero.alias("pairs")).unionByName(pairs.select(*keys, zero.alias("agreed"), "pairs"))
    out = each.rollup(*by).agg(F.sum("pairs").alias("pairs"), F.sum("agreed").alias("agreed"))
    return out.where("pairs > 0").select(*by, "pairs", "agreed", (100.0 * F.col("agreed") / F.col("pairs")).alias("percent"))


def agreement_by_reviewer(df: DataFrame, sample: str, reviewer: str, answer: str, blank_counts: bool = True) -> DataFrame:
    """A26 by the reviewer of smaller name in a pair (`first`), without pairs: a review meets as many later reviewers
    as come before it in descending order, and agrees with those of its own answer."""
    rows = _answered(df, answer, blank_counts).select(sample, F.col(reviewer).alias("first"), F.col(answer).alias("_answer"))
    ahead = lambda *keys: F.rank().over(W.partitionBy(*keys).orderBy(F.desc("first"))) - 1
    each = rows.withColumn("pairs", ahead(sample).cast("long")).withColumn("agreed", ahead(sample, "_answer").cast("long")).where("pairs > 0")
    return each.rollup("first").agg(F.sum("pairs").alias("pairs"), F.sum("agreed").alias("agreed")).select("first", "pairs", "agreed", (100.0 * F.col("agreed") / F.col("pairs")).alias("percent"))


def disagreements(df: DataFrame, sample: str, reviewer: str, answer: str) -> DataFrame:
    """How often each unordered pair of different answers (a, b) occurs among pairs of different reviewers of a sample.

    Counted from a sample's counts by answer: n of one and m of another are n m pairs, less those of one reviewer."""
    own = df.where(F.col(answer).isNotNull()).groupBy(F.col(sample).alias("s"), F.col(reviewer).alias("r"), F.col(answer).alias("x")).agg(F.count(F.lit(1)).alias("n"))

    def products(counts: DataFrame, keys: list[str], sign: int) -> DataFrame:
        """Pairs of answers of each group, which has a few distinct ones; both sides come from one array."""
        m = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "n"))).alias("m"))
        later = F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b["x"] > a["x"]), lambda b: F.struct(a["x"].alias("a"), b["x"].alias("b"), (a["n"] * b["n"] * sign).alias("n"))))
        return m.select(F.inline(F.flatten(later)))

    every = products(own.groupBy("s", "x").agg(F.sum("n").alias("n")), ["s"], 1).unionByName(products(own, ["s", "r"], -1))
    return every.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 0")


def kappa(df: DataFrame, sample: str, reviewer: str, answer: str) -> DataFrame:
    """Q15: Cohen's kappa over the pairs of reviewers of a sample, the one of smaller name first, an extension: observed
    agreement against that of independent answers. Without pairs: reviewers before and after each are counted by ranks."""
    rows = df.where(F.col(answer).isNotNull()).select(F.col(sample).alias("s"), F.col(reviewer).alias("r"), F.col(answer).alias("x")).repartition("s")
    names = ("later", "earlier", "same")

    def ahead(name: str, order: Column, *keys: str) -> DataFrame:
        """Each ranking in tasks of its own, over the same shuffle, so that no task holds more than one sort."""
        n = (F.rank().over(W.partitionBy(*keys).orderBy(order)) - 1).cast("long")
        return rows.select("x", n.alias("n")).select("x", *[(F.col("n") if k == name else F.lit(0).cast("long")).alias(k) for k in names]).groupBy("x").agg(*[F.sum(k).alias(k) for k in names])

    each = ahead("later", F.desc("r"), "s").unionByName(ahead("earlier", F.asc("r"), "s")).unionByName(ahead("same", F.desc("r"), "s", "x"))
    by = each.groupBy("x").agg(*[F.sum(k).alias(k) for k in names])  # a row for each answer
    total = by.agg(F.sum("later").alias("n"), F.sum("same").alias("same"), F.sum(F.col("later").cast("double") * F.col("earlier")).alias("c"))
    po, pe = F.col("same") / F.col("n"), F.col("c") / (F.col("n").cast("double") * F.col("n"))
    return total.where("n > 0").select("n", po.alias("observed"), pe.alias("expected"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0).alias("kappa"))


def load_table(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts by row and reviewer."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def rare_classes(df: DataFrame, label: str, least: int = 3) -> DataFrame:
    """A36."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)


def row_scores(df: DataFrame, scorer: Callable[..., dict[str, Column]], pred: str, gold: str) -> DataFrame:
    """A column for each metric that a scorer makes of gold, prediction and, if it takes three, the row as a struct."""
    args = [F.col(gold), F.col(pred)]
    if len(inspect.signature(scorer).parameters) >= 3:
        args.append(F.struct(*[F.col(c) for c in df.columns]))
    return df.select("*", *[v.alias(k) for k, v in scorer(*args).items()])


def corpus_scores(df: DataFrame, scorer: Callable[[Column, Column], dict[str, Column]], pred: str, gold: str, by: list[str] | None = None) -> DataFrame:
    """Metrics of all rows (of each group), from aggregates that a scorer makes of the predictions and gold answers."""
    return df.groupBy(*(by or [])).agg(*[v.alias(k) for k, v in scorer(F.col(pred), F.col(gold)).items()])


class CorpusScorer(Protocol):
    """X04 where aggregates can't say it: a state that batches are added to and that merges with others.

    A state should stay small (counts by class, a sketch), as it is what moves; it is pickled."""

    def start(self) -> Any: ...

    def add(self, state: Any, predictions: list, gold: list) -> Any: ...

    def merge(self, state: Any, other: Any) -> Any: ...

    def finish(self, state: Any) -> dict[str, float]: ...


#: States that one step of the tree merges, its steps, and groups of which a task holds states at once.
FAN_IN, LEVELS, HELD_GROUPS = 16, 3, 10_000


def merged_scores(df: DataFrame, scorer: CorpusScorer, pred: str, gold: str, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """`metrics` of a scorer's result, of all rows or of each group.

    Tasks add up what they read, Arrow batch by batch, into one state for each group. A tree merges these:
    each step takes the states of FAN_IN neighbouring tasks, so no task meets a whole group's rows, nor
    all of its states until few are left."""
    by = by or []
    keys = T.StructType([df.schema[c] for c in by])
    kind = T.StructType([*keys.fields, T.StructField("_slot", T.IntegerType()), T.StructField("_state", T.BinaryType())])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}
        slot = TaskContext.get().partitionId() % FAN_IN**LEVELS

        def flushed() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in states], to_arrow_type(f.dataType)) for i, f in enumerate(keys.fields)]
            columns += [pa.array([slot] * len(states), pa.int32()), pa.array([pickle.dumps(s) for s in states.values()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in kind.fields])

        for batch in batches:
            of_group: dict[tuple, tuple[list, list]] = {}
            for *key, p, g in zip(*(batch[c].to_pylist() for c in (*by, "_pred", "_gold")), strict=True):
                ps, gs = of_group.setdefault(tuple(key), ([], []))
                ps.append(p)
                gs.append(g)
            for key, (ps, gs) in of_group.items():
                states[key] = scorer.add(states[key] if key in states else scorer.start(), ps, gs)
            if len(states) > HELD_GROUPS:
                yield flushed()
                states.clear()
        yield flushed()

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        state = reduce(scorer.merge, (pickle.loads(bytes(s)) for s in group["_state"]))
        return group.iloc[:1].assign(_state=pickle.dumps(state))

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [scorer.finish(pickle.loads(bytes(s))) for s in b["_state"]]
            yield b[by].assign(**{m: pd.Series([x[m] for x in found], index=b.index, dtype="float64") for m in metrics})

    states = df.select(*by, F.col(pred).alias("_pred"), F.col(gold).alias("_gold")).mapInArrow(added, kind)
    for _ in range(LEVELS):
        states = states.withColumn("_slot", F.expr(f"_slot div {FAN_IN}").cast("int")).groupBy(*by, "_slot").applyInPandas(merged, kind)
    return states.mapInPandas(finished, T.StructType([*keys.fields, *[T.StructField(m, T.DoubleType()) for m in metrics]]))


def reviewer_rates(df: DataFrame, reviewer: str, answers: list[str], completed: Column, positive: str = "Yes") -> DataFrame:
    """Of each reviewer's completed forms their number and, by question, the percent of positive answers."""
    rate = lambda c: (100.0 * F.avg(F.coalesce(F.col(c) == positive, F.lit(False)).cast("int"))).alias(f"{c}_positive_rate")
    return df.where(completed).groupBy(reviewer).agg(F.count(F.lit(1)).alias("total_assessments"), *[rate(c) for c in answers])
