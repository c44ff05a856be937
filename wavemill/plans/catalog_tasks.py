"""More queries of the catalogue: prompts by family, captions, noise, scorers, reviewers, rows from records."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import functions as F

from ..folders import new_folder
from ..functions import series as S
from ..operators import relational as R
from ..operators import scoring as C
from ..streaming import online
from . import prompts as P
from .catalog import PREDICTIONS, _predictions, query

_NAMES = list(P.FAMILIES)
_FILLED = {"question": "'How many of ' || o_orderkey || '?'", "task": "o_orderpriority", "labels": "'a, b'", "context": "CASE WHEN o_orderkey % 2 = 0 THEN 'Status ' || o_orderstatus || '.' END"}


def _filled_sql(k: int) -> str:
    out = "CASE o_orderkey % " + str(len(_NAMES)) + " " + " ".join(f"WHEN {i} THEN '{P.FAMILIES[n][k]}'" for i, n in enumerate(_NAMES)) + " END"
    for name, sql in _FILLED.items():
        out = f"replace({out}, '{{{name}}}', coalesce({sql}, ''))"
    return out


@query("f19_family_prompts", f"SELECT o_orderkey, {_filled_sql(0)} AS pre_prompt, {_filled_sql(1)} AS post_prompt FROM orders")
def _(t):
    family = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("o_orderkey") % len(_NAMES) + 1).cast("int"))
    values = {"question": F.format_string("How many of %d?", "o_orderkey"), "task": F.col("o_orderpriority"), "labels": F.lit("a, b"), "context": F.when(F.col("o_orderkey") % 2 == 0, F.format_string("Status %s.", "o_orderstatus"))}
    pre, post = P.family_prompts(family, values)
    return t.orders.select("o_orderkey", pre.alias("pre_prompt"), post.alias("post_prompt"))


@query("f20_captions", "SELECT vec_id, printf('series %d, it has mean %.3f and std %.3f:', vec_id, list_avg(embedding::DOUBLE[]), list_stddev_samp(embedding::DOUBLE[])) AS caption FROM embeddings")
def _(t):
    v = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", S.caption(F.format_string("series %d", "vec_id"), v, decimals=3).alias("caption"))


_DRAW = "('0x' || left(md5('4|' || vec_id || '|' || {}i), 8))::BIGINT / 4294967296.0::DOUBLE"


@query("f27_uniform_noise", f"SELECT vec_id, i, {_DRAW.format('')} * 2 - 1 AS x FROM (SELECT vec_id, unnest(range(len(embedding))) AS i FROM embeddings)")
def _(t):
    return t.embeddings.select("vec_id", F.posexplode(S.noise(F.col("embedding"), "uniform", 4, F.col("vec_id"))).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), "x")


@query("f27_gaussian_noise", f"SELECT vec_id, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT vec_id, sqrt(-2 * ln(1 - {_DRAW.format("'r|' || ")})) * cos(2 * pi() * {_DRAW.format("'a|' || ")}) AS x FROM (SELECT vec_id, unnest(range(len(embedding))) AS i FROM embeddings)) GROUP BY vec_id")
def _(t):
    drawn = t.embeddings.select("vec_id", F.explode(S.noise(F.col("embedding"), "gaussian", 4, F.col("vec_id"))).alias("x"))
    return drawn.groupBy("vec_id").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"))


@query("f38_stamped")
def _(t):
    return t.region.select("r_regionkey", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"))


@query("x03_row_scores", f"SELECT l_orderkey, l_linenumber, (pred = gold)::INT AS exact, (pred = gold AND template = 3)::INT AS exact_of_template FROM {PREDICTIONS}")
def _(t):
    scorer = lambda gold, pred, row: {"exact": (gold == pred).cast("int"), "exact_of_template": ((gold == pred) & (row["template"] == 3)).cast("int")}
    return C.row_scores(_predictions(t), scorer, "pred", "gold").select("l_orderkey", "l_linenumber", "exact", "exact_of_template")


@query("x04_corpus_scores", f"SELECT template, avg((pred = gold)::INT) AS accuracy, count(DISTINCT pred) AS labels FROM {PREDICTIONS} GROUP BY template")
def _(t):
    scorer = lambda pred, gold: {"accuracy": F.avg((pred == gold).cast("int")), "labels": F.count_distinct(pred)}
    return C.corpus_scores(_predictions(t), scorer, "pred", "gold", ["template"])


class TokenF1:
    """Macro F1 over the tokens of answers, each token a class: a state of [hits, predicted, gold] by token."""

    def start(self) -> dict[str, list[int]]:
        return {}

    def add(self, state, predictions, gold):
        for p, g in zip(predictions, gold, strict=True):
            a, b = Counter((p or "").split()), Counter((g or "").split())
            for token in a | b:
                n = state.setdefault(token, [0, 0, 0])
                n[0], n[1], n[2] = n[0] + min(a[token], b[token]), n[1] + a[token], n[2] + b[token]
        return state

    def merge(self, state, other):
        for token, n in other.items():
            state[token] = [x + y for x, y in zip(state.get(token, (0, 0, 0)), n, strict=True)]
        return state

    def finish(self, state):
        f1 = [2 * hits / (predicted + gold) for hits, predicted, gold in state.values()]
        return {"macro_f1": math.fsum(f1) / len(f1) if f1 else 0.0, "tokens": float(len(f1))}


_ANSWER_TOKENS = "CASE WHEN l_linenumber % 3 = 0 THEN l_linestatus ELSE l_returnflag || ' ' || l_linestatus END"


@query(
    "x04_merged_scores",
    f"""WITH w AS (SELECT l_suppkey % 7 AS template, l_orderkey, l_linenumber, string_split({_ANSWER_TOKENS}, ' ') AS p, string_split(l_returnflag || ' ' || l_linestatus || ' ' || l_returnflag, ' ') AS g FROM lineitem),
t AS (SELECT template, l_orderkey, l_linenumber, token, sum(a) AS a, sum(b) AS b FROM (SELECT template, l_orderkey, l_linenumber, unnest(p) AS token, 1 AS a, 0 AS b FROM w UNION ALL SELECT template, l_orderkey, l_linenumber, unnest(g), 0, 1 FROM w) GROUP BY ALL),
c AS (SELECT template, token, 2.0 * sum(least(a, b)) / (sum(a) + sum(b)) AS f1 FROM t GROUP BY 1, 2)
SELECT template, avg(f1)::DOUBLE AS macro_f1, count(*)::DOUBLE AS tokens FROM c GROUP BY template""",
)
def _(t):
    pred = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_linestatus")).otherwise(F.concat_ws(" ", "l_returnflag", "l_linestatus"))
    rows = t.lineitem.select((F.col("l_suppkey") % 7).alias("template"), pred.alias("pred"), F.concat_ws(" ", "l_returnflag", "l_linestatus", "l_returnflag").alias("gold"))
    return C.merged_scores(rows, TokenF1(), "pred", "gold", ["macro_f1", "tokens"], ["template"])


@query("x09_record_rows", "SELECT vec_id, (i // 16)::INT AS lead, i % 16 / 100.0::DOUBLE AS time_seconds, embedding[i + 1]::DOUBLE AS signal FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)")
def _(t):
    v = F.col("embedding").cast("array<double>")
    points = F.transform(v, lambda x, i: F.struct((i / 16).cast("int").alias("lead"), (i % 16 / F.lit(100.0)).alias("time_seconds"), x.alias("signal")))
    return R.records_to_rows(t.embeddings, ["vec_id"], points)


_FORM = "CASE WHEN {} % 3 = 0 THEN 'Yes' WHEN {} % 3 = 1 THEN 'No' ELSE 'Some' END"


@query(
    "a25_reviewer_rates",
    f"SELECT l_suppkey, count(*) AS total_assessments, 100.0 * avg((first = 'Yes')::INT) AS first_positive_rate, 100.0 * avg((second = 'Yes')::INT) AS second_positive_rate FROM (SELECT l_suppkey, l_linestatus, {_FORM.format('l_partkey', 'l_partkey')} AS first, {_FORM.format('l_orderkey', 'l_orderkey')} AS second FROM lineitem) WHERE l_linestatus = 'F' GROUP BY l_suppkey",
)
def _(t):
    answer = lambda c: F.when(F.col(c) % 3 == 0, "Yes").when(F.col(c) % 3 == 1, "No").otherwise("Some")
    forms = t.lineitem.select("l_suppkey", "l_linestatus", answer("l_partkey").alias("first"), answer("l_orderkey").alias("second"))
    return C.reviewer_rates(forms, "l_suppkey", ["first", "second"], F.col("l_linestatus") == "F")


@query("t02_aligned_windows", "SELECT user_id, epoch_us(ts) // 3600000000 AS window_id, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return R.aligned_windows(t.events, "ts", 3600).groupBy("user_id", "window_id").agg(F.count(F.lit(1)).alias("n"))


_CLOSED = "(SELECT *, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS origin, (max(epoch_us(ts)) OVER () - 3600000000) // 1000 * 1000 AS reached FROM events)"


@query("t02_entity_windows_online", f"SELECT user_id, (epoch_us(ts) - origin) // 3600000000 AS window_id, count(*) AS n, sum(value) AS total FROM {_CLOSED} GROUP BY user_id, window_id, origin, reached HAVING origin + (window_id + 1) * 3600000000 <= reached")
def _(t):
    """The table as a stream: the windows that are over an hour after their end when it has been read."""
    folder = new_folder(t._spark, "entity-windows")
    rows = t._spark.readStream.schema(t.events.schema).parquet(f"{t._dir}/[e]vents.parquet")  # as a pattern, which may also find one file
    windows = online.entity_windows_online(rows, "user_id", "ts", "value", 3600)
    windows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start().awaitTermination()
    return t._spark.read.schema(windows.schema).parquet(f"{folder}/rows")
