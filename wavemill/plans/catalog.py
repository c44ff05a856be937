"""A query and its SQL for each operator of the survey, over the driver's tables as stand-ins.

Each entry is (survey ids, DataFrame query, DuckDB SQL). Names start with the first id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import series as S
from ..operators import relational as R
from ..operators import scoring as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


# Predictions and gold answers for label queries, written as texts: ids of orders give the cases.
ANSWERS = ["Answer: Walking.<eos>", "I think so. Answer: sitting <|end|>", "The answer: RUNNING!", "no marker here", "Answer: stage 2. More text", "(b) is right", "", "Answer:  Non-REM stage 4.", "a) first", "Answer: Walking Answer: rem sleep.",
    "S2", "2", "artifact", "slow spindle seen", "stage 1 then stage 2", "rem with movement", "(c) n3!?", "c.x it is", "Option D: yes", "NREM stage 1", "first REM sleep then Wake it seems", "Answer:", "Rapid eye movement .", "AWAKE", "mt", "N4"]


def _texts(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.element_at(F.array(*[F.lit(x) for x in ANSWERS]), (F.col("o_orderkey") % len(ANSWERS) + 1).cast("int")).alias("text"))


TEXTS = "(SELECT o_orderkey, [" + ", ".join("'" + x + "'" for x in ANSWERS) + f"][o_orderkey % {len(ANSWERS)} + 1] AS text FROM orders)"
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def _predictions(t: Tables) -> DataFrame:
    """gold and prediction: return flags, the prediction wrong where the line number is 3; template: a line's part."""
    li = t.lineitem
    pred = F.when(F.col("l_linenumber") == 3, "R").when((F.col("l_linenumber") == 5) & (F.col("l_returnflag") == "N"), "X").otherwise(F.col("l_returnflag"))
    return li.select((F.col("l_suppkey") % 7).alias("template"), F.col("l_returnflag").alias("gold"), pred.alias("pred"), "l_orderkey", "l_linenumber")


PREDICTIONS = "(SELECT l_suppkey % 7 AS template, l_returnflag AS gold, CASE WHEN l_linenumber = 3 THEN 'R' WHEN l_linenumber = 5 AND l_returnflag = 'N' THEN 'X' ELSE l_returnflag END AS pred, l_orderkey, l_linenumber FROM lineitem)"
COUNTS = f"""(SELECT k AS class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
  SELECT gold AS k, (pred = gold)::INT AS tp, 0 AS fp, (pred <> gold)::INT AS fn FROM {PREDICTIONS}
  UNION ALL SELECT pred, 0, (pred <> gold)::INT, 0 FROM {PREDICTIONS}) GROUP BY k)"""
F1 = "CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END"


# Sources over tables.
@query("s17_table_read", "SELECT label, count(*) AS n, min(len(embedding)) AS points FROM embeddings GROUP BY label")
def _(t):
    return t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).cast("long").alias("points"))


@query("s18_simulated_series", "SELECT p_partkey, k.range AS series, i.range AS i, ('0x' || left(md5('7|' || p_partkey || '|' || k.range || '|' || i.range), 8))::BIGINT / 4294967296.0 AS value FROM part, range(2) k, range(10) i")
def _(t):
    made = t.part.select("p_partkey", F.posexplode(S.simulated(F.col("p_partkey"), 2, 10, 7)).alias("series", "points"))
    return made.select("p_partkey", F.col("series").cast("long").alias("series"), F.posexplode("points").alias("i", "value")).withColumn("i", F.col("i").cast("long"))


@query("s27_record_paths", "SELECT o_orderkey, printf('%05d/%05d_hr', (o_orderkey // 1000 % 100) * 1000 + 0, o_orderkey % 100000) AS path FROM orders")
def _(t):
    return t.orders.select("o_orderkey", L.path_of_record(F.col("o_orderkey") % 100000).alias("path"))


# Projections and filters.
@query("p01_named_columns", "SELECT r_regionkey AS id, r_name AS label FROM region")
def _(t):
    return R.named(t.region.select("r_regionkey", "r_name"), ["id", "label"])


@query("p02_dropped_columns", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(t):
    return t.lineitem.drop("l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@query("p03_allowed_columns", "SELECT c_custkey, c_acctbal FROM customer")
def _(t):
    return R.allowed(t.customer, ["c_custkey", "missing", "c_acctbal"])


@query("p05_dictionary", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' END AS status FROM orders")
def _(t):
    return t.orders.select("o_orderkey", L.mapped(F.col("o_orderstatus"), {"O": "open", "F": "filled"}).alias("status"))


@query("p06_first_rows_overwritten", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 4 THEN 100.0 ELSE value END AS value FROM events")
def _(t):
    rn = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("event_id", F.when(rn <= 4, 100.0).otherwise(F.col("value")).alias("value"))


@query("p07_header_rows", "SELECT event_id FROM events WHERE event_type IS DISTINCT FROM 'view'")
def _(t):
    return R.not_header(t.events.withColumnRenamed("event_type", "view"), "view").select("event_id")


@query("p08_class_filter", "SELECT vec_id, label FROM embeddings WHERE label <> 0")
def _(t):
    return t.embeddings.where("label <> 0").select("vec_id", "label")


@query("p09_least_length", "SELECT doc_id FROM documents WHERE len(string_split(text, ' ')) >= 150")
def _(t):
    return R.long_enough(t.documents.select("doc_id", F.split("text", " ", -1).alias("a")), ["a"], 150).select("doc_id")


@query("p10_comparisons", "SELECT p_partkey FROM part WHERE NOT starts_with(coalesce(p_type, ''), 'comparison')")
def _(t):
    return R.without_comparisons(t.part, "p_type").select("p_partkey")


@query("p11_numeric_coercion", "SELECT p_partkey, try_cast(p_name AS DOUBLE) AS number, try_cast(p_size::VARCHAR AS DOUBLE) AS size FROM part")
def _(t):
    return t.part.select("p_partkey", F.expr("try_cast(p_name AS double)").alias("number"), F.expr("try_cast(cast(p_size AS string) AS double)").alias("size"))


@query("p12_required_fields", "SELECT c_custkey FROM customer WHERE trim(c_name) <> '' AND trim(c_mktsegment) <> ''")
def _(t):
    return R.validated(t.customer, ["c_name", "c_mktsegment"])[0].select("c_custkey")


@query("p13_finite_series", "SELECT vec_id FROM embeddings WHERE len(embedding) > 0 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x) OR isinf(x)))")
def _(t):
    return t.embeddings.where(S.finite(F.col("embedding").cast("array<double>"))).select("vec_id")


@query("p14_quality_flags", "SELECT vec_id, len(embedding) <> 12 AS odd_leads, len(embedding) <> 64 AS odd_points FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", (F.size("embedding") != 12).alias("odd_leads"), (F.size("embedding") != 64).alias("odd_points"))


@query("p15_sentinels", "SELECT l_orderkey, l_linenumber, nullif(l_tax, 0.0) AS tax, CASE WHEN l_discount = 0.0 THEN 50.0 ELSE l_discount END AS discount FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", R.sentinel_null(F.col("l_tax"), 0.0).alias("tax"), F.when(F.col("l_discount") == 0.0, 50.0).otherwise(F.col("l_discount")).alias("discount"))


@query("p16_prefix_and_parse", "SELECT s_suppkey, nullif(regexp_extract(s_name, '(\\d+)$', 1), '')::BIGINT AS number FROM supplier WHERE starts_with(s_name, 'S') AND regexp_matches(s_name, '\\d+$')")
def _(t):
    n = F.nullif(F.regexp_extract("s_name", r"(\d+)$", 1), F.lit("")).cast("long")
    return t.supplier.where(F.startswith("s_name", F.lit("S"))).select("s_suppkey", n.alias("number")).dropna()


@query("p17_threshold_split", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 25 THEN 'ok' WHEN l_quantity > 25 THEN 'oom' END AS status FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") <= 25, "ok").when(F.col("l_quantity") > 25, "oom").alias("status"))


@query("p18_correct_only", f"SELECT l_orderkey, l_linenumber FROM {PREDICTIONS} WHERE pred = gold")
def _(t):
    return _predictions(t).where("pred = gold").select("l_orderkey", "l_linenumber")


@query("p21_outside_vocabulary", f"SELECT l_orderkey, l_linenumber, pred NOT IN ('A', 'N', 'R') AS excluded FROM {PREDICTIONS}")
def _(t):
    return _predictions(t).select("l_orderkey", "l_linenumber", (~F.col("pred").isin("A", "N", "R")).alias("excluded"))


@query("p22_completion", "SELECT o_orderkey, CASE WHEN count(*) >= 3 THEN 'complete' WHEN count(*) > 0 THEN 'partial' ELSE 'empty' END AS status FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def _(t):
    n = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return t.orders.join(n, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", R.completion(F.col("n")).alias("status"))


@query("p23_tiers", "SELECT p_partkey, CASE WHEN p_size * 2 >= 70 THEN 'excellent' WHEN p_size * 2 >= 50 THEN 'good' WHEN p_size * 2 >= 30 THEN 'fair' ELSE 'poor' END AS tier FROM part")
def _(t):
    return t.part.select("p_partkey", R.tier(F.col("p_size") * 2).alias("tier"))


# Joins.
@query("j01_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("j02_common_keys", "SELECT doc_id, 'a' AS side FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'b' FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def _(t):
    a, b = R.on_common_keys(t.documents.select("doc_id"), t.labels.select("doc_id"), "doc_id")
    return a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))


@query("j03_list_lookup", "SELECT o_orderkey, string_agg(coalesce(p_brand, 'unknown'), ',' ORDER BY l_linenumber, l_partkey) AS brands FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey GROUP BY o_orderkey")
def _(t):
    ids = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias("ids"))
    out = R.collected_lookup(ids, "l_orderkey", "ids", t.part.where("p_size > 10").select(F.col("p_partkey").alias("id"), "p_brand"), F.col("p_brand"), "unknown")
    return t.orders.join(out, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.array_join("found", ",").alias("brands"))


@query("j04_left_lookup", "SELECT c_custkey, coalesce(n_name, 'none') AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON c_nationkey = n_nationkey")
def _(t):
    return t.customer.join(t.nation.where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("none")).alias("nation"))


@query("j05_positional_zip", "SELECT doc_id, list_zip(a[1:least(len(a), len(b))], b[1:least(len(a), len(b))])::VARCHAR <> '' AS zipped, least(len(a), len(b)) AS n FROM (SELECT doc_id, string_split(text, ' ') AS a, string_split(source, 'r') AS b FROM documents)")
def _(t):
    z = R.zipped(F.split("text", " ", -1), F.split("source", "r", -1))
    return t.documents.select("doc_id", (F.size(z) > 0).alias("zipped"), F.size(z).cast("long").alias("n"))


@query("j07_reviewer_pairs", "SELECT a.l_orderkey, a.l_linenumber AS first, b.l_linenumber AS second, a.l_returnflag AS first_answer, b.l_returnflag AS second_answer FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber")
def _(t):
    return R.reviewer_pairs(t.lineitem, "l_orderkey", "l_linenumber", "l_returnflag")


@query("j08_not_done", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    return R.not_done(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("j11_membership", "SELECT p_partkey, list_contains(['small', 'large'], lower(trim(string_split(p_type, ' ')[1]))) AS known FROM part")
def _(t):
    return t.part.select("p_partkey", F.array_contains(F.array(F.lit("small"), F.lit("large")), L.strip(F.lower(F.split("p_type", " ")[0]))).alias("known"))


@query("j12_round_robin", "SELECT o_orderkey, r.range::INT AS round, ((q + r.range) % 5)::INT AS reviewer FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1 AS q FROM orders), range(2) r")
def _(t):
    return R.round_robin(t.orders, "o_orderkey", 5, 2, 42)


@query("j13_grid", "SELECT r_name, l.range AS length, n.range AS series FROM region, range(4) l, range(5) n")
def _(t):
    return R.grid(t.region.select("r_name"), t._spark.range(4).toDF("length"), t._spark.range(5).toDF("series"))


# Aggregations.
@query("a01_sample_statistics", "SELECT vec_id, list_avg(embedding::DOUBLE[]) AS mean, list_stddev_samp(embedding::DOUBLE[]) AS std FROM embeddings")
def _(t):
    v = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", S.mean(v).alias("mean"), S.deviation(v, 1).alias("std"))


@query("a02_population_statistics", "SELECT vec_id, list_avg(embedding::DOUBLE[]) AS mean, list_stddev_pop(embedding::DOUBLE[]) AS std FROM embeddings")
def _(t):
    v = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", S.mean(v).alias("mean"), S.deviation(v, 0).alias("std"))


@query("a03_label_shares", "SELECT event_type, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM events) AS percent FROM events GROUP BY event_type")
def _(t):
    return C.share_table(t.events, "event_type")


@query("a05_distinct_counts", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events")
def _(t):
    return t.events.agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("kinds"))


@query("a06_modal_label", "SELECT user_id, event_type AS label, n FROM (SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY user_id, event_type) WHERE rn = 1 AND n >= 0.5 * total")
def _(t):
    return R.window_majority(t.events.withColumn("window_id", F.lit(0)), "user_id", "event_type").select("user_id", "label", "n")


@query("a07_accuracy", f"SELECT count(*) AS total, sum((pred = gold)::INT)::BIGINT AS correct, sum((pred <> gold)::INT)::BIGINT AS incorrect, 100.0 * avg((pred = gold)::INT) AS accuracy FROM {PREDICTIONS}")
def _(t):
    return C.accuracy(_predictions(t), "pred", "gold")


@query("a08_open_vocabulary", f"SELECT class, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn FROM {COUNTS}")
def _(t):
    return C.class_counts(_predictions(t), "pred", "gold")


_OPEN = ["A", "N", "Z"]  # R is a gold answer and a prediction, but not allowed


@query(
    "a09_closed_vocabulary",
    f"""SELECT class, coalesce(sum((gold = class AND pred = gold)::INT), 0)::BIGINT AS tp, coalesce(sum((pred = class AND pred <> gold AND class IN {tuple(_OPEN)})::INT), 0)::BIGINT AS fp, coalesce(sum((gold = class AND pred <> gold)::INT), 0)::BIGINT AS fn
FROM (SELECT unnest({_OPEN}) AS class UNION SELECT DISTINCT gold FROM {PREDICTIONS}) c LEFT JOIN {PREDICTIONS} p ON p.gold = c.class OR p.pred = c.class GROUP BY class""",
)
def _(t):
    return C.closed_counts(_predictions(t), "pred", "gold", t._spark.createDataFrame([(x,) for x in _OPEN], "class string"))


@query("a10_supported_gold", f"SELECT class, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn FROM {COUNTS} WHERE tp + fn > 0")
def _(t):
    return C.supported_counts(_predictions(t), "pred", "gold")


@query("a12_precision_recall_f1", f"SELECT class, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END::DOUBLE AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END::DOUBLE AS recall, ({F1})::DOUBLE AS f1 FROM {COUNTS}")
def _(t):
    return C.with_f1(C.class_counts(_predictions(t), "pred", "gold")).select("class", "precision", "recall", "f1")


@query("a13_macro_f1", f"SELECT avg({F1})::DOUBLE AS macro_f1, count(*) AS classes FROM {COUNTS} WHERE tp + fn > 0")
def _(t):
    return C.macro_f1(C.with_f1(C.supported_counts(_predictions(t), "pred", "gold")))


# Allowed answers: R only of templates 0, 1 and 2, so others have gold answers and predictions that aren't allowed; Z never occurs.
ALLOWED = f"(SELECT DISTINCT template, class FROM {PREDICTIONS}, (SELECT unnest(['A', 'N', 'R', 'Z']) AS class) WHERE class <> 'R' OR template < 3)"


@query(
    "a14_template_f1",
    f"""WITH kept AS (SELECT p.* FROM {PREDICTIONS} p WHERE EXISTS (SELECT 1 FROM {ALLOWED} a WHERE a.template = p.template AND a.class = p.gold)),
c AS (SELECT a.template, a.class, coalesce(sum((k.gold = a.class AND k.pred = k.gold)::INT), 0) AS tp, coalesce(sum((k.pred = a.class AND k.pred <> k.gold)::INT), 0) AS fp, coalesce(sum((k.gold = a.class AND k.pred <> k.gold)::INT), 0) AS fn
  FROM {ALLOWED} a LEFT JOIN kept k ON k.template = a.template AND (k.gold = a.class OR k.pred = a.class) GROUP BY 1, 2),
f AS (SELECT template, avg({F1}) AS macro_f1 FROM c GROUP BY template),
s AS (SELECT template, count(*) AS n, sum((pred = gold)::INT) AS correct FROM {PREDICTIONS} GROUP BY template)
SELECT template, sum(n)::BIGINT AS n, avg(macro_f1)::DOUBLE AS macro_f1, (sum(macro_f1 * n) / sum(n))::DOUBLE AS weighted_f1, (sum(correct) / sum(n))::DOUBLE AS accuracy, avg(correct / n)::DOUBLE AS template_accuracy
FROM f JOIN s USING (template) GROUP BY GROUPING SETS ((template), ())""",
)
def _(t):
    p = _predictions(t)
    classes = t._spark.createDataFrame([(x,) for x in "ANRZ"], "class string")
    labels = p.select("template").distinct().crossJoin(classes).where("class <> 'R' OR template < 3")  # four classes
    return C.template_f1(p, "pred", "gold", "template", labels)


@query("a15_task_accuracy", f"SELECT template, count(*) AS total, sum((pred = gold)::INT)::BIGINT AS correct, sum((pred <> gold)::INT)::BIGINT AS incorrect, 100.0 * avg((pred = gold)::INT) AS accuracy FROM {PREDICTIONS} GROUP BY ROLLUP (template)")
def _(t):
    return C.accuracy(_predictions(t), "pred", "gold", ["template"])


_CODES = "list_transform(string_split(o_orderstatus || o_orderpriority, ''), lambda x: ascii(x))"


@query("m06_label_mask", f"SELECT o_orderkey, i.range AS i, CASE WHEN i.range < (o_custkey % 4) OR ({_CODES})[i.range + 1] = 45 THEN -100 ELSE ({_CODES})[i.range + 1] END AS label FROM orders, range(20) i WHERE i.range < len({_CODES})")
def _(t):
    """Codes of characters stand for token ids, a hyphen for padding; prompts have 0 to 3 tokens."""
    ids = F.transform(F.split(F.concat("o_orderstatus", "o_orderpriority"), ""), F.ascii)
    out = t.orders.select("o_orderkey", F.posexplode(L.label_mask(ids, (F.col("o_custkey") % 4).cast("int"), 45)).alias("i", "label"))
    return out.select("o_orderkey", F.col("i").cast("long").alias("i"), "label")


def _normal(c: str) -> str:
    return f"rtrim(trim(lower({c}), {_BLANKS}), '.,!?;:')"


@query(
    "a16_token_overlap",
    f"""WITH w AS (SELECT a.conv_id, a.turn, list_filter(string_split_regex({_normal("a.text")}, '\\s+'), lambda x: x <> '') AS p, list_filter(string_split_regex({_normal("b.text")}, '\\s+'), lambda x: x <> '') AS g FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
s AS (SELECT *, coalesce(list_sum(list_transform(list_intersect(p, g), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))), 0) AS shared FROM w)
SELECT conv_id, turn, CASE WHEN len(p) + len(g) = 0 THEN 1.0 WHEN shared = 0 THEN 0.0 ELSE shared / len(p) END::DOUBLE AS precision, CASE WHEN len(p) + len(g) = 0 THEN 1.0 WHEN shared = 0 THEN 0.0 ELSE shared / len(g) END::DOUBLE AS recall, CASE WHEN len(p) + len(g) = 0 THEN 1.0 WHEN shared = 0 THEN 0.0 ELSE 2.0 * shared / (len(p) + len(g)) END::DOUBLE AS f1 FROM s""",
)
def _(t):
    c = t.conversations
    a, b = c.select("conv_id", "turn", F.col("text").alias("p")), c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("g"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", C.token_overlap(F.col("p"), F.col("g")).alias("s")).select("conv_id", "turn", "s.*")


@query("a17_confusion", f"SELECT gold, count(*) FILTER (pred = 'A') AS A, count(*) FILTER (pred = 'N') AS N, count(*) FILTER (pred = 'R') AS R, count(*) AS support FROM {PREDICTIONS} WHERE pred IN ('A', 'N', 'R') GROUP BY gold")
def _(t):
    return C.confusion(_predictions(t), "gold", "pred", ["A", "N", "R"])


@query("a18_metric_means", "SELECT avg(coalesce(quality, 0)) * 100 AS quality, avg(coalesce(toxic, 0)) * 100 AS toxic FROM labels")
def _(t):
    return C.metric_means(t.labels, ["quality", "toxic"])


@query("a19_success_rate", f"SELECT count(*) AS total, sum((pred <> 'X')::INT)::BIGINT AS ok, avg((pred <> 'X')::INT) AS rate FROM {PREDICTIONS}")
def _(t):
    ok = (F.col("pred") != "X").cast("int")
    return _predictions(t).agg(F.count(F.lit(1)).alias("total"), F.sum(ok).alias("ok"), F.avg(ok).alias("rate"))


@query("a20_grouping_sets", "SELECT l_linestatus, l_returnflag, avg(l_quantity) AS mean, count(l_quantity) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")
def _(t):
    return C.grouped_means(t.lineitem, [["l_returnflag"], ["l_linestatus"]], "l_quantity")


@query("a21_layer_statistics", "SELECT l_linenumber, avg(l_quantity) AS l_quantity_mean, stddev_pop(l_quantity) AS l_quantity_std, avg(l_tax) AS l_tax_mean, stddev_pop(l_tax) AS l_tax_std FROM lineitem GROUP BY ROLLUP (l_linenumber)")
def _(t):
    return C.layer_stats(t.lineitem, "l_linenumber", ["l_quantity", "l_tax"])


@query("a22_contribution", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 0.0 ELSE abs(-l_tax) * l_quantity / l_discount * 100 END AS percent FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", S.contribution(-F.col("l_tax"), F.col("l_quantity"), F.col("l_discount")).alias("percent"))


_STATUS = "CASE WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderstatus = 'O' THEN 'partial' ELSE 'empty' END"


@query("a23_review_overview", f"SELECT count(*) AS total, sum(({_STATUS} = 'complete')::INT)::BIGINT AS completed, round(100.0 * avg(({_STATUS} = 'complete')::INT), 1) AS rate FROM orders")
def _(t):
    return C.review_overview(t.orders.withColumn("status", F.expr(_STATUS)), "status")


@query(
    "a24_response_rates",
    "WITH x AS (SELECT 'a' AS question, CASE WHEN l_returnflag = 'A' THEN 'positive' WHEN l_returnflag = 'N' THEN 'partial' ELSE 'negative' END AS kind FROM lineitem UNION ALL SELECT 'b', CASE WHEN l_linestatus = 'O' THEN 'positive' ELSE 'negative' END FROM lineitem) SELECT question, count(*) AS n, 100.0 * avg((kind = 'positive')::INT) AS positive_rate, 100.0 * avg((kind = 'partial')::INT) AS partial_rate, 100.0 * avg((kind = 'negative')::INT) AS negative_rate FROM x GROUP BY question",
)
def _(t):
    forms = t.lineitem.select(L.mapped(F.col("l_returnflag"), {"A": "Yes, all", "N": "Used some", "R": "No"}).alias("a"), F.when(F.col("l_linestatus") == "O", "Yes").otherwise("No").alias("b"))
    return C.response_rates(forms, ["a", "b"], L.response_kind)


@query(
    "a26_agreement",
    "SELECT a.l_linenumber AS first, count(*) AS pairs, sum((a.l_returnflag = b.l_returnflag)::INT)::BIGINT AS agreed, 100.0 * avg((a.l_returnflag = b.l_returnflag)::INT) AS percent FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY ROLLUP (a.l_linenumber)",
)
def _(t):
    return C.agreement_by_reviewer(t.lineitem, "l_orderkey", "l_linenumber", "l_returnflag")


@query(
    "a26_agreement_by_question",
    """WITH q AS (SELECT l_orderkey % 50 AS sample, l_suppkey % 3 AS question, l_linenumber AS reviewer, nullif(CASE WHEN l_partkey % 4 = 0 THEN '' ELSE l_returnflag END, 'A') AS answer FROM lineitem WHERE l_orderkey % 5 < 4 OR l_linenumber < 3)
SELECT a.question, count(*) AS pairs, sum((a.answer = b.answer)::INT)::BIGINT AS agreed, 100.0 * avg((a.answer = b.answer)::INT) AS percent FROM q a JOIN q b ON a.sample = b.sample AND a.question = b.question AND a.reviewer < b.reviewer WHERE a.answer IS NOT NULL AND b.answer IS NOT NULL GROUP BY ROLLUP (a.question)""",
)
def _(t):
    """Reviewers answer a sample's question often; some answers are blank, some are missing."""
    answer = F.when(F.col("l_partkey") % 4 == 0, "").when(F.col("l_returnflag") != "A", F.col("l_returnflag"))
    rows = t.lineitem.where("l_orderkey % 5 < 4 OR l_linenumber < 3").select((F.col("l_orderkey") % 50).alias("sample"), (F.col("l_suppkey") % 3).alias("question"), F.col("l_linenumber").alias("reviewer"), answer.alias("answer"))
    return C.agreement_from_counts(rows, "sample", "reviewer", "answer", ["question"])


@query(
    "a26_disagreements",
    "SELECT least(a.l_returnflag, b.l_returnflag) AS a, greatest(a.l_returnflag, b.l_returnflag) AS b, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE a.l_returnflag <> b.l_returnflag GROUP BY 1, 2",
)
def _(t):
    return C.disagreements(t.lineitem, "l_orderkey", "l_linenumber", "l_returnflag")


@query(
    "x15_cohen_kappa",
    """WITH p AS (SELECT a.l_returnflag AS x, b.l_returnflag AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber),
t AS (SELECT count(*) AS n, avg((x = y)::INT) AS po FROM p), c AS (SELECT sum(i.c * j.c)::DOUBLE AS c FROM (SELECT x, count(*) AS c FROM p GROUP BY x) i JOIN (SELECT y, count(*) AS c FROM p GROUP BY y) j ON x = y)
SELECT n, po AS observed, c / n / n AS expected, (po - c / n / n) / (1 - c / n / n) AS kappa FROM t, c""",
)
def _(t):
    return C.kappa(t.lineitem, "l_orderkey", "l_linenumber", "l_returnflag")


@query("a27_reviewer_load", "SELECT l_returnflag, count(*) FILTER (l_linenumber = 1) AS \"1\", count(*) FILTER (l_linenumber = 2) AS \"2\" FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_returnflag")
def _(t):
    return C.load_table(t.lineitem.where("l_linenumber <= 2"), "l_returnflag", "l_linenumber", [1, 2])


@query("a28_peak", "SELECT l_suppkey, max(l_extendedprice) / 1073741824 AS peak_gib FROM lineitem GROUP BY l_suppkey")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg((F.max("l_extendedprice") / 1024**3).alias("peak_gib"))


@query("a30_mean_loss", "SELECT avg(value) AS loss FROM events")
def _(t):
    return t.events.agg(F.avg("value").alias("loss"))


@query("a32_distinct_listed", "SELECT DISTINCT trim(x) AS label FROM (SELECT unnest(string_split(p_type, ' ')) AS x FROM part) WHERE trim(x) <> ''")
def _(t):
    return t.part.select(F.explode(F.split("p_type", " ")).alias("x")).select(L.strip(F.col("x")).alias("label")).where("label <> ''").distinct()


@query("a34_balanced_batch_count", "SELECT min(n) AS least, (min(n) // 2)::BIGINT AS batches FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)")
def _(t):
    return t.embeddings.groupBy("label").count().agg(F.min("count").alias("least"), F.expr("min(count) div 2").alias("batches"))


@query("a36_rare_classes", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) < 70")
def _(t):
    return C.rare_classes(t.part, "p_brand", 70)


@query("a37_prefix_accuracy", "SELECT avg(starts_with(o_orderpriority, left(o_orderpriority, (o_orderkey % 3)::INT))::INT) AS accuracy FROM orders")
def _(t):
    return C.prefix_accuracy(t.orders.withColumn("pred", F.left("o_orderpriority", (F.col("o_orderkey") % 3).cast("int"))), "pred", "o_orderpriority")


# Windows and order.
_WINDOW = "(SELECT *, date_diff('microsecond', min(ts) OVER (PARTITION BY user_id), ts) // 3600000000 AS window_id FROM events)"


@query("w01_entity_windows", f"SELECT user_id, window_id, count(*) AS n, sum(value) AS total FROM {_WINDOW} GROUP BY user_id, window_id")
def _(t):
    return R.entity_windows(t.events, "user_id", "ts", 3600).groupBy("user_id", "window_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


_NAMED = f"(SELECT user_id, window_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS label FROM {_WINDOW})"


@query("w02_window_majority", f"""WITH n AS (SELECT user_id, window_id, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id, window_id) AS total FROM {_NAMED} GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_id ORDER BY n DESC, label) AS rn FROM n WHERE label IS NOT NULL)
SELECT user_id, window_id, label, n, total::BIGINT AS total FROM r WHERE rn = 1 AND n >= 0.5 * total""")
def _(t):
    """A third of the rows has no label."""
    rows = R.entity_windows(t.events, "user_id", "ts", 3600).withColumn("label", F.when(F.col("event_id") % 3 != 0, F.col("event_type")))
    return R.window_majority(rows, "user_id", "label")


@query("w03_window_series", f"SELECT user_id, window_id, unnest(range(len(s))) AS i, unnest(s) AS x FROM (SELECT user_id, window_id, list(value ORDER BY ts, event_id) AS s FROM {_WINDOW} GROUP BY user_id, window_id)")
def _(t):
    out = R.window_series(R.entity_windows(t.events, "user_id", "ts", 3600), "user_id", ["ts", "event_id"], "value")
    return out.select("user_id", "window_id", F.posexplode("series").alias("i", "x")).withColumn("i", F.col("i").cast("long"))


@query(
    "w04_interpolated",
    """WITH e AS (SELECT event_id, user_id, row_number() OVER w AS i, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {'i': i, 'v': v} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i) AS b, first_value(CASE WHEN v IS NOT NULL THEN {'i': i, 'v': v} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM e)
SELECT event_id, coalesce(v, CASE WHEN a IS NULL THEN b.v ELSE b.v + (a.v - b.v) * (i - b.i) / (a.i - b.i) END) AS value FROM k""",
)
def _(t):
    gaps = t.events.select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    return R.interpolated(gaps, "user_id", ["ts", "event_id"], "value").select("event_id", "value")


@query(
    "w04_interpolated_whole",
    """WITH e AS (SELECT event_id, row_number() OVER w AS i, CASE WHEN event_id % 7 IN (0, 3) THEN value WHEN event_id % 7 = 1 THEN 'nan'::DOUBLE END AS v FROM events WINDOW w AS (ORDER BY ts, event_id)),
n AS (SELECT event_id, i, CASE WHEN isnan(v) THEN NULL ELSE v END AS v FROM e),
k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {'i': i, 'v': v} END IGNORE NULLS) OVER (ORDER BY i) AS b, first_value(CASE WHEN v IS NOT NULL THEN {'i': i, 'v': v} END IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM n)
SELECT event_id, coalesce(v, CASE WHEN a IS NULL THEN b.v ELSE b.v + (a.v - b.v) * (i - b.i) / (a.i - b.i) END) AS value FROM k""",
)
def _(t):
    gaps = t.events.select("event_id", "ts", F.when((F.col("event_id") % 7).isin(0, 3), F.col("value")).when(F.col("event_id") % 7 == 1, float("nan")).alias("value"))
    return R.interpolated(gaps, None, ["ts", "event_id"], "value").select("event_id", "value")


@query("w05_first_of_full_groups", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE rn <= 2 AND n >= 2")
def _(t):
    return R.first_per_group(t.orders, "o_custkey", ["o_orderkey"], 2, complete=True).select("o_custkey", "o_orderkey")


_LABEL3 = "(SELECT vec_id, label % 3 AS label FROM embeddings)"


@query("w06_balanced_batches", f"SELECT vec_id, label, (rn // 2)::BIGINT AS batch FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('5|' || vec_id), vec_id) - 1 AS rn FROM {_LABEL3}) WHERE rn // 2 < (SELECT min(n) // 2 FROM (SELECT count(*) AS n FROM {_LABEL3} GROUP BY label))")
def _(t):
    rows = t.embeddings.select("vec_id", (F.col("label") % 3).alias("label"))
    return R.balanced_batches(rows, "label", "vec_id", 6, 5)


@query(
    "w07_early_stop",
    """WITH RECURSIVE l AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id),
f(user_id, v, epoch, best_epoch, best, misses, stopped_at) AS (SELECT user_id, v, 0, 0, 'inf'::DOUBLE, 0, 0 FROM l UNION ALL
SELECT user_id, v, epoch + 1, CASE WHEN v[epoch + 1] + 0.0001 < best THEN epoch + 1 ELSE best_epoch END, CASE WHEN v[epoch + 1] + 0.0001 < best THEN v[epoch + 1] ELSE best END,
CASE WHEN v[epoch + 1] + 0.0001 < best THEN 0 ELSE misses + 1 END, CASE WHEN v[epoch + 1] + 0.0001 >= best AND misses + 1 >= 2 THEN epoch + 1 ELSE 0 END FROM f WHERE stopped_at = 0 AND epoch < len(v))
SELECT user_id, max(best_epoch) AS best_epoch, min(best) AS best, max(stopped_at) AS stopped_at FROM f GROUP BY user_id""",
)
def _(t):
    losses = t.events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda s: s["value"]).alias("v"))
    return losses.select("user_id", R.early_stop(F.col("v")).alias("s")).select("user_id", "s.best_epoch", "s.best", "s.stopped_at")


@query("w08_last_rows", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5")
def _(t):
    return R.first_per_group(t.events, "user_id", [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


@query("w09_first_and_last", "SELECT l_suppkey, min(l_quantity) FILTER (l_quantity > 25) AS first_oom, max(l_quantity) FILTER (l_quantity <= 25) AS last_ok FROM lineitem GROUP BY l_suppkey")
def _(t):
    q = F.col("l_quantity")
    return t.lineitem.groupBy("l_suppkey").agg(F.min_by(q, F.when(q > 25, q)).alias("first_oom"), F.max_by(q, F.when(q <= 25, q)).alias("last_ok"))


@query("w11_patches", "SELECT vec_id, p.range AS patch, list_sum(embedding[p.range * 4 + 1:p.range * 4 + 4]::DOUBLE[]) AS total FROM embeddings, range(16) p")
def _(t):
    v = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", F.posexplode(S.patches(v)).alias("patch", "p")).select("vec_id", F.col("patch").cast("long").alias("patch"), S.total(F.col("p")).alias("total"))


@query("o02_top", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 12")
def _(t):
    return t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand").limit(12)


@query("o03_head_per_split", "SELECT lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 10")
def _(t):
    return R.first_per_group(t.documents, "lang", ["doc_id"], 10).select("lang", "doc_id")


@query("o04_category_order", "SELECT o_orderkey, list_position(['5-LOW', '1-URGENT'], o_orderpriority) AS rank FROM orders WHERE o_orderpriority IN ('5-LOW', '1-URGENT')")
def _(t):
    order = F.array(F.lit("5-LOW"), F.lit("1-URGENT"))
    return t.orders.where(F.col("o_orderpriority").isin("5-LOW", "1-URGENT")).select("o_orderkey", F.array_position(order, F.col("o_orderpriority")).cast("int").alias("rank")).orderBy("rank", "o_orderkey")


@query("o05_first_match", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", "o_orderkey").alias("o_orderkey"))


_RN = "row_number() OVER (ORDER BY left(md5('42|' || doc_id), 2), md5('42|' || doc_id), doc_id)"


@query("r01_random_split", f"SELECT doc_id, CASE WHEN rn <= ceil(n * 0.1) THEN 'test' WHEN rn <= ceil(n * 0.1) + ceil(n * 0.1) THEN 'validation' ELSE 'train' END AS split FROM (SELECT doc_id, {_RN} AS rn, count(*) OVER () AS n FROM documents)")
def _(t):
    return R.random_split(t.documents.select("doc_id"), "doc_id", 42)


@query(
    "r02_stratified_split",
    """WITH s AS (SELECT lang, count(*) AS n, sum(count(*)) OVER () AS total FROM documents GROUP BY lang),
a AS (SELECT lang, floor(n * 0.1::DOUBLE) + (row_number() OVER (ORDER BY floor(n * 0.1::DOUBLE) - n * 0.1::DOUBLE, lang) <= ceil(total * 0.1::DOUBLE) - sum(floor(n * 0.1::DOUBLE)) OVER ())::INT AS k FROM s),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS rn FROM documents)
SELECT doc_id, lang, CASE WHEN rn <= k THEN 'test' WHEN rn <= 2 * k THEN 'validation' ELSE 'train' END AS split FROM r JOIN a USING (lang)""",
)
def _(t):
    return R.stratified_split(t.documents.select("doc_id", "lang"), "doc_id", "lang", 42)


@query("r04_entity_split", "SELECT event_id, CASE WHEN user_id IN (5, 6) THEN 'validation' WHEN user_id IN (7, 8) THEN 'test' ELSE 'train' END AS split FROM events")
def _(t):
    return t.events.select("event_id", R.entity_split(F.col("user_id"), [5, 6], [7, 8]).alias("split"))


@query("r05_missing_classes", f"SELECT DISTINCT source FROM documents EXCEPT SELECT source FROM documents JOIN ({SQL['r01_random_split']}) USING (doc_id) WHERE split = 'test'")
def _(t):
    held = R.random_split(t.documents.select("doc_id", "source"), "doc_id", 42).where("split = 'test'")
    return t.documents.select("source").distinct().subtract(held.select("source"))


@query("r06_seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('9|' || doc_id), doc_id LIMIT 50")
def _(t):
    return R.sampled(t.documents.select("doc_id"), "doc_id", 9, 50)


@query("r07_dealt", f"SELECT doc_id, (({_RN} - 1) % 4)::INT AS worker FROM documents")
def _(t):
    return R.dealt(t.documents.select("doc_id"), "doc_id", 42, 4)


@query("r08_weighted_choice", "SELECT o_orderkey, CASE WHEN u < 0.5 THEN 'yes' WHEN u < 0.85 THEN 'some' ELSE 'no' END AS answer FROM (SELECT o_orderkey, ('0x' || left(md5('3|' || o_orderkey), 8))::BIGINT / 4294967296.0 AS u FROM orders)")
def _(t):
    return t.orders.select("o_orderkey", R.weighted_choice(S.uniform(3, F.col("o_orderkey")), {"yes": 0.5, "some": 0.35, "no": 0.15}).alias("answer"))


# Sets.
@query("u01_union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def _(t):
    return R.union_all(t.nation.select(F.col("n_name").alias("name")), t.region.select(F.col("r_name").alias("name")))


@query("u02_union_missing", "SELECT n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_name, NULL FROM region")
def _(t):
    return R.union_all(t.nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), t.region.select(F.col("r_name").alias("name")), missing=True)


@query("u03_intersect", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def _(t):
    return t.documents.select("doc_id").intersect(t.labels.select("doc_id"))


@query("u05_distinct_union", "SELECT l_returnflag AS k FROM lineitem UNION SELECT o_orderstatus FROM orders")
def _(t):
    return t.lineitem.select(F.col("l_returnflag").alias("k")).union(t.orders.select("o_orderstatus")).distinct()


@query("u06_multiset_intersect", "SELECT l_returnflag AS k FROM lineitem WHERE l_linenumber = 1 INTERSECT ALL SELECT l_returnflag FROM lineitem WHERE l_linenumber = 6")
def _(t):
    k = F.col("l_returnflag").alias("k")
    return t.lineitem.where("l_linenumber = 1").select(k).intersectAll(t.lineitem.where("l_linenumber = 6").select(k))


@query("u07_ordered_parts", "SELECT n_name AS name, 0 AS part FROM nation UNION ALL SELECT r_name, 1 FROM region")
def _(t):
    return R.ordered_union(t.nation.select(F.col("n_name").alias("name")), t.region.select(F.col("r_name").alias("name")))


# Strings and labels.
def _text_query(name: str, column, sql: str) -> None:
    @query(name, f"SELECT o_orderkey, {sql} AS label FROM {TEXTS}")
    def _(t):
        return _texts(t).select("o_orderkey", column(F.col("text")).alias("label"))


_STRIP = lambda x: f"trim({x}, {_BLANKS})"
_LAST = _STRIP("string_split(text, 'Answer: ')[-1]")
_LAST_WORD = "coalesce(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[-1], '')"
_text_query("f01_normalized", L.normalize_label, f"rtrim({_STRIP('lower(text)')}, '.,!?;:')")
_text_query("f02a_answer_tagged", L.answer_tagged, f"CASE WHEN contains(text, 'Answer: ') THEN {_STRIP(f"regexp_replace({_LAST}, '<\\|.*?\\|>$', '')")} ELSE text END")
_text_query("f02b_answer_clean", L.answer_clean, f"regexp_replace({_STRIP(f"regexp_replace(CASE WHEN contains(text, 'Answer: ') THEN {_LAST} ELSE text END, '<\\|.*?\\|>|<eos>$', '', 'g')")}, '\\.$', '')")
_text_query("f02c_answer_or_last_word", L.answer_or_last_word, f"rtrim(CASE WHEN contains(lower(text), 'answer:') THEN {_STRIP("string_split(lower(text), 'answer:')[-1]")} ELSE lower({_LAST_WORD}) END, '.,!?;:')")
_DIRECT = f"nullif({_STRIP("regexp_extract(text, '(?is)answer:\\s*(.+?)(?:\\.|$)', 1)")}, '')"
_text_query("f02d_answer_sentence", L.answer_sentence, f"coalesce({_DIRECT}, nullif(regexp_extract(text, '(?i)\\b((?:non-)?rem \\w+)', 1), ''), nullif(rtrim({_LAST_WORD}, '.,!?;:'), ''))")
_text_query("f02f_answer_prefix", L.answer_prefix3, f"left({_STRIP("string_split(lower(text), 'answer:')[-1]")}, 3)")
_text_query("f02f_mcq_prefix_cut_first", L.mcq_prefix3, f"left({_STRIP('lower(text)')}, 3)")
_text_query(
    "f03_option",
    L.mcq_option,
    f"coalesce('(' || lower(coalesce(nullif(regexp_extract(text, '\\(([a-eA-E])\\)', 1), ''), nullif(regexp_extract(text, '\\b([a-eA-E])[).]\\b', 1), ''), nullif(regexp_extract(text, '\\b([a-eA-E])\\s*[:-]', 1), ''))) || ')', {_STRIP('text')})",
)
_text_query("f07_slug", L.slug, "regexp_replace(lower(text), '[^a-z0-9]', '-', 'g')")
_text_query("f14_preview", lambda c: L.preview(c, 12), "CASE WHEN length(text) > 12 THEN left(text, 12) || '...' ELSE text END")
_text_query("f18_end_token", lambda c: L.with_end(c, "<eos>"), "CASE WHEN ends_with(text, '<eos>') THEN text ELSE text || '<eos>' END")
_text_query("f23_fitted", lambda c: L.fitted(c, 20), "rpad(left(text, 20), 20, ' ')")


_ANSWER = "regexp_extract(t, '(?i)answer:\\s*([^\\n]+?)(?:\\.|$)', 1)"
_FURTHEST = "list_sort(list_transform(list_filter([" + ", ".join(f"{{'x': '{x}', 'k': {k}}}" for k, x in enumerate(L.STAGE_NAMES)) + "], lambda s: contains(lower(t), s.x)), lambda s: {'at': -(length(t) - position(reverse(s.x) IN reverse(lower(t))) - length(s.x)), 'k': s.k, 'x': s.x}))[1].x"


@query(
    "f02e_answer_staged",
    f"""SELECT o_orderkey, lower(CASE WHEN regexp_matches(t, '(?i)answer:\\s*([^\\n]+?)(?:\\.|$)') THEN trim(regexp_replace(trim({_ANSWER}), '\\.$', '')) WHEN contains(lower(t), 'answer:') THEN rtrim(trim(regexp_extract(t, '(?is)^.*answer:\\s*(.*)$', 1)), '.,!?;:')
  ELSE coalesce({_FURTHEST}, rtrim({_LAST_WORD.replace('text', 't')}, '.,!?;:')) END) AS label FROM (SELECT o_orderkey, {_STRIP('text')} AS t FROM {TEXTS})""",
)
def _(t):
    return _texts(t).select("o_orderkey", L.answer_staged(F.col("text")).alias("label"))


_WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda w: w <> '')"
_text_query("f02g_first_word", L.answer_first_word, f"lower(CASE WHEN contains(text, 'Answer:') THEN {_WORDS.format("string_split(text, 'Answer:')[-1]")}[1] ELSE coalesce({_WORDS.format('text')}[-1], 'unknown') END)")
_text_query("f02h_sampler_label", L.answer_label, SQL["f02b_answer_clean"].removeprefix("SELECT o_orderkey, ").removesuffix(f" AS label FROM {TEXTS}"))

# The rules of the two canonicalisers, written out case by case.
_STAGE_SQL = f"""SELECT o_orderkey, CASE WHEN t = 'w' THEN 'wake' WHEN t IN ('rem', 'rapid eye movement') THEN 'rem sleep' WHEN t IN ('artifact', 'artifacts', 'movement time') THEN 'movement'
  WHEN regexp_full_match(t, '(s|n|stage )?[1-4]') THEN 'non-rem stage ' || least(right(t, 1), '3')
  WHEN u IN ('wake', 'rem sleep', 'movement') OR regexp_full_match(u, 'non-rem stage [123]') THEN u WHEN u = 'non-rem stage 4' THEN 'non-rem stage 3'
  WHEN u LIKE '%wake%' THEN 'wake' WHEN u LIKE '%rem%' AND u NOT LIKE '%non-rem%' THEN 'rem sleep' WHEN u LIKE '%movement%' OR u LIKE '%artifact%' THEN 'movement'
  WHEN u LIKE '%stage 4%' OR u LIKE '%stage 3%' THEN 'non-rem stage 3' WHEN u LIKE '%stage 2%' OR u LIKE '%spindle%' OR u LIKE '%k-complex%' THEN 'non-rem stage 2' WHEN u LIKE '%stage 1%' THEN 'non-rem stage 1' ELSE u END AS label
FROM (SELECT o_orderkey, t, replace(replace(t, 'non rem', 'non-rem'), 'nrem', 'non-rem') AS u FROM (
  SELECT o_orderkey, CASE WHEN length(s) > 3 AND left(s, 1) = '(' AND contains(left(s, 4), ')') THEN trim(substr(s, position(')' IN s) + 1)) ELSE s END AS t
  FROM (SELECT o_orderkey, trim(regexp_replace(trim(lower(text)), '[.,;:!?][.,;:!?\\s]*$', '')) AS s FROM {TEXTS})))"""
_OWN_STAGE_SQL = f"""SELECT o_orderkey, label, label IN ('Wake', 'Non-REM stage 1', 'Non-REM stage 2', 'Non-REM stage 3', 'REM sleep', 'Movement') AS supported FROM (SELECT o_orderkey,
  CASE WHEN n AND (u LIKE '%stage 4%' OR u LIKE '%stage 3%') THEN 'Non-REM stage 3' WHEN n AND u LIKE '%stage 2%' THEN 'Non-REM stage 2' WHEN n AND u LIKE '%stage 1%' THEN 'Non-REM stage 1'
  WHEN u LIKE '%rem%' AND u LIKE '%sleep%' THEN 'REM sleep' WHEN u IN ('wake', 'awake') THEN 'Wake' WHEN u LIKE '%movement%' OR u IN ('mov', 'mt') THEN 'Movement' ELSE c END AS label
  FROM (SELECT *, u LIKE '%non-rem%' AS n FROM (SELECT o_orderkey, c, CASE WHEN lower(c) LIKE '%nrem%' OR lower(c) LIKE '%non-rem%' THEN replace(replace(lower(c), 'nrem', 'non-rem'), 'non rem', 'non-rem') ELSE lower(c) END AS u
  FROM (SELECT o_orderkey, trim(regexp_replace(trim(regexp_replace(trim(text), '<\\|.*?\\|>|<eos>$', '', 'g')), '\\.$', '')) AS c FROM {TEXTS}))))"""


@query("f04_stage_labels", _STAGE_SQL)
def _(t):
    return _texts(t).select("o_orderkey", L.stage_label(F.col("text")).alias("label"))


@query("f05_own_stage_labels", _OWN_STAGE_SQL)
def _(t):
    return _texts(t).select("o_orderkey", L.own_stage_label(F.col("text")).alias("label"), L.stage_supported(F.col("text")).alias("supported"))


@query(
    "f06_stage_codes",
    f"""SELECT o_orderkey, CASE t WHEN 'w' THEN 'wake' WHEN 'n1' THEN 'non-rem stage 1' WHEN 'n2' THEN 'non-rem stage 2' WHEN 'n3' THEN 'non-rem stage 3' WHEN 'n4' THEN 'non-rem stage 3' WHEN 'rem' THEN 'rem sleep' ELSE t END AS stage,
  CASE text WHEN 'W' THEN 'Wake' WHEN 'N1' THEN 'Non-REM stage 1' WHEN 'N2' THEN 'Non-REM stage 2' WHEN 'N3' THEN 'Non-REM stage 3' WHEN 'N4' THEN 'Non-REM stage 4' WHEN 'REM' THEN 'REM sleep' WHEN 'M' THEN 'Movement' WHEN 'Unknown' THEN 'Unknown' END AS shown
FROM (SELECT o_orderkey, text, {_STRIP('lower(text)')} AS t FROM {TEXTS})""",
)
def _(t):
    return _texts(t).select("o_orderkey", L.stage_of_code(F.col("text")).alias("stage"), L.shown_code(F.col("text")).alias("shown"))


_NAMES_SQL = "CASE s_suppkey % 5 WHEN 0 THEN 'owner/m' || s_suppkey || '-SP' WHEN 1 THEN 'm' || s_suppkey || '_flamingo' WHEN 2 THEN 'a/b/m' || s_suppkey || '-Flamingo' WHEN 3 THEN 'owner/sp-' || s_suppkey ELSE 'x-sp-' || s_suppkey || '-SP' END"


@query("f08_model_names", f"SELECT s_suppkey, regexp_replace(string_split(n, '/')[-1], '[-_]([sS][pP]|[fF][lL][aA][mM][iI][nN][gG][oO])$', '') AS base, CASE WHEN lower(n) LIKE '%flamingo' THEN 'flamingo' WHEN lower(n) LIKE '%sp' THEN 'sp' END AS config FROM (SELECT s_suppkey, {_NAMES_SQL} AS n FROM supplier)")
def _(t):
    k, text = F.col("s_suppkey") % 5, F.col("s_suppkey").cast("string")
    name = F.when(k == 0, F.concat(F.lit("owner/m"), text, F.lit("-SP"))).when(k == 1, F.concat(F.lit("m"), text, F.lit("_flamingo"))).when(k == 2, F.concat(F.lit("a/b/m"), text, F.lit("-Flamingo")))
    name = name.when(k == 3, F.concat(F.lit("owner/sp-"), text)).otherwise(F.concat(F.lit("x-sp-"), text, F.lit("-SP")))
    return t.supplier.select("s_suppkey", L.model_base(name).alias("base"), L.model_config(name).alias("config"))


@query("f09_simulation_names", "SELECT s_suppkey, (s_suppkey * 10)::INT AS length, (s_suppkey % 5)::INT AS series FROM supplier")
def _(t):
    length, series = L.simulation_size(F.format_string("Simulation-L%d-N%d", F.col("s_suppkey") * 10, F.col("s_suppkey") % 5))
    return t.supplier.select("s_suppkey", length.alias("length"), series.alias("series"))


@query("f14_sample_ids", "SELECT l_orderkey, l_linenumber, printf('T%02d_S%d', l_linenumber, l_orderkey) AS id FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", L.sample_id(F.col("l_linenumber"), F.col("l_orderkey")).alias("id"))


# Series.
def _series_query(name: str, column, sql: str) -> None:
    @query(name, f"SELECT vec_id, i.range AS i, (v)[i.range + 1] AS x FROM (SELECT vec_id, {sql} AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)), range(64) i WHERE i.range < len(v)")
    def _(t):
        out = t.embeddings.select("vec_id", F.posexplode(column(F.col("embedding").cast("array<double>"))).alias("i", "x"))
        return out.select("vec_id", F.col("i").cast("long").alias("i"), "x")


_GUARDS = {"add": "{sd} + {eps}", "clamp": "greatest({sd}, {eps})", "centre": "CASE WHEN {sd} > {eps} THEN {sd} ELSE 1.0 END"}
for _name, (_ddof, _guard, _eps) in S.VARIANTS.items():
    _sd = "list_stddev_samp(e)" if _ddof else "list_stddev_pop(e)"
    _series_query(f"f25_znorm_{_name.lower()}", lambda v, a=_ddof, b=_guard, c=_eps: S.znorm(v, a, b, c), f"list_transform(e, lambda x: (x - list_avg(e)) / ({_GUARDS[_guard].format(sd=_sd, eps=repr(_eps))}))")
_series_query("f28_every_fifth", lambda v: S.every_nth(v, 5), "list_transform(range(0, 13), lambda k: e[k * 5 + 1])")
_series_query("f27_zero_noise", lambda v: S.noise(v, "zero", 1), "list_transform(e, lambda x: 0.0::DOUBLE)")


@query("f27_shuffled", "SELECT vec_id, unnest(range(64)) AS i, unnest(list_transform(list_sort(list_transform(range(64), lambda i: {'k': md5('4|' || vec_id || '|' || i), 'x': embedding[i + 1]::DOUBLE})), lambda s: s.x)) AS x FROM embeddings")
def _(t):
    out = t.embeddings.select("vec_id", F.posexplode(S.noise(F.col("embedding").cast("array<double>"), "shuffle", 4, F.col("vec_id"))).alias("i", "x"))
    return out.select("vec_id", F.col("i").cast("long").alias("i"), "x")


@query(
    "f26_padded",
    """WITH v AS (SELECT vec_id, list_slice(embedding::DOUBLE[], 1, 1 + vec_id % 7) AS a, list_slice(embedding::DOUBLE[], 3, 3 + vec_id % 11) AS b FROM embeddings),
n AS (SELECT *, (greatest(len(a), len(b)) + 3) // 4 * 4 AS n FROM v)
SELECT vec_id, s.range AS series, i.range AS i, coalesce(CASE s.range WHEN 0 THEN a[i.range + 1] ELSE b[i.range + 1] END, 0.0) AS x FROM n, range(2) s, range(12) i WHERE i.range < n""",
)
def _(t):
    v = F.col("embedding").cast("array<double>")
    lengths = [(F.col("vec_id") % k + 1).cast("int") for k in (7, 11)]
    padded = S.padded_together(F.array(F.slice(v, F.lit(1), lengths[0]), F.slice(v, F.lit(3), lengths[1])), 4)
    out = t.embeddings.select("vec_id", F.posexplode(padded).alias("series", "v")).select("vec_id", F.col("series").cast("long").alias("series"), F.posexplode("v").alias("i", "x"))
    return out.withColumn("i", F.col("i").cast("long"))


@query("f35_norm", "SELECT vec_id, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm, tanh(embedding[1]::DOUBLE) AS gate FROM embeddings")
def _(t):
    v = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", S.norm(v).alias("norm"), F.tanh(v[0]).alias("gate"))


@query(
    "f39_json_arrays",
    """SELECT vec_id, i.range AS i, CASE i.range WHEN 0 THEN vec_id * 0.5 WHEN 1 THEN -1e-3 WHEN 2 THEN vec_id END::DOUBLE AS x
FROM embeddings, range(4) i WHERE vec_id % 5 < 4 AND (i.range < 3 OR vec_id % 5 = 1) AND vec_id % 5 <> 2""",
)
def _(t):
    """Lists of numbers with blanks and exponents, some with a null; one kind is empty, one is no list."""
    k, whole = F.col("vec_id") % 5, F.format_string("%d", "vec_id")
    text = F.concat(F.lit("[ "), (F.col("vec_id") * 0.5).cast("string"), F.lit(", -1e-3,"), whole, F.when(k == 1, ", null").otherwise(""), F.lit("]"))
    text = F.when(k == 2, "[]").when(k == 4, "1, 2").otherwise(text)
    out = t.embeddings.select("vec_id", F.posexplode(S.parsed(text)).alias("i", "x"))
    return out.select("vec_id", F.col("i").cast("long").alias("i"), "x")


@query("f41_json_lookup", "SELECT event_id, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing, coalesce(json_extract_string(props, '$.k'), 'none') AS k, CASE WHEN event_id % 3 = 0 THEN coalesce(json_extract_string(props, '$.k'), 'none') ELSE 'none' END AS sometimes FROM events")
def _(t):
    """A key that never occurs, one that does, and texts that are broken or null."""
    look = lambda c, key: F.coalesce(F.get_json_object(c, f"$.{key}"), F.lit("none"))
    broken = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, "{broken")
    return t.events.select("event_id", look("props", "missing").alias("missing"), look("props", "k").alias("k"), look(broken, "k").alias("sometimes"))


@query("f44_axis_limits", "SELECT vec_id, least(floor(list_min(embedding::DOUBLE[]) * 2) / 2, -2.5) AS low, greatest(ceil(list_max(embedding::DOUBLE[]) * 2) / 2, 2.5) AS high FROM embeddings")
def _(t):
    low, high = S.axis_limits(F.col("embedding").cast("array<double>"))
    return t.embeddings.select("vec_id", low.alias("low"), high.alias("high"))
