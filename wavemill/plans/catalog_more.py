"""More of the catalogue: remaining projections, anti-joins, aggregations, splits, and functions on texts and series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import series as S
from ..operators import relational as R
from ..operators import scoring as C
from . import prompts
from .catalog import TEXTS, _texts, query

_E = "embedding::DOUBLE[]"


def _series(t):
    return t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


# Projections and filters.
@query("p04_from_file_name", "SELECT n_nationkey, 'nation' AS part FROM nation")
def _(t):
    return t.nation.select("n_nationkey", F.regexp_extract("_metadata.file_name", r"^(\w+)\.", 1).alias("part"))


@query("p19_extra_columns", "SELECT vec_id, label, 'Predict the class' AS pre_prompt, 'class ' || label || '<eos>' AS answer FROM embeddings")
def _(t):
    spec = prompts.DatasetSpec(F.lit("Predict the class"), F.lit("Answer:"), F.concat(F.lit("class "), F.col("label").cast("string")), [F.lit("series")], [F.col("v")], keep=("vec_id", "label"))
    good, _bad = prompts.prompt_records(_series(t), spec, "<eos>")
    return good.select("vec_id", "label", "pre_prompt", "answer")


@query("p20_bad_rows_skipped", "SELECT o_orderkey, o_orderkey::DOUBLE AS first FROM orders WHERE o_orderkey % 3 <> 0")
def _(t):
    key = F.col("o_orderkey").cast("string")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("[oops"), key)).otherwise(F.concat(F.lit("["), key, F.lit(", 2]")))
    return t.orders.select("o_orderkey", S.parsed(text)[0].alias("first")).where("first is not null")


@query("j06_both_exist", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_semi")


@query("j09_resumed_by_index", "SELECT event_id FROM events WHERE event_id % 4 <> 1")
def _(t):
    return R.not_done(t.events.select("event_id"), t.events.where("event_id % 4 = 1"), ["event_id"])


@query("j10_stages_left", "SELECT l_returnflag, l_linestatus FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem) WHERE NOT (l_returnflag = 'R' AND l_linestatus = 'F')")
def _(t):
    return R.not_done(t.lineitem.select("l_returnflag", "l_linestatus").distinct(), t.lineitem.where("l_returnflag = 'R' AND l_linestatus = 'F'"), ["l_returnflag", "l_linestatus"])


# Aggregations.
@query("a04_answer_shares", "SELECT label, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM orders) AS percent FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'unknown' ELSE 'class ' || (o_orderkey % 3) END AS label FROM orders) GROUP BY label")
def _(t):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.lit("Answer:  ")).otherwise(F.concat(F.lit("Answer: class "), (F.col("o_orderkey") % 3).cast("string"), F.lit(".")))
    label = F.coalesce(F.nullif(L.strip(L.answer_clean(text)), F.lit("")), F.lit("unknown"))
    return C.share_table(t.orders.select(label.alias("label")), "label")


@query("a11_support_only_macro", "SELECT avg(f1)::DOUBLE AS macro_f1, count(*) AS classes FROM (SELECT 2.0 * sum((p = g)::INT) / (count(*) + (SELECT count(*) FROM lineitem x WHERE (CASE WHEN x.l_linenumber = 3 THEN 'X' ELSE x.l_returnflag END) = g)) AS f1 FROM (SELECT l_returnflag AS g, CASE WHEN l_linenumber = 3 THEN 'X' ELSE l_returnflag END AS p FROM lineitem) GROUP BY g)")
def _(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("gold"), F.when(F.col("l_linenumber") == 3, "X").otherwise(F.col("l_returnflag")).alias("pred"))
    return C.macro_f1(C.with_f1(C.supported_counts(rows, "pred", "gold")))


@query("a29_bars", "SELECT l_returnflag, l_linestatus, avg(l_quantity) AS mean, count(l_quantity) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def _(t):
    return C.grouped_means(t.lineitem, [["l_returnflag", "l_linestatus"]], "l_quantity")


@query("a31_listed_by_key", "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY l_orderkey")
def _(t):
    lists = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"))
    return lists.select("l_orderkey", F.array_join(F.transform("s", lambda s: s["l_partkey"].cast("string")), ",").alias("parts"))


@query("a33_prompt_shares", "SELECT o_orderpriority, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM orders) AS percent FROM orders GROUP BY o_orderpriority")
def _(t):
    return C.share_table(t.orders, "o_orderpriority")


@query("a35_progress", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1)::DOUBLE AS rate FROM orders")
def _(t):
    return C.review_overview(t.orders.select(F.when(F.col("o_orderstatus") == "F", "complete").otherwise("empty").alias("status")), "status")


# Order, splits, sets.
@query("w10_reviewer_offsets", "SELECT c_custkey, r.range::INT AS round, ((q + r.range) % 6)::INT AS reviewer FROM (SELECT c_custkey, row_number() OVER (ORDER BY md5('7|' || c_custkey), c_custkey) - 1 AS q FROM customer), range(3) r")
def _(t):
    return R.round_robin(t.customer, "c_custkey", 6, 3, 7)


@query("o01_sorted", "SELECT l_returnflag, l_orderkey, l_linenumber FROM lineitem ORDER BY l_returnflag, l_orderkey DESC, l_linenumber")
def _(t):
    return t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber").orderBy("l_returnflag", F.desc("l_orderkey"), "l_linenumber")


@query("o06_sorted_report", "SELECT label, count(*) AS n FROM embeddings GROUP BY label ORDER BY label")
def _(t):
    return t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label")


@query("r03_train_validation", "SELECT p_partkey, CASE WHEN row_number() OVER (ORDER BY left(md5('3|' || p_partkey), 2), md5('3|' || p_partkey), p_partkey) <= ceil(count(*) OVER () * 0.1) THEN 'validation' ELSE 'train' END AS split FROM part")
def _(t):
    return R.random_split(t.part.select("p_partkey"), "p_partkey", 3, test=0.0)


@query("u04_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(t):
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id"))


# Texts.
@query("f10_task_names", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'unknown' END AS task FROM part")
def _(t):
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Series. Predict the "), F.col("p_brand"), F.lit(" Answer: (a)"))).otherwise("No task")
    return t.part.select("p_partkey", L.task_name(text).alias("task"))


@query(
    "f11_without_statistics",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Look. This is the time series: Then ' || p_name WHEN 1 THEN 'This is the time series, it has mean 1.5 and std 2.' ELSE p_name || ', it has mean 0.5000 and std 1.0000:' END AS text,
  CASE WHEN p_partkey % 2 = 0 THEN 'Pre ' || chr(10) || 'Post' ELSE 'The following is the data on the x-axis' || chr(10) || p_size || ', 3' END AS axes FROM part""",
)
def _(t):
    """A stated sentence inside a text, one of other decimals, and one of another series; two axes and another sentence."""
    k, stated = F.col("p_partkey") % 3, F.format_string("Look. This is the time series, it has mean %.4f and std %.4f. Then %s", F.col("p_size") * -0.5, F.col("p_size") * 1.0, "p_name")
    text = F.when(k == 0, stated).when(k == 1, "This is the time series, it has mean 1.5 and std 2.").otherwise(F.concat(F.col("p_name"), F.lit(", it has mean 0.5000 and std 1.0000:")))
    axis = lambda a: F.format_string("The following is the accelerometer data on the " + a + "-axis\n%d, -3, 14", "p_size")
    axes = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Pre "), axis("x"), F.lit("\n"), axis("z"), F.lit("Post"))).otherwise(F.format_string("The following is the data on the x-axis\n%d, 3", "p_size"))
    return t.part.select("p_partkey", L.without_statistics(text).alias("text"), L.without_axis_data(axes).alias("axes"))


@query("f12_prompt_numbers", "SELECT p_partkey, i.range AS i, CASE i.range WHEN 0 THEN p_size WHEN 1 THEN -4 WHEN 2 THEN p_partkey % 100 ELSE 5 END::INT AS x FROM part, range(4) i WHERE p_partkey % 4 > 0 AND (i.range < 3 OR p_partkey % 2 = 0)")
def _(t):
    """Lists of two lengths with odd blanks, before another list; a quarter of the texts has none."""
    more = F.when(F.col("p_partkey") % 2 == 0, " , 5").otherwise("")
    text = F.concat(F.lit("series ["), F.col("p_size").cast("string"), F.lit(",-4,  "), (F.col("p_partkey") % 100).cast("string"), more, F.lit("] end [7, 8]"))
    numbers = L.prompt_numbers(F.when(F.col("p_partkey") % 4 > 0, text).otherwise("no list"))
    return t.part.select("p_partkey", F.posexplode(numbers).alias("i", "x")).withColumn("i", F.col("i").cast("long"))


@query("f13_between", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name ELSE 'none' END AS found FROM part")
def _(t):
    end = F.when(F.col("p_partkey") % 3 == 0, "\n\nmore\nlines").otherwise("\nmore")
    text = F.concat(F.when(F.col("p_partkey") % 3 < 2, "Head\nQuestion: ").otherwise("Head "), F.col("p_name"), end)
    return t.part.select("p_partkey", L.between(text, "Question:", "none").alias("found"))


@query("f15_pair_keys", "SELECT l_orderkey, l_linenumber, least(l_returnflag, l_linestatus) || ' ↔ ' || greatest(l_returnflag, l_linestatus) AS pair FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", L.pair_key(F.col("l_returnflag"), F.col("l_linestatus")).alias("pair"))


@query(
    "f16_context",
    """WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_size + 0.7 END AS age, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 3 END AS sex, p_partkey % 5 > 1 AS dated, CASE p_partkey % 6 WHEN 0 THEN '  ' WHEN 1 THEN 'nan' WHEN 2 THEN NULL ELSE ' ' || p_brand || ' ' END AS device,
  p_partkey % 2 = 0 AS drift, p_partkey % 7 = 0 AS burst, p_partkey % 11 = 0 AS beats, p_partkey % 13 = 0 AS pace FROM part),
l AS (SELECT p_partkey, list_filter([CASE WHEN age IS NOT NULL THEN floor(age)::INT || '-year-old' END, CASE sex WHEN 1 THEN 'male patient' WHEN 2 THEN 'female patient' END, '12-lead ECG', CASE WHEN dated THEN 'clinical recording' END,
  CASE WHEN trim(device) NOT IN ('', 'nan') THEN 'recorded with ' || trim(device) END,
  'Signal quality: ' || coalesce(nullif(concat_ws(', ', CASE WHEN drift THEN 'baseline drift noted' END, CASE WHEN burst THEN 'burst noise present' END), ''), 'adequate for analysis'),
  CASE WHEN beats THEN 'extra beats detected during recording' END, CASE WHEN pace THEN 'pacemaker present' END], lambda x: x IS NOT NULL) AS p FROM r)
SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN '12-lead ECG recording. Signal quality adequate for analysis.' ELSE p[1] || ' ' || p[2] || '. ' || array_to_string(p[3:], '. ') || '.' END AS context FROM l""",
)
def _(t):
    """Every part is missing in some rows; some records aren't found."""
    k = lambda n: F.col("p_partkey") % n
    record = {
        "age": F.when(k(4) > 0, F.col("p_size") + 0.7), "sex": F.when(k(3) > 0, k(3)), "recording_date": F.when(k(5) > 1, "2024-01-01"),
        "device": F.when(k(6) == 0, "  ").when(k(6) == 1, "nan").when(k(6) > 2, F.concat(F.lit(" "), F.col("p_brand"), F.lit(" "))),
        "baseline_drift": F.when(k(2) == 0, "all leads").otherwise(" "), "static_noise": F.lit(""), "burst_noise": F.when(k(7) == 0, "V1"), "extra_beats": F.when(k(11) == 0, "2 ES"), "pacemaker": F.when(k(13) == 0, "yes"),
    }
    return t.part.select("p_partkey", L.context_sentence(record, k(17) != 0).alias("context"))


@query("f17_answer_of_list", "SELECT p_partkey, string_split(p_type, ' ')[1] AS answer FROM part")
def _(t):
    words = F.split("p_type", " ")
    return t.part.select("p_partkey", F.coalesce(F.try_element_at(words, F.lit(1)), F.col("p_type")).alias("answer"))


@query("f21_string_prompt", "SELECT p_partkey, 'Pre' || chr(10) || p_name || chr(10) || p_size || chr(10) || 'Post' AS prompt FROM part")
def _(t):
    rows = t.part.select("p_partkey", F.lit("Pre").alias("pre_prompt"), F.array("p_name").alias("time_series_text"), F.lit("Post").alias("post_prompt"), F.array(F.col("p_size").cast("string")).alias("formatted"))
    return rows.select("p_partkey", prompts.string_prompt(F.col("formatted")).alias("prompt"))


@query("f22_media_prompt", "SELECT p_partkey, 'Pre <image>' || p_name || '<|endofchunk|><image>' || p_brand || '<|endofchunk|> Post yes' AS prompt FROM part")
def _(t):
    rows = t.part.select("p_partkey", F.lit("Pre").alias("pre_prompt"), F.array("p_name", "p_brand").alias("time_series_text"), F.lit("Post").alias("post_prompt"), F.lit("yes").alias("answer"))
    return rows.select("p_partkey", prompts.media_prompt().alias("prompt"))


@query("f24_same_start", f"SELECT o_orderkey, left(trim(text), 3) = 'Ans' AS same FROM {TEXTS}")
def _(t):
    return _texts(t).select("o_orderkey", (F.left(L.strip(F.col("text")), F.lit(3)) == "Ans").alias("same"))


# Series.
@query("f29_lead_names", "SELECT n_nationkey, ['I', 'II', 'III', 'aVR', 'aVL', 'aVF', 'V1', 'V2', 'V3', 'V4', 'V5', 'V6'][n_nationkey + 1] AS lead FROM nation")
def _(t):
    return t.nation.select("n_nationkey", S.lead_name(F.col("n_nationkey").cast("int")).alias("lead"))


@query("f30_transposed", f"SELECT vec_id, lead.range AS lead, i.range AS i, ({_E})[i.range * 4 + lead.range + 1] AS x FROM embeddings, range(4) lead, range(16) i")
def _(t):
    """Sixteen samples of four leads."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("v", i * 4 + 1, F.lit(4)))
    out = _series(t).select("vec_id", F.posexplode(S.transposed(rows, 4)).alias("lead", "s")).select("vec_id", F.col("lead").cast("long").alias("lead"), F.posexplode("s").alias("i", "x"))
    return out.withColumn("i", F.col("i").cast("long"))


@query("f31_labelled_axes", f"SELECT vec_id, a.range AS axis, ['x', 'y'][a.range + 1] AS text, i.range AS i, ({_E})[a.range * 32 + i.range + 1] AS x FROM embeddings, range(2) a, range(32) i")
def _(t):
    axes = S.labelled(["x", "y"], [F.slice("v", 1, 32), F.slice("v", 33, 32)])
    out = _series(t).select("vec_id", F.posexplode(axes).alias("axis", "s")).select("vec_id", F.col("axis").cast("long").alias("axis"), "s.text", F.posexplode("s.values").alias("i", "x"))
    return out.withColumn("i", F.col("i").cast("long"))


_POWERS = "[1e6, 1e5, 1e4, 1e3, 1e2, 1e1, 1e0, 0.1, 0.01, 0.001]::DOUBLE[]"
_PRICES = "[l_extendedprice, -l_discount, 0.29, -1.5, l_tax - 0.04, NULL, 'nan'::DOUBLE, 0.0, 1e7]"


def _prices() -> Column:
    return F.array(F.col("l_extendedprice"), -F.col("l_discount"), F.lit(0.29), F.lit(-1.5), F.col("l_tax") - 0.04, F.lit(None).cast("double"), F.lit(float("nan")), F.lit(0.0), F.lit(1e7))


def _digits_sql(minus: str, separator: str) -> str:
    """A number's digits by a fold over the powers, what is left after each digit carried on."""
    cut = "{'rest': s.rest - trunc(s.rest / e.power) * e.power, 'out': list_append(s.out, trunc(s.rest / e.power)::INT::VARCHAR), 'power': 0.0::DOUBLE}"
    start = "{'rest': abs(x), 'out': []::VARCHAR[], 'power': 0.0::DOUBLE}"
    steps = f"list_transform({_POWERS}, lambda p: {{'rest': 0.0::DOUBLE, 'out': []::VARCHAR[], 'power': p}})"
    out = f"list_reduce(list_prepend({start}, {steps}), lambda s, e: {cut}).out"
    joined = f"coalesce(nullif(regexp_replace(array_to_string({out}, ' '), '^(0 )*0?( ?)', ''), ''), '0')"
    one = f"CASE WHEN x IS NULL OR isnan(x) THEN ' Nan' ELSE CASE WHEN x < 0 THEN '{minus}' ELSE '' END || {joined} END || '{separator}'"
    return f"array_to_string(list_transform({_PRICES}, lambda x: {one}), '')"


@query("f32_digits", f"SELECT l_orderkey, l_linenumber, {_digits_sql(' -', ' ,')} AS spaced, {_digits_sql('-', ', ')} AS compact FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", S.digits(_prices()).alias("spaced"), S.digits(_prices(), S.COMPACT).alias("compact"))


def _undigits_sql(column: str, minus: str, separator: str) -> str:
    """Numbers from the text itself: digits of each token added up from the last one on, over their powers of ten."""
    digits = f"list_reverse(list_filter(string_split(CASE WHEN starts_with(t, '{minus}') THEN substr(t, {len(minus) + 1}) ELSE t END, ' '), lambda d: regexp_full_match(d, '[0-9]+')))"
    total = f"list_sum(list_prepend(0.0::DOUBLE, list_transform({digits}, lambda d, i: d::DOUBLE / pow(10.0, 3 - (i - 1)))))"
    return f"list_transform(list_filter(string_split({column}, '{separator}'), lambda t: t <> ''), lambda t: printf('%.4f', (CASE WHEN starts_with(t, '{minus}') THEN -1 ELSE 1 END) * ({total} + 0.0005)))"


@query(
    "f33_undigits",
    f"SELECT l_orderkey, l_linenumber, {_undigits_sql('spaced', ' -', ' ,')}::VARCHAR AS spaced, {_undigits_sql('compact', '-', ', ')}::VARCHAR AS compact FROM (SELECT l_orderkey, l_linenumber, {_digits_sql(' -', ' ,')} AS spaced, {_digits_sql('-', ', ')} AS compact FROM lineitem)",
)
def _(t):
    """Back from the texts of f32, to the half step."""
    shown = lambda form: S.decimals(S.undigits(S.digits(_prices(), form), form), 4)
    return t.lineitem.select("l_orderkey", "l_linenumber", shown(S.SPACED).alias("spaced"), shown(S.COMPACT).alias("compact"))


@query("f34_guards", "SELECT p_partkey, greatest((p_size % 3) * 1.0, 0.000001)::DOUBLE AS clamped, ceil(p_size / 4.0)::BIGINT AS whole, (p_size // 4)::BIGINT AS part FROM part")
def _(t):
    return t.part.select("p_partkey", S.guarded((F.col("p_size") % 3).cast("double"), "clamp", 1e-6).alias("clamped"), F.ceil(F.col("p_size") / 4).cast("long").alias("whole"), F.floor(F.col("p_size") / 4).cast("long").alias("part"))


@query("f36_epoch_seconds", "SELECT o_orderkey, year(make_timestamp(o_orderkey * 100000 * 1000000))::INT AS year FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.year(F.timestamp_seconds(F.col("o_orderkey") * 100000)).alias("year"))


@query("f37_time_axis", f"SELECT vec_id, i.range / 100.0::DOUBLE AS second, (({_E})[i.range + 1])::DOUBLE AS x FROM embeddings, range(64) i")
def _(t):
    out = _series(t).select("vec_id", F.posexplode("v").alias("i", "x"))
    return out.select("vec_id", (F.col("i") / F.lit(100.0)).alias("second"), "x")


@query("f40_json_text", "SELECT vec_id, '[' || vec_id || ',' || label || ']' AS text FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", S.as_json(F.array(F.col("vec_id").cast("long"), F.col("label").cast("long"))).alias("text"))


@query("f42_counts_map", "SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY o_orderstatus")
def _(t):
    counts = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("o_orderstatus").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("m"))
    return maps.select("o_orderstatus", F.coalesce(F.try_element_at("m", F.lit("1-URGENT")), F.lit(0)).alias("urgent"), F.size("m").cast("long").alias("kinds"))


@query("f43_valid_series", "SELECT vec_id, vec_id % 4 = 0 AS ok FROM embeddings")
def _(t):
    k, v = F.col("vec_id") % 4, F.col("v")
    broken = F.when(k == 1, F.slice(v, 1, 0)).when(k == 2, F.concat(v, F.array(F.lit(None).cast("double")))).when(k == 3, F.concat(v, F.array(F.lit(float("nan"))))).otherwise(v)
    return _series(t).select("vec_id", F.coalesce(S.finite(broken), F.lit(False)).alias("ok"))


@query("f45_schedule", "SELECT p_partkey, (p_size * 20)::BIGINT AS steps, floor(p_size * 20 * 0.03)::BIGINT AS warm_up FROM part")
def _(t):
    steps, warm_up = S.schedule(20, F.col("p_size"))
    return t.part.select("p_partkey", steps.cast("long").alias("steps"), warm_up.alias("warm_up"))
