"""Queries of the catalogue whose tables pass through files: written by a sink, read back by a reader.

The driver tables hold no such files, so Spark derives them from the tables, in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..folders import new_folder
from ..functions import series as S
from ..operators import relational as R
from ..sinks import documents, writers
from ..sources import archives, readers
from .catalog import query


def _folder(t, name: str) -> str:
    return new_folder(t._spark, name)


def _csv(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> str:
    df.write.options(header=header, quote='"', escape='"', sep=sep).csv(path)
    return path


def _listed(*values: Column) -> Column:
    """A list literal."""
    return F.concat(F.lit("["), F.concat_ws(", ", *[v.cast("string") for v in values]), F.lit("]"))


def _points(df: DataFrame, key: str, series: str) -> DataFrame:
    """A row for each point of a series."""
    return df.select(key, F.posexplode(series).alias("i", "x")).withColumn("i", F.col("i").cast("long"))


# Sources.
@query("s01_series_csv", "SELECT p_partkey::VARCHAR AS label, i.range AS i, CASE i.range WHEN 0 THEN p_size ELSE p_partkey * 0.5 END::DOUBLE AS x FROM part, range(2) i")
def _(t):
    """Some rows repeat the head."""
    rows = t.part.select(_listed(F.col("p_size"), F.col("p_partkey") * 0.5).alias("x"), F.col("p_partkey").cast("string").alias("label"))
    heads = t.part.where("p_partkey % 50 = 0").select(F.lit("x").alias("x"), F.lit("label").alias("label"))
    return _points(readers.series_csv(t._spark, _csv(rows.unionByName(heads), _folder(t, "s01")), ["x"], ["label"]), "label", "x")


@query("s02_split_files", "SELECT ['train', 'validation', 'test'][p_partkey % 3 + 1] AS split, count(*) AS n, sum(p_size)::DOUBLE AS total FROM part GROUP BY split")
def _(t):
    at, paths = _folder(t, "s02"), {}
    for k, split in enumerate(readers.SPLITS):
        paths[split] = _csv(t.part.where(F.col("p_partkey") % 3 == k).select(_listed(F.col("p_size")).alias("x"), F.col("p_name").alias("label")), f"{at}/{split}")
    rows = readers.split_files(lambda p: readers.series_csv(t._spark, p, ["x"], ["label"]), paths)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x")[0]).alias("total"))


@query("s03_paired_csv", "SELECT p_partkey::VARCHAR AS id, p_name || ', \"' || p_brand || '\"' AS caption, p_size::DOUBLE AS first FROM part WHERE p_partkey % 4 > 0 AND p_partkey % 5 > 0")
def _(t):
    at = _folder(t, "s03")
    _csv(t.part.where("p_partkey % 4 > 0").select(F.col("p_partkey").alias("id"), _listed(F.col("p_size"), F.lit(1)).alias("series")), f"{at}/series")
    _csv(t.part.where("p_partkey % 5 > 0").select(F.col("p_partkey").alias("id"), F.format_string('%s, "%s"', "p_name", "p_brand").alias("caption")), f"{at}/captions")
    return readers.paired_csv(t._spark, f"{at}/series", f"{at}/captions").select("id", "caption", F.col("series")[0].alias("first"))


@query("s04_all_frequencies", "SELECT CASE n_regionkey % 5 WHEN 4 THEN 'broken' WHEN 3 THEN 'headless' ELSE 'r' || n_regionkey END AS frequency, CASE WHEN n_regionkey % 5 < 3 THEN n_nationkey::VARCHAR END AS id, n_regionkey % 5 < 3 AS good FROM nation WHERE n_regionkey % 5 < 3 OR n_nationkey IN (SELECT min(n_nationkey) FROM nation GROUP BY n_regionkey)")
def _(t):
    """Three files that can be read, one with a broken list, one without its head."""
    at = _folder(t, "s04")
    for k in range(5):
        series = F.when((F.lit(k) == 4) & (F.col("n_nationkey") % 2 == 0), "[1, oops]").otherwise(_listed(F.col("n_nationkey"), F.lit(1.5)))
        name = f"r{k}" if k < 3 else ("headless", "broken")[k - 3]
        rows = t.nation.where(F.col("n_regionkey") == k).select(F.col("n_nationkey").alias("id" if k != 3 else "key"), series.alias("series"))
        _csv(rows.unionByName(rows.limit(1).select(rows[0], F.lit("[0, bad").alias("series"))) if k == 4 else rows, f"{at}/{name}_series.csv")
    good, broken = readers.all_frequencies(t._spark, at)
    return good.select("frequency", "id", F.lit(True).alias("good")).unionByName(broken.select(F.replace("file", F.lit("_series.csv"), F.lit("")).alias("frequency"), F.lit(None).cast("string").alias("id"), F.lit(False).alias("good")))


@query("s05_strict_lists", "SELECT p_partkey::VARCHAR AS label, p_size::DOUBLE AS first, 3 AS points FROM part")
def _(t):
    rows = t.part.select(_listed(F.col("p_size"), F.lit("-1e-3"), F.lit("NaN")).alias("x"), F.col("p_partkey").cast("string").alias("label"))
    return readers.series_csv(t._spark, _csv(rows, _folder(t, "s05")), ["x"], ["label"], strict=True).select("label", F.col("x")[0].alias("first"), F.size("x").alias("points"))


@query("s06_nested_series", "SELECT p_partkey::VARCHAR AS label, i.range AS i, CASE i.range WHEN 0 THEN p_size ELSE i.range END::DOUBLE AS x FROM part, range(3) i WHERE p_partkey % 3 = 0")
def _(t):
    """Series of 3, 2 and 4 points; only those of 3 stay."""
    more = F.when(F.col("p_partkey") % 3 == 0, ", 1, 2").when(F.col("p_partkey") % 3 == 1, ", 1").otherwise(", 1, 2, 3")
    rows = t.part.select(F.concat(F.lit("[["), F.col("p_size").cast("string"), more, F.lit("]]")).alias("time_series"), F.col("p_partkey").cast("string").alias("label"), F.format_string('of "%s",\nas said', "p_name").alias("rationale"))
    return _points(readers.nested_series_csv(t._spark, _csv(rows, _folder(t, "s06")), 3), "label", "series")


@query("s07_reasoning_rows", "SELECT '[' || o_orderkey || ']' AS ecg_id, o_orderkey % 7 > 0 AND o_orderkey % 5 > 0 AS good FROM orders")
def _(t):
    """Rows without a question or a rationale are put aside."""
    k = F.col("o_orderkey")
    rows = t.orders.select(_listed(k).alias("ecg_id"), F.when(k % 7 > 0, "Which, if any?").alias("question"), F.col("o_orderstatus").alias("answer"), (k % 9).alias("template_id"), F.lit("single").alias("question_type"), F.lit(None).cast("string").alias("clinical_context"), F.when(k % 5 > 0, F.col("o_orderpriority")).otherwise("  ").alias("rationale"))
    good, bad = readers.reasoning_csv(t._spark, _csv(rows, _folder(t, "s07")))
    return good.select("ecg_id", F.lit(True).alias("good")).unionByName(bad.select("ecg_id", F.lit(False).alias("good")))


@query("s08_question_files", "SELECT c_custkey AS id, c_nationkey::BIGINT AS template_id, c_mktsegment AS answer FROM customer WHERE c_custkey % 6 > 0")
def _(t):
    """A file for each nation, each one array; questions without a record go."""
    ids = F.when(F.col("c_custkey") % 6 > 0, F.array("c_custkey")).otherwise(F.array().cast("array<long>"))
    row = F.struct(ids.alias("ecg_id"), F.lit("q\n?").alias("question"), F.array("c_mktsegment").alias("answer"), F.lit("t").alias("question_type"), F.col("c_nationkey").cast("long").alias("template_id"))
    at = _folder(t, "s08")
    t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.to_json(F.collect_list(row)).alias("value")).write.partitionBy("nation").text(at)
    return readers.question_json(t._spark, at).select(F.col("ecg_id")[0].alias("id"), "template_id", F.col("answer")[0].alias("answer"))


@query("s09_metadata_columns", "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier")
def _(t):
    return readers.metadata_csv(t._spark, _csv(t.supplier, _folder(t, "s09")), ["s_suppkey", "age", "s_name"])


@query("s10_mapping", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name || ', ' || n_regionkey AS n_name FROM nation")
def _(t):
    rows = t.nation.select("n_nationkey", F.format_string("%s, %s", "n_name", F.col("n_regionkey").cast("string")).alias("n_name"))
    return readers.csv(t._spark, _csv(rows, _folder(t, "s10")), "n_nationkey long, n_name string")


@query("s11_template_answers", "SELECT n_nationkey::INT AS template_id, CASE WHEN n_nationkey % 5 = 4 THEN '' ELSE lower(n_name) || '|no' END AS classes FROM nation")
def _(t):
    """Lists with single quotes and blanks; a malformed one is empty."""
    rows = t.nation.select(F.col("n_nationkey").alias("template_id"), F.when(F.col("n_nationkey") % 5 == 4, "oops").otherwise(F.format_string("[' %s', 'NO ']", "n_name")).alias("classes"))
    return readers.template_answers(t._spark, _csv(rows, _folder(t, "s11"))).select("template_id", F.array_join("classes", "|").alias("classes"))


@query("s13_sensor_log", "SELECT (100 + n_regionkey % 3)::BIGINT AS entity, n_nationkey::DOUBLE AS t, CASE WHEN n_nationkey % 4 > 0 THEN (n_nationkey * -0.5)::DOUBLE END AS a FROM nation")
def _(t):
    at = _folder(t, "s13")
    line = F.format_string("%d   %s ", "n_nationkey", F.when(F.col("n_nationkey") % 4 > 0, (F.col("n_nationkey") * -0.5).cast("string")).otherwise("NaN"))
    t.nation.select(F.concat(F.lit("subject"), (F.col("n_regionkey") % 3 + 100).cast("string")).alias("file"), line.alias("value")).write.partitionBy("file").text(at)
    return readers.sensor_log(t._spark, at, ["t", "a"]).select(F.col("entity").cast("long").alias("entity"), "t", "a")


@query("s14_labelled_tsv", "SELECT vec_id, i.range AS i, round(embedding[i.range + 1]::DOUBLE, 6) AS x FROM embeddings, range(8) i")
def _(t):
    rows = t.embeddings.select("vec_id", *[F.round(F.col("embedding")[k].cast("double"), 6).alias(f"t{k + 1}") for k in range(8)])
    out = readers.labelled_tsv(t._spark, _csv(rows, _folder(t, "s14"), False, "\t"), 8)
    return _points(out.select(F.col("label").cast("long").alias("vec_id"), "series"), "vec_id", "series")


def _archive(t, name: str, points: int) -> str:
    """A file for each class: its head, then its cases; a third of the first values is missing."""
    first = F.when(F.col("vec_id") % 3 == 0, "?").otherwise((F.col("vec_id") * 0.5).cast("string"))
    second = F.transform(F.sequence(F.lit(1), F.lit(points - 1)), lambda k: (k - F.col("vec_id")).cast("string"))
    case = F.concat(first, F.lit(","), F.array_join(second, ","), F.lit(":"), F.array_join(F.reverse(F.sequence(F.lit(1), F.lit(points))), ","), F.lit(":C"), F.col("label").cast("string"))
    head = "@problemName made\n@timeStamps false\n@univariate false\n@equalLength true\n@classLabel true c0 c1 c2 c3 c4 c5 c6 c7 c8 c9\n@data"
    rows = t.embeddings.select(F.col("label").alias("kind"), F.col("vec_id").alias("place"), case.alias("value"))
    heads = t.embeddings.select(F.col("label").alias("kind")).distinct().select("kind", F.lit(-1).cast("long").alias("place"), F.lit(head).alias("value"))
    rows.unionByName(heads).repartition("kind").sortWithinPartitions("kind", "place").select("kind", "value").write.partitionBy("kind").text(at := _folder(t, name))
    return at


_ARCHIVE = "SELECT vec_id, d.range AS dimension, i.range AS i, 'c' || label AS label, CASE WHEN d.range = 1 THEN 4 - i.range WHEN i.range > 0 THEN i.range - vec_id WHEN vec_id % 3 = 0 THEN -9 ELSE vec_id * 0.5 END::DOUBLE AS x FROM embeddings, range(2) d, range(4) i"


def _cases(rows: DataFrame) -> DataFrame:
    vec_id = (1 - F.col("dimensions")[0][1]).cast("long").alias("vec_id")
    out = rows.select(vec_id, "label", F.posexplode("dimensions").alias("dimension", "s")).select("vec_id", "label", F.col("dimension").cast("long").alias("dimension"), F.posexplode("s").alias("i", "x"))
    return out.withColumn("i", F.col("i").cast("long"))


@query("s15_ts_archive", _ARCHIVE)
def _(t):
    return _cases(archives.ts_archive(t._spark, _archive(t, "s15", 4), missing="-9", suffix=".txt", rangeBytes=2000))


@query("s16_dense_archive", _ARCHIVE)
def _(t):
    return _cases(archives.ts_dense(t._spark, _archive(t, "s16", 4), missing="-9", suffix=".txt"))


@query(
    "s19_prediction_lines",
    """WITH l AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line FROM customer)
SELECT c_nationkey::BIGINT AS nation, line, CASE WHEN c_custkey % 11 > 0 AND c_custkey % 7 > 0 THEN 'n ' || c_custkey END AS generated, CASE WHEN c_custkey % 11 = 0 THEN 'broken JSON' WHEN c_custkey % 7 = 0 THEN 'no JSON object' END AS reason FROM l""",
)
def _(t):
    """A file for each nation; malformed lines have their numbers and reasons."""
    good = F.to_json(F.struct(F.format_string("n %d", "c_custkey").alias("generated"), F.col("c_mktsegment").alias("gold")))
    line = F.when(F.col("c_custkey") % 11 == 0, '{"generated": "cut').when(F.col("c_custkey") % 7 == 0, "not JSON").otherwise(good)
    at = _folder(t, "s19")
    t.customer.select("c_nationkey", "c_custkey", line.alias("value")).repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select(F.col("c_nationkey").alias("nation"), "value").write.partitionBy("nation").text(at)
    nation = F.regexp_extract("file", r"nation=(\d+)", 1).cast("long").alias("nation")
    found, bad = readers.predictions(t._spark, at)
    return found.select(nation, "line", "generated", F.lit(None).cast("string").alias("reason")).unionByName(bad.select(nation, "line", F.lit(None).cast("string").alias("generated"), "reason"))


@query("s21_scraped_pairs", "SELECT 'g' || o_orderkey AS generated, o_orderpriority AS gold FROM orders")
def _(t):
    """A whole text for each day; a value that has no partner at its end is left out."""
    pair = F.format_string('{\\rtf "generated": "g%d", junk "gold" : "%s"}', "o_orderkey", "o_orderpriority")
    at = _folder(t, "s21")
    t.orders.groupBy((F.col("o_orderkey") % 20).alias("k")).agg(F.array_join(F.collect_list(pair), "\n").alias("v")).select("k", F.concat("v", F.lit(' "generated": "alone"')).alias("value")).write.partitionBy("k").text(at)
    return readers.scraped_pairs(t._spark, at)


@query("s22_text_reports", "SELECT n_name AS question, n_regionkey || chr(10) || 'more' AS answer, '' AS missing FROM nation")
def _(t):
    at = _folder(t, "s22")
    t.nation.select("n_nationkey", F.format_string("Question: %s\n\nAnswer: %d\nmore\n\nEnd", "n_name", "n_regionkey").alias("value")).write.partitionBy("n_nationkey").text(at)
    return readers.text_reports(t._spark, at, {"question": "Question", "answer": "Answer", "missing": "Context"}).drop("file_path")


@query("s25_memory_runs", "SELECT 'm' || p_partkey AS model, p_size::DOUBLE AS nvml_peak_gb, CASE WHEN p_size > 40 THEN 'OOM, at once' END AS error FROM part")
def _(t):
    names = [c.split()[0] for c in readers.MEMORY_RUN.split(", ")]
    known = {"model": F.format_string("m%d", "p_partkey"), "nvml_peak_gb": F.col("p_size"), "error": F.when(F.col("p_size") > 40, "OOM, at once")}
    rows = t.part.select(*[known.get(n, F.lit(None)).cast("string").alias(n) for n in names])
    return readers.memory_runs(t._spark, _csv(rows, _folder(t, "s25"))).select("model", "nvml_peak_gb", "error")


# Sinks.
@query("k01_json_lines", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, t.range AS time FROM nation, range(2) t")
def _(t):
    """Appended twice."""
    at = _folder(t, "k01")
    for k in range(2):
        writers.append_json(t.nation.select("n_nationkey", "n_name", F.lit(k).cast("long").alias("time")), at)
    return t._spark.read.schema("n_nationkey long, n_name string, time long").json(at)


@query("k02_ranked_parts", "SELECT o_orderkey % 3 AS part, (row_number() OVER (ORDER BY o_orderkey % 3, o_orderkey) - 1) AS place, o_orderkey FROM orders")
def _(t):
    """What three workers wrote, joined in their order: places in the document are those of the sorted rows."""
    at = f"{_folder(t, 'k02')}/d.json"
    parts = [t.orders.where(F.col("o_orderkey") % 3 == k).select("o_orderkey").orderBy("o_orderkey") for k in range(3)]
    documents.write_document(R.ordered_union(*parts), at, field="rows")
    return readers.document_rows(t._spark, at, "part long, o_orderkey long").select("r.part", "place", "r.o_orderkey")


@query("k03_one_document", "SELECT 'm' AS model_name, s_suppkey::INT AS sample_idx, s_name AS target_answer, (SELECT count(*) FROM supplier) AS n FROM supplier")
def _(t):
    """S20 reads the results back, beside the fields of the summary."""
    at = f"{_folder(t, 'k03')}/results.json"
    summary = t.supplier.agg(F.lit("m").alias("model_name"), F.lit("d").alias("dataset_name"), F.count(F.lit(1)).alias("n"))
    documents.write_document(t.supplier.select(F.col("s_suppkey").cast("int").alias("sample_idx"), F.col("s_name").alias("target_answer")).orderBy("sample_idx"), at, summary)
    head = t._spark.read.schema("n long").option("multiLine", True).json(at)  # one row
    return readers.detailed_results(t._spark, at).select("model_name", "sample_idx", "target_answer").crossJoin(head)


@query("k04_append_new", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END::BIGINT AS time FROM customer")
def _(t):
    """A third is written first; the second time only what isn't there yet."""
    at = _folder(t, "k04")
    writers.append_new(t.customer.where("c_custkey % 3 = 0").select("c_custkey", F.lit(0).cast("long").alias("time")), at, ["c_custkey"])
    writers.append_new(t.customer.select("c_custkey", F.lit(1).cast("long").alias("time")), at, ["c_custkey"])
    return t._spark.read.parquet(at)


_ROWS = "SELECT p_partkey, p_name || ', \"' || p_brand || '\"' AS text, '[' || p_size || ',' || p_size + 1 || ']' AS numbers FROM part"


def _appended(t, name: str, sep: str) -> DataFrame:
    """Text with separators and quotes, arrays as JSON text."""
    at = _folder(t, name)
    writers.append_csv(t.part.select("p_partkey", F.format_string('%s, "%s"', "p_name", "p_brand").alias("text"), F.array("p_size", F.col("p_size") + 1).alias("numbers")), at, sep)
    return readers.csv(t._spark, at, "p_partkey long, text string, numbers string", sep)


@query("k05_csv_rows", _ROWS)
def _(t):
    return _appended(t, "k05", ",")


@query("k11_tab_rows", _ROWS)
def _(t):
    return _appended(t, "k11", "\t")


@query("k06_summary_and_parts", "SELECT (SELECT count(*) FROM nation) AS n, n_name FROM nation")
def _(t):
    at = _folder(t, "k06")
    writers.consolidated(t.nation.agg(F.count(F.lit(1)).alias("n")), t.nation.select("n_name"), at)
    summary = t._spark.read.schema("n long").json(f"{at}/summary")  # one row
    return t._spark.read.schema("n_name string").json(f"{at}/results").crossJoin(summary)


@query("k08_lead_files", "SELECT vec_id, ['I', 'II'][k.range + 1] AS lead, i.range / 100.0 AS time_seconds, round(embedding[k.range * 32 + i.range + 1]::DOUBLE, 6) AS signal FROM embeddings, range(2) k, range(32) i")
def _(t):
    """time and signal of each lead, a folder for each."""
    at, v = _folder(t, "k08"), F.transform("embedding", lambda x: F.round(x.cast("double"), 6))
    writers.leads_csv(t.embeddings.select("vec_id", F.array(F.slice(v, 1, 32), F.slice(v, 33, 32)).alias("leads")), "vec_id", "leads", S.LEADS[:2], at)
    rows = t._spark.read.schema("vec_id long, time_seconds double, signal_mV double, lead string").options(header=True).csv(at)
    return rows.select("vec_id", "lead", "time_seconds", F.col("signal_mV").alias("signal"))


@query("k09_report_lines", "SELECT 'Part ' || p_partkey || ': ' || p_name AS value FROM part")
def _(t):
    at = _folder(t, "k09")
    writers.reports(t.part, F.format_string("Part %d: %s", "p_partkey", "p_name"), at)
    return t._spark.read.text(at)
