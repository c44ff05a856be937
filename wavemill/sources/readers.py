"""Readers of raw files (survey 2.1) that Spark's own sources serve. Archives and signal records have sources of their own."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import strip
from ..operators.relational import allowed, not_header, validated

SPLITS = ("train", "validation", "test")


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """A CSV file with an explicit schema; quotes are doubled inside quotes, and a field may hold line ends."""
    return spark.read.schema(schema).options(header=header, sep=sep, quote='"', escape='"', multiLine=True).csv(path)


def series_csv(spark: SparkSession, path: str, axes: list[str], others: list[str], strict: bool = False) -> DataFrame:
    """List-literal columns become arrays, repeated header rows go. A malformed list is null, or with `strict` an error that shows it."""
    raw = csv(spark, path, ", ".join(f"{c} string" for c in [*axes, *others]))

    def series(c: str) -> Column:
        v = F.from_json(c, "array<double>")
        # A number that can't be read makes from_json null as well; a null inside a list is one that was written so.
        wrong = F.col(c).isNotNull() & (v.isNull() | (F.exists(v, F.isnull) & ~F.contains(c, F.lit("null"))))
        return F.when(wrong, F.raise_error(F.format_string(f"{path}: column {c} holds no list of numbers: %s", F.left(c, F.lit(80)))).cast("array<double>")).otherwise(v) if strict else v

    return not_header(raw, axes[0]).select(*[series(c).alias(c) for c in axes], *others)


def split_files(read, paths: dict[str, str]) -> DataFrame:
    """One file a split."""
    out = None
    for split, path in paths.items():
        part = read(path).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


def nested_series_csv(spark: SparkSession, path: str, length: int) -> DataFrame:
    """`[[...]]` with exactly so many points; other rows go."""
    raw = csv(spark, path, "time_series string, label string, rationale string")
    v = F.try_element_at(F.from_json("time_series", "array<array<double>>"), F.lit(1))
    return raw.select(v.alias("series"), "label", "rationale").where(F.size("series") == length)


def paired_csv(spark: SparkSession, series_path: str, captions_path: str) -> DataFrame:
    """Series and captions joined on id."""
    a = csv(spark, series_path, "id string, series string").select("id", F.from_json("series", "array<double>").alias("series"))
    return a.join(csv(spark, captions_path, "id string, caption string"), "id")


def all_frequencies(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Id, series, frequency (from the file name) of the series files of a folder that can be read, and the files that can't: file, reason.

    A file is broken as a whole if its head isn't `id,series`, or a row of it has no id or no list. Files that vanish are skipped."""
    read = spark.read.schema("id string, series string").options(header=False, quote='"', escape='"', multiLine=True, ignoreMissingFiles=True)
    name = r"([^/]+)_series\.csv(?:/[^/]*)?$"  # a file, or a folder that Spark has written
    file, series = F.regexp_extract("_metadata.file_path", name, 1), F.from_json("series", "array<double>")
    rows = read.csv(f"{folder}/*_series.csv").select(file.alias("file"), "id", F.col("series").alias("text"), series.alias("series"), (F.col("id").eqNullSafe(F.lit("id")) & F.col("series").eqNullSafe(F.lit("series"))).alias("head"))
    bad = ~F.col("head") & (F.col("id").isNull() | F.col("series").isNull())
    state = rows.groupBy("file").agg(F.max("head").alias("head"), F.sum(bad.cast("long")).alias("bad"))
    broken = state.where(~F.col("head") | (F.col("bad") > 0))
    reason = F.when(~F.col("head"), "no head of id and series").otherwise(F.format_string("%d rows without id or list of numbers", "bad"))
    good = rows.where(~F.col("head")).join(broken.select("file"), "file", "left_anti")
    return good.select("id", "series", F.col("file").alias("frequency")), broken.select(F.concat("file", F.lit("_series.csv")).alias("file"), reason.alias("reason"))


def reasoning_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Strict rows and the quarantine."""
    raw = csv(spark, path, "ecg_id string, question string, answer string, template_id int, question_type string, clinical_context string, rationale string")
    return validated(raw, ["ecg_id", "question", "answer", "question_type", "rationale"])


def question_json(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold one JSON array."""
    return spark.read.schema("ecg_id array<long>, question string, answer array<string>, question_type string, template_id long").option("multiLine", True).json(path).where(F.size("ecg_id") > 0)


def metadata_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """S09."""
    return allowed(spark.read.options(header=True).csv(path), columns)


def template_answers(spark: SparkSession, path: str) -> DataFrame:
    """Allowed answers of each template, lower case and stripped; a malformed list is empty."""
    raw = csv(spark, path, "template_id int, classes string")
    listed = F.coalesce(F.from_json("classes", "array<string>", {"allowSingleQuotes": "true"}), F.expr("cast(array() as array<string>)"))
    return raw.select("template_id", F.transform(listed, lambda x: strip(F.lower(x))).alias("classes"))


def sensor_log(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Numbers between blanks, one row a tick, entity from the last digits of its path (a part that Spark has written: of its folder); NaN text is null."""
    parts = F.split(strip(F.col("value")), r"\s+")
    number = lambda k: F.nanvl(F.expr(f"try_cast(try_element_at(parts, {k + 1}) AS double)"), F.lit(None)).alias(columns[k])
    raw = spark.read.text(path).select(F.regexp_extract("_metadata.file_path", r"(\d+)\D*?(?:/part-[^/]*)?$", 1).cast("int").alias("entity"), parts.alias("parts"))
    return raw.select("entity", *[number(k) for k in range(len(columns))])


def labelled_tsv(spark: SparkSession, path: str, points: int) -> DataFrame:
    """Label and so many numbers in each line."""
    raw = csv(spark, path, "label double, " + ", ".join(f"t{k} double" for k in range(1, points + 1)), "\t", header=False)
    return raw.select("label", F.array(*[f"t{k}" for k in range(1, points + 1)]).alias("series"))


PREDICTION = "pre_prompt string, time_series_text array<string>, post_prompt string, generated string, gold string, time_series_id string, template_id int, ecg_id array<long>, correct_answer string"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and value of each line of text files, whatever splits they are read in.

    Spark numbers the lines of a task in order, so a split's lines have numbers in a row. The counts of the
    splits (a row each), added up along a file, say where each begins. Both passes read the same splits."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), "value")
    splits = raw.groupBy("file", "split").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("split")) - F.col("n")
    placed = splits.select("file", "split", (before - F.col("first") + 1).alias("shift"))
    return raw.join(placed, ["file", "split"]).select("file", (F.col("id") + F.col("shift")).alias("line"), "value")


def predictions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The predictions of JSON lines with `file` and `line`, and the malformed lines: file, line, value, reason. Blank lines are neither."""
    rows = numbered_lines(spark, path).where(strip(F.col("value")) != "")
    read = rows.withColumn("r", F.from_json("value", PREDICTION + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    reason = F.when(~F.startswith(strip(F.col("value")), F.lit("{")), "no JSON object").when(F.try_parse_json("value").isNull(), "broken JSON").otherwise("a field of another type")
    good = read.where(~bad).select("file", "line", *[F.col(f"r.{c.split()[0]}") for c in PREDICTION.split(", ")])
    return good, read.where(bad).select("file", "line", "value", reason.alias("reason"))


def detailed_results(spark: SparkSession, path: str) -> DataFrame:
    """One document with an array of results."""
    schema = "model_name string, dataset_name string, detailed_results array<struct<sample_idx:int,input_text:string,target_answer:string,generated_answer:string,metrics:map<string,double>,template_id:int>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select("model_name", "dataset_name", F.inline("detailed_results"))


def document_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """place (from 0) and r of each row of a document of our own sink, which has a line for each row: read by splits, like other lines."""
    lines = numbered_lines(spark, path).where("line > 1 AND value NOT IN ('', ']}')")  # the first line is the head
    return lines.select((F.col("line") - 2).alias("place"), F.from_json(F.regexp_replace("value", ",$", ""), schema, {"mode": "FAILFAST"}).alias("r"))


def scraped_pairs(spark: SparkSession, path: str) -> DataFrame:
    """`generated` and `gold` values of a whole text, paired by position; the shorter list decides."""
    raw = spark.read.text(path, wholetext=True)
    found = [F.regexp_extract_all("value", F.lit(rf'"{name}"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1)).alias(name) for name in ("generated", "gold")]
    n = F.least(F.size("generated"), F.size("gold"))
    return raw.select(*found).select(F.explode(F.arrays_zip(F.slice("generated", F.lit(1), n).alias("generated"), F.slice("gold", F.lit(1), n).alias("gold"))).alias("r")).select("r.*")


def text_reports(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """A field for each heading, up to the next blank line."""
    raw = spark.read.text(path, wholetext=True).select("_metadata.file_path", "value")
    return raw.select("file_path", *[strip(F.regexp_extract("value", rf"(?s){heading}:?\s*(.*?)(?=\n\s*\n|\z)", 1)).alias(name) for name, heading in fields.items()])


def paired_samples(spark: SparkSession, folder: str, kinds: tuple[str, str] = ("txt", "png")) -> DataFrame:
    """Samples of `template_*/sample*` folders that have both kinds of file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    at = files.select(F.regexp_extract("path", r"template_(\d+)/", 1).cast("int").alias("template_id"), F.regexp_extract("path", r"sample_?(\d+)", 1).cast("int").alias("sample"), F.regexp_extract("path", r"\.(\w+)$", 1).alias("kind"))
    return at.where(F.col("kind") == kinds[0]).join(at.where(F.col("kind") == kinds[1]), ["template_id", "sample"], "left_semi").select("template_id", "sample").distinct()


MEMORY_RUN = "timestamp string, llm_id string, device string, model string, dataset string, loss double, peak_cuda_bytes double, peak_cuda_gb double, peak_cuda_reserved_bytes double, peak_cuda_reserved_gb double, nvml_peak_bytes double, nvml_peak_gb double, status string, error string"


def memory_runs(spark: SparkSession, path: str) -> DataFrame:
    """S25."""
    return csv(spark, path, MEMORY_RUN)


def existing_records(spark: SparkSession, paths: DataFrame, path: str, folder: str, suffixes: tuple[str, ...] = (".hea", ".dat")) -> tuple[DataFrame, DataFrame]:
    """The rows whose record (a path without suffix, below a folder) has a file of each suffix, and the others with `missing`, the suffixes that lack.

    The folder is listed once, by Spark's file source, which reads no contents here; it leaves out empty files."""
    try:
        below = rf"\Q{re.sub(r'^[a-z0-9]+:(//[^/]*)?', '', folder).rstrip('/')}\E/(.*?)(\.[^./]+)$"
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_extract("path", below, 1).alias("record"), F.regexp_extract("path", below, 2).alias("suffix"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], "record string, suffix string")
    kinds = found.groupBy("record").agg(F.collect_set("suffix").alias("suffixes"))
    none = F.array().cast("array<string>")
    out = paths.withColumn("record", F.col(path)).join(kinds, "record", "left").withColumn("missing", F.array_except(F.array(*map(F.lit, suffixes)), F.coalesce("suffixes", none))).drop("record", "suffixes")
    return out.where(F.size("missing") == 0).drop("missing"), out.where(F.size("missing") > 0)
