"""Writers of results (survey 2.2). Task commit replaces flush and fsync; part files replace per-rank files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import not_done


def append_json(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("append").json(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append only rows whose keys the Parquet table at `path` doesn't have yet."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(*keys)
    except Exception as e:  # the first run
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = df.select(*keys).limit(0)
    not_done(df, done, keys).write.mode("append").parquet(path)


def append_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV parts with a header each; arrays go as JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("append").options(header=True, sep=sep, quote='"', escape='"').csv(path)


def consolidated(summary: DataFrame, results: DataFrame, path: str) -> None:
    """One summary line, and the results as parts beside it. `documents.write_document` joins both to one document."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    results.write.mode("overwrite").json(f"{path}/results")


def leads_csv(df: DataFrame, id_: str, leads: str, names: list[str], path: str, rate: float = 100.0) -> None:
    """Time and signal of each lead, a folder for each."""
    at = df.select(id_, F.posexplode(leads).alias("k", "v")).select(id_, F.element_at(F.array(*[F.lit(x) for x in names]), F.col("k") + 1).alias("lead"), F.posexplode("v").alias("i", "signal_mV"))
    at.select(id_, "lead", (F.col("i") / F.lit(rate)).alias("time_seconds"), "signal_mV").write.mode("overwrite").partitionBy("lead").options(header=True).csv(path)


def reports(df: DataFrame, line, path: str) -> None:
    """A line of text for each row; `line` is a string column."""
    df.select(line.alias("value")).write.mode("overwrite").text(path)
