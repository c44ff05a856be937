"""Streams in several micro-batches, out of order, late and restarted, against what a batch query says of the same rows."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavemill.operators import relational as R
from wavemill.streaming import online

SCHEMA = "id long, entity string, ts timestamp, value double"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def write(spark, rows, path, k):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/part{k}")


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(path)


def drained(frame, name, checkpoint):
    query = frame.writeStream.format("parquet").option("path", name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return query


def events(n=600, seed=4):
    """Entities begin at their own times; a row comes up to 40 minutes after a later one."""
    rng = random.Random(seed)
    rows = [(k, f"e{k % 7}", k % 7 * 1234.567891 + rng.random() * 80_000, float(k % 5)) for k in range(n)]
    rows.sort(key=lambda r: r[2] + rng.random() * 2400)
    return [(k, e, at(t), v) for k, e, t, v in rows]


def test_entity_windows_online(spark, tmp_path):
    rows, path = events(), str(tmp_path / "in")
    write(spark, rows[:200], path, 0)
    write(spark, rows[200:400], path, 1)
    online_rows = lambda: online.entity_windows_online(stream(spark, path), "entity", "ts", "value", 3600, "1 hour")
    drained(online_rows(), str(tmp_path / "out"), str(tmp_path / "cp"))
    before = spark.read.parquet(str(tmp_path / "out")).count()
    # A restart goes on from the state; one row is long late, and the last one moves the watermark past all.
    write(spark, rows[400:], path, 2)
    write(spark, [(9000, "e1", at(10), 5.0), (9001, "end", at(400_000), 0.0)], path, 3)
    query = drained(online_rows(), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    wanted = R.entity_windows(spark.createDataFrame(rows, SCHEMA), "entity", "ts", 3600).groupBy("entity", "window_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    assert 0 < before < got.count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    assert online.late_rows(query) == 1


def test_origin_moves_until_the_watermark_reaches_it(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, [(0, "a", at(5000), 1.0)], path, 0)
    write(spark, [(1, "a", at(4000), 1.0), (2, "a", at(7700), 1.0)], path, 1)  # earlier than what came first
    write(spark, [(3, "end", at(90_000), 0.0)], path, 2)
    drained(online.entity_windows_online(stream(spark, path), "entity", "ts", "value", 3600), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("a", 0, 2, 2.0), ("a", 1, 1, 1.0)]


def test_scored_once_after_a_crash(spark, tmp_path, monkeypatch):
    path, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    assert online.scored_rows(spark, target) is None
    write(spark, [(1, "a", at(1), 1.0)], path, 0)
    score = lambda df: df.select("id", (F.col("value") * 2).alias("score"))
    run = lambda: online.score_once(stream(spark, path), score, target, checkpoint).awaitTermination(300)
    run()
    write(spark, [(2, "a", at(2), 2.0), (3, "b", at(3), 3.0)], path, 1)
    enter = online._enter

    def crash(*args):
        raise RuntimeError("between the rows and the ledger")

    monkeypatch.setattr(online, "_enter", crash)
    with pytest.raises(Exception, match="between the rows"):
        run()
    assert [tuple(r) for r in online.scored_rows(spark, target).collect()] == [(1, 2.0)]

    def crash_after(*args):
        enter(*args)
        raise RuntimeError("between the ledger and the stream's own commit")

    monkeypatch.setattr(online, "_enter", crash_after)
    with pytest.raises(Exception, match="own commit"):
        run()
    monkeypatch.setattr(online, "_enter", enter)
    run()  # the batch is run a third time and adds nothing
    assert sorted(map(tuple, online.scored_rows(spark, target).collect())) == [(1, 2.0), (2, 4.0), (3, 6.0)]
    assert online.ledger(spark, target).count() == 2


def test_windows_and_sessions(spark, tmp_path):
    rows = [(k, "a", at(t), 1.0) for k, t in enumerate([0, 30, 90, 400, 1000, 1010])]
    path = str(tmp_path / "in")
    write(spark, rows, path, 0)
    write(spark, [(99, "end", at(100_000), 1.0), (100, "a", at(5), 1.0)], path, 1)
    drained(online.windowed_counts(stream(spark, path), "ts", ["entity"], "60 seconds"), str(tmp_path / "w"), str(tmp_path / "cw"))
    drained(online.windowed_counts(stream(spark, path), "ts", ["entity"], "60 seconds", "30 seconds"), str(tmp_path / "s"), str(tmp_path / "cs"))
    drained(online.session_counts(stream(spark, path), "ts", "entity", "100 seconds"), str(tmp_path / "g"), str(tmp_path / "cg"))
    read = lambda name: sorted((int(r["start"].timestamp() - START.timestamp()), int(r["end"].timestamp() - START.timestamp()), r["n"]) for r in spark.read.parquet(str(tmp_path / name)).where("entity = 'a'").select(F.col("start"), F.col("end"), "n").collect())
    late = 1  # comes in the batch that moves the watermark, so it still counts
    assert read("w") == [(0, 60, 2 + late), (60, 120, 1), (360, 420, 1), (960, 1020, 2)]
    assert read("s") == [(-30, 30, 1 + late), (0, 60, 2 + late), (30, 90, 1), (60, 120, 1), (90, 150, 1), (360, 420, 1), (390, 450, 1), (960, 1020, 2), (990, 1050, 2)]
    assert read("g") == [(0, 190, 3 + late), (400, 500, 1), (1000, 1110, 2)]


def test_entity_windows_send_few_messages():
    """calls to the state store are messages to the JVM; they must not grow with an entity's rows or closed windows."""
    calls = []

    class State(dict):
        def exists(self):
            calls.append("exists")
            return bool(self)

        def get(self, *a):
            calls.append("get")
            return dict.get(self, "v")

        def update(self, v):
            calls.append("update")
            self["v"] = v

        def appendList(self, rows):  # noqa: N802
            calls.append("appendList")
            self["v"] = rows

        def clear(self):
            calls.append("clear")
            dict.clear(self)

    class Handle:
        getValueState = getListState = getMapState = lambda self, *a: State()  # noqa: E731, N815

        def registerTimer(self, at):  # noqa: N802
            calls.append("registerTimer")

    class Mark:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    windows = online._EntityWindows(1_000_000)
    windows.init(Handle())
    batch = pd.DataFrame({"at": [k * 500_000 + 1 for k in range(1000)], "value": [1.0] * 1000})
    assert list(windows.handleInputRows(("a",), iter([batch]), Mark(0))) == []
    (out,) = windows.handleExpiredTimer(("a",), Mark(10**9), None)
    assert len(out) == 500 and set(out["n"]) == {2} and out["total"].sum() == 1000.0 and len(calls) < 12
