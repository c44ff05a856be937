"""Archives of series and signal records: every tag and format, ranges against one range, what is pushed down."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.sources import archives, files, signals


# .ts archives
def ts_text(timestamps, univariate, kind, equal, cases):
    tags = ["# made for a test", "@problemName Some Name", f"@timeStamps {str(timestamps).lower()}", f"@univariate {str(univariate).lower()}", f"@equalLength {str(equal).lower()}"]
    tags += ["@targetLabel true"] if kind == "target" else ["@classLabel true Up down"] if kind == "class" else ["@targetlabel false"]
    series = lambda s, stamp: ",".join(f"({stamp(k)},{v})" if timestamps else str(v) for k, v in enumerate(s))
    stamp = lambda k: f"2024-01-0{k + 1} 10:00:00"
    rows = [":".join([*(series(s, stamp) for s in dims), *({"target": [str(end)], "class": [("UP", "down")[end % 2]]}.get(kind, []))]) for dims, end in cases]
    return "\n".join([*tags, "@data", *rows]) + "\n"


@pytest.mark.parametrize("timestamps,univariate,kind,equal", list(itertools.product([False, True], [False, True], ["target", "class", "none"], [False, True])))
def test_every_combination_of_tags(spark, tmp_path, timestamps, univariate, kind, equal):
    rng = random.Random(1)
    cases = [([[rng.choice([1, -2.5, "?", 3e-2]) for _ in range(4 if equal else rng.randint(1, 5))] for _ in range(1 if univariate else 3)], k) for k in range(30)]
    (tmp_path / "a.ts").write_text(ts_text(timestamps, univariate, kind, equal, cases))
    got = archives.ts_archive(spark, str(tmp_path), missing="-7", rangeBytes=300).collect()
    value = lambda v: -7.0 if v == "?" else float(v)
    wanted = [([[value(v) for v in s] for s in dims], [[f"2024-01-0{k + 1} 10:00:00" for k in range(len(s))] for s in dims] if timestamps else None, float(end) if kind == "target" else None, ("up", "down")[end % 2] if kind == "class" else None) for dims, end in cases]
    assert sorted(((r["dimensions"], r["timestamps"], r["target"], r["label"]) for r in got), key=str) == sorted(wanted, key=str)
    assert {r["file"].rpartition("/")[2] for r in got} == {"a.ts"}


def test_ranges_equal_one(spark, tmp_path):
    rng = random.Random(2)
    cases = [([[rng.random() for _ in range(rng.randint(0, 20))] for _ in range(2)], k) for k in range(200)]
    (tmp_path / "a.ts").write_text(ts_text(False, False, "target", False, cases))
    (tmp_path / "b.ts").write_bytes(ts_text(False, False, "target", False, cases[:3]).replace("\n", "\r\n").encode().removesuffix(b"\r\n") + b"\n\n# end")
    one = archives.ts_archive(spark, str(tmp_path))
    assert one.rdd.getNumPartitions() == 2 and one.count() == 203
    for size in (1, 7, 64, 1000):
        some = archives.ts_archive(spark, str(tmp_path), rangeBytes=size) if size >= 64 else None
        if some is not None:
            assert some.rdd.getNumPartitions() > 10
            assert sorted(map(str, some.collect())) == sorted(map(str, one.collect()))
        store, path = files.opened(str(tmp_path / "b.ts"))
        data = (tmp_path / "b.ts").read_bytes()
        cut = [x for r in files.ranges(path, 0, len(data), size) for x in files.lines(store, r)]
        assert cut == list(files.lines(store, files.Range(path, 0, len(data)))) and [x for _, x in cut] == [x.removesuffix(b"\r") for x in data.split(b"\n")]


@pytest.mark.parametrize(
    "change,error",
    [
        (("@univariate true\n", ""), "line 5: before @data there is no @univariate"),
        (("@targetLabel true\n", ""), "@targetlabel or @classlabel"),
        (("@timeStamps false", "@timeStamps perhaps"), "line 2: @timestamps needs true or false"),
        (("@targetLabel true", "@classLabel true"), "@classlabel true needs its labels"),
        (("@targetLabel true", "@classLabel true 1 2"), "line 9: label '3.0' is none of 1, 2"),
        (("1,2:1\n", "1,2:4:1\n"), "line 7: 2 dimensions in a univariate file"),
        (("3,4:2", "3,x:2"), "line 8: could not convert"),
        (("3,4:2", "3,4,5:2"), r"line 8: series of \[3\] points where all have 2"),
        (("3,4:2", "3 4"), "line 8: no target or label"),
        (("@data\n", "@data now\n"), "line 6: @data has no value"),
        (("5,6:3.0", "@data"), "line 9: a tag after @data"),
        (("@timeStamps false", "@timeStamps true"), "line 7: timestamps stand in pairs"),
    ],
)
def test_what_breaks_a_rule_names_file_and_line(spark, tmp_path, change, error):
    text = "@problemName x\n@timeStamps false\n@univariate true\n@targetLabel true\n@equalLength true\n@data\n1,2:1\n3,4:2\n5,6:3.0\n"
    assert change[0] in text
    text = text.replace("@equalLength true\n", "@equalLength true\n").replace(*change)
    (tmp_path / "bad.ts").write_text(text)
    with pytest.raises(Exception, match=rf"bad\.ts(, |: ).*{error}|bad\.ts, {error}"):
        archives.ts_archive(spark, str(tmp_path), rangeBytes=8).collect()


def test_dense_archives_and_mixed_timestamps(spark, tmp_path):
    (tmp_path / "a.ts").write_text(ts_text(False, True, "none", False, [([[1, 2]], 0), ([[3]], 0)]))
    assert archives.ts_archive(spark, str(tmp_path / "a.ts")).count() == 2
    with pytest.raises(Exception, match="points where all have 2"):
        archives.ts_dense(spark, str(tmp_path / "a.ts")).collect()
    (tmp_path / "t.ts").write_text("@problemname x\n@timestamps true\n@univariate true\n@targetlabel false\n@data\n(0,1),(1,2)\n(noon,3)\n")
    with pytest.raises(Exception, match="line 7: timestamp 'noon' is no whole number"):
        archives.ts_archive(spark, str(tmp_path / "t.ts")).collect()


# Signal records
def packed(values, format_):
    """Numbers as bytes of a format, in order."""
    v = np.array(values, dtype=np.int64)
    if format_ == "212":
        v = np.concatenate([v, np.zeros(len(v) % 2, np.int64)]) & 0xFFF
        a, b = v[::2], v[1::2]
        return np.stack([a & 255, (a >> 8) | ((b >> 8) << 4), b & 255], axis=1).astype(np.uint8).tobytes()
    if format_ == "24":
        return (v & 0xFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return (v + 128).astype(np.uint8).tobytes() if format_ == "80" else v.astype({"16": "<i2", "32": "<i4"}[format_]).tobytes()


@pytest.mark.parametrize("format_", sorted(signals.MISSING))
@pytest.mark.parametrize("leads", [1, 3])
def test_formats(spark, tmp_path, format_, leads):
    rng, n = random.Random(int(format_)), 101
    top = -signals.MISSING[format_] - 1
    raw = [[rng.choice([-top, top, 0, signals.MISSING[format_], rng.randint(-top, top)]) for _ in range(n)] for _ in range(leads)]
    (tmp_path / "r.dat").write_bytes(b"skip!" + packed([raw[k][i] for i in range(n) for k in range(leads)], format_))
    (tmp_path / "r.hea").write_text(f"# a comment\nr {leads} 250.5/1 {n}\n" + "".join(f"r.dat {format_}+5 {k + 2}.0({k - 1})/uV 12 0 0 0 0 lead {k}\n" for k in range(leads)))
    for samples in (1 << 20, 10, 7):
        rows = signals.signal_records(spark, str(tmp_path), samples).collect()
        for k in range(leads):
            own = sorted((r for r in rows if r["number"] == k), key=lambda r: r["first"])
            assert [r["first"] for r in own] == list(range(0, n, samples)) and {(r["lead"], r["unit"], r["rate"]) for r in own} == {(f"lead {k}", "uV", 250.5)}
            wanted = [None if v == signals.MISSING[format_] else (v - (k - 1)) / (k + 2.0) for v in raw[k]]
            assert [v for r in own for v in r["signal"]] == wanted
    (r,) = signals.signal_matrix(spark, str(tmp_path)).collect()
    assert r["names"] == [f"lead {k}" for k in range(leads)] and len(r["leads"][leads - 1]) == n


def test_pushed_leads_and_runs(spark, tmp_path):
    n = 100
    (tmp_path / "a.dat").write_bytes(packed([v for i in range(n) for v in (i, 1000 + i)], "16"))
    (tmp_path / "b.dat").write_bytes(packed(list(range(n)), "80"))
    (tmp_path / "r.hea").write_text(f"r 3 100 {n}\na.dat 16 0 16 0 0 0 0 I\na.dat 16 100 16 0 0 0 0 II\nb.dat 80 1(0)/mV 8 0 0 0 0 III\n")
    all_ = signals.signal_records(spark, str(tmp_path), 10)
    assert all_.rdd.getNumPartitions() == 10 and all_.count() == 30
    some = all_.where(F.col("lead").isin("II", "IV") & (F.col("first") >= 30) & (F.col("first") < 50))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter " not in plan  # the source has taken all conditions
    assert some.rdd.getNumPartitions() == 2
    assert sorted((r["first"], r["lead"], r["signal"][0]) for r in some.collect()) == [(30, "II", 10.3), (40, "II", 10.4)]
    (tmp_path / "b.dat").unlink()  # a file of pruned leads isn't opened
    assert all_.where("lead = 'I'").count() == 10 and all_.where("lead = 'V9'").count() == 0
    assert all_.where("lead = 'I' AND first > 80 AND signal[0] > 0").count() == 1  # what isn't pushed is still tested


@pytest.mark.parametrize("header,error", [("x 1 100 2\nx.dat 310 200 12 0 0 0 0 I\n", "format 310"), ("x 1 100 9\nx.dat 16 200 16 0 0 0 0 I\n", "fewer than 9 samples"), ("x 2 100 1\nx.dat 16\n", "2 leads are announced, 1 described"), ("x/2 1 100 1\n", "several segments")])
def test_records_that_cannot_be_read(spark, tmp_path, header, error):
    (tmp_path / "x.hea").write_text(header)
    (tmp_path / "x.dat").write_bytes(b"abcd")
    with pytest.raises(Exception, match=error):
        signals.signal_records(spark, str(tmp_path)).collect()


def test_lengths_and_gains_that_are_left_out(spark, tmp_path):
    (tmp_path / "x.hea").write_text("x 1\nx.dat 16\n")
    (tmp_path / "x.dat").write_bytes(packed([200, -200, 0], "16"))
    (r,) = signals.signal_records(spark, str(tmp_path)).collect()
    assert (r["rate"], r["lead"], r["unit"], r["signal"]) == (250.0, "1", "mV", [1.0, -1.0, 0.0])
