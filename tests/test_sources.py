"""Readers and writers over small files with the odd rows that real ones have."""

import pytest
from pyspark.sql import functions as F

from wavemill.functions import labels as L
from wavemill.sinks import writers
from wavemill.sources import readers


def test_split_files(spark, tmp_path):
    paths = {}
    for k, split in enumerate(readers.SPLITS):
        paths[split] = str(tmp_path / f"{split}.csv")
        (tmp_path / f"{split}.csv").write_text(f'x,label\n"[{k}, 2]",walk\nx,label\n')
    out = readers.split_files(lambda p: readers.series_csv(spark, p, ["x"], ["label"]), paths).collect()
    assert sorted((r["split"], r["x"][0], r["label"]) for r in out) == [("test", 2.0, "walk"), ("train", 0.0, "walk"), ("validation", 1.0, "walk")]


def test_nested_series_of_exact_length(spark, tmp_path):
    rows = ["[[1, 2, 3]]", "[[1, 2]]", "[1, 2, 3]", "[[1, 2, 3], [4]]", "bad"]
    (tmp_path / "s.csv").write_text("time_series,label,rationale\n" + "".join(f'"{r}",Wake,"a ""quoted"" one\nof two lines"\n' for r in rows))
    out = readers.nested_series_csv(spark, str(tmp_path / "s.csv"), 3).collect()
    assert [r["series"] for r in out] == [[1.0, 2.0, 3.0]] * 2 and out[0]["rationale"] == 'a "quoted" one\nof two lines'


def test_paired_and_all_frequencies(spark, tmp_path):
    (tmp_path / "daily_series.csv").write_text('id,series\na,"[1, 2]"\nb,"[3]"\nb,"[4]"\n')
    (tmp_path / "yearly_series.csv").write_text('id,series\nz,"[9, NaN]"\n')
    (tmp_path / "daily_captions.csv").write_text('id,caption\nb,"two, of them"\nc,none\n')
    out = readers.paired_csv(spark, str(tmp_path / "daily_series.csv"), str(tmp_path / "daily_captions.csv")).collect()
    assert sorted((r["id"], r["series"], r["caption"]) for r in out) == [("b", [3.0], "two, of them"), ("b", [4.0], "two, of them")]
    (tmp_path / "weekly_series.csv").write_text('id,series\nq,"[1, 2]"\nr,"[1, oops]"\n')
    (tmp_path / "hourly_series.csv").write_text('key,values\nq,"[1, 2]"\n')
    every, broken = readers.all_frequencies(spark, str(tmp_path))
    assert sorted((r["frequency"], r["id"]) for r in every.collect()) == [("daily", "a"), ("daily", "b"), ("daily", "b"), ("yearly", "z")]
    assert {r["file"]: r["reason"] for r in broken.collect()} == {"weekly_series.csv": "1 rows without id or list of numbers", "hourly_series.csv": "no head of id and series"}


def test_strict_lists(spark, tmp_path):
    (tmp_path / "ok.csv").write_text('x,label\n"[1, 2]",a\nx,label\n"[3]",b\n')
    (tmp_path / "bad.csv").write_text('x,label\n"[1, two]",a\n')
    assert sorted(r["x"] for r in readers.series_csv(spark, str(tmp_path / "ok.csv"), ["x"], ["label"], strict=True).collect()) == [[1.0, 2.0], [3.0]]
    with pytest.raises(Exception, match=r"bad.csv: column x holds no list of numbers: \[1, two\]"):
        readers.series_csv(spark, str(tmp_path / "bad.csv"), ["x"], ["label"], strict=True).collect()


def test_existing_records(spark, tmp_path):
    for name in ("21000/21837_hr.hea", "21000/21837_hr.dat", "21000/21838_hr.hea"):
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text("x")
    ids = spark.createDataFrame([(21837,), (21838,), (1,)], "id long").select("id", L.path_of_record(F.col("id")).alias("path"))
    there, lacking = readers.existing_records(spark, ids, "path", str(tmp_path / "r"))
    assert [r["id"] for r in there.collect()] == [21837] and {r["id"]: r["missing"] for r in lacking.collect()} == {21838: [".dat"], 1: [".hea", ".dat"]}
    assert readers.existing_records(spark, ids, "path", str(tmp_path / "none"))[1].count() == 3


def test_numbered_lines_of_many_splits(spark, tmp_path):
    text = {}
    for name, n in (("a.jsonl", 700), ("b.jsonl", 3)):
        text[name] = ["" if k % 11 == 3 else '{"generated": "broken' if k % 7 == 1 else "plain" if k % 13 == 5 else f'{{"generated": "é{"x" * (k % 50)}", "gold": "{k}"}}' for k in range(n)]
        (tmp_path / name).write_text("\n".join(text[name]) + ("\n" if n > 3 else ""))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 12
        lines = readers.numbered_lines(spark, str(tmp_path)).collect()
        good, bad = (df.collect() for df in readers.predictions(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    name = lambda r: r["file"].rpartition("/")[2]
    assert sorted((name(r), r["line"], r["value"]) for r in lines) == sorted((k, i, v) for k, vs in text.items() for i, v in enumerate(vs, 1))
    kinds = {(k, i): "good" if "gold" in v else "broken JSON" if v.startswith("{") else "no JSON object" for k, vs in text.items() for i, v in enumerate(vs, 1) if v}
    assert {(name(r), r["line"]): "good" for r in good} | {(name(r), r["line"]): r["reason"] for r in bad} == kinds and len(good) + len(bad) == len(kinds)
    assert all(r["gold"] == str(r["line"] - 1) for r in good)


def test_reasoning_rows_and_quarantine(spark, tmp_path):
    (tmp_path / "r.csv").write_text("ecg_id,question,answer,template_id,question_type,clinical_context,rationale\n[1],Q,A,3,single,,because\n[2],,A,3,single,x,because\n[3],Q,A,3,single,x,\n")
    good, bad = readers.reasoning_csv(spark, str(tmp_path / "r.csv"))
    assert [r["ecg_id"] for r in good.collect()] == ["[1]"] and sorted(r["ecg_id"] for r in bad.collect()) == ["[2]", "[3]"]


def test_questions_metadata_and_template_answers(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"ecg_id": [1, 2], "question": "q", "answer": ["yes"], "question_type": "t", "template_id": 5}, {"ecg_id": [], "question": "q", "answer": [], "question_type": "t", "template_id": 5}]')
    out = readers.question_json(spark, str(tmp_path / "q.json")).collect()
    assert [(r["ecg_id"], r["answer"], r["template_id"]) for r in out] == [([1, 2], ["yes"], 5)]
    (tmp_path / "m.csv").write_text("ecg_id,age,secret\n1,50,x\n")
    assert readers.metadata_csv(spark, str(tmp_path / "m.csv"), ["ecg_id", "age", "sex"]).columns == ["ecg_id", "age"]
    (tmp_path / "t.csv").write_text("template_id,classes\n1,\"[' Yes', 'NO ']\"\n2,oops\n")
    assert {r["template_id"]: r["classes"] for r in readers.template_answers(spark, str(tmp_path / "t.csv")).collect()} == {1: ["yes", "no"], 2: []}


def test_tsv_results_and_scrapes(spark, tmp_path):
    (tmp_path / "u.tsv").write_text("-1\t1.5\t2\n2\t0\t0\n")
    assert sorted((r["label"], r["series"]) for r in readers.labelled_tsv(spark, str(tmp_path / "u.tsv"), 2).collect()) == [(-1.0, [1.5, 2.0]), (2.0, [0.0, 0.0])]
    (tmp_path / "d.json").write_text('{"model_name": "m", "dataset_name": "d",\n "detailed_results": [{"sample_idx": 1, "target_answer": "a", "generated_answer": "b", "metrics": {"accuracy": 0.0}}, {"sample_idx": 2, "metrics": {}}]}')
    out = {r["sample_idx"]: r for r in readers.detailed_results(spark, str(tmp_path / "d.json")).collect()}
    assert out[1]["metrics"] == {"accuracy": 0.0} and out[2]["target_answer"] is None and out[2]["model_name"] == "m"
    (tmp_path / "s.rtf").write_text('{\\rtf junk "generated": "x \\"y\\"", more "gold": "z"} "generated": "left over"')
    assert [tuple(r) for r in readers.scraped_pairs(spark, str(tmp_path / "s.rtf")).collect()] == [('x \\"y\\"', "z")]


def test_reports_samples_and_memory_runs(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Question: how\nmany?\n\nAnswer: two\n")
    (r,) = readers.text_reports(spark, str(tmp_path / "a.txt"), {"question": "Question", "answer": "Answer", "missing": "Context"}).collect()
    assert (r["question"], r["answer"], r["missing"]) == ("how\nmany?", "two", "")
    for name in ("template_1/sample_2/r.txt", "template_1/sample_2/p.png", "template_1/sample_3/r.txt"):
        (tmp_path / "w" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "w" / name).write_text("x")
    assert [tuple(r) for r in readers.paired_samples(spark, str(tmp_path / "w")).collect()] == [(1, 2)]
    (tmp_path / "mem.csv").write_text(readers.MEMORY_RUN.replace(" string", "").replace(" double", "").replace(", ", ",") + "\nt,l,d,m,Simulation-L10-N1,0.5,-1,-1,,,,180,OOM,\"a, b\"\n")
    (m,) = readers.memory_runs(spark, str(tmp_path / "mem.csv")).collect()
    assert (m["peak_cuda_bytes"], m["nvml_peak_gb"], m["error"]) == (-1.0, 180.0, "a, b")


def test_writers(spark, tmp_path):
    at = str(tmp_path)
    df = spark.createDataFrame([(1, "a,b", [1.0, 2.0]), (2, None, [])], "k int, v string, xs array<double>")
    writers.append_json(df, f"{at}/j")
    writers.append_json(df, f"{at}/j")
    assert spark.read.json(f"{at}/j").count() == 4
    writers.append_csv(df, f"{at}/c")
    back = {r["k"]: r for r in spark.read.options(header=True, escape='"').csv(f"{at}/c").collect()}
    assert back["1"]["v"] == "a,b" and back["1"]["xs"] == "[1.0,2.0]"
    writers.consolidated(df.agg(F.count(F.lit(1)).alias("n")), df, f"{at}/s")
    assert spark.read.json(f"{at}/s/summary").first()["n"] == 2 and spark.read.json(f"{at}/s/results").count() == 2
    leads = spark.createDataFrame([(7, [[0.1, 0.2], [0.3]])], "id int, leads array<array<double>>")
    writers.leads_csv(leads, "id", "leads", ["I", "II"], f"{at}/l")
    out = spark.read.options(header=True, inferSchema=True).csv(f"{at}/l").collect()
    assert sorted((r["lead"], r["time_seconds"], r["signal_mV"]) for r in out) == [("I", 0.0, 0.1), ("I", 0.01, 0.2), ("II", 0.0, 0.3)]
    writers.reports(df, F.format_string("row %d", "k"), f"{at}/r")
    assert sorted(r["value"] for r in spark.read.text(f"{at}/r").collect()) == ["row 1", "row 2"]
