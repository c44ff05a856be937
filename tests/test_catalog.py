"""Every catalogue query against its SQL on the smallest tables, and cases that those tables lack."""

import os

import pytest
from pyspark.sql import functions as F

from wavemill.functions import labels as L
from wavemill.functions import series as S
from wavemill.operators import relational as R
from wavemill.operators import scoring as C
from wavemill.plans import catalog, catalog_files, catalog_more, catalog_tasks, prompts  # noqa: F401 (the others add to the first)
from wavemill.sinks import writers
from wavemill.sources import readers

SF = "/root/testdata/sf0.001"
#: A few of each kind; the driver compares all.
NAMES = ["a25_reviewer_rates", "f19_family_prompts", "f20_captions", "f27_gaussian_noise", "f27_uniform_noise", "t02_aligned_windows", "t02_entity_windows_online", "x03_row_scores", "x04_corpus_scores", "x09_record_rows"]
NAMES += ["f02e_answer_staged", "f02g_first_word", "f02h_sampler_label", "f03_option", "f04_stage_labels", "f05_own_stage_labels", "f06_stage_codes", "f25_znorm_n3", "a16_token_overlap", "r05_missing_classes", "a11_support_only_macro", "f16_context", "f33_undigits", "f43_valid_series", "j10_stages_left", "p19_extra_columns"]
NAMES += ["a08_open_vocabulary", "a14_template_f1", "a26_agreement", "f02b_answer_clean", "f25_znorm_n5", "j03_list_lookup", "p13_finite_series", "r01_random_split", "r02_stratified_split", "w02_window_majority", "w04_interpolated", "s04_all_frequencies", "s15_ts_archive", "s19_prediction_lines", "k02_ranked_parts", "k04_append_new", "w04_interpolated_whole", "a09_closed_vocabulary", "a26_agreement_by_question", "f32_digits", "j12_round_robin", "x04_merged_scores", "w06_balanced_batches"]


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name[:-8]} as select * from '{SF}/{name}'")
    return con


def plain(rows):
    cell = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    wanted = con.execute(f"select {', '.join(f'"{c}"' for c in columns)} from ({catalog.SQL[name]})").fetchall()
    assert plain(df.select(*columns).collect()) == plain(wanted)


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_labels(spark):
    t = F.col("t")
    assert one(spark, L.normalize_label(t), t=" a .") == "a "
    assert one(spark, L.answer_staged(t), t="first REM sleep then Wake it seems") == "wake"
    assert one(spark, L.answer_staged(t), t="x\nAnswer: Wake\nmore, y.") == "wake\nmore, y" and one(spark, L.answer_staged(t), t="so: Answer:") == ""
    assert one(spark, L.answer_first_word(t), t="x Answer: ") is None
    stages = {"stage 4.": "non-rem stage 3", "S2": "non-rem stage 2", "2": "non-rem stage 2", "artifact": "movement", "spindle": "non-rem stage 2", "stage 1 then stage 2": "non-rem stage 2", "rem with movement": "rem sleep", "(a) w . ,": "wake", "NREM stage 4": "non-rem stage 3", "other": "other"}
    assert {k: one(spark, L.stage_label(t), t=k) for k in stages} == stages
    own = {"Answer nrem stage 4.": "Non-REM stage 3", "AWAKE": "Wake", "rem sleep<eos>": "REM sleep", "mt": "Movement", "w": "w", "stage 2": "stage 2"}
    assert {k: one(spark, L.own_stage_label(t), t=k) for k in own} == own
    assert one(spark, L.stage_supported(t), t="w") is False and one(spark, L.stage_of_code(t), t=" N4") == "non-rem stage 3" and one(spark, L.shown_code(t), t="N4") == "Non-REM stage 4"
    options = {"a) first": "a) first", "b)yes": "(b)", "none of them": "none of them", "it is (C)": "(c)", "so D: x": "(d)", " e.g ": "(e)"}
    assert {k: one(spark, L.mcq_option(t), t=k) for k in options} == options
    assert one(spark, L.prompt_numbers(t), t="see [1, -2,3] ok") == [1, -2, 3]


def test_series(spark):
    v = F.col("v")
    assert one(spark, S.deviation(v, 1), v=[1.0]) is None
    assert one(spark, S.znorm(v, 0, "centre", 1e-6), v=[2.0, 2.0]) == [0.0, 0.0]
    assert one(spark, S.finite(v), v=[1.0, float("nan")]) is False
    assert one(spark, S.patches(v), v=[1.0, 2.0, 3.0, 4.0, 5.0]) == [[1.0, 2.0, 3.0, 4.0]]
    assert one(spark, S.transposed(F.col("m"), 2), m=[[1.0, 2.0], [3.0, 4.0]]) == [[1.0, 3.0], [2.0, 4.0]]
    with pytest.raises(ValueError):
        S.noise(v, "pink", 1)


def test_early_stop_and_interpolation(spark):
    assert tuple(one(spark, R.early_stop(F.col("v")), v=[1.0, 0.9, 0.89995, 0.95, 0.1]))[1:] == (2, 0.9, 2, 4)
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate([None, 1.0, None, None, 4.0, None])], "e string, i int, v double")
    assert [r["v"] for r in R.interpolated(df, "e", ["i"], "v").orderBy("i").collect()] == [None, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_scores(spark):
    df = spark.createDataFrame([("b", "a"), ("a", "a"), (None, "a"), ("c", "b")], "p string, g string")
    counts = {r["class"]: (r["tp"], r["fp"], r["fn"]) for r in C.class_counts(df.na.fill("none"), "p", "g").collect()}
    assert counts == {"a": (1, 0, 2), "b": (0, 1, 1), "c": (0, 1, 0), "none": (0, 1, 0)}
    f1 = lambda p, g: one(spark, C.token_overlap(F.col("p"), F.col("g"))["f1"], p=p, g=g)
    assert (f1("", ""), f1("a", ""), f1("a a b", "a b b")) == (1.0, 0.0, pytest.approx(2 / 3))
    pairs = spark.createDataFrame([("", ""), ("x", "y")], "first_answer string, second_answer string").withColumn("q", F.lit(1))
    assert C.agreement(pairs, ["q"]).where("q = 1").first()["percent"] == 50.0
    assert C.agreement(pairs, ["q"], blank_counts=False).where("q = 1").first()["percent"] == 0.0


def test_readers_and_writers(spark, tmp_path):
    at = str(tmp_path)
    (tmp_path / "har.csv").write_text('x_axis,y_axis,label\n"[1, 2]","[3, NaN]",walk\nx_axis,y_axis,label\nbad,"[1]",sit\n')
    rows = readers.series_csv(spark, f"{at}/har.csv", ["x_axis", "y_axis"], ["label"]).collect()
    assert [(r["x_axis"], r["label"]) for r in rows] == [([1.0, 2.0], "walk"), (None, "sit")]
    (tmp_path / "subject101.dat").write_text("1.5 2 NaN\n")
    r = readers.sensor_log(spark, f"{at}/subject101.dat", ["t", "a", "h"]).first()
    assert tuple(r) == (101, 1.5, 2.0, None)
    (tmp_path / "p.jsonl").write_text('{"generated": "a", "gold": "b"}\n{bad\n')
    good, bad = readers.predictions(spark, f"{at}/p.jsonl")
    assert (len(good.collect()), good.first()["gold"]) == (1, "b")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    writers.append_new(df, f"{at}/out", ["k"])
    writers.append_new(df.union(spark.createDataFrame([(3, "c")], df.schema)), f"{at}/out", ["k"])
    assert spark.read.parquet(f"{at}/out").count() == 3


def test_prompts(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [])], "id int, v array<double>")
    spec = prompts.DatasetSpec(F.lit("pre"), F.lit("post"), F.lit("yes"), [F.lit("a series")], [F.col("v")], ("id",))
    good, bad = prompts.prompt_records(df, spec, "<eos>")
    assert good.first()["answer"] == "yes<eos>" and bad.first()["id"] == 2
    out = prompts.predicted(good.select(prompts.string_prompt(F.array(F.lit("1 2"))).alias("prompt")))
    assert out.first()["generated"] == "Answer: post"


def test_streaming(spark, tmp_path):
    from wavemill.streaming import online

    schema = "run string, epoch long, loss double"
    spark.createDataFrame([("a", k, v) for k, v in enumerate([1.0, 0.5, 0.5, 0.5, 0.1], 1)], schema).coalesce(1).write.json(f"{tmp_path}/in")
    stream = online.early_stop_monitor(spark.readStream.schema(schema).json(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("stops").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["epoch"], r["best_epoch"], r["stopped"]) for r in spark.table("stops").collect())[-1] == (4, 2, True)


def test_streaming_late_epochs(spark, tmp_path):
    from wavemill.streaming import online

    schema = "run string, epoch long, loss double"
    (tmp_path / "in").mkdir()
    stream = online.early_stop_monitor(spark.readStream.schema(schema).json(f"{tmp_path}/in"))
    for rows in ([("a", 1, 1.0), ("a", 3, 0.5)], [("a", 2, 0.1), ("a", 4, 0.4)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(60)
    out = sorted((r["epoch"], r["best_epoch"], r["late"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert out == [(1, 1, False), (2, 3, True), (3, 3, False), (4, 4, False)]


def test_closed_vocabulary_and_templates(spark):
    rows = spark.createDataFrame([("t", "a", "a"), ("t", "z", "a"), ("t", "b", "b"), ("t", "a", "z"), ("u", "a", "a")], "template string, gold string, pred string")
    labels = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "a")], "template string, class string")
    closed = {r["class"]: (r["tp"], r["fp"], r["fn"]) for r in C.closed_counts(rows.where("template = 't'"), "pred", "gold", labels.where("template = 't'").select("class")).collect()}
    assert closed == {"a": (1, 1, 1), "b": (1, 0, 0), "z": (0, 0, 1)}  # z as a prediction is no false positive
    out = {r["template"]: r for r in C.template_f1(rows, "pred", "gold", "template", labels).collect()}
    assert (out["t"]["n"], out["t"]["accuracy"]) == (4, 0.5) and out["t"]["macro_f1"] == pytest.approx((2 / 3 + 1) / 2)  # (z, a) counts in no class
    assert out[None]["macro_f1"] == pytest.approx((5 / 6 + 1) / 2) and out[None]["n"] == 5
    only = spark.createDataFrame([("t", "a", "a"), ("t", "z", "a"), ("t", "b", "b")], "template string, gold string, pred string")
    assert C.template_f1(only, "pred", "gold", "template", labels).where("template = 't'").first()["macro_f1"] == 1.0
    with pytest.raises(Exception, match="template t has no allowed answers"):
        C.template_f1(rows, "pred", "gold", "template", labels.where("template = 'u'")).collect()


def test_overlap_of_normalised_answers(spark):
    rows = spark.createDataFrame([("The cat.", "the cat"), ("a a b", "a c a a"), ("", " .!"), ("x", ""), (None, "x")], "p string, g string")
    got = [tuple(x if x is None else round(x, 6) for x in r["s"]) for r in rows.select(C.token_overlap(F.col("p"), F.col("g")).alias("s")).collect()]
    assert got[:4] == [(1.0, 1.0, 1.0), (0.666667, 0.5, 0.571429), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0)]
    assert got[4][2] in (None, 0.0)


def test_majority_counts_rows_without_label(spark):
    rows = spark.createDataFrame([("e", 0, x) for x in (None, None, None, "x", "x")] + [("e", 1, None)] + [("e", 2, x) for x in "ba"], "e string, window_id long, label string")
    assert sorted(map(tuple, R.window_majority(rows, "e", "label", 0.4).collect())) == [("e", 0, "x", 2, 5), ("e", 2, "a", 1, 2)]
    assert [r["window_id"] for r in R.window_majority(rows, "e", "label", 0.5).collect()] == [2]


def test_round_robin_loads(spark):
    samples = spark.range(84).withColumn("rn", F.lit(1)).select(F.col("id").alias("sample"))
    out = R.round_robin(samples, "sample", 5, 2, 1)
    loads = sorted(r["count"] for r in out.groupBy("reviewer").count().collect())
    assert loads == [33, 33, 34, 34, 34] and out.distinct().count() == 168 and out.groupBy("sample").agg(F.count_distinct("reviewer").alias("n")).where("n <> 2").count() == 0
    with pytest.raises(ValueError, match="2 different reviewers of 1"):
        R.round_robin(samples, "sample", 1, 2, 1)


def test_interpolation_of_one_long_series(spark):
    import random

    rng = random.Random(6)
    known = [rng.random() if rng.random() < 0.02 else None for _ in range(3000)]
    known[:40], known[-40:] = [None] * 40, [None] * 40
    df = spark.createDataFrame([(k, v) for k, v in enumerate(known)], "k long, v double").repartition(5)
    out = R.interpolated(df, None, ["k"], "v")
    at = [k for k, v in enumerate(known) if v is not None]

    def wanted(k):
        before, after = max((x for x in at if x <= k), default=None), min((x for x in at if x >= k), default=None)
        if before is None:
            return None
        return known[before] if after is None or after == before else known[before] + (known[after] - known[before]) * (k - before) / (after - before)

    for r in out.collect():
        assert r["v"] == (None if wanted(r["k"]) is None else pytest.approx(wanted(r["k"])))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "SinglePartition" not in plan
    assert R.interpolated(df.where("v is null"), None, ["k"], "v").where("v is not null").count() == 0 and R.interpolated(df.limit(0), None, ["k"], "v").count() == 0


def test_agreement_without_pairs(spark):
    import random

    rng = random.Random(8)
    rows = [(f"s{k % 6}", f"q{k % 2}", rng.randint(1, 5), rng.choice(["a", "b", "", None])) for k in range(200)]
    df = spark.createDataFrame(rows, "sample string, question string, reviewer int, answer string")
    a, b = (df.select("sample", "question", F.col("reviewer").alias(f"{n}"), F.col("answer").alias(f"{n}_answer")) for n in ("first", "second"))
    pairs = a.join(b, ["sample", "question"]).where("first < second")
    for blank in (True, False):
        counted = C.agreement_from_counts(df, "sample", "reviewer", "answer", ["question"], blank)
        assert plain(counted.select("question", "pairs", "agreed", "percent").collect()) == plain(C.agreement(pairs, ["question"], blank).collect())
        by_reviewer = C.agreement_by_reviewer(df.where("question = 'q0'"), "sample", "reviewer", "answer", blank)
        assert plain(by_reviewer.collect()) == plain(C.agreement(pairs.where("question = 'q0'"), ["first"], blank).collect())
        assert "Join" not in counted._jdf.queryExecution().executedPlan().toString() + by_reviewer._jdf.queryExecution().executedPlan().toString()


def test_disagreements_and_kappa_without_pairs(spark):
    import random
    from collections import Counter

    rng = random.Random(9)
    rows = [(f"s{k % 9}", rng.randint(1, 4), rng.choice(["a", "b", "b", "c", None])) for k in range(120)]
    df = spark.createDataFrame(rows, "sample string, reviewer int, answer string")
    pairs = [(x, y) for s, r, x in rows for t, q, y in rows if s == t and r < q and x is not None and y is not None]
    wanted = Counter(tuple(sorted(p)) for p in pairs if p[0] != p[1])
    assert {(r["a"], r["b"]): r["n"] for r in C.disagreements(df, "sample", "reviewer", "answer").collect()} == dict(wanted)
    first, second, n = Counter(x for x, _ in pairs), Counter(y for _, y in pairs), len(pairs)
    po, pe = sum(x == y for x, y in pairs) / n, sum(first[x] * second[x] for x in first) / n**2
    (k,) = C.kappa(df, "sample", "reviewer", "answer").collect()
    assert tuple(k) == (n, pytest.approx(po), pytest.approx(pe), pytest.approx((po - pe) / (1 - pe)))
    assert C.kappa(df.limit(0), "sample", "reviewer", "answer").count() == 0


def test_kappa_sorts_once_a_task(spark):
    """rankings stand side by side, never on top of each other in one task."""
    df = spark.createDataFrame([("s", 1, "a")], "sample string, reviewer int, answer string")
    plan = C.kappa(df, "sample", "reviewer", "answer")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("Window [") == 3


def test_scores_of_mergeable_states(spark):
    scorer = catalog_tasks.TokenF1()
    rows = [(k % 3 or None, f"t{k % 4} t{k % 5}", None if k % 7 == 0 else f"t{k % 5} t{k % 4} t1") for k in range(500)]
    df = spark.createDataFrame(rows, "g int, p string, t string").repartition(9)
    got = {r["g"]: (r["macro_f1"], r["tokens"]) for r in C.merged_scores(df, scorer, "p", "t", ["macro_f1", "tokens"], ["g"]).collect()}
    for g in (1, 2, None):
        x = scorer.finish(scorer.add(scorer.start(), [p for k, p, _ in rows if k == g], [t for k, _, t in rows if k == g]))
        assert got[g] == (pytest.approx(x["macro_f1"]), x["tokens"])
    (r,) = C.merged_scores(df, scorer, "p", "t", ["tokens"]).collect()
    assert r["tokens"] == 5.0 and C.merged_scores(df.limit(0), scorer, "p", "t", ["tokens"], ["g"]).count() == 0


def test_digit_texts(spark):
    write = lambda v, form=S.SPACED: one(spark, S.digits(F.col("v"), form), v=v)
    assert write([0.29, -1.5, None, float("nan"), 0.0, 12000.0]) == "2 8 9 , -1 5 0 0 , Nan , Nan ,0 ,1 2 0 0 0 0 0 0 ,"
    assert write([-0.0001, 5.0], S.COMPACT) == "-0, 5 0 0 0, " and write([]) == ""
    with pytest.raises(Exception, match="beyond 1e\\+07"):
        write([1e8])
    read = lambda t, form=S.SPACED, **k: one(spark, S.undigits(F.col("t"), form, **k), t=t)
    assert read("2 8 9 , -1 5 0 0 , Nan ,0 ,") == [pytest.approx(x) for x in (0.2895, -1.5005, 0.0005, 0.0005)]
    assert read("-1 5 0 0, 7, ", S.COMPACT, half_step=False) == [pytest.approx(-1.5), pytest.approx(0.007)] and read("") == []


def test_digits_of_whole_batches(spark):
    """no function runs once for each number; the same texts as a fold over the powers of ten."""
    import numpy as np

    def folded(x):
        if x is None or x != x:
            return " Nan ,"
        rest, out = abs(x), []
        for k in range(6, -4, -1):
            out.append(int(rest / 10.0**k))
            rest -= out[-1] * 10.0**k
        shown = " ".join(map(str, out[next((i for i, d in enumerate(out) if d), len(out) - 1) :]))
        return (" -" if x < 0 else "") + shown + " ,"

    rng = np.random.default_rng(5)
    rows = [(k, None if k % 50 == 7 else [None if rng.random() < 0.1 else float(round(rng.uniform(-1, 1) * 10.0 ** rng.integers(-3, 8), int(rng.integers(0, 5)))) for _ in range(rng.integers(0, 6))]) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    out = df.select("id", "v", S.digits(F.col("v")).alias("t"), S.undigits(S.digits(F.col("v"))).alias("back"), S.decimals(S.undigits(S.digits(F.col("v"))), 4).alias("shown"))
    for r in out.collect():
        if r["v"] is None:
            assert r["t"] is None and r["back"] is None and r["shown"] is None
        else:
            assert r["t"] == "".join(map(folded, r["v"])) and len(r["back"]) == len(r["v"])
            assert r["back"] == pytest.approx([(x or 0) + (0.0005 if (x or 0) >= 0 else -0.0005) for x in r["v"]], abs=0.0011)
            assert r["shown"] == "[" + ", ".join(f"{x:.4f}" for x in r["back"]) + "]"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "ArrowEvalPython" in plan


def test_digits_cost_few_folds():
    """putting digits into texts takes a small multiple of cutting them off, in every format."""
    import time

    import numpy as np
    import pyarrow as pa

    from wavemill.functions import digits as D

    def folded(x, form):
        if x is None or x != x:
            return form.missing + form.separator
        rest, out = abs(x), []
        for k in range(form.whole - 1, -form.decimals - 1, -1):
            out.append(int(rest / 10.0**k))
            rest -= out[-1] * 10.0**k
        shown = form.digit_separator.join(map(str, out[next((i for i, d in enumerate(out) if d), len(out) - 1) :]))
        return (form.minus if x < 0 else "") + shown + form.separator

    rng = np.random.default_rng(3)
    odd = [1e7, -1e7, 0.0, -0.0, 0.29, -0.0004, 5e-324, float(np.nextafter(1e7, 0)), float(np.nextafter(1.0, 0)), None, float("nan")]
    mixed = odd + [float(v) for v in rng.uniform(-1, 1, D.AT_ONCE) * 10.0 ** rng.integers(-6, 8, D.AT_ONCE)] + odd
    for form in (D.SPACED, D.COMPACT, D.DigitFormat(";", "", "", "", 3, 0, 1e9), D.DigitFormat(minus="\u2212", whole=140, decimals=5)):
        lists = pa.array([mixed[:5], None, [], mixed[5:]], pa.list_(pa.float64()))
        assert D.write_digits(lists, form).to_pylist() == ["".join(folded(x, form) for x in v) if v is not None else None for v in lists.to_pylist()]

    x = rng.uniform(-1e7, 1e7, 1 << 18)
    lists = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))

    def fold():
        rest = np.abs(x)
        for k in range(6, -4, -1):
            rest = rest - np.trunc(rest / 10.0**k) * 10.0**k

    def least(f):
        took = []
        for _ in range(7):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: D.write_digits(lists, D.SPACED)) < 10 * least(fold)  # 18 folds before, 7 now


def test_context_sentences(spark):
    say = lambda found=None, truthy=False, **record: one(spark, L.context_sentence({k: F.lit(v) for k, v in record.items()}, None if found is None else F.lit(found), truthy))
    assert say(age=61.9, sex=1.0, recording_date="x", device=" AT-6 ", baseline_drift="V1", burst_noise=" ", static_noise="y", extra_beats="1ES", pacemaker=None) == "61-year-old male patient. 12-lead ECG. clinical recording. recorded with AT-6. Signal quality: baseline drift noted, static noise present. extra beats detected during recording."
    assert say() == "12-lead ECG Signal quality: adequate for analysis. ." and say(sex=0, pacemaker="") == "female patient 12-lead ECG. Signal quality: adequate for analysis."
    assert say(found=False, age=5) == "12-lead ECG recording. Signal quality adequate for analysis."
    assert say(truthy=True, age=3.0, burst_noise=None, pacemaker=None) == "3-year-old 12-lead ECG. Signal quality: burst noise present. pacemaker present."
