"""Small frames: nulls, ties, empty and one-row groups, values at a limit."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from robolake.functions.columns import bin_of, wilson
from robolake.operators import evaluation, ledger, quality, recursive, release, timeline

S = timeline.SECOND


def vals(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_wilson_bounds(spark):
    df = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (3, 7)], "k long, n long")
    p, lo, hi = wilson(F.col("k"), F.col("n"))
    for r in df.select("k", "n", p.alias("p"), lo.alias("lo"), hi.alias("hi")).collect():
        if r.n == 0:
            assert r.p is None and r.lo is None and r.hi is None
        else:
            assert -1e-9 <= r.lo <= r.p + 1e-9 and r.p - 1e-9 <= r.hi <= 1 + 1e-9


def test_bins(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.5, 0.999, 1.0, 2.0)], "x double").select(bin_of(F.col("x"), 0.0, 1.0, 10).alias("b"))
    assert [r.b for r in df.collect()] == [0, 1, 6, 10, 10, 11]


def test_asof_strict_tolerance_and_ties(spark):
    left = spark.createDataFrame([("a", 1, 100), ("a", 2, 10), ("b", 3, 50), (None, 4, 100)], "entity string, id long, us long")
    right = spark.createDataFrame(
        [("a", 100, 9.0, 1), ("a", 90, 1.0, 2), ("a", 90, 2.0, 3), ("a", 0, 5.0, 4), ("c", 1, 1.0, 5)],
        "entity string, us long, value double, id long"
    )
    got = {r.id: r.match_value for r in timeline.align_asof(left, right, "entity", "us", 10, "value", "id").collect()}
    assert got == {1: 2.0, 2: 5.0, 3: None, 4: None}


def test_asof_against_brute_force(spark):
    import random

    rnd = random.Random(5)
    ls = [(rnd.choice("ab"), i, rnd.randrange(300)) for i in range(120)]
    rs = [(rnd.choice("ab"), rnd.randrange(300), float(i), i) for i in range(150)]
    got = {
        r.id: r.match_id for r in timeline.align_asof(
            spark.createDataFrame(ls, "entity string, id long, us long"),
            spark.createDataFrame(rs, "entity string, us long, value double, id long"), "entity", "us", 17, "value", "id"
        ).collect()
    }
    for e, i, us in ls:
        near = [(r[1], r[3]) for r in rs if r[0] == e and r[1] < us and us - r[1] <= 17]
        assert got[i] == (max(near)[1] if near else None)


def test_tickets_gap_at_limit_stays(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 30, 2), ("a", 61, 3), ("b", 5, 4)], "entity string, us long, id long")
    assert vals(
        timeline.tickets(df, "entity", "us", "id", 30), "entity", "first_us", "last_us", "n_events"
    ) == [("a", 0, 30, 2), ("a", 61, 61, 1), ("b", 5, 5, 1)]


def test_clean_reasons(spark):
    rows = [(1, None), (2, "  "), (3, "short"), (4, "#" * 60), (5, "line that repeats\n" * 9), (6, "good text with many letters and no other signs in it at all")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = dict(vals(quality.clean(df, "text", F.length("text")), "id", "reason"))
    assert got == {1: "null", 2: "empty", 3: "short", 4: "symbols", 5: "repeated", 6: None}


def test_clean_no_deviation(spark):
    df = spark.createDataFrame([(1, "x" * 60), (2, "x" * 60)], "id long, text string")
    assert quality.clean(df, "text", F.length("text")).filter("reason is not null").count() == 0


def test_dedup_and_balance(spark):
    df = spark.createDataFrame([(2, " A  b"), (1, "a B "), (3, "c"), (4, None)], "id long, text string")
    assert vals(quality.dedup_exact(df, "id", "text"), "id", "copies") == [(1, 2), (3, 1), (4, 1)]
    b = spark.createDataFrame([(i, "x" if i < 5 else "y") for i in range(7)], "id long, cls string")
    assert vals(quality.balance(b, "cls", "id").groupBy("cls").count(), "cls", "count") == [("x", 2), ("y", 2)]
    assert quality.balance(b, "cls", "id", 1).count() == 2


def test_redaction_leaves_nothing(spark):
    df = spark.createDataFrame([(1, "me@x.org 10.0.0.1 +49 30 1234567 " + "a" * 32), (2, None)], "id long, text string")
    red = quality.redact(df, "text").filter("id = 1").first()["text"]
    assert red == "<EMAIL> <IP> <PHONE> <SECRET>"
    assert quality.redaction_report(quality.redact(df, "text"), "text", "id").agg(F.sum("n")).first()[0] == 0


def test_split_is_stable(spark):
    df = spark.range(500)
    a = {r.id: r.split for r in quality.split(df, "id").collect()}
    assert a == {r.id: r.split for r in quality.split(df.filter("id % 3 = 0").unionByName(df.filter("id % 3 > 0")), "id").collect()}
    assert set(a.values()) == {"train", "val", "test"}


def test_score_flags_null(spark):
    r = quality.score(spark.createDataFrame([(1.0, None)], "a double, b double"), {"a": (F.col("a"), 1.0), "b": (F.col("b"), 3.0)}).first()
    assert r.score == 25 and r.flagged


def test_regression_missing(spark):
    df = spark.createDataFrame(
        [("x", "base", True), ("y", "cand", False)] + [("z", v, v == "base") for v in ("base", "cand") for _ in range(50)],
        "cell string, version string, ok boolean"
    )
    assert dict(
        vals(evaluation.regression(df, "cell", "version", "ok", "base", "cand"), "cell", "status")
    ) == {"x": "MISSING", "y": "MISSING", "z": "REGRESSED"}


def test_divergence_edges(spark):
    df = spark.createDataFrame([("a", 0.0, 0.5), ("a", 1.0, 0.5), ("b", 1.0, 0.0)], "g string, p double, q double")
    got = dict(vals(evaluation.divergence(df, "g", "p", "q"), "g", "kl"))
    assert got["b"] is None and got["a"] == pytest.approx(0.693147, abs=1e-6)


def test_canary_levels(spark):
    rows = [("few", "base", True)] + [("same", v, i % 2 == 0) for v in ("base", "cand") for i in range(40)] + [
        ("worse", v, v == "cand") for v in ("base", "cand") for _ in range(40)
    ]
    df = spark.createDataFrame(rows, "cell string, version string, bad boolean")
    assert dict(
        vals(release.canary(df, "cell", "version", "base", "cand", F.col("bad"), 0.0, 0.1, 30), "cell", "verdict")
    ) == {"few": "WATCH", "same": "PASS", "worse": "ROLLBACK"}


def test_acceptance_missing_fails(spark):
    df = spark.createDataFrame([("a", "m", 1.0), ("a", "n", 0.5), ("b", "m", 1.0)], "entity string, metric string, value double")
    assert dict(vals(release.acceptance(df, {"m": (0.5, 1.0), "n": (0.5, 1.0)}), "entity", "verdict")) == {"a": "YELLOW", "b": "FAIL"}


def test_degrade_resets(spark):
    df = spark.createDataFrame([("a", i, i, k) for i, k in enumerate("eegee e")], "entity string, us long, id long, kind string")
    assert [
        r.state for r in release.degrade(df, "entity", "us", "id", F.col("kind") == "e", 2, 3).orderBy("id").collect()
    ] == ["NORMAL", "DEGRADED", "NORMAL", "NORMAL", "DEGRADED", "NORMAL", "NORMAL"]


def test_reconcile_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, 5), (3, 6)], "k long, v long")
    b = spark.createDataFrame([(1, None), (2, None), (4, 1)], "k long, v long")
    assert vals(ledger.reconcile(a, b, "k", ("v",)), "k", "status") == [(2, "differs"), (3, "missing_right"), (4, "missing_left")]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "entity string, us long, id long, value double, ok boolean, version string")
    for df in (
        timeline.tickets(e, "entity", "us", "id", 5), timeline.gaps(e, "entity", "us", "id", 5),
        evaluation.success_rate(e, ("entity",), "ok"), release.degrade(e, "entity", "us", "id", F.col("ok"), 1, 2),
        timeline.resample(e, "entity", "us", "value", "id", 5), quality.split(e, "id")
    ):
        assert df.count() == 0


def test_hot_keys_are_sliced(spark):
    """Windows over keys cut into many slices give what they give over whole keys."""
    import random

    rnd = random.Random(8)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", None]), rnd.randrange(4000), i, float(rnd.randrange(50)), rnd.choice("eeo")) for i in range(700)]
    df = spark.createDataFrame(rows, "entity string, us long, id long, value double, kind string").repartition(3)
    bad = F.col("kind") == "e"
    forms = [
        lambda h: timeline.gaps(df, "entity", "us", "id", 20, h),
        lambda h: timeline.jitter(df, "entity", "us", "id", h),
        lambda h: timeline.tickets(df, "entity", "us", "id", 12, h),
        lambda h: timeline.stage_shares(df, "entity", "kind", "us", "id", ("e", "o"), h),
        lambda h: timeline.smooth(df, "entity", "us", "id", "value", 5, h),
        lambda h: timeline.ripple(df, "entity", "us", "id", "value", 7, 1.5, h),
        lambda h: timeline.trailing_mean(df, "entity", "us", "id", "value", 4, "m", h),
        lambda h: timeline.deadline_miss(df, "entity", "us", "id", 9, h),
        lambda h: timeline.predict_linear(df, "entity", "us", "id", "value", h),
        lambda h: ledger.path_length(df, "entity", "us", "id", "value", h),
        lambda h: evaluation.horizon_error(df, "entity", "us", "id", "value", (1, 3), h),
        lambda h: release.degrade(df, "entity", "us", "id", bad, 2, 3, h),
        lambda h: release.case_stats(df, "entity", "kind", "us", "id", 15, h),
    ]
    text = lambda f: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in f.collect())
    for n, form in enumerate(forms):
        assert text(form(25)) == text(form(10**9)), n


def test_slices_bound_a_window(spark):
    from robolake.functions.slices import sliced

    df = spark.range(3000).selectExpr("if(id % 2 = 0, 'hot', cast(id as string)) as k", "id as us")
    n = sliced(df, ("k",), "us", 100).groupBy("k", "__slice").count().agg(F.max("count")).first()[0]
    assert n <= 101


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_percentiles_are_exact(spark, accuracy):
    import random

    from robolake.functions.quantiles import percentiles

    rnd = random.Random(3)
    rows = [
        ("big", rnd.gauss(0, 1)) for _ in range(2000)
    ] + [("same", 7.0)] * 500 + [("few", float(i)) for i in range(6)] + [("none", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.percentile("v", 0.25).alias("q1"), F.percentile("v", 0.95).alias("p"))
    text = lambda f: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in f.select("g", "n", "q1", "p").collect())
    for few in (False, True):
        assert text(percentiles(df, ("g",), "v", {"q1": 0.25, "p": 0.95}, few, accuracy)) == text(want)
    assert percentiles(df.filter("g = 'few'"), (), "v", {"m": 0.5}).first().m == 2.5


def test_levels_and_reach_beyond_any_bound(spark):
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(15)], "src string, dst string")
    assert ledger.levels(chain).agg(F.max("level")).first()[0] == 15
    assert ledger.reachable(chain, "0").count() == 16 and ledger.reachable(chain, "0", 10).count() == 11
    for edges in ([("a", "b"), ("b", "a")], [("s", "a"), ("a", "b"), ("b", "a")]):
        with pytest.raises(ValueError, match="cycle"):
            ledger.levels(spark.createDataFrame(edges, "src string, dst string"))


def test_empty_and_failing_inputs(spark, sf):
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "id long, cls string")
    assert vals(quality.hard_cases(docs, docs.limit(0), "cls"), "cls", "n_failed", "weight") == [("x", 0, 1.0), ("y", 0, 1.0)]
    v = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    for a, b in ((v, v.limit(0)), (v.limit(0), v), (v.limit(0), v.limit(0))):
        assert evaluation.distribution_gap(a, b, "v").first()["mean_gap"] is None
    turns = spark.createDataFrame([(1, t, "u", n) for t, n in enumerate((900, 900, 100, 5000, 10))], "conv long, turn long, role string, n long")
    got = vals(quality.pack_turns(turns, "conv", "turn", F.col("n"), 1000), "part", "n_steps", "size")
    assert got == [(0, 1, 900), (1, 2, 1000), (2, 1, 5000), (3, 1, 10)]
    few = spark.createDataFrame([(i, "c") for i in range(10)], "id long, cls string")
    assert quality.balance(few, "cls", "id", 4).count() == 4 and quality.balance(few.limit(0), "cls", "id").count() == 0


def test_score_of_empty_text(spark, tmp_path):
    from robolake.plans import data

    rows = [(1, "", "en", "s", 0), (2, None, "en", "s", None), (3, "abc\nabc", "en", "s", 7)]
    spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert data.c09_score(spark, str(tmp_path)).count() == 3 and data.c09_gate(spark, str(tmp_path)).first()["n"] == 2


def test_scores_of_odd_texts_as_in_sql(spark, tmp_path):
    """An empty text, none, and texts of 2560 characters whose scores lie in the middle of two sixth decimals."""
    from compare import connect

    from robolake.plans import data

    texts = ["", None, "abc\nabc", *["a" * n + "1" * (2560 - n) for n in range(5, 1000, 10)]]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    told = lambda r: tuple(repr(v) for v in r)
    want = {told(r) for r in con.sql(data.SQL["c09_score"]).fetchall()}
    assert {told(r) for r in data.c09_score(spark, str(tmp_path)).collect()} == want
    assert {w[1] for w in want} >= {"nan", "None"}


def test_rounding_as_in_sql(spark):
    import duckdb

    from robolake.functions.columns import r6

    ties = [(2 * k + 1) / 2e6 for k in range(1, 10**8, 10_007)] + [64.0001595, -64.0001595, float("inf"), float("nan"), None]
    got = spark.createDataFrame([(x,) for x in ties], "x double").select(r6(F.col("x")).alias("r")).collect()
    con = duckdb.connect()
    assert [repr(r["r"]) for r in got] == [repr(con.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0]) for x in ties]


def test_steps_that_end_at_zero_as_in_sql(spark, tmp_path):
    from compare import connect

    from robolake.plans import robots

    values = {1: (3.0, 0.0), 2: (0.0, 0.0), 3: (-1.0, -0.0), 4: (2.0, -0.0), 5: (1.0, 2.0, 4.0), 6: (5.0, None), 7: (None, 1.0), 8: (1.0, -2.0)}
    rows = [(k * 10 + i, i * 1000, k, "view", v) for k, vs in values.items() for i, v in enumerate(vs)]
    events = spark.createDataFrame(rows, "event_id long, us long, user_id long, event_type string, value double")
    events = events.withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz")).drop("us")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    told = lambda rs: sorted(repr(tuple(r)) for r in rs)
    got = robots.c21_step(spark, str(tmp_path)).collect()
    assert told(got) == told(con.sql(robots.SQL["c21_step"]).fetchall())
    assert {repr(r["overshoot"]) for r in got} >= {"inf", "-inf", "nan", "0.0"}


def test_detections_of_one_confidence(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "RUN", 10)
    box = lambda n, conf: spark.range(n).selectExpr("id", "id % 5 as image", "0.0 + id as x0", "0.0D as y0", "2.0 + id as x1", "2.0D as y1", f"{conf} as conf")
    truth = box(60, "0.0D").filter("id % 2 = 0").drop("conf")
    for conf in ("0.5D", "cast(id % 7 as double) - 3"):
        monkeypatch.setattr(evaluation, "RUN", 10)
        small = evaluation.detections(box(60, conf), truth, "image", 0.5).first()
        monkeypatch.setattr(evaluation, "RUN", 10**9)
        assert small == evaluation.detections(box(60, conf), truth, "image", 0.5).first() and small.tp == 30


def test_report_file(spark, tmp_path):
    df = spark.createDataFrame([("a", "PASS"), ("b", "FAIL")], "entity string, verdict string")
    release.write_report(release.report_md(df, "T"), str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("part-*"))
    assert text.startswith("# T\n\n| entity | verdict |") and "| b | FAIL |" in text and "Sign-off" in text


def test_ingest_takes_files_once(spark, sf, tmp_path):
    from robolake.streaming import jobs

    for _ in range(2):
        jobs.ingest(jobs.events(spark, sf), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "c"), "value >= 10")
    good, bad = spark.read.parquet(str(tmp_path / "good")), spark.read.parquet(str(tmp_path / "bad"))
    assert good.count() + bad.count() == 1000 and good.filter("value < 10").count() == 0


def test_filter_missing_and_single(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("b", 1, 7.0)], "k string, t long, v double")
    assert vals(
        recursive.kalman(df, "k", ("t",), "v", 1.0, 4.0), "k", "t", "estimate", "variance"
    ) == [("a", 1, 2.0, 4.0), ("a", 2, 2.0, 5.0), ("b", 1, 7.0, 4.0)]
    assert recursive.control_loop(df.limit(0), "k", ("t",), "v", 1.0, 0.1, 0.2).count() == 0


def test_read_rows(spark, tmp_path):
    from robolake.sources.tables import read_rows

    (tmp_path / "a.json").write_text('{"a": 1, "b": "x"}\n{"a": 2}\n')
    (tmp_path / "a.csv").write_text("a,b\n1,x\n,y\n")
    assert vals(read_rows(spark, str(tmp_path / "a.json"), "json", "a long, b string"), "a", "b") == [(1, "x"), (2, None)]
    assert vals(read_rows(spark, str(tmp_path / "a.csv"), "csv", "a long, b string"), "a", "b") == [(1, "x"), (None, "y")]


def test_more_queries_than_one_block(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = v.filter("vec_id % 4 = 0")
    rows = lambda most: sorted(tuple(r) for r in evaluation.top_similar(v, q, "vec_id", "embedding", 5, most).collect())
    one = rows(10_000)
    assert len(one) == 5 * q.count() and rows(q.count()) == rows(q.count() - 1) == rows(7) == one


@pytest.mark.parametrize("accuracy", [20, 200, 10_000])
def test_tail_by_rank_as_in_sql(spark, tmp_path, monkeypatch, accuracy):
    """Groups above and below the sketch's accuracy, with copies, nulls, values that aren't numbers, and none but these."""
    from compare import connect

    from robolake.plans import evaluation as plans

    rnd = random.Random(accuracy)
    odd = [None, float("nan"), float("inf"), -float("inf")]
    kinds = {
        "view": [rnd.random() for _ in range(3000)], "click": [float(rnd.randrange(5)) for _ in range(999)], "error": [None] * 30, "signup": [1.0, None],
        "purchase": [rnd.choice([rnd.gauss(0, 1), rnd.gauss(0, 1), *odd]) for _ in range(2000)], None: [float("nan")] * 300 + [7.0] * 20,
    }
    rows = [(i, i * 977_000_000 % 2_592_000_000_000, i % 7, c, v) for c, vs in kinds.items() for i, v in enumerate(vs)]
    events = spark.createDataFrame(rows, "event_id long, us long, user_id long, event_type string, value double")
    events = events.withColumn("ts", F.timestamp_micros(F.col("us") + 1_704_067_200_000_000).cast("timestamp_ntz")).drop("us")
    events.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    told = lambda rs: sorted(repr(tuple(r)) for r in rs)
    want = told(con.sql(plans.SQL["e2_tail_approx"]).fetchall())
    assert told(plans.e2_tail_approx(spark, str(tmp_path)).collect()) == want
    small = lambda df, by, value: tail(df, by, value, accuracy)
    tail = evaluation.tail_approx
    monkeypatch.setattr(evaluation, "tail_approx", small)
    assert told(plans.e2_tail_approx(spark, str(tmp_path)).collect()) == want
