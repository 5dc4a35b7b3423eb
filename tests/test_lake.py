"""Layers, payload details, matrix, checks, stages and experiments on small fixtures."""

import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pitlake.operators import checks, experiments, latest, matrix, metrics, quality, ranks, stages
from pitlake.sources import details, layers, stores


def test_raw_payloads_are_written_once(spark, tmp_path):
    root = str(tmp_path)
    assert set(layers.initialize(spark, root)) == {"raw", "bronze", "silver", "gold"}
    assert open(layers.write_raw(spark, root, "a/b.json", b"\x00x").removeprefix("file:"), "rb").read() == b"\x00x"
    with pytest.raises(FileExistsError):
        layers.write_raw(spark, root, "a/b.json", b"y")
    for bad in ("../x", "/etc/x", "", "a/../../x"):
        with pytest.raises(ValueError):
            layers.write_raw(spark, root, bad, b"y")


def test_reports_and_fingerprints(spark, tmp_path):
    assert layers.canonical_json({"b": [1, None], "a": "é"}) == '{"a":"é","b":[1,null]}'.encode()
    one, two = {"x": 1, "certified_at": "now"}, {"certified_at": "then", "x": 1}
    assert layers.fingerprint(one) == layers.fingerprint(two) != layers.fingerprint({"x": 2}) and len(layers.fingerprint(one)) == 16
    path = layers.write_artifact(spark, str(tmp_path), one)
    assert layers.write_artifact(spark, str(tmp_path), two) == path and json.load(open(path)) == one


def test_requests():
    assert layers.request(season=2024, this_year=2024) == {"season": 2024}
    assert layers.request(start=dt.date(2024, 1, 1), end=dt.date(2024, 1, 2)) == {"startDate": "2024-01-01", "endDate": "2024-01-02"}
    for bad in ({}, {"season": 1875}, {"season": 2026, "this_year": 2024}, {"season": True}, {"season": 2024, "start": dt.date(2024, 1, 1)}, {"start": dt.date(2024, 1, 2), "end": dt.date(2024, 1, 1)}, {"start": dt.date(2024, 1, 1)}):
        with pytest.raises(ValueError):
            layers.request(**bad)


def test_fetch_retries_and_waits():
    slept, calls = [], []

    def get(statuses):
        calls.append(1)
        if statuses:
            raise layers.FetchError(statuses.pop(0))
        return "ok"

    run = lambda statuses, **k: layers.fetch(lambda: get(statuses), sleep=slept.append, clock=lambda: 0.0, **k)
    assert run([500, 429, None]) == "ok" and slept == [0.5, 0.4, 1.0, 0.4, 2.0, 0.4]
    calls.clear()
    for left in ([404], [500] * 9):
        with pytest.raises(layers.FetchError):
            run(left)
    assert len(calls) == 5


def test_ingest_refuses_other_content(spark, tmp_path):
    parse = lambda df: df.select(F.inline(F.from_json("payload", "array<struct<id bigint, v string>>")))
    go = lambda name, rows, **k: layers.ingest(spark, str(tmp_path), name, layers.canonical_json(rows), parse, f"{tmp_path}/store", ["id"], **k)
    assert go("1", [{"id": 1, "v": "a"}])["appended"] == 1
    assert go("2", [{"id": 1, "v": "a"}, {"id": 2, "v": "b"}]) | {"sha256": ""} == {"sha256": "", "appended": 1, "skipped": 1}
    with pytest.raises(stores.KeyConflict):
        go("3", [{"id": 2, "v": "other"}])
    with pytest.raises(ValueError):
        go("4", [], published="0" * 64)


def test_store_that_cannot_be_read_raises(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.parquet").write_text("no parquet")
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    with pytest.raises(Exception, match="not a Parquet file"):
        stores.append_new(df, str(tmp_path / "s"), ["id"])


def test_flatten(spark):
    df = spark.createDataFrame([(1, ((2, "x"), 3))], "a int, b struct<c: struct<d: int, e: string>, f: int>")
    assert layers.flatten(df).collect()[0].asDict() == {"a": 1, "b_c_d": 2, "b_c_e": "x", "b_f": 3}


@pytest.mark.parametrize("coded, detailed, abstract, want", [("F", "Postponed", None, True), ("O", None, None, True), ("S", None, "Final", False), ("X", "Suspended: rain", "Final", False), (None, "Game Over", "Final", True), (None, None, "Live", False), (None, None, None, False)])
def test_completed_lifecycle(spark, coded, detailed, abstract, want):
    row = spark.createDataFrame([(coded, detailed, abstract)], "c string, d string, a string")
    assert row.select(details.completed_lifecycle(F.col("c"), F.col("d"), F.col("a")).alias("x")).collect()[0].x is want


@pytest.mark.parametrize("text, kind, want", [("5", "bigint", 5), ("null", "bigint", None), ("true", "boolean", True), ('"x"', "string", "x"), ("true", "bigint", ValueError), ("5.0", "bigint", ValueError), ('"5"', "bigint", ValueError), ("1", "boolean", ValueError), ("1", "string", ValueError)])
def test_strict_types(spark, text, kind, want):
    x = spark.createDataFrame([(text,)], "j string").select(details.strict(F.parse_json("j"), kind).alias("x"))
    if want is ValueError:
        with pytest.raises(PySparkException):
            x.collect()
    else:
        assert x.collect()[0].x == want


def test_hollow_payloads(spark):
    line = {"inningsPitched": "6.1", "outs": 19, "pitchesThrown": 90, "earnedRuns": 1, "hits": 4, "baseOnBalls": 1, "strikeOuts": 6, "battersFaced": 24}
    idle = {k: "0.0" if k == "inningsPitched" else 0 for k in line}

    def payload(pk, home, away):
        side = lambda rows: {"team": {"id": 1}, "pitchers": [i for i, _ in rows], "players": {f"ID{i}": {"person": {"id": i}, "stats": {"pitching": s}} for i, s in rows}}
        return pk, json.dumps({"gamePk": pk, "liveData": {"boxscore": {"teams": {"home": side(home), "away": side(away)}}}})

    good = [(7, line)]
    rows = [payload(1, good, good), payload(2, good, []), payload(3, good, []), payload(4, [(7, {})], good), payload(5, [(7, line | {"outs": True})], good), payload(6, [(7, line | {"inningsPitched": "6.3"})], good),
            payload(8, [(7, {k: v for k, v in line.items() if k != "hits"})], good), payload(9, [(7, line), (7, line)], good), payload(10, [(7, idle)], good), payload(11, good, good)]
    df = spark.createDataFrame(rows, "game_pk long, payload string")
    done = spark.createDataFrame([(pk, pk != 3) for pk, _ in rows if pk != 11], "game_pk long, completed boolean")
    assert {r.game_pk: r.reason for r in details.hollow(df, done).collect()} == {2: "no_active_pitcher", 4: "empty_stats", 5: "whole_numbers", 6: "innings", 8: "missing_stats", 9: "pitcher_ids", 10: "no_active_pitcher"}
    with pytest.raises(PySparkException):
        details.load_details(df.union(df.limit(1))).collect()
    with pytest.raises(PySparkException):
        details.load_details(df.withColumn("game_pk", F.col("game_pk") + 1)).collect()


def test_rebuild_publishes_nothing_that_miscounts(spark, tmp_path):
    a, b = spark.range(3), spark.range(5)
    assert details.rebuild({"x": a}, str(tmp_path), {"x": 3}) == {"x": 3}
    with pytest.raises(ValueError):
        details.rebuild({"x": b}, str(tmp_path), {"x": 6})
    assert spark.read.parquet(f"{tmp_path}/x").count() == 3


GAMES = "game_pk long, game_date date, home_team_id long, away_team_id long, game_type string"
D = dt.date(2024, 4, 1)
PASSED = {"status": "PASS", "dataset": {"fingerprint": "f"}}


def fixture(spark, **change):
    games = change.get("games") or [(1, D, 10, 20, "R"), (2, D, 20, 10, None), (3, D, 10, 20, "S"), (4, D, 30, 40, "R")]
    team = change.get("team") or [(1, 10, 5, 0.5, True), (1, 20, 3, None, False), (2, 10, 1, 1.0, None), (2, 20, 2, 2.0, True)]
    results = [(1, 10, 4, True), (1, 20, 2, False), (2, 10, None, None), (2, 20, None, None)]
    comp = spark.createDataFrame(team, "game_pk long, team_id long, n int, rate double, hot boolean")
    return matrix.build(spark.createDataFrame(games, GAMES), {"team": comp}, spark.createDataFrame(results, "game_pk long, team_id long, score int, is_winner boolean"), change.get("certification", PASSED))


def test_matrix(spark):
    m, excluded = fixture(spark)
    assert m.columns[5:-1] == ["away_team_hot", "away_team_n", "away_team_rate", "diff_team_n", "diff_team_rate", "home_team_hot", "home_team_n", "home_team_rate"]
    got = {r.game_pk: r for r in m.collect()}
    assert set(got) == {1, 2} and got[1].diff_team_n == 2 and got[1].diff_team_rate is None and got[1].home_win is True and got[1].build_id == "f"
    assert got[2].home_team_n == 2 and got[2].home_win is None
    assert [tuple(r) for r in excluded.collect()] == [(4, ["team"])]


@pytest.mark.parametrize("change", [{"games": [(1, D, 10, 10, "R")]}, {"games": [(1, D, 10, 20, "R"), (1, D, 10, 20, "R")]}, {"team": [(1, 10, 5, 0.5, True)]}, {"team": [(1, 10, 5, 0.5, True)] * 2 + [(1, 20, 1, 1.0, True)]}])
def test_matrix_raises(spark, change):
    with pytest.raises(Exception, match="more than one row|one-sided|two teams"):
        fixture(spark, **change)[0].collect()


def test_matrix_gates(spark):
    for bad in ({}, {"status": "FAIL", "dataset": {"fingerprint": "f"}}, {"status": "PASS"}):
        with pytest.raises(matrix.NotCertified):
            fixture(spark, certification=bad)
    x = spark.createDataFrame([(float(i), None if i % 2 else 1.0, 0.0, 1.0 if i % 30 else float("nan")) for i in range(60)], "a double, b double, c double, d double")
    report = matrix.completeness(x, x.columns)
    assert {r.column: r.status for r in report.collect()} == {"a": "PASS", "b": "FAIL", "c": "FAIL", "d": "FAIL"}
    assert [r.column for r in report.collect()][:2] == ["b", "d"]
    assert {r.status for r in matrix.completeness(x, x.columns, "inference").collect()} == {"PASS", "WARN"}
    with pytest.raises(matrix.Incomplete, match="b, c, d"):
        matrix.require_complete(report)
    matrix.require_complete(matrix.completeness(x, ["a"]))
    with pytest.raises(ValueError):
        matrix.locked("Status: Proposed")
    s = spark.createDataFrame([(2024,), (None,)], "season int")
    assert matrix.without_holdout(s, "season", 2025).count() == 2
    with pytest.raises(PySparkException):
        matrix.without_holdout(s, "season", 2024).collect()


def test_bullpen_classification(spark):
    df = spark.createDataFrame([(True, 3), (False, 1), (None, 1), (None, 2)], "f boolean, o int")
    assert [r.x for r in df.select(matrix.is_bullpen(F.col("f"), F.col("o")).alias("x")).collect()] == [False, True, False, True]
    with pytest.raises(PySparkException):
        df.select(matrix.is_bullpen(F.col("f"), F.lit(None).cast("int")).alias("x")).collect()


def test_measure_counts_and_names_the_first(spark):
    df = spark.range(100).withColumn("v", F.when(F.col("id") % 2 == 0, F.col("id")))
    got = {r.check: r for r in checks.measure(df, [checks.Rule("even", F.col("v") >= 0, F.lpad(F.col("id").cast("string"), 3, "0")), checks.Rule("none", F.col("id") < 0, F.col("id")), checks.Rule("warn", F.col("id") > 97, F.col("id"), "WARN")]).collect()}
    assert (got["even"].status, got["even"].failing_count, got["even"].failing) == ("FAIL", 50, [f"{2 * i:03}" for i in range(20)])
    assert (got["none"].status, got["none"].failing_count, got["none"].failing) == ("PASS", 0, [])
    assert (got["warn"].status, got["warn"].failing) == ("WARN", ["98", "99"])
    assert quality.verdict(checks.measure(df.limit(0), [checks.Rule("x", F.lit(True), F.lit("r"))])).collect()[0].verdict == "PASS"


def test_stages():
    ticks = iter(range(100))
    run = lambda **k: [(r["stage"], r["status"], r["result"], r["error"]) for r in stages.run_stages([("a", lambda d: 1), ("b", lambda d: 1 / 0), ("c", lambda d: d["a"] + 1)], clock=lambda: float(next(ticks)), **k)]
    assert run() == [("a", "ok", 1, None), ("b", "failed", None, "ZeroDivisionError: division by zero"), ("c", "skipped", None, None)]
    assert run(required=["a"])[2] == ("c", "ok", 2, None)


def test_running_total_and_tail(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice([None, *range(40)]), rng.randrange(5)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, n int").groupBy("g", "x").agg(F.sum("n").alias("n"))
    for parts in (2, 7, 128):
        for r in ranks.running_total(df, "x", "n", "upto", ["g"], parts).collect():
            assert r.upto == sum(n for g, x, n in rows if g == r.g and (x is None or (r.x is not None and x <= r.x)))
    for n in (0, 1, 7, 10, 25):
        days = [dt.date(2024, 1, 1 + rng.randrange(4)) for _ in range(n)]
        got = latest.tail_split(spark.createDataFrame(list(enumerate(days)), "k int, d date"), "d", "k", 0.2).collect()
        order = sorted((d, k) for k, d in enumerate(days))
        assert {r.k for r in got if r.calibration} == {k for _, k in order[n - round(n * 0.2) :]} and len(got) == n


def test_reliability_curve_has_empty_bins(spark):
    df = spark.createDataFrame([(0.05, 1), (0.45, 0), (0.45, 1), (1.0, 1)], "p double, y int")
    got = {r.bin: (r.n, r.mean_p, r.rate) for r in metrics.reliability_curve(df, "y", "p").collect()}
    assert got[4] == (2, 0.45, 0.5) and got[5] == (0, None, None) and got[9] == (1, 1.0, 1.0) and len(got) == 10


def test_experiment_rules(spark):
    assert list(experiments.variants({"a": ["x"], "b": ["y", "z"]})) == ["all", "leave_one_out:a", "leave_one_out:b", "incremental:a"]
    assert len(experiments.tuning_grid()) == 20 and experiments.tuning_grid()[-1] == {}
    folds = experiments.window_folds([2021, 2022, 2023, 2024, 2025])
    assert [s for _, s in folds["expanding"]] == [2022, 2023, 2024, 2025] and folds["rolling_2"] == [((2022, 2023), 2024), ((2023, 2024), 2025)]
    assert experiments.flags({"log_loss": 0.01, "roc_auc": -0.05}, 0.01) == ["modest_holdout_log_loss_degradation", "holdout_auc_drop", "probabilities_not_extreme"]
    assert experiments.flags({"log_loss": None, "roc_auc": None}, 0.5) == []
    df = spark.createDataFrame([("f", "w", 3.0), ("f", "w", 1.0), ("f", "w", -2.0), ("g", "w", -1.0)], "family string, window string, d double")
    assert {r.family: (r.total, r.largest_share, r.concentrated) for r in experiments.concentration(df, "d").collect()} == {"f": (4.0, 0.75, True), "g": (0.0, None, False)}


def test_future_games_change_no_earlier_feature(spark, tmp_path):
    """Orders after the last day leave every earlier row of the matrix as it was."""
    from pitlake.plans import league
    from pitlake.plans.base import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    last = t.orders.agg(F.max("o_orderdate").alias("d")).collect()[0].d

    class Later(Tables):
        orders = property(lambda self: t.orders.unionByName(t.orders.withColumns({"o_orderkey": F.col("o_orderkey") + 10_000_000, "o_orderdate": F.col("o_orderdate") + F.expr("interval 9 years"), "o_totalprice": F.lit(1e6)})))

    before = league.built(t)[0].drop("build_id")
    after = league.built(Later(spark, t.sf_dir))[0].drop("build_id").where(F.col("game_date") <= F.lit(last))
    assert before.count() > 500 and before.exceptAll(after).count() == 0
