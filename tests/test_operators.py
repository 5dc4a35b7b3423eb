import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from pitlake.functions import odds, text
from pitlake.operators import calibration, checks, history, latest, matching, metrics, modelling, quality
from pitlake.sources import stores

D = dt.datetime


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


@pytest.mark.parametrize("price, decimal_odds", [(-150, 1 + 100 / 150), (150, 2.5), (-100, 2.0), (100, 2.0), (99, None), (0, None), (None, None), (110.5, None)])
def test_american_to_decimal(spark, price, decimal_odds):
    assert one(spark, odds.american_to_decimal(F.lit(price).cast("double"))) == decimal_odds


@pytest.mark.parametrize("p, price", [(0.5, -100), (0.6, -150), (0.4, 150), (0.0, None), (1.0, None), (math.nan, None), (0.25, 300)])
def test_probability_to_american(spark, p, price):
    assert one(spark, odds.probability_to_american(F.lit(p))) == price


def test_no_vig_sums_to_one(spark):
    m = one(spark, odds.no_vig(F.lit(-120), F.lit(110)))
    assert m.home + m.away == pytest.approx(1.0) and m.vig == pytest.approx(m.overround / m.booksum)


def test_pregame_is_strict(spark):
    t = [F.lit(D(2024, 1, 1, h)) for h in (1, 1, 2)]
    assert one(spark, odds.is_pregame(*t)) is False
    assert one(spark, odds.is_pregame(F.lit(D(2024, 1, 1, 0)), *t[1:])) is True


def test_names(spark):
    df = spark.createDataFrame([("  St. Louis  ",), ("Montréal É.",), ("Straße",), (None,)], "n string")
    assert [r.x for r in df.select(text.folded_name("n").alias("x")).collect()] == ["st louis", "montreal e", "strasse", None]
    assert one(spark, text.words_within(F.lit("new york"), F.lit("york new mets"))) is True
    assert one(spark, text.words_within(F.lit(""), F.lit("a"))) is False


def test_edges_move_up(spark):
    assert [one(spark, metrics.bin_of(F.lit(p))) for p in (0.0, 0.1, 0.3, 0.6, 0.7, 0.95, 1.0)] == [0, 1, 2, 5, 6, 9, 9]


def games(spark, rows):
    return spark.createDataFrame([(e, D(2024, m, d), k, x, ok) for e, m, d, k, x, ok in rows], "e string, at timestamp, k int, x int, ok boolean")


def test_last_eligible_skips_unfinished_rows(spark):
    rows = [("a", 1, 1, 1, 10, True), ("a", 1, 2, 2, 99, False), ("a", 1, 3, 3, 20, True), ("a", 1, 3, 4, 30, True), ("a", 1, 5, 5, 40, None), ("b", 1, 1, 6, 7, True)]
    out = history.last_eligible(games(spark, rows), ["e"], ["at", "k"], F.col("ok"), {"x": F.col("x")}, [2])
    assert {r.k: (r.n_L2, r.x_L2) for r in out.collect()} == {1: (0, None), 2: (1, 10), 3: (1, 10), 4: (2, 30), 5: (2, 50), 6: (0, None)}


def test_day_window_is_inclusive_and_strictly_earlier(spark):
    rows = [("a", 1, 1, 1, 10, True), ("a", 1, 1, 2, 20, True), ("a", 1, 2, 3, 40, True), ("a", 1, 4, 4, 80, True)]
    out = history.prior_days(games(spark, rows), ["e"], "at", ["k"], {"x": F.col("x")}, [1, 3])
    assert {r.k: (r.x_1d, r.x_3d) for r in out.collect()} == {1: (0, 0), 2: (10, 10), 3: (30, 30), 4: (0, 70)}


def test_future_rows_change_nothing(spark):
    rows = [("a", 1, d, d, d, True) for d in range(1, 9)]
    run = lambda r: {x.k: (x.n_before, x.x_before) for x in history.cumulative(games(spark, r), ["e"], ["at", "k"], F.col("ok"), {"x": F.col("x")}).collect()}
    before, after = run(rows), run(rows + [("a", 2, 1, 100, 999, True)])
    assert all(after[k] == v for k, v in before.items())


def test_latest_rules(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", None, 3), ("b", None, 4), ("b", None, 5), ("c", 7, 6), ("c", 7, 7)], "k string, t int, o int")
    pick = lambda **o: {r.k: r.o for r in latest.latest(df, ["k"], F.col("t"), "o", **o).collect()}
    assert pick() == {"a": 2, "b": 4, "c": 7}
    assert pick(later_wins=False) == {"a": 2, "b": 4, "c": 6}


def test_matching_never_guesses(spark):
    ev = spark.createDataFrame([(1, "x", D(2024, 1, 1, 1)), (2, "y", D(2024, 1, 1, 2)), (3, "y", None), (4, "z", None), (5, "y", D(2024, 1, 1, 9)), (6, "w", D(2024, 1, 1, 3)), (7, None, None)], "id int, k string, st timestamp")
    ca = spark.createDataFrame([(10, "x", None), (20, "y", D(2024, 1, 1, 2)), (21, "y", D(2024, 1, 1, 5)), (30, "w", D(2024, 1, 1, 3)), (31, "w", D(2024, 1, 1, 3))], "pk int, k string, st timestamp")
    got = {r.id: (r.status, r.reason, r.pk) for r in matching.match_with_start(ev, ca, ["k"], "st", "id", "pk").collect()}
    assert got == {
        1: ("MATCHED", "unique_date_team_candidate", 10), 2: ("MATCHED", "unique_start_time_match_among_candidates", 20), 3: ("AMBIGUOUS", "doubleheader_no_event_start_time", None), 4: ("UNMATCHED", "no_date_team_candidate", None),
        5: ("AMBIGUOUS", "doubleheader_no_start_time_match", None), 6: ("AMBIGUOUS", "doubleheader_multiple_start_time_matches", None), 7: ("UNMATCHED", "no_date_team_candidate", None),
    }


def test_nearest_in_time_ties_are_ambiguous(spark):
    a = spark.createDataFrame([(1, "k", D(2024, 1, 1, 12)), (2, "k", D(2024, 1, 3, 0)), (3, "q", D(2024, 1, 1, 0))], "a int, k string, ta timestamp")
    b = spark.createDataFrame([(1, "k", D(2024, 1, 1, 11)), (2, "k", D(2024, 1, 1, 13)), (3, "k", D(2024, 1, 2, 13))], "b int, k string, tb timestamp")
    got = {r.a: (r.status, r.b) for r in matching.nearest_in_time(a, b, ["k"], "ta", "tb", "a", "b", 12 * 3600).collect()}
    assert got == {1: ("ambiguous", None), 2: ("matched", 3), 3: ("unmatched", None)}


def test_one_sided_component_raises(spark):
    g = spark.createDataFrame([(1, 10, 11), (2, 12, 13)], "game int, home int, away int")
    c = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.25)], "game int, side int, v double")
    rows, gone = matching.two_sided(c, g, "game", "side", "home", "away", ["v"])
    assert [(r.home_v, r.away_v) for r in rows.collect()] == [(0.5, 0.25)] and [r.game for r in gone.collect()] == [2]
    bad, _ = matching.two_sided(c.where("side = 10"), g, "game", "side", "home", "away", ["v"])
    with pytest.raises(Exception, match="one-sided"):
        bad.collect()


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (None, 0.3)], "y int, p double")
    assert metrics.auc(df, "y", "p").collect()[0].auc == 0.875
    assert metrics.auc(df.where("y = 1"), "y", "p").collect()[0].auc is None


def test_quality(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, None), (2, 0.0)], "k int, v double")
    f = quality.unique(df, ["k"], "k").collect()[0]
    assert (f.status, f.failing_count, f.failing) == ("FAIL", 1, ["1"])
    s = quality.column_stats(df, ["v"]).collect()[0]
    assert (s.n, s.non_null, s.n_distinct, s.all_zero, s.constant) == (3, 1, 1, True, True)
    assert quality.same_content(df.select("k"), df.select("k"), "x").collect()[0].status == "PASS"


def test_append_store(spark, tmp_path):
    path = str(tmp_path / "s")
    df = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    assert stores.append_new(df((1, "a"), (2, "b"), (2, "b")), path, ["k"]) == {"appended": 2, "skipped": 0}
    assert stores.append_new(df((2, "b"), (3, "c")), path, ["k"]) == {"appended": 1, "skipped": 1}
    with pytest.raises(stores.KeyConflict):
        stores.append_new(df((2, "z"), (9, "q")), path, ["k"])
    with pytest.raises(stores.KeyConflict):
        stores.append_new(df((5, "x"), (5, "y")), path, ["k"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_folds():
    assert modelling.expanding_folds([2, 1, 3]) == [((1,), 2), ((1, 2), 3)]
    assert modelling.rolling_folds([1, 2, 3, 4], 1, 2) == [((2,), 3), ((3,), 4)]
    with pytest.raises(ValueError):
        modelling.check_folds([((2,), 2)])


def test_recommendation():
    row = lambda v, f, *m: dict(zip(("variant", "fold", "log_loss", "brier", "ece"), (v, f, *m)))
    raw = [row("raw", f, 0.69, 0.25, 0.02) for f in (-1, 1, 2, 3)]
    good = lambda v, pooled, *folds: [row(v, -1, *pooled), *(row(v, f + 1, x, 0.25, 0.02) for f, x in enumerate(folds))]
    worse = good("isotonic", (0.70, 0.26, 0.03), 0.70, 0.70, 0.70)
    assert calibration.recommend(raw + good("sigmoid", (0.68, 0.24, 0.03), 0.68, 0.68, 0.70) + worse) == "USE PLATT"
    assert calibration.recommend(raw + good("sigmoid", (0.68, 0.24, 0.01), 0.60, 0.70, 0.70) + worse) == "KEEP RAW"  # better in one fold of three
    assert calibration.recommend(raw + good("sigmoid", (0.68, 0.26, 0.01), 0.60, 0.60, 0.60) + worse) == "KEEP RAW"
    assert calibration.recommend(raw + good("sigmoid", (0.68, 0.24, 0.03), 0.68, 0.68, 0.68) + good("isotonic", (0.68, 0.23, 0.03), 0.68, 0.68, 0.68)) == "USE ISOTONIC"


def test_split_later(spark):
    rows = [(day, key) for key, day in enumerate([3, 1, 2, 2, 2, 2, 1, 3, 2, 2])]
    df = spark.createDataFrame(rows, "day int, key int")
    for share in (0.1, 0.2, 0.5, 0.8):
        early, late = (sorted((r.day, r.key) for r in x.collect()) for x in calibration.split_later(df, "day", "key", share))
        assert early + late == sorted(rows) and len(late) == round(10 * share)
    for bad, share in ((df, 0.01), (df, 0.0), (df, 1.0), (df.limit(0), 0.5), (df.withColumn("day", F.nullif("day", F.lit(3))), 0.5)):
        with pytest.raises(ValueError):
            calibration.split_later(bad, "day", "key", share)


def test_fold_check(spark):
    found = lambda some, dev, held: checks.folds(spark, some, dev, held).collect()[0]
    assert found([((1,), 2), ((1, 2), 3)], [1, 2, 3], 4).status == "PASS"
    assert found([((3,), 2), ((2,), 2), ((4,), 5)], [4], 4).failing == ["4|holdout_in_development", "2|not_chronological", "2|train_test_overlap", "2|not_chronological", "5|holdout_in_fold"]


def test_models_as_modules_and_loaders():
    class Module:
        build_model = staticmethod(lambda: "built")

    assert modelling.builder(Module)() == "built" and modelling.builder(len) is len
    with pytest.raises(TypeError):
        modelling.builder("name")
    loaded = type("Model", (), {"transform": None})()
    assert modelling.fitted(loaded) is loaded and modelling.fitted(lambda: loaded) is loaded


def test_certification_names_content(spark):
    results = spark.createDataFrame([("a", "PASS"), ("b", "WARN")], "check string, status string")
    made = lambda n, at, found=results: checks.certify({"t": spark.range(n)}, found, "v1", at)
    one = made(3, "monday")
    assert one["status"] == "PASS" and one["warnings"] == ["b"] and one["summary"] == {"pass": 1, "warn": 1, "fail": 0}
    assert made(3, "tuesday")["fingerprint"] == one["fingerprint"] != made(4, "monday")["fingerprint"]
    assert made(3, "monday", results.union(spark.createDataFrame([("c", "FAIL")], results.schema)))["failures"] == ["c"]


def test_simulation_is_seeded(spark):
    g = spark.createDataFrame([(1, 5.0, 1.0), (2, 3.0, 3.0)], "game_pk long, home_rate double, away_rate double")
    a, b = ({r.game_pk: r for r in modelling.simulate(g.repartition(n), 4000, 3).collect()} for n in (1, 2))
    assert a == b and a[1].p_home > 0.9 and abs(a[2].p_home - 0.5) < 0.05
