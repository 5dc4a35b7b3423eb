"""Boards, reports, feature rows and experiments over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.operators import experiments, history, matrix, metrics, modelling
from pitlake.plans.base import Tables, query
from pitlake.plans.feeds import matrix as model_matrix
from pitlake.plans.feeds import stored
from pitlake.plans.league import MATRIX_SQL, built
from pitlake.plans.metrics import LL, P, auc_sql, predictions

r4 = lambda c: F.round(c, 4)
r6 = lambda c: F.round(c, 6)
r8 = lambda c: F.round(c, 8)


def window_sql(k: int, order: str, by: str) -> str:
    return f"w{k} AS (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


STARTS = "s AS (SELECT l_suppkey AS pitcher, l_orderkey * 10 + l_linenumber AS pk, l_partkey, l_shipdate::DATE AS d, year(l_shipdate) AS season, l_quantity::BIGINT AS outs, l_linenumber % 5 AS er, l_partkey % 3 AS bb, l_partkey % 7 AS k FROM lineitem)"
START_ORDER = "d, pk, l_partkey, outs"


@query("e04_starter_rows", f"""WITH {STARTS} SELECT pitcher, pk, l_partkey, outs,
  count(*) OVER y AS season_starts, coalesce(sum(outs) OVER y, 0)::BIGINT AS season_outs, round(27.0 * sum(er) OVER y / sum(outs) OVER y, 8) AS season_era, round(3.0 * sum(bb) OVER y / sum(outs) OVER y, 8) AS season_whip, round((sum(k) OVER y)::DOUBLE / nullif(sum(bb) OVER y, 0), 8) AS season_k_bb,
  date_diff('day', lag(d) OVER o, d) AS days_rest, date_diff('day', lag(d) OVER o, d) <= 4 AS short_rest,
  {', '.join(f"count(*) OVER w{n} AS n_l{n}, round(27.0 * sum(er) OVER w{n} / sum(outs) OVER w{n}, 8) AS era_l{n}, round((sum(k - bb) OVER w{n})::DOUBLE / nullif(sum(outs) OVER w{n}, 0), 8) AS kbb_l{n}" for n in (3, 5, 10))}
FROM s WINDOW y AS (PARTITION BY pitcher, season ORDER BY {START_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), o AS (PARTITION BY pitcher ORDER BY {START_ORDER}), {', '.join(window_sql(n, START_ORDER, 'pitcher') for n in (3, 5, 10))}""")
def starter_rows(t: Tables) -> DataFrame:
    """A starter's feature row: season, rest and three rolling windows, all strictly before the start."""
    s = t.lineitem.select(F.col("l_suppkey").alias("pitcher"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pk"), "l_partkey", F.to_date("l_shipdate").alias("d"), F.year("l_shipdate").alias("season"), F.col("l_quantity").cast("long").alias("outs"),
                          (F.col("l_linenumber") % 5).alias("er"), (F.col("l_partkey") % 3).alias("bb"), (F.col("l_partkey") % 7).alias("k"))
    order, own = ["d", "pk", "l_partkey", "outs"], {c: F.col(c) for c in ("outs", "er", "bb", "k")}
    x = history.cumulative(s, ["pitcher", "season"], order, F.lit(True), own, "y")
    x = history.previous(x, ["pitcher"], order, F.lit(True), F.col("d"), "last")
    x = history.last_rows(x, ["pitcher"], order, own, [3, 5, 10])
    rest = F.datediff("d", "last")
    per = lambda c, w, by: r8(history.ratio(F.col(f"{c}_{w}") * 1.0, F.col(f"outs_{w}")) * by)
    era = lambda w: r8(history.ratio(27.0 * F.col(f"er_{w}"), F.col(f"outs_{w}")))
    rolling = [c for n in (3, 5, 10) for c in (F.col(f"n_L{n}").alias(f"n_l{n}"), era(f"L{n}").alias(f"era_l{n}"), r8(history.ratio((F.col(f"k_L{n}") - F.col(f"bb_L{n}")).cast("double"), F.col(f"outs_L{n}"))).alias(f"kbb_l{n}"))]
    return x.select("pitcher", "pk", "l_partkey", "outs", F.col("n_y").alias("season_starts"), F.col("outs_y").alias("season_outs"), era("y").alias("season_era"), r8(history.ratio(3.0 * F.col("bb_y"), F.col("outs_y"))).alias("season_whip"),
                    r8(history.ratio(F.col("k_y").cast("double"), F.col("bb_y"))).alias("season_k_bb"), rest.alias("days_rest"), (rest <= 4).alias("short_rest"), *rolling)


PEN = "p AS (SELECT o_custkey AS team, o_orderkey AS pk, o_orderdate AS d, sum(l_quantity)::BIGINT AS outs, sum(l_linenumber % 4)::BIGINT AS er, sum(l_partkey % 3)::BIGINT AS bb, sum(l_partkey % 5)::BIGINT AS h, count(*) AS apps FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)"


@query("e07_bullpen_rows", f"""WITH {PEN} SELECT team, pk, {', '.join(f"coalesce(sum(outs) OVER w{n}, 0)::BIGINT AS outs_l{n}, coalesce(sum(apps) OVER w{n}, 0)::BIGINT AS apps_l{n}, CASE WHEN sum(outs) OVER w{n} > 0 THEN round(27.0 * sum(er) OVER w{n} / sum(outs) OVER w{n}, 8) END AS era_l{n}, CASE WHEN sum(outs) OVER w{n} > 0 THEN round(3.0 * sum(h + bb) OVER w{n} / sum(outs) OVER w{n}, 8) END AS whip_l{n}" for n in (1, 3, 7))}
FROM p WINDOW {', '.join(window_sql(n, 'd, pk', 'team') for n in (1, 3, 7))}""")
def bullpen_rows(t: Tables) -> DataFrame:
    """A bullpen's feature row: workload and quality over the last games, rates only where someone pitched."""
    p = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("o_orderkey") == F.col("l_orderkey"))
    s = lambda c: F.sum(c).cast("long")
    p = p.groupBy(F.col("o_custkey").alias("team"), F.col("o_orderkey").alias("pk"), F.col("o_orderdate").alias("d")).agg(
        s("l_quantity").alias("outs"), s(F.col("l_linenumber") % 4).alias("er"), s(F.col("l_partkey") % 3).alias("bb"), s(F.col("l_partkey") % 5).alias("h"), F.count(F.lit(1)).alias("apps"))
    x = history.last_rows(p, ["team"], ["d", "pk"], {c: F.col(c) for c in ("outs", "er", "bb", "h", "apps")}, [1, 3, 7])
    out = []
    for n in (1, 3, 7):
        outs, er, bb, h = (F.col(f"{c}_L{n}") for c in ("outs", "er", "bb", "h"))
        out += [outs.alias(f"outs_l{n}"), F.col(f"apps_L{n}").alias(f"apps_l{n}"), r8(F.when(outs > 0, 27.0 * er / outs)).alias(f"era_l{n}"), r8(F.when(outs > 0, 3.0 * (h + bb) / outs)).alias(f"whip_l{n}")]
    return x.select("team", "pk", *out)


@query("d53_match_statistics", "SELECT CASE WHEN event_type = 'error' THEN 'unmapped' ELSE 'mapped' END AS status, event_type AS reason, count(*) AS n, count(DISTINCT CASE WHEN event_type <> 'error' THEN user_id END) AS mapped_games FROM events GROUP BY ALL")
def match_statistics(t: Tables) -> DataFrame:
    """Matches by status and reason, mapped games counted once."""
    status = F.when(F.col("event_type") == "error", "unmapped").otherwise("mapped")
    return t.events.groupBy(status.alias("status"), F.col("event_type").alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.when(F.col("event_type") != "error", F.col("user_id"))).alias("mapped_games"))


@query("d48_concentration", f"""WITH {P}, f AS (SELECT grp AS family, 'expanding' AS "window", user_id % 4 AS fold, avg((p - y) * (p - y)) - avg((0.9 * p + 0.05 - y) * (0.9 * p + 0.05 - y)) AS benefit FROM x GROUP BY ALL),
g AS (SELECT family, "window", sum(greatest(benefit, 0)) AS total, max(greatest(benefit, 0)) AS most FROM f GROUP BY ALL)
SELECT family, "window", round(total, 6) AS total, CASE WHEN total > 0 THEN round(most / total, 6) END AS largest_share, total > 0 AND most / total > 0.5 AS concentrated FROM g""")
def fold_concentration(t: Tables) -> DataFrame:
    """Whether the benefit of a family comes from one fold."""
    q = 0.9 * F.col("p") + 0.05
    f = predictions(t).groupBy(F.col("grp").alias("family"), F.lit("expanding").alias("window"), (F.col("user_id") % 4).alias("fold")).agg((metrics.brier(F.col("y"), F.col("p")) - metrics.brier(F.col("y"), q)).alias("benefit"))
    return experiments.concentration(f, "benefit").withColumns({"total": r6(F.col("total")), "largest_share": r6(F.col("largest_share"))})


@query("m13_combo_metrics", f"WITH {P}, a AS ({auc_sql('grp, event_type')}) SELECT x.grp, x.event_type, count(*) AS n, round({LL}, 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier, round(any_value(auc), 6) AS auc FROM x JOIN a ON a.grp = x.grp AND a.event_type = x.event_type GROUP BY x.grp, x.event_type")
def combo_metrics(t: Tables) -> DataFrame:
    """Pooled metrics of each pair of model and window."""
    m = metrics.slice_metrics(predictions(t), "y", "p", ["grp", "event_type"])
    return m.select("grp", "event_type", "n", *(r6(F.col(c)).alias(c) for c in ("log_loss", "brier", "auc")))


@query("m25_edge_side", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value - 50 >= 0 END AS home_picked FROM events")
def edge_side(t: Tables) -> DataFrame:
    """The side picked by the edge alone."""
    return t.events.select("event_id", experiments.edge_side(F.when(F.col("event_id") % 5 != 0, F.col("value") - 50)).alias("home_picked"))


BOARD = """latest AS (SELECT user_id, event_id, ts, value, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_id % 3 <> 0) WHERE k = 1),
journal AS (SELECT user_id, event_id AS result_id, value > 50 AS home_won FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'purchase') WHERE k = 1)"""


def board(t: Tables) -> tuple[DataFrame, DataFrame]:
    last = F.struct("ts", "event_id")
    rows = t.events.where("event_id % 3 <> 0").groupBy("user_id").agg(F.max_by(F.struct("event_id", "value", "event_type"), last).alias("r")).select("user_id", "r.*")
    journal = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max_by(F.struct(F.col("event_id").alias("result_id"), (F.col("value") > 50).alias("home_won")), last).alias("r")).select("user_id", "r.*")
    return rows, journal


@query("c19_board_status", f"""WITH {BOARD} SELECT user_id, event_id, CASE WHEN result_id IS NULL THEN 'PENDING' WHEN home_won = (value >= 40) THEN 'WIN' ELSE 'LOSS' END AS status FROM latest LEFT JOIN journal USING (user_id)""")
def board_status(t: Tables) -> DataFrame:
    """Board rows with the status that the journal gives them."""
    rows, journal = board(t)
    status = F.when(F.col("result_id").isNull(), "PENDING").when(F.col("home_won") == (F.col("value") >= 40), "WIN").otherwise("LOSS")
    return rows.join(journal, "user_id", "left").select("user_id", "event_id", status.alias("status"))


@query("m21_resolved_rows", f"""WITH {BOARD}, v AS (SELECT l.*, result_id, home_won, event_id % 2 = 0 AS wanted FROM latest l LEFT JOIN journal USING (user_id))
SELECT user_id, event_id, home_won, value AS selected_value, event_type AS selected_kind FROM v WHERE wanted AND result_id IS NOT NULL""")
def resolved_rows(t: Tables) -> DataFrame:
    """Resolved rows of one model version, with the raw fields of the prediction brought back by its key."""
    rows, journal = board(t)
    slim = rows.where("event_id % 2 = 0").select("user_id", "event_id").join(journal, "user_id").select("user_id", "event_id", "home_won")
    raw = t.events.select("user_id", "event_id", F.col("value").alias("selected_value"), F.col("event_type").alias("selected_kind"))
    return slim.join(raw, ["user_id", "event_id"], "left")


@query("k07_pending_games", "SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') ORDER BY c_nationkey, c_custkey")
def pending_games(t: Tables) -> DataFrame:
    """Slate rows that still wait, in order: customers without an open order."""
    return t.customer.join(t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_nationkey").orderBy("c_nationkey", "c_custkey")


SIGNAL = "CASE WHEN value IS NULL THEN 'DATA WARNING' WHEN abs(value - 50) >= 45 THEN 'REVIEW LARGE EDGE' WHEN abs(value - 50) < 10 THEN 'NO EDGE' ELSE 'VALUE' END"


@query("k08_signals", f"""WITH {BOARD} SELECT user_id, event_id, {SIGNAL} AS signal, round(abs(value - 50), 6) AS edge, result_id IS NOT NULL AS resolved, count(*) OVER (PARTITION BY {SIGNAL}) AS same_signal FROM latest LEFT JOIN journal USING (user_id)""")
def signals(t: Tables) -> DataFrame:
    """One signal row a board row, and the counts of the bundle, aggregated before they are joined."""
    rows, journal = board(t)
    edge = F.abs(F.col("value") - 50)
    signal = F.when(F.col("value").isNull(), "DATA WARNING").when(edge >= 45, "REVIEW LARGE EDGE").when(edge < 10, "NO EDGE").otherwise("VALUE")
    x = rows.join(journal, "user_id", "left").select("user_id", "event_id", signal.alias("signal"), r6(edge).alias("edge"), F.col("result_id").isNotNull().alias("resolved"))
    return x.join(F.broadcast(x.groupBy("signal").agg(F.count(F.lit(1)).alias("same_signal"))), "signal")  # four labels


FAMILY = "CASE WHEN name LIKE '%_team_%' THEN 'team' ELSE 'bullpen' END"


@query("k15_feature_context", f"""WITH {MATRIX_SQL}, l AS (SELECT game_pk, unnest(['diff_team_games', 'diff_team_runs', 'diff_pen_outs']) AS name, unnest([diff_team_games::DOUBLE, diff_team_runs, diff_pen_outs::DOUBLE]) AS v FROM m),
f AS (SELECT game_pk, {FAMILY} AS family, name, v, row_number() OVER (PARTITION BY game_pk, {FAMILY} ORDER BY abs(v) DESC, name) AS k FROM l WHERE v IS NOT NULL)
SELECT game_pk, family, name, round(v, 6) AS v FROM f WHERE k = 1""")
def feature_context(t: Tables) -> DataFrame:
    """The largest difference of each family of a game's features."""
    names = ["diff_team_games", "diff_team_runs", "diff_pen_outs"]
    x = built(t)[0].select("game_pk", *(F.col(c).cast("double").alias(c) for c in names)).unpivot(["game_pk"], names, "name", "v").where("v IS NOT NULL")
    best = F.min_by(F.struct("name", "v"), F.struct((-F.abs(F.round("v", 6))).alias("a"), "name"))
    family = F.when(F.col("name").contains("_team_"), "team").otherwise("bullpen")
    return x.groupBy("game_pk", family.alias("family")).agg(best.alias("b")).select("game_pk", "family", "b.name", r6(F.col("b.v")).alias("v"))


@query("k16_prospective_report", f"""WITH {P}, s AS (SELECT 'all' AS section, 'all' AS label, p, y FROM x UNION ALL SELECT 'plays', 'all', p, y FROM x WHERE abs(p - 0.5) >= 0.02 UNION ALL SELECT 'probability', CASE WHEN p < 0.45 THEN '<45%' WHEN p < 0.65 THEN '45–65%' ELSE '65%+' END, p, y FROM x UNION ALL SELECT 'kind', event_type, p, y FROM x)
SELECT section, label, count(*) AS n, round({LL}, 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy FROM s GROUP BY ALL""")
def prospective_report(t: Tables) -> DataFrame:
    """All predictions, plays, probability buckets and slices in one grouping over stacked labels."""
    p = F.col("p")
    label = lambda s, v: F.struct(F.lit(s).alias("section"), v.alias("label"))
    every = F.array(label("all", F.lit("all")), label("plays", F.when(F.abs(p - 0.5) >= 0.02, "all")), label("probability", F.when(p < 0.45, "<45%").when(p < 0.65, "45–65%").otherwise("65%+")), label("kind", F.col("event_type")))
    x = predictions(t).select("p", "y", F.inline(F.filter(every, lambda s: s["label"].isNotNull())))
    y = F.col("y")
    return x.groupBy("section", "label").agg(F.count(F.lit(1)).alias("n"), r6(metrics.log_loss(y, p)).alias("log_loss"), r6(metrics.brier(y, p)).alias("brier"), r6(metrics.accuracy(y, p)).alias("accuracy"))


@query("k17_diagnostics", f"""WITH {P}, d AS (SELECT {LL} AS ll FROM x WHERE grp < 3), h AS (SELECT {LL} AS ll FROM x WHERE grp >= 3), e AS (SELECT avg((p < 0.4 OR p >= 0.7)::INT) AS share FROM x WHERE grp >= 3)
SELECT round(h.ll - d.ll, 6) AS log_loss_gap, round(share, 6) AS extreme_share, concat_ws(',', CASE WHEN h.ll - d.ll > 0.02 THEN 'large_holdout_log_loss_degradation' WHEN h.ll - d.ll > 0.005 THEN 'modest_holdout_log_loss_degradation' END, CASE WHEN share < 0.05 THEN 'probabilities_not_extreme' END) AS flags FROM d, h, e""")
def diagnostics(t: Tables) -> DataFrame:
    """Holdout against development, the spread of probabilities, and what they flag."""
    p = F.col("p")
    x = predictions(t).groupBy((F.col("grp") >= 3).alias("late")).agg(metrics.log_loss(F.col("y"), p).alias("loss"), F.avg(((p < 0.4) | (p >= 0.7)).cast("int")).alias("share"))
    late, early = (next(r for r in x.collect() if r["late"] == k) for k in (True, False))  # two rows
    gap = late["loss"] - early["loss"]
    return t.spark.createDataFrame([(round(gap, 6), round(late["share"], 6), ",".join(experiments.flags({"log_loss": gap}, late["share"])))], "log_loss_gap double, extreme_share double, flags string")


@query("j31_tuning_grid", """SELECT d AS max_depth, r.rate AS learning_rate, r.n AS n_estimators, x AS reg_lambda FROM (SELECT unnest([2, 3, 4]) AS d), (SELECT unnest([1.0, 5.0])::DOUBLE AS x), (VALUES (0.03::DOUBLE, 200), (0.05, 150), (0.08, 100)) r(rate, n)
UNION ALL SELECT 2, 0.03, 300, 10.0 UNION ALL SELECT NULL, NULL, NULL, NULL""")
def tuning_grid(t: Tables) -> DataFrame:
    """The candidates of the tuning pass."""
    keys = ["max_depth", "learning_rate", "n_estimators", "reg_lambda"]
    return t.spark.createDataFrame([tuple(c.get(k) for k in keys) for c in experiments.tuning_grid()], "max_depth int, learning_rate double, n_estimators int, reg_lambda double")


FEATURES = ["price", "q", "d"]
LOGISTIC = lambda columns: modelling.pipeline("logistic", columns)


def seasons_of(m: DataFrame) -> list[int]:
    return sorted(r[0] for r in m.where("season IS NOT NULL").select("season").distinct().collect())


@query("j14_rolling")
def rolling(t: Tables) -> DataFrame:
    """Expanding and rolling windows of the logistic model, ranked on the seasons that all of them test."""
    m = model_matrix(t)
    folds = experiments.window_folds(seasons_of(m))
    common = set.intersection(*({s for _, s in f} for f in folds.values()))
    p = stored(t, experiments.run_windows(m, FEATURES, folds, {"logistic": LOGISTIC}), "predictions").where(F.col("fold").isin(sorted(common)))
    x = metrics.slice_metrics(p, "label", "p", ["model", "window"])
    return x.select("model", "window", "n", *(r4(F.col(c)).alias(c) for c in ("log_loss", "brier", "accuracy", "auc")))


@query("j15_ablation")
def ablation(t: Tables) -> DataFrame:
    """Families left out and added one by one, pooled over expanding folds before the holdout season."""
    m = model_matrix(t)
    seasons = seasons_of(m)
    m = matrix.without_holdout(m.where(F.col("season") < seasons[-1]), "season", seasons[-1])
    p = stored(t, experiments.ablation(m, {"price": ["price"], "lines": ["q", "d"]}, {"expanding": modelling.expanding_folds(seasons[:-1])}, LOGISTIC), "predictions")
    return metrics.slice_metrics(p, "label", "p", ["variant", "window"]).select("variant", "window", "n", *(r4(F.col(c)).alias(c) for c in ("log_loss", "brier", "auc")))


@query("j21_holdout")
def holdout(t: Tables) -> DataFrame:
    """One fit on all earlier seasons, scored once on the last, after the lock."""
    m = model_matrix(t)
    *train, last = seasons_of(m)
    x = experiments.holdout(m, FEATURES, train, last, LOGISTIC, "Status: Accepted")
    return x.select("n", *(r4(F.col(c)).alias(c) for c in ("log_loss", "brier", "accuracy", "auc", "ece")))


@query("j32_predictions")
def out_of_sample(t: Tables) -> DataFrame:
    """Every order's probability by a model of earlier seasons, with the reason where there is none."""
    m = model_matrix(t)
    p = modelling.walk_forward(m, FEATURES, modelling.expanding_folds(seasons_of(m)), lambda: LOGISTIC(FEATURES)).select("o_orderkey", "fold", "p")
    return m.select("o_orderkey", "season", "q").join(p, "o_orderkey", "left").select("o_orderkey", "fold", F.round("p", 3).alias("p"), F.when(F.col("p").isNull(), "no_earlier_season").when(F.col("q").isNull(), "no_lines").alias("reason"))
