"""All checks in order, their certification, requests and fetches, canonical JSON and free slices over the driver's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.operators import checks, metrics, modelling
from pitlake.plans.base import Tables, query
from pitlake.plans.feeds import shared_folder
from pitlake.plans.league import COVERAGE_SQL, MATRIX_SQL, STRUCTURAL, WARNINGS, checks_sql, coverage, games, structural
from pitlake.plans.metrics import LL, P, predictions
from pitlake.sources import layers

r6 = lambda c: F.round(c, 6)


def seasons_of(t: Tables) -> list[int]:
    found = t.orders.select(F.year("o_orderdate").alias("s")).where("s IS NOT NULL").distinct().collect()  # a row a season
    return sorted(r["s"] for r in found)


SEASONS = "s AS (SELECT DISTINCT year(o_orderdate) AS season FROM orders WHERE o_orderdate IS NOT NULL)"


@query("i18_fold_check", f"""WITH {SEASONS}, l AS (SELECT max(season) AS last FROM s) SELECT 'before the holdout' AS folds, 'PASS' AS status, 0::BIGINT AS failing_count
UNION ALL SELECT 'over the holdout', 'FAIL', (SELECT count(*) FROM s, l WHERE season >= last - 1 AND season > (SELECT min(season) FROM s)) + 1 FROM l""")
def fold_check(t: Tables) -> DataFrame:
    """Folds that stop before the holdout season pass; one that is also a development season is found in its own and each later fold."""
    s = seasons_of(t)
    before = checks.folds(t.spark, modelling.expanding_folds(s[:-1]), s[:-1], s[-1], "before the holdout")
    over = checks.folds(t.spark, modelling.expanding_folds(s), s, s[-2], "over the holdout")
    return before.unionByName(over).select(F.col("check").alias("folds"), "status", "failing_count")


ALL_SQL = f"""every AS (SELECT 0 AS pos, 'structural' AS "group", "check", status FROM ({checks_sql(STRUCTURAL, WARNINGS)}) UNION ALL SELECT 1, 'semantic', "check", status FROM ({COVERAGE_SQL}) UNION ALL SELECT 2, 'leakage', 'leakage.chronological_folds', 'PASS')"""


def all_checks(t: Tables) -> DataFrame:
    s = seasons_of(t)
    leakage = checks.folds(t.spark, modelling.expanding_folds(s[:-1]), s[:-1], s[-1])
    return checks.run_all([("structural", structural(t)), ("semantic", coverage(t)), ("leakage", leakage)])


@query("m01_all_checks", f"WITH {MATRIX_SQL}, {ALL_SQL} SELECT * FROM every")
def run_all(t: Tables) -> DataFrame:
    """Structural, semantic and leakage checks in this order."""
    return all_checks(t)


@query("a36_certification", f"""WITH {MATRIX_SQL}, {ALL_SQL} SELECT CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'WARN') AS warned, count(*) FILTER (status = 'FAIL') AS failed, (SELECT count(*) FROM games) AS games, 1::BIGINT AS files FROM every""")
def certification(t: Tables) -> DataFrame:
    """The artifact of a build under the name of its fingerprint, written twice and there once."""
    results, folder = all_checks(t), shared_folder(t, "certifications")
    made = checks.certify({"games": games(t)}, results, "1", "2024-01-01T00:00:00Z")
    paths = {layers.write_artifact(t.spark, folder, made | {"certified_at": at}) for at in ("2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z")}
    back = t.spark.read.schema("status string, summary struct<pass: bigint, warn: bigint, fail: bigint>, dataset struct<games: struct<rows: bigint>>").option("multiLine", True).json(folder)
    return back.select("status", F.col("summary.pass").alias("passed"), F.col("summary.warn").alias("warned"), F.col("summary.fail").alias("failed"), F.col("dataset.games.rows").alias("games"), F.lit(len(paths)).cast("long").alias("files"))


@query("a05_requests", f"WITH {SEASONS} SELECT season, season BETWEEN 1876 AND 2025 AS season_ok, season % 2 = 0 AS range_ok FROM s")
def requests(t: Tables) -> DataFrame:
    """Requests by season or by a range of dates that ends after it begins."""
    def valid(**k) -> bool:
        try:
            return bool(layers.request(this_year=2024, **k))
        except ValueError:
            return False

    days = lambda s: (dt.date(s, 4, 1), dt.date(s, 9, 30)) if s % 2 == 0 else (dt.date(s, 9, 30), dt.date(s, 4, 1))
    rows = [(s, valid(season=s), valid(start=days(s)[0], end=days(s)[1])) for s in seasons_of(t)]
    return t.spark.createDataFrame(rows, "season int, season_ok boolean, range_ok boolean")


@query("a15_fetch", """SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 4 END::BIGINT AS calls, CASE n_nationkey % 5 WHEN 1 THEN 1.5 WHEN 3 THEN 0.5 WHEN 4 THEN 3.5 ELSE 0.0 END::DOUBLE AS waited, n_nationkey % 5 NOT IN (2, 4) AS fetched FROM nation""")
def fetches(t: Tables) -> DataFrame:
    """Failing requests tried again after growing waits; client errors but 429 aren't."""
    answers = {0: [], 1: [500, None], 2: [404], 3: [429], 4: [503] * 9}  # what fails before an answer comes

    def run(n: int) -> tuple[int, float, bool]:
        left, now, calls = list(answers[n % 5]), [0.0], []

        def get():
            calls.append(now[0])
            if left:
                raise layers.FetchError(left.pop(0))
            return "payload"

        def sleep(s: float) -> None:
            now[0] += s

        try:
            got = layers.fetch(get, sleep=sleep, clock=lambda: now[0]) == "payload"
        except layers.FetchError:
            got = False
        return len(calls), now[0], got

    return t.spark.createDataFrame([(r["n_nationkey"], *run(r["n_nationkey"])) for r in t.nation.select("n_nationkey").collect()], "n_nationkey int, calls long, waited double, fetched boolean")  # requests run on the driver


@query("a16_canonical_json", """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || CASE WHEN c_nationkey % 5 = 0 THEN 'null' ELSE c_nationkey::VARCHAR END || '}') AS sha FROM customer""")
def canonical(t: Tables) -> DataFrame:
    """Rows as compact JSON with sorted keys, hashed."""
    x = t.customer.select("c_name", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey")).alias("c_nationkey"), "c_custkey")
    return x.select("c_custkey", F.sha2(layers.canonical_column(x.columns), 256).alias("sha"))


SLICE = "CASE WHEN grp = 0 THEN NULL WHEN p < 0.5 THEN 'low ' || event_type ELSE 'high' END"


@query("l02_slices_by_label", f"WITH {P}, l AS (SELECT {SLICE} AS slice, p, y FROM x) SELECT slice, count(*) AS n, round({LL}, 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier FROM l WHERE slice IS NOT NULL GROUP BY 1")
def slices_by_label(t: Tables) -> DataFrame:
    """Metrics by any label of a row; rows without one are left out."""
    m = metrics.slice_by(predictions(t), F.expr(SLICE), "y", "p")
    return m.select("slice", "n", r6(F.col("log_loss")).alias("log_loss"), r6(F.col("brier")).alias("brier"))
