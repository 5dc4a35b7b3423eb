"""Aggregate, metric and check queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitlake.operators import checks, metrics, quality
from pitlake.plans.base import Tables, query
from pitlake.plans.scalars import G, NUMPY_EDGES, market

r6 = lambda c: F.round(c, 6)

#: labelled predictions: probability from an event's value, outcome from its kind
P = """x AS (SELECT event_id, user_id, event_type, least(greatest(floor(value) / 100, 0), 1) AS p, (event_id * 31 % 7 < 3)::INT AS y, user_id % 5 AS grp FROM events),
xb AS (SELECT *, list_count(list_filter([""" + ", ".join(map(repr, NUMPY_EDGES)) + """]::DOUBLE[], lambda e: p >= e)) AS b FROM x)"""


def predictions(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", "user_id", "event_type", F.least(F.greatest(F.floor("value") / 100, F.lit(0.0)), F.lit(1.0)).alias("p"),
        (F.col("event_id") * 31 % 7 < 3).cast("int").alias("y"), (F.col("user_id") % 5).alias("grp"),
    )


LL = "-avg(CASE WHEN y = 1 THEN ln(least(greatest(p, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)) END)"


def auc_sql(by: str) -> str:
    over = f"PARTITION BY {by} " if by else ""
    cols = f"{by}, " if by else ""
    return f"""SELECT {cols}(sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc
  FROM (SELECT *, rank() OVER ({over}ORDER BY p) + (count(*) OVER (PARTITION BY {cols}p) - 1) / 2.0 AS r FROM x) {'GROUP BY ' + by if by else ''}"""


@query("d20_probability_metrics", f"""WITH {P}, a AS ({auc_sql('')}), e AS (SELECT sum(abs(sp - sy)) / sum(n) AS ece FROM (SELECT b, count(*) AS n, sum(p) AS sp, sum(y) AS sy FROM xb GROUP BY b))
SELECT count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate, round({LL}, 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy, round(any_value(auc), 6) AS auc, round(any_value(ece), 6) AS ece FROM x, a, e""")
def probability_metrics(t: Tables) -> DataFrame:
    """Log loss, Brier, accuracy, AUC with ties, calibration error."""
    p = predictions(t)
    m = metrics.slice_metrics(p, "y", "p", []).crossJoin(F.broadcast(metrics.calibration_error(p, "y", "p")))
    return m.select("n", *(r6(F.col(c)).alias(c) for c in ("mean_p", "rate", "log_loss", "brier", "accuracy", "auc", "ece")))


@query("d22_reliability_curve", f"WITH {P}, s AS (SELECT unnest(range(0, 10)) AS b) SELECT s.b::INT AS bin, count(p) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM s LEFT JOIN xb USING (b) GROUP BY s.b")
def reliability_curve(t: Tables) -> DataFrame:
    """Bins including empty ones."""
    c = metrics.reliability_curve(predictions(t), "y", "p")
    return c.select("bin", "n", r6(F.col("mean_p")).alias("mean_p"), r6(F.col("rate")).alias("rate"))


#: fixed values: (label, from, below)
P_SPECS = [("<45%", 0.0, 0.45), ("45–50%", 0.45, 0.50), ("50–55%", 0.50, 0.55), ("55–60%", 0.55, 0.60), ("60–65%", 0.60, 0.65), ("65%+", 0.65, None)]
E_SPECS = [("0–2%", 0.0, 0.02), ("2–4%", 0.02, 0.04), ("4–6%", 0.04, 0.06), ("6–8%", 0.06, 0.08), ("8%+", 0.08, None)]


def spec_sql(specs: list, x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {lo} {'' if hi is None else f'AND {x} < {hi} '}THEN '{label}'" for label, lo, hi in specs) + " END"


@query("d24_probability_buckets", f"WITH {P}, s AS (SELECT unnest([{', '.join(repr(s[0]) for s in P_SPECS)}]) AS bucket), q AS (SELECT {spec_sql(P_SPECS, 'p')} AS bucket, p, y FROM x) SELECT bucket, count(p) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate, round(avg(y) - avg(p), 6) AS gap FROM s LEFT JOIN q USING (bucket) GROUP BY bucket")
def probability_buckets(t: Tables) -> DataFrame:
    """Half-open buckets with signed gap."""
    b = metrics.buckets(predictions(t), F.col("p"), P_SPECS, {"mean_p": r6(F.avg("p")), "rate": r6(F.avg("y")), "gap": r6(F.avg("y") - F.avg("p"))})
    return b.drop("pos")


@query("d25_edge_buckets", f"WITH {G}, s AS (SELECT unnest([{', '.join(repr(s[0]) for s in E_SPECS)}]) AS bucket), q AS (SELECT {spec_sql(E_SPECS, 'round(abs(edge), 9)')} AS bucket, edge, CASE WHEN status = 'F' THEN dh - 1 ELSE -1 END AS profit FROM n) SELECT bucket, count(edge) AS n, round(avg(abs(edge)), 6) AS mean_edge, round(avg(profit), 6) AS roi FROM s LEFT JOIN q USING (bucket) GROUP BY bucket")
def edge_buckets(t: Tables) -> DataFrame:
    """Buckets of absolute edge with return on a flat stake."""
    from pitlake.functions import odds

    m = market(t).withColumn("profit", odds.flat_stake_profit(F.col("status") == "F", F.col("home")))
    return metrics.buckets(m, F.round(F.abs("edge"), 9), E_SPECS, {"mean_edge": r6(F.avg(F.abs("edge"))), "roi": r6(F.avg("profit"))}).drop("pos")


@query("d27_edge_summary", f"WITH {G} SELECT round(avg(edge), 6) AS mean, round(avg(abs(edge)), 6) AS mean_abs, round(min(edge), 6) AS lo, round(max(edge), 6) AS hi, count(*) FILTER (abs(edge) >= 0.02) AS plays FROM n")
def edge_summary(t: Tables) -> DataFrame:
    """Edge summary."""
    e = F.col("edge")
    return market(t).agg(r6(F.avg(e)).alias("mean"), r6(F.avg(F.abs(e))).alias("mean_abs"), r6(F.min(e)).alias("lo"), r6(F.max(e)).alias("hi"), F.count_if(F.abs(e) >= 0.02).alias("plays"))


@query("d28_betting_results", f"WITH {G} SELECT o_custkey, count(*) FILTER (status = 'F') AS wins, count(*) FILTER (status = 'O') AS losses, count(*) FILTER (status = 'P') AS pending, round(sum(CASE status WHEN 'F' THEN dh - 1 WHEN 'O' THEN -1 END), 6) AS units FROM n GROUP BY 1")
def betting_results(t: Tables) -> DataFrame:
    """Wins, losses, pending and units per group."""
    from pitlake.functions import odds

    s = F.col("status")
    profit = F.when(s != "P", odds.flat_stake_profit(s == "F", F.col("home")))
    return market(t).groupBy("o_custkey").agg(F.count_if(s == "F").alias("wins"), F.count_if(s == "O").alias("losses"), F.count_if(s == "P").alias("pending"), r6(F.sum(profit)).alias("units"))


@query("d30_summary_counts", "SELECT event_type, count(*) AS n, max(event_id) AS last_id, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def summary_counts(t: Tables) -> DataFrame:
    """Counts by reason with latest marks."""
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"), F.countDistinct("user_id").alias("users"))


@query("d31_last_days", """WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events), r AS (SELECT day FROM d ORDER BY day DESC LIMIT 7)
SELECT CASE WHEN grouping(day) = 1 THEN 'total' ELSE day::VARCHAR END AS day, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS hits FROM (SELECT ts::DATE AS day, event_type FROM events) JOIN r USING (day) GROUP BY ROLLUP (day)""")
def last_days(t: Tables) -> DataFrame:
    """The last seven dates and their total."""
    x = t.events.select(F.to_date("ts").alias("day"), "event_type")
    days = x.select("day").distinct().orderBy(F.desc("day")).limit(7)
    g = x.join(F.broadcast(days), "day").rollup("day").agg(F.grouping("day").alias("g"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("hits"))
    return g.select(F.when(F.col("g") == 1, "total").otherwise(F.col("day").cast("string")).alias("day"), "n", "hits")


@query("d33_slices", f"WITH {P}, a AS ({auc_sql('grp')}) SELECT x.grp, count(*) AS n, round(avg(p), 6) AS mean_p, round(abs(avg(p) - avg(y)), 6) AS gap, round({LL}, 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier, round(any_value(auc), 6) AS auc, count(*) < 30 AS low_confidence FROM x JOIN a ON a.grp = x.grp GROUP BY x.grp")
def slices(t: Tables) -> DataFrame:
    """D33, D34, D13M: metrics per group, ranks within the group."""
    m = metrics.slice_metrics(predictions(t), "y", "p", ["grp"])
    return m.select("grp", "n", *(r6(F.col(c)).alias(c) for c in ("mean_p", "gap", "log_loss", "brier", "auc")), "low_confidence")


@query("d35_terciles", "WITH v AS (SELECT p_retailprice, row_number() OVER (ORDER BY p_retailprice) - 1 AS i, count(*) OVER () AS n FROM part), c AS (SELECT max(p_retailprice) FILTER (i = n // 3) AS lo, max(p_retailprice) FILTER (i = 2 * n // 3) AS hi FROM v) SELECT p_partkey, CASE WHEN p_retailprice < lo THEN 'low' WHEN p_retailprice >= hi THEN 'high' ELSE 'middle' END AS tercile FROM part, c")
def terciles(t: Tables) -> DataFrame:
    """Terciles by sorted position."""
    return metrics.terciles(t.part.select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", "tercile")


@query("d36_failure_regimes", f"""WITH {P}, l AS (SELECT 'user_group' AS dimension, grp::VARCHAR AS label, p, y FROM x UNION ALL SELECT 'kind', event_type, p, y FROM x UNION ALL SELECT 'side', CASE WHEN p >= 0.5 THEN 'home' ELSE 'away' END, p, y FROM x)
SELECT dimension, label, count(*) AS n, round({LL}, 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier FROM l GROUP BY ALL""")
def failure_regimes(t: Tables) -> DataFrame:
    """Several dimensions in one grouping over stacked labels."""
    p = predictions(t)
    dims = {"user_group": F.col("grp").cast("string"), "kind": F.col("event_type"), "side": F.when(F.col("p") >= 0.5, "home").otherwise("away")}
    stacked = p.select("p", "y", F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), v.alias("label")) for k, v in dims.items()))).alias("s")).select("s.*", "p", "y")
    return stacked.groupBy("dimension", "label").agg(F.count(F.lit(1)).alias("n"), r6(metrics.log_loss(F.col("y"), F.col("p"))).alias("log_loss"), r6(metrics.brier(F.col("y"), F.col("p"))).alias("brier"))


@query("d42_deltas", f"WITH {P}, a AS (SELECT avg((p - y) * (p - y)) AS b, avg(p) AS m FROM x WHERE grp < 3), h AS (SELECT avg((p - y) * (p - y)) AS b, avg(p) AS m FROM x WHERE grp >= 3) SELECT 'brier' AS metric, round(h.b - a.b, 6) AS delta FROM a, h UNION ALL SELECT 'mean_p', round(h.m - a.m, 6) FROM a, h")
def deltas(t: Tables) -> DataFrame:
    """Holdout minus development, per metric."""
    hold = F.col("grp") >= 3
    sq = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    x = predictions(t).agg(*(F.avg(F.when(c, v)).alias(n) for n, c, v in [("hb", hold, sq), ("ab", ~hold, sq), ("hm", hold, F.col("p")), ("am", ~hold, F.col("p"))]))
    return x.select(F.inline(F.array(F.struct(F.lit("brier").alias("metric"), r6(F.col("hb") - F.col("ab")).alias("delta")), F.struct(F.lit("mean_p").alias("metric"), r6(F.col("hm") - F.col("am")).alias("delta")))))


@query("d43_univariate_auc", """WITH l AS (SELECT (l_returnflag = 'R')::INT AS y, unnest(['discount', 'quantity', 'tax']) AS name, unnest([l_discount, l_quantity, l_tax]) AS p FROM lineitem),
r AS (SELECT *, rank() OVER (PARTITION BY name ORDER BY p) + (count(*) OVER (PARTITION BY name, p) - 1) / 2.0 AS r FROM l),
a AS (SELECT name, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM r GROUP BY name)
SELECT name, round(greatest(auc, 1 - auc), 6) AS auc FROM a""")
def univariate_auc(t: Tables) -> DataFrame:
    """How well each column alone tells the label."""
    x = t.lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_discount").alias("discount"), F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))
    a = metrics.auc(x.unpivot(["y"], ["discount", "quantity", "tax"], "name", "value"), "y", "value", ["name"])
    return a.select("name", r6(F.greatest(F.col("auc"), 1 - F.col("auc"))).alias("auc"))


@query("d44_correlation", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem")
def correlation(t: Tables) -> DataFrame:
    """All pairs in one pass."""
    return metrics.pairwise_correlation(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("r", r6(F.col("r")))


@query("d45_column_groups", "SELECT 'l_extendedprice' AS name, 'l_extendedprice' AS grp UNION ALL SELECT 'twice', 'l_extendedprice'")
def column_groups(t: Tables) -> DataFrame:
    """Components of strongly correlated columns, a few hundred names at most."""
    x = t.lineitem.select("l_extendedprice", (F.col("l_extendedprice") * 2 + 1).alias("twice"), "l_discount")
    found = metrics.pairwise_correlation(x, x.columns).where("abs(r) >= 0.9").collect()
    groups = metrics.connected_columns([(r["a"], r["b"]) for r in found])
    return t.spark.createDataFrame(list(groups.items()), "name string, grp string")


@query("d47_stability", "WITH s AS (SELECT year(o_orderdate) AS season, count(*) FILTER (o_orderstatus = 'F') / count(*) AS f, count(*) FILTER (o_orderpriority = '5-LOW') / count(*) AS l FROM orders GROUP BY 1) SELECT 'final' AS name, round(max(f) - min(f), 6) AS spread FROM s UNION ALL SELECT 'low', round(max(l) - min(l), 6) FROM s")
def stability(t: Tables) -> DataFrame:
    """Spread of a column's population over seasons."""
    s = t.orders.groupBy(F.year("o_orderdate").alias("season")).agg((F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))).alias("final"), (F.count_if(F.col("o_orderpriority") == "5-LOW") / F.count(F.lit(1))).alias("low"))
    return s.unpivot(["season"], ["final", "low"], "name", "v").groupBy("name").agg(r6(F.max("v") - F.min("v")).alias("spread"))


@query("d49_compare_windows", f"WITH {P} SELECT grp, event_type, round(avg((p - y) * (p - y)), 6) AS brier, row_number() OVER (ORDER BY round(avg((p - y) * (p - y)), 6), grp, event_type) AS rank FROM x GROUP BY grp, event_type")
def compare_windows(t: Tables) -> DataFrame:
    """Models by windows, ranked."""
    g = predictions(t).groupBy("grp", "event_type").agg(r6(metrics.brier(F.col("y"), F.col("p"))).alias("brier"))
    return g.withColumn("rank", F.row_number().over(W.orderBy("brier", "grp", "event_type")))


@query("d50_fold_stability", f"WITH {P}, f AS (SELECT user_id % 4 AS fold, avg((p - y) * (p - y)) - avg((0.9 * p + 0.05 - y) * (0.9 * p + 0.05 - y)) AS d FROM x GROUP BY 1) SELECT count(*) FILTER (d > 0) AS improved, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std FROM f")
def fold_stability(t: Tables) -> DataFrame:
    """Fold deltas."""
    q = 0.9 * F.col("p") + 0.05
    f = predictions(t).groupBy((F.col("user_id") % 4).alias("fold")).agg((metrics.brier(F.col("y"), F.col("p")) - metrics.brier(F.col("y"), q)).alias("d"))
    return f.agg(F.count_if(F.col("d") > 0).alias("improved"), r6(F.avg("d")).alias("mean"), r6(F.stddev_pop("d")).alias("std"))


@query("d05_agreeing_groups", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS books, count(DISTINCT l_linestatus) = 1 AS agree FROM lineitem GROUP BY 1")
def agreeing_groups(t: Tables) -> DataFrame:
    """Lines to one event, with an agreement flag."""
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("books"), (F.min("l_linestatus") == F.max("l_linestatus")).alias("agree"))


@query("d06_coverage_cube", "SELECT coalesce(year(o_orderdate)::VARCHAR, '*') AS season, coalesce(o_orderstatus, '*') AS status, count(*) AS n, round(avg((o_orderkey % 2)), 6) AS share FROM orders GROUP BY GROUPING SETS ((), (year(o_orderdate)), (o_orderstatus))")
def coverage_cube(t: Tables) -> DataFrame:
    """Totals, by season and by status in one pass."""
    x = t.orders.select(F.year("o_orderdate").alias("season"), F.col("o_orderstatus").alias("status"), "o_orderkey")
    g = x.groupingSets([[], ["season"], ["status"]], "season", "status").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("o_orderkey") % 2)).alias("share"))
    return g.select(F.coalesce(F.col("season").cast("string"), F.lit("*")).alias("season"), F.coalesce("status", F.lit("*")).alias("status"), "n", "share")


@query("d07_column_stats", """SELECT name AS column, count(*) AS n, count(v) AS non_null, count(DISTINCT v) AS n_distinct, min(v) AS lo, max(v) AS hi, min(v) = 0 AND max(v) = 0 AS all_zero, count(DISTINCT v) <= 1 AS constant
FROM (SELECT unnest(['l_discount', 'l_quantity', 'l_tax']) AS name, unnest([l_discount, l_quantity, l_tax]) AS v FROM lineitem) GROUP BY name""")
def column_stats(t: Tables) -> DataFrame:
    """Statistics per column."""
    return quality.column_stats(t.lineitem, ["l_discount", "l_quantity", "l_tax"])


@query("d08_column_status", """WITH s AS (SELECT name, 1 - count(v) / count(*) AS nulls, count(DISTINCT v) AS d, min(v) AS lo, max(v) AS hi FROM (SELECT unnest(['a', 'b', 'c']) AS name, unnest([CASE WHEN l_discount > 0.01 THEN l_discount END, l_quantity, 0]) AS v FROM lineitem) GROUP BY name)
SELECT name AS column, CASE WHEN nulls >= 1 THEN 'FAIL' WHEN d <= 1 THEN 'FAIL' WHEN nulls > 0.02 THEN 'WARN' ELSE 'PASS' END AS status FROM s""")
def column_status(t: Tables) -> DataFrame:
    """Verdict per column."""
    x = t.lineitem.select(F.when(F.col("l_discount") > 0.01, F.col("l_discount")).alias("a"), F.col("l_quantity").alias("b"), F.lit(0.0).alias("c"))
    s = quality.column_stats(x, ["a", "b", "c"])
    return s.select("column", quality.column_status(1 - F.col("non_null") / F.col("n"), F.col("all_zero"), F.col("constant"), F.col("n")).alias("status"))


@query("d10_rate_sanity", "SELECT count(*) AS n, round(avg((o_orderstatus = 'F')::INT), 6) AS rate, avg((o_orderstatus = 'F')::INT) BETWEEN 0.45 AND 0.60 AS plausible FROM orders")
def rate_sanity(t: Tables) -> DataFrame:
    """Rate with a plausible range."""
    rate = F.avg((F.col("o_orderstatus") == "F").cast("int"))
    return t.orders.agg(F.count(F.lit(1)).alias("n"), r6(rate).alias("rate"), rate.between(0.45, 0.60).alias("plausible"))


@query("d13_contiguity", "SELECT 'line numbers' AS \"check\", 'FAIL' AS status, count(*) AS failing_count FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*) OR count(*) FILTER (l_linenumber = 1) <> 1)")
def contiguity(t: Tables) -> DataFrame:
    """Numbering without gaps and one first entry."""
    return quality.contiguous(t.lineitem, ["l_orderkey"], "l_linenumber", F.col("l_linenumber") == 1, "line numbers").select("check", "status", "failing_count")


@query("d16_null_counts", "SELECT count(*) AS n, count(*) FILTER (CASE WHEN value > 50 THEN value END IS NULL) AS no_value, count(*) FILTER (props IS NULL) AS no_props FROM events")
def null_counts(t: Tables) -> DataFrame:
    """Conditional null counts in one pass."""
    return t.events.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.when(F.col("value") > 50, F.col("value")).isNull()).alias("no_value"), F.count_if(F.col("props").isNull()).alias("no_props"))


def structural_checks(t: Tables) -> DataFrame:
    """Generic checks of three tables, the rules of a table in one pass."""
    o, li, c = t.orders, t.lineitem, t.customer
    counted = lambda df, *key: df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    name = F.lower(F.trim("c_name"))
    lost = li.select("l_orderkey").join(o.select(F.col("o_orderkey").alias("l_orderkey")).distinct(), "l_orderkey", "left_anti")
    return checks.all_of([
        checks.measure(counted(o, "o_orderkey"), [checks.Rule("order key unique", F.col("n") > 1, F.col("o_orderkey"))]),
        checks.measure(counted(li, "l_orderkey", "l_linenumber"), [checks.Rule("line key unique", F.col("n") > 1, checks.key_of("l_orderkey", "l_linenumber"))]),
        checks.measure(lost, [checks.Rule("lines have orders", F.lit(True), F.col("l_orderkey"))]),
        checks.measure(o, [checks.Rule("status known", ~F.col("o_orderstatus").isin("F", "O"), F.col("o_orderkey"), "WARN"), checks.Rule("dates present", F.col("o_orderdate").isNull(), F.col("o_orderkey"))]),
        checks.measure(li, [checks.Rule("prices positive", F.col("l_extendedprice") <= 0, F.col("l_orderkey"))]),
        checks.measure(c, [
            checks.Rule("names present", F.col("c_name").isNull() | (F.trim("c_name") == ""), F.col("c_custkey")),
            checks.Rule("name normaliser idempotent", name != F.lower(F.trim(name)), F.col("c_custkey")),
        ]),
    ]).withColumn("severity", F.when(F.col("severity") == "FAIL", "ERROR").otherwise(F.col("severity")))


CHECKS_SQL = """
SELECT 'order key unique' AS "check", count(*) AS failing_count, 'ERROR' AS severity FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'line key unique', count(*), 'ERROR' FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'lines have orders', count(*), 'ERROR' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'status known', count(*), 'WARN' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'prices positive', count(*), 'ERROR' FROM lineitem WHERE l_extendedprice <= 0
UNION ALL SELECT 'names present', count(*), 'ERROR' FROM customer WHERE c_name IS NULL OR trim(c_name) = ''
UNION ALL SELECT 'name normaliser idempotent', count(*), 'ERROR' FROM customer WHERE lower(trim(lower(trim(c_name)))) <> lower(trim(c_name))
UNION ALL SELECT 'dates present', count(*), 'ERROR' FROM orders WHERE o_orderdate IS NULL"""


@query("i01_structural_checks", f"SELECT \"check\", CASE WHEN failing_count = 0 THEN 'PASS' WHEN severity = 'WARN' THEN 'WARN' ELSE 'FAIL' END AS status, severity, failing_count FROM ({CHECKS_SQL})")
def run_checks(t: Tables) -> DataFrame:
    """Generic checks of three tables, each one row (the catalogues are i01_structural, i02_coverage and i24_archive_checks)."""
    return structural_checks(t).drop("failing")


@query("d56_verdict", f"SELECT count(*) AS checks, count(*) FILTER (failing_count = 0) AS passed, count(*) FILTER (failing_count > 0 AND severity = 'WARN') AS warned, count(*) FILTER (failing_count > 0 AND severity <> 'WARN') AS failed, CASE WHEN count(*) FILTER (failing_count > 0 AND severity <> 'WARN') > 0 THEN 'FAIL' WHEN count(*) FILTER (failing_count > 0) > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM ({CHECKS_SQL})")
def verdict(t: Tables) -> DataFrame:
    """Roll-up of check results."""
    return quality.verdict(structural_checks(t))


@query("m02_failing_sample", "SELECT unnest(list_sort(list(l_orderkey::VARCHAR || '|' || l_linenumber))[1:20]) AS failing FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)")
def failing_sample(t: Tables) -> DataFrame:
    """The first twenty failing records."""
    return quality.unique(t.lineitem, ["l_orderkey", "l_linenumber"], "k").select(F.explode("failing").alias("failing"))


@query("d17_content_hash", "SELECT count(*) AS rows, true AS stable, count(*) > 0 AS changes FROM lineitem")
def content_hash(t: Tables) -> DataFrame:
    """A hash of a table's content that doesn't depend on the order of rows."""
    a = quality.content_hash(t.lineitem, t.lineitem.columns)
    b = quality.content_hash(t.lineitem.repartition(5, "l_tax"), t.lineitem.columns).select(F.col("hash").alias("other"))
    least = t.lineitem.agg(F.min("l_orderkey").alias("k")).collect()[0]["k"]
    c = quality.content_hash(t.lineitem.withColumn("l_tax", F.when(F.col("l_orderkey") == least, F.col("l_tax") + 1).otherwise(F.col("l_tax"))), t.lineitem.columns).select(F.col("hash").alias("changed"))
    return a.crossJoin(b).crossJoin(c).select("rows", (F.col("hash") == F.col("other")).alias("stable"), (F.col("hash") != F.col("changed")).alias("changes"))  # one row each
