"""History and latest-per-key queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.operators import history, latest
from pitlake.plans.base import Tables, query

r4 = lambda c: F.round(c, 4)


@query("e01_team_form", """
WITH p AS (SELECT o_custkey, o_orderkey, o_orderdate, year(o_orderdate) AS season, (o_totalprice * 100)::BIGINT AS cents, o_orderstatus = 'F' AS done FROM orders),
j AS (SELECT a.o_orderkey, b.cents, b.season = a.season AS same, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate DESC, b.o_orderkey DESC) AS k
      FROM p a JOIN p b ON a.o_custkey = b.o_custkey AND b.done AND (b.o_orderdate, b.o_orderkey) < (a.o_orderdate, a.o_orderkey)),
g AS (SELECT o_orderkey, count(*) FILTER (same) AS n, sum(cents) FILTER (same) AS total, count(*) FILTER (k <= 3) AS n3, sum(cents) FILTER (k <= 3) AS s3, count(*) FILTER (k <= 7) AS n7, sum(cents) FILTER (k <= 7) AS s7 FROM j GROUP BY 1)
SELECT p.o_orderkey, o_custkey, season, coalesce(n, 0) AS prior_orders, coalesce(total, 0)::BIGINT AS prior_cents, coalesce(n3, 0) AS n_l3, round(s3 / n3, 4) AS avg_l3, coalesce(n7, 0) AS n_l7, round(s7 / n7, 4) AS avg_l7
FROM p LEFT JOIN g USING (o_orderkey)""")
def team_form(t: Tables) -> DataFrame:
    """Season to date and last 3 and 7 eligible rows strictly before each row."""
    p = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", F.year("o_orderdate").alias("season"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), (F.col("o_orderstatus") == "F").alias("done"))
    order, m = ["o_orderdate", "o_orderkey"], {"cents": F.col("cents")}
    x = history.last_eligible(p, ["o_custkey"], order, F.col("done"), m, [3, 7])
    x = history.cumulative(x, ["o_custkey", "season"], order, F.col("done"), m)
    return x.select(
        "o_orderkey", "o_custkey", "season", F.col("n_before").alias("prior_orders"), F.col("cents_before").alias("prior_cents"), F.col("n_L3").alias("n_l3"), r4(history.ratio(F.col("cents_L3"), F.col("n_L3"))).alias("avg_l3"),
        F.col("n_L7").alias("n_l7"), r4(history.ratio(F.col("cents_L7"), F.col("n_L7"))).alias("avg_l7"),
    )


@query("e03_starter_form", """
WITH p AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity::BIGINT AS q, (l_discount * 100)::BIGINT AS d, l_returnflag <> 'N' AS ok,
             row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS i FROM lineitem),
e AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY i) AS k, sum(q) OVER (PARTITION BY l_suppkey ORDER BY i) AS cq, sum(d) OVER (PARTITION BY l_suppkey ORDER BY i) AS cd FROM p WHERE ok),
a AS (SELECT p.*, e.k, e.l_shipdate AS prev FROM p ASOF LEFT JOIN e ON p.l_suppkey = e.l_suppkey AND p.i > e.i)
SELECT a.l_suppkey, a.l_orderkey, a.l_linenumber, a.l_partkey, coalesce(a.k, 0) AS starts, least(coalesce(a.k, 0), 5) AS n_l5,
  CASE WHEN hi.cq - coalesce(lo.cq, 0) <> 0 THEN round((hi.cd - coalesce(lo.cd, 0)) / (hi.cq - coalesce(lo.cq, 0)), 4) END AS rate_l5, date_diff('day', a.prev, a.l_shipdate) AS days_rest
FROM a LEFT JOIN e hi ON hi.l_suppkey = a.l_suppkey AND hi.k = a.k LEFT JOIN e lo ON lo.l_suppkey = a.l_suppkey AND lo.k = a.k - 5""")
def starter_form(t: Tables) -> DataFrame:
    """Last 5 usable lines, rate of two sums, days since the previous one."""
    p = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", F.col("l_quantity").cast("long").alias("q"), F.round(F.col("l_discount") * 100).cast("long").alias("d"), (F.col("l_returnflag") != "N").alias("ok"))
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    x = history.last_eligible(p, ["l_suppkey"], order, F.col("ok"), {"q": F.col("q"), "d": F.col("d")}, [5])
    x = history.cumulative(x, ["l_suppkey"], order, F.col("ok"), {})
    x = history.previous(x, ["l_suppkey"], order, F.col("ok"), F.col("l_shipdate"), "prev")
    return x.select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("n_before").alias("starts"), F.col("n_L5").alias("n_l5"), r4(history.ratio(F.col("d_L5"), F.col("q_L5"))).alias("rate_l5"),
        F.datediff("l_shipdate", "prev").alias("days_rest"),
    )


@query("e06_bullpen_form", """
WITH p AS (SELECT l_suppkey, l_orderkey, o_orderdate AS d, sum(l_quantity)::BIGINT AS outs, count(*) AS apps FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
x AS (SELECT a.l_suppkey, a.l_orderkey, sum(b.outs) FILTER (a.d - b.d <= INTERVAL 1 DAY) AS o1, sum(b.outs) FILTER (a.d - b.d <= INTERVAL 3 DAY) AS o3, sum(b.apps) FILTER (a.d - b.d <= INTERVAL 3 DAY) AS a3
      FROM p a JOIN p b ON a.l_suppkey = b.l_suppkey AND (b.d, b.l_orderkey) < (a.d, a.l_orderkey) GROUP BY ALL)
SELECT p.l_suppkey, p.l_orderkey, coalesce(o1, 0)::BIGINT AS outs_1d, coalesce(o3, 0)::BIGINT AS outs_3d, coalesce(a3, 0)::BIGINT AS apps_3d,
  (sum(outs) OVER (PARTITION BY p.l_suppkey ORDER BY d, p.l_orderkey ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))::BIGINT AS outs_l7 FROM p LEFT JOIN x ON x.l_suppkey = p.l_suppkey AND x.l_orderkey = p.l_orderkey""")
def bullpen_form(t: Tables) -> DataFrame:
    """Group lines per entity and game, then day windows (inclusive, strictly earlier in order) and the last 7 games."""
    p = t.lineitem.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("o_orderkey") == F.col("l_orderkey"))
    p = p.groupBy("l_suppkey", "l_orderkey", F.col("o_orderdate").alias("d")).agg(F.sum("l_quantity").cast("long").alias("outs"), F.count(F.lit(1)).alias("apps"))
    x = history.prior_days(p, ["l_suppkey"], "d", ["l_orderkey"], {"outs": F.col("outs"), "apps": F.col("apps")}, [1, 3])
    x = history.last_rows(x, ["l_suppkey"], ["d", "l_orderkey"], {"outs": F.col("outs")}, [7])
    return x.select("l_suppkey", "l_orderkey", F.col("outs_1d"), "outs_3d", "apps_3d", F.when(F.col("n_L7") > 0, F.col("outs_L7")).alias("outs_l7"))


LATEST = "SELECT {c} FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {o}) AS rn FROM {t}) WHERE rn = 1"


@query("e08_latest_attempt", LATEST.format(c="user_id, event_type, event_id, value", k="user_id, event_type", o="ts DESC, event_id DESC", t="events"))
def latest_attempt(t: Tables) -> DataFrame:
    """Latest row per key by an aggregate."""
    return latest.latest_by_max(t.events, ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"])


E = "(SELECT *, CASE WHEN event_id % 4 = 0 THEN NULL ELSE date_trunc('day', ts) END AS day FROM events)"


@query("e10_latest_lowest_null", LATEST.format(c="user_id, event_id", k="user_id", o="coalesce(day, TIMESTAMP '1900-01-01') DESC, event_id DESC", t=E))
def latest_lowest_null(t: Tables) -> DataFrame:
    """A bad instant counts as the smallest, ties go to the later record."""
    d = F.coalesce(F.when(F.col("event_id") % 4 != 0, F.date_trunc("day", "ts")), F.lit("1900-01-01").cast("timestamp"))
    return latest.latest(t.events, ["user_id"], d, "event_id", nulls="lowest").select("user_id", "event_id")


@query("e11_latest_null_never_replaces", LATEST.format(c="user_id, event_id", k="user_id", o="day DESC NULLS LAST, CASE WHEN day IS NULL THEN -event_id ELSE event_id END DESC", t=E))
def latest_null_never_replaces(t: Tables) -> DataFrame:
    """A null instant never replaces a row; among nulls the first stays."""
    return latest.latest(t.events, ["user_id"], F.when(F.col("event_id") % 4 != 0, F.date_trunc("day", "ts")), "event_id").select("user_id", "event_id")


@query("e16_canonical_entry", """
WITH x AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 5 WHEN 'O' THEN 4 ELSE 2 END AS rank, max(CASE o_orderstatus WHEN 'F' THEN 5 WHEN 'O' THEN 4 ELSE 2 END) OVER (PARTITION BY o_custkey) AS top FROM orders),
c AS (SELECT o_custkey, count(DISTINCT o_orderpriority) FILTER (rank = top) > 1 AS conflict FROM x GROUP BY 1),
b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY rank DESC, (o_orderkey % 5 = 0)::INT DESC, o_orderdate DESC, o_orderkey) AS rn FROM x)
SELECT o_custkey, o_orderkey, conflict FROM b JOIN c USING (o_custkey) WHERE rn = 1""")
def canonical_entry(t: Tables) -> DataFrame:
    """Lifecycle-ranked canonical entry with conflict flag."""
    rank = F.when(F.col("o_orderstatus") == "F", 5).when(F.col("o_orderstatus") == "O", 4).otherwise(2)
    x = latest.canonical(t.orders, ["o_custkey"], rank, F.col("o_orderkey") % 5 == 0, F.col("o_orderdate"), "o_orderkey", F.col("o_orderpriority"))
    return x.select("o_custkey", "o_orderkey", "conflict")


@query("e18_carry_over", """SELECT user_id, arg_min(value, event_id) FILTER (value > 50) AS first_value, arg_min(props, event_id) FILTER (event_type = 'error') AS first_error FROM events GROUP BY user_id""")
def carry_over(t: Tables) -> DataFrame:
    """First non-null value of each field."""
    x = t.events.select("user_id", "event_id", F.when(F.col("value") > 50, F.col("value")).alias("first_value"), F.when(F.col("event_type") == "error", F.col("props")).alias("first_error"))
    return latest.carry_first(x, ["user_id"], "event_id", ["first_value", "first_error"])


@query("e20_equal_time_conflict", """SELECT o_custkey, o_orderdate FROM orders GROUP BY ALL HAVING count(DISTINCT o_totalprice) > 1""")
def equal_time_conflict(t: Tables) -> DataFrame:
    """Same key and instant, different content."""
    return t.orders.groupBy("o_custkey", "o_orderdate").agg((F.min("o_totalprice") != F.max("o_totalprice")).alias("c")).where("c").drop("c")


@query("e21_chronological_split", """WITH n AS (SELECT count(*) AS n FROM orders)
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) > n - round_even(n * 0.2, 0) AS calibration FROM orders, n""")
def chronological_split(t: Tables) -> DataFrame:
    """Last fifth in time; the cut is found from counts by day, then inside one day only."""
    return latest.tail_split(t.orders, "o_orderdate", "o_orderkey", 0.2).select("o_orderkey", "calibration")


@query("i16_future_mutation", "SELECT 0::BIGINT AS changed, count(*) AS rows FROM orders")
def future_mutation(t: Tables) -> DataFrame:
    """A row added after the end changes no earlier feature."""
    return changed_rows(t, lambda o: o.unionByName(o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("o_orderdate")).select(
        (F.col("o_custkey") + 10_000_000).alias("o_orderkey"), "o_custkey", F.lit("F").alias("o_orderstatus"), F.lit(1e6).alias("o_totalprice"),
        (F.col("o_orderdate") + F.expr("interval 9 days")).alias("o_orderdate"), F.lit("x").alias("o_orderpriority"))))


@query("i17_current_row_excluded", "SELECT 0::BIGINT AS changed, count(*) AS rows FROM orders")
def current_row_excluded(t: Tables) -> DataFrame:
    """Changing the last row of each entity doesn't change its own features."""
    from pyspark.sql import Window as W

    last = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))) == 1
    return changed_rows(t, lambda o: o.withColumn("o_totalprice", F.when(last, F.col("o_totalprice") + 77777).otherwise(F.col("o_totalprice"))))


def changed_rows(t: Tables, mutate) -> DataFrame:
    """How many features of the original rows differ after a mutation."""

    class Mutated(Tables):
        orders = property(lambda self: mutate(t.orders))

    before, after = team_form(t), team_form(Mutated(t.spark, t.sf_dir))
    gone = before.exceptAll(after).agg(F.count(F.lit(1)).alias("changed"))
    return gone.crossJoin(before.agg(F.count(F.lit(1)).alias("rows")))
