"""Scalar functions, projections, predicates and normalisation.

Prices and probabilities are derived from order keys; the SQL does the same in
its own words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.functions import odds, text
from pitlake.plans.base import Tables, query

EDGES10 = [i / 10 for i in range(1, 10)]
NUMPY_EDGES = [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]


def games(t: Tables) -> DataFrame:
    """Orders as games: two prices, a model probability and three instants."""
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("game_pk"),
        F.when(k % 2 == 0, -(100 + k % 250)).otherwise(100 + k % 300).alias("home"),
        F.when(k % 2 == 0, 100 + k % 230).otherwise(-(100 + k % 270)).alias("away"),
        ((k * 7919) % 1000 / 1000.0).alias("p"),
        F.col("o_orderdate").alias("start"),
        (F.col("o_orderdate") - F.expr("make_dt_interval(0, cast(o_orderkey % 30 as int))")).alias("predicted"),
        (F.col("o_orderdate") - F.expr("make_dt_interval(0, cast(o_orderkey % 41 as int))")).alias("snapshot"),
        F.col("o_orderstatus").alias("status"), "o_custkey", "o_totalprice",
    )


G = """o AS (
  SELECT o_orderkey AS game_pk,
         CASE WHEN o_orderkey % 2 = 0 THEN -(100 + o_orderkey % 250) ELSE 100 + o_orderkey % 300 END AS home,
         CASE WHEN o_orderkey % 2 = 0 THEN 100 + o_orderkey % 230 ELSE -(100 + o_orderkey % 270) END AS away,
         (o_orderkey * 7919) % 1000 / 1000.0::DOUBLE AS p, o_orderdate AS start,
         o_orderdate - to_hours(o_orderkey % 30) AS predicted, o_orderdate - to_hours(o_orderkey % 41) AS snapshot,
         o_orderstatus AS status, o_custkey, o_totalprice
  FROM orders),
m AS (
  SELECT *, CASE WHEN home < 0 THEN -home / (100.0::DOUBLE - home) ELSE 100.0::DOUBLE / (home + 100) END AS rh,
            CASE WHEN away < 0 THEN -away / (100.0::DOUBLE - away) ELSE 100.0::DOUBLE / (away + 100) END AS ra,
            CASE WHEN home < 0 THEN 1 - 100.0::DOUBLE / home ELSE 1 + home / 100.0::DOUBLE END AS dh,
            CASE WHEN away < 0 THEN 1 - 100.0::DOUBLE / away ELSE 1 + away / 100.0::DOUBLE END AS da
  FROM o),
n AS (SELECT *, rh / (rh + ra) AS mh, ra / (rh + ra) AS ma, p - rh / (rh + ra) AS edge FROM m)"""
r6 = lambda c: F.round(c, 6)


@query("h01_h04_price_conversions", f"""WITH {G} SELECT game_pk, round(dh, 6) AS decimal_home, round(1 / dh, 6) AS implied_home, round(1 / da, 6) AS implied_away,
  CASE WHEN p > 0 AND p < 1 THEN round_even(CASE WHEN p >= 0.5 THEN -100.0 * p / (1 - p) ELSE 100.0 * (1 - p) / p END, 0)::BIGINT END AS american FROM n""")
def price_conversions(t: Tables) -> DataFrame:
    """H01-H04."""
    d = odds.american_to_decimal(F.col("home"))
    return games(t).select(
        "game_pk", r6(d).alias("decimal_home"), r6(odds.american_to_implied(F.col("home"))).alias("implied_home"),
        r6(odds.decimal_to_implied(odds.american_to_decimal(F.col("away")))).alias("implied_away"), odds.probability_to_american(F.col("p")).alias("american"),
    )


def market(t: Tables) -> DataFrame:
    g = games(t).withColumn("mk", odds.no_vig(F.col("home"), F.col("away")))
    return g.withColumn("edge", odds.edge(F.col("p"), F.col("mk.home")))


@query("h05_no_vig", f"WITH {G} SELECT game_pk, round(rh + ra, 6) AS booksum, round(rh + ra - 1, 6) AS overround, round((rh + ra - 1) / (rh + ra), 6) AS vig, round(mh, 6) AS market_home, round(ma, 6) AS market_away FROM n")
def no_vig(t: Tables) -> DataFrame:
    """Two-way no-vig market."""
    return market(t).select("game_pk", *(r6(F.col(f"mk.{a}")).alias(b) for a, b in [("booksum", "booksum"), ("overround", "overround"), ("vig", "vig"), ("home", "market_home"), ("away", "market_away")]))


@query("h06_h09_sides", f"""WITH {G} SELECT game_pk, 'home' AS side, home AS american, round(edge, 6) AS edge, round(p * (dh - 1) - (1 - p), 6) AS ev FROM n
UNION ALL SELECT game_pk, 'away', away, round((1 - p) - ma, 6), round((1 - p) * (da - 1) - p, 6) FROM n""")
def sides(t: Tables) -> DataFrame:
    """Edge and expected value of each side."""
    m = market(t)
    both = F.array(*(odds.side(F.col("mk"), F.col("home"), F.col("away"), F.col("p"), s) for s in ("home", "away")))
    return m.select("game_pk", F.inline(both)).select("game_pk", "side", "american", r6(F.col("edge")).alias("edge"), r6(F.col("ev")).alias("ev"))


@query("h08_h10_pregame", f"""WITH {G} SELECT game_pk, snapshot < predicted AND predicted < start AS pregame,
  CASE WHEN status = 'P' THEN 'opening_not_live' WHEN NOT (snapshot < predicted AND predicted < start) THEN 'not_pregame' END AS problem,
  CASE WHEN status <> 'P' AND snapshot < predicted AND predicted < start THEN round(edge, 6) END AS edge FROM n""")
def pregame(t: Tables) -> DataFrame:
    """Point-in-time guard; evaluation only where it holds."""
    label = F.when(F.col("status") == "P", "OPENING").otherwise("SNAPSHOT")
    problem = odds.pregame_problem(label, F.col("snapshot"), F.col("predicted"), F.col("start"))
    return market(t).select(
        "game_pk", odds.is_pregame(F.col("snapshot"), F.col("predicted"), F.col("start")).alias("pregame"), problem.alias("problem"), F.when(problem.isNull(), r6(F.col("edge"))).alias("edge")
    )


@query("h11_h12_benchmark", f"""WITH {G} SELECT game_pk, CASE status WHEN 'F' THEN 'opening_market_benchmark' ELSE 'closing_market_benchmark' END AS label, round(edge, 6) AS edge FROM n WHERE status IN ('F', 'O')""")
def benchmark(t: Tables) -> DataFrame:
    """Post-hoc benchmark labels; only accepted statuses."""
    names = F.create_map(F.lit("F"), F.lit("opening_market_benchmark"), F.lit("O"), F.lit("closing_market_benchmark"))
    return market(t).where(F.col("status").isin("F", "O")).select("game_pk", names[F.col("status")].alias("label"), r6(F.col("edge")).alias("edge"))


@query("h13_h14_validation", "SELECT p_partkey, p_size BETWEEN 100 AND 1000 OR p_size * 4 >= 100 AS price_ok, p_retailprice / 1500 BETWEEN 0 AND 1 AS probability_ok FROM part")
def validation(t: Tables) -> DataFrame:
    """Validity of prices and probabilities."""
    return t.part.select(
        "p_partkey", odds.valid_american(F.col("p_size") * 4).isNotNull().alias("price_ok"), odds.valid_probability(F.col("p_retailprice") / 1500).isNotNull().alias("probability_ok")
    )


@query("h15_totals", f"WITH {G} SELECT game_pk, 7.5 + game_pk % 5 AS line, round(mh, 6) AS over_p, round(ma, 6) AS under_p, round(p - mh, 6) AS over_edge FROM n")
def totals(t: Tables) -> DataFrame:
    """Totals, over in the home slot and under in the away slot."""
    return market(t).select("game_pk", (F.lit(7.5) + F.col("game_pk") % 5).alias("line"), r6(F.col("mk.home")).alias("over_p"), r6(F.col("mk.away")).alias("under_p"), r6(F.col("edge")).alias("over_edge"))


@query("h16_totals_from_trials", """WITH x AS (SELECT l_suppkey, list(l_quantity) AS trials FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, round(len(list_filter(trials, lambda v: v > 25)) / len(trials), 6) AS over_p, round(len(list_filter(trials, lambda v: v < 25)) / len(trials), 6) AS under_p FROM x""")
def totals_from_trials(t: Tables) -> DataFrame:
    """Share of trials over and under a line; pushes count in the denominator only."""
    x = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") > 25).alias("o"), F.count_if(F.col("l_quantity") < 25).alias("u"))
    return x.select("l_suppkey", r6(F.col("o") / F.col("n")).alias("over_p"), r6(F.col("u") / F.col("n")).alias("under_p"))


@query("h17_midpoint", "SELECT p_partkey, CASE WHEN (p_size % 11) / 10.0 > 0 AND (p_size % 11) / 10.0 < 1 THEN ((p_size % 11) / 10.0)::DOUBLE END AS mid FROM part")
def midpoint(t: Tables) -> DataFrame:
    """Quote midpoint, empty at 0 and 1."""
    q = (F.col("p_size") % 11 / 10).cast("decimal(5,4)")
    return t.part.select("p_partkey", odds.midpoint_probability(q, q).alias("mid"))


@query("h18_h23_picks", f"""WITH {G}, q AS (SELECT *, coalesce(edge >= 0, p >= 0.5, true) AS pick FROM n)
SELECT game_pk, abs(edge) >= 0.02 AS play, pick AS picked_home, p >= 0.5 AS model_home, round(CASE WHEN pick THEN p ELSE 1 - p END, 6) AS selected_p,
  round(CASE WHEN status = 'F' THEN CASE WHEN pick THEN dh ELSE da END - 1 ELSE -1 END, 6) AS profit,
  CASE WHEN edge IS NULL THEN 'DATA WARNING' WHEN abs(edge) >= 0.08 THEN 'REVIEW LARGE EDGE' WHEN abs(edge) < 0.02 THEN 'NO EDGE' WHEN pick THEN 'VALUE ON HOME' ELSE 'VALUE ON AWAY' END AS signal FROM q""")
def picks(t: Tables) -> DataFrame:
    """Play, picked side, model winner, selected probability, flat-stake profit, signal label."""
    e, p = F.col("edge"), F.col("p")
    pick = odds.picked_home(e, p)
    return market(t).select(
        "game_pk", odds.is_play(e).alias("play"), pick.alias("picked_home"), odds.model_picks_home(p).alias("model_home"), r6(odds.selected_probability(pick, p)).alias("selected_p"),
        r6(odds.flat_stake_profit(F.col("status") == "F", F.when(pick, F.col("home")).otherwise(F.col("away")))).alias("profit"), odds.signal_label(e, p).alias("signal"),
    )


@query("h24_risk_flags", f"""WITH {G}, q AS (SELECT *, TIMESTAMP '1998-06-01 00:00:00' AS now, CASE WHEN coalesce(edge >= 0, true) THEN p ELSE 1 - p END AS sel FROM n)
SELECT game_pk, array_to_string(list_filter([
  CASE WHEN game_pk % 17 = 0 THEN 'MISSING_ODDS' END, CASE WHEN now - snapshot > INTERVAL 4 HOUR THEN 'STALE_ODDS' END, CASE WHEN now - predicted > INTERVAL 12 HOUR THEN 'STALE_PREDICTION' END,
  CASE WHEN now >= start THEN 'GAME_ALREADY_STARTED' END, CASE WHEN now < start AND start - now <= INTERVAL 30 MINUTE THEN 'GAME_STARTING_SOON' END,
  CASE WHEN predicted >= start THEN 'DATA WARNING' END, CASE WHEN sel BETWEEN 0.48 AND 0.52 THEN 'MODEL_PROB_NEAR_50' END, CASE WHEN abs(edge) < 0.01 THEN 'LOW_EDGE' END,
  CASE WHEN abs(edge) >= 0.08 THEN 'LARGE_MODEL_MARKET_DISAGREEMENT' END, CASE WHEN game_pk % 13 = 0 THEN 'MISSING_FEATURE_VALUES' END, CASE WHEN game_pk % 19 = 0 THEN 'UNKNOWN_STARTER_RISK' END,
  CASE WHEN game_pk % 23 = 0 THEN 'MISSING_FEATURE_VALUES' END], lambda x: x IS NOT NULL), ',') AS flags FROM q""")
def risk_flags(t: Tables) -> DataFrame:
    """Ordered risk flags at a given instant."""
    k = F.col("game_pk")
    odd = lambda c: F.when(k % 17 != 0, F.col(c))
    return market(t).select("game_pk", F.array_join(odds.risk_flags(
        F.lit("1998-06-01 00:00:00").cast("timestamp_ntz"), F.col("edge"), F.col("p"), F.col("mk.home"), odd("home"), odd("away"), F.col("snapshot"), F.col("predicted"), F.col("start"),
        k % 19 == 0, k % 13 != 0, k % 23 != 0), ",").alias("flags"))


@query("h25_formatting", f"WITH {G} SELECT game_pk, printf('%+.1f pp', floor(round(edge * 1000, 6) + 0.5) / 10) AS edge_pp, printf('%+d', home::BIGINT) AS price FROM n")
def formatting(t: Tables) -> DataFrame:
    """Signed percentage points and prices."""
    return market(t).select("game_pk", text.signed_points(F.col("edge")).alias("edge_pp"), F.format_string("%+d", F.col("home")).alias("price"))


@query("h26_h27_labels", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  coalesce(CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag = 'A' END, CASE WHEN l_discount <> l_tax THEN l_discount > l_tax END) AS home_win, round(l_discount - l_tax, 6) AS diff FROM lineitem""")
def labels(t: Tables) -> DataFrame:
    """Label from flag, else from scores, else null; difference of two sides."""
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.coalesce(flag, F.when(F.col("l_discount") != F.col("l_tax"), F.col("l_discount") > F.col("l_tax"))).alias("home_win"), r6(F.col("l_discount") - F.col("l_tax")).alias("diff"),
    )


@query("h28_lifecycle_rank", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 5 WHEN 'O' THEN 4 WHEN 'P' THEN 2 ELSE 1 END AS rank FROM orders")
def lifecycle_rank(t: Tables) -> DataFrame:
    """Lifecycle code to rank."""
    return t.orders.select("o_orderkey", text.lifecycle_rank(F.col("o_orderstatus")).alias("rank"))


EDGE_LABELS = ["model_much_lower_than_market", "model_slightly_lower_than_market", "model_slightly_higher_than_market", "model_much_higher_than_market"]


@query("h29_h31_bucket_labels", f"""WITH {G}, q AS (SELECT *, list_count(list_filter([{', '.join(map(repr, NUMPY_EDGES))}]::DOUBLE[], lambda e: p >= e)) AS b, date_diff('hour', snapshot, start) AS hours FROM n)
SELECT game_pk, printf('%.2f-%.2f', b / 10.0::DOUBLE, (b + 1) / 10.0::DOUBLE) AS p_bucket,
  CASE WHEN edge >= 0.05 THEN 'model_much_higher_than_market' WHEN edge >= 0 THEN 'model_slightly_higher_than_market' WHEN edge >= -0.05 THEN 'model_slightly_lower_than_market' ELSE 'model_much_lower_than_market' END AS edge_bucket,
  CASE WHEN hours < 2 THEN '<2h' WHEN hours < 6 THEN '2-6h' WHEN hours < 24 THEN '6-24h' ELSE '24h+' END AS time_bucket FROM q""")
def bucket_labels(t: Tables) -> DataFrame:
    """Labels by literal edges."""
    b = text.digitised(F.col("p"), NUMPY_EDGES)
    hours = (F.col("start").cast("timestamp").cast("long") - F.col("snapshot").cast("timestamp").cast("long")) / 3600
    return market(t).select(
        "game_pk", F.format_string("%.2f-%.2f", b / 10, (b + 1) / 10).alias("p_bucket"),
        F.element_at(F.array(*map(F.lit, EDGE_LABELS)), text.digitised(F.col("edge"), [-0.05, 0.0, 0.05]) + 1).alias("edge_bucket"),
        F.when(hours < 2, "<2h").when(hours < 6, "2-6h").when(hours < 24, "6-24h").otherwise("24h+").alias("time_bucket"),
    )


@query("h32_logit", f"WITH {G} SELECT game_pk, round(ln(greatest(least(p, 1 - 1e-12), 1e-12) / (1 - greatest(least(p, 1 - 1e-12), 1e-12))), 6) AS logit FROM n")
def logit(t: Tables) -> DataFrame:
    """Clipped logit."""
    return games(t).select("game_pk", r6(odds.safe_logit(F.col("p"))).alias("logit"))


@query("h33_vector_hash", "SELECT l_suppkey, sha256(string_agg(l_quantity::INT::VARCHAR, ',' ORDER BY l_quantity, l_orderkey)) AS hash FROM lineitem GROUP BY l_suppkey")
def vector_hash(t: Tables) -> DataFrame:
    """Hash of an ordered vector per key."""
    x = F.sort_array(F.collect_list(F.struct("l_quantity", "l_orderkey")))
    return t.lineitem.groupBy("l_suppkey").agg(F.sha2(F.array_join(F.transform(x, lambda v: v["l_quantity"].cast("int").cast("string")), ","), 256).alias("hash"))


@query("h34_h35_patterns", """SELECT event_id, regexp_extract(props, '"k": ([0-9]+)', 1)::BIGINT AS k, regexp_matches(value::VARCHAR, '^[0-9]+\\.[012]$') AS innings_ok FROM events""")
def patterns(t: Tables) -> DataFrame:
    """Id out of a string by pattern; domain check by pattern."""
    return t.events.select("event_id", F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("long").alias("k"), F.col("value").cast("string").rlike(r"^[0-9]+\.[012]$").alias("innings_ok"))


@query("h36_h37_coercion", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS flag, o_custkey::DOUBLE AS number, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 1900 END, year(o_orderdate)) AS season FROM orders")
def coercion(t: Tables) -> DataFrame:
    """Numeric coercion by type; season or else year."""
    return t.orders.select(
        "o_orderkey", text.lenient_double(F.col("o_orderstatus") == "F", "boolean").alias("flag"), text.lenient_double(F.col("o_custkey"), "bigint").alias("number"),
        F.coalesce(F.when(F.col("o_orderkey") % 3 == 0, 1900), F.year("o_orderdate")).alias("season"),
    )


@query("h38_h39_distribution_frame", """SELECT l_returnflag, q::VARCHAR AS bin, n FROM (SELECT l_returnflag, floor(l_quantity / 10)::INT AS q, count(*) AS n FROM lineitem GROUP BY ALL)""")
def distribution_frame(t: Tables) -> DataFrame:
    """Histogram as a map per group, opened again into rows."""
    x = t.lineitem.groupBy("l_returnflag", F.floor(F.col("l_quantity") / 10).cast("int").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    m = x.groupBy("l_returnflag").agg(F.map_from_entries(F.collect_list(F.struct(F.col("q").cast("string"), "n"))).alias("m"))
    return m.select("l_returnflag", F.explode("m").alias("bin", "n"))


@query("h40_book_deltas", f"""WITH {G}, q AS (SELECT game_pk, o_custkey, mh FROM n WHERE abs(home) >= 100), b AS (SELECT o_custkey, avg(mh) AS mean FROM q GROUP BY 1)
SELECT game_pk, round(mh - mean, 6) AS delta FROM q JOIN b USING (o_custkey)""")
def book_deltas(t: Tables) -> DataFrame:
    """Each book's no-vig probability against the mean of all books."""
    from pyspark.sql import Window as W

    m = market(t).where(odds.valid_american(F.col("home")).isNotNull())
    return m.select("game_pk", r6(F.col("mk.home") - F.avg("mk.home").over(W.partitionBy("o_custkey"))).alias("delta"))


@query("h41_dimension_label", "SELECT s_suppkey, upper(substr(n_name, 1, 3)) AS label FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def dimension_label(t: Tables) -> DataFrame:
    """Abbreviation from a dimension of fixed size."""
    return t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.upper(F.substring("n_name", 1, 3)).alias("label"))


@query("b10_b12_names", """SELECT c_custkey, lower(trim(' ' || c_name || ' ')) AS v1, trim(regexp_replace(regexp_replace(lower(c_name || '.  X.Y'), '[.]', '', 'g'), '\\s+', ' ', 'g')) AS v3 FROM customer""")
def names(t: Tables) -> DataFrame:
    """Name normalisers."""
    return t.customer.select("c_custkey", text.normal_name(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("v1"), text.plain_name(F.concat("c_name", F.lit(".  X.Y"))).alias("v3"))


@query("b11_folded_names", """SELECT doc_id, trim(regexp_replace(replace(lower(strip_accents(replace(text, 'ß', 'ss'))), '.', ''), '\\s+', ' ', 'g')) AS folded FROM documents""")
def folded_names(t: Tables) -> DataFrame:
    """Accents and dots dropped, case folded."""
    return t.documents.select("doc_id", text.folded_name(F.col("text")).alias("folded"))


@query("b13_b15_instants", """SELECT event_id, floor(epoch(ts))::BIGINT AS seconds, CASE WHEN event_id % 5 = 0 THEN NULL ELSE epoch(date_trunc('second', ts))::BIGINT END AS parsed FROM events""")
def instants(t: Tables) -> DataFrame:
    """Naive is UTC; text that can't be read is null."""
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return t.events.select(
        "event_id", F.col("ts").cast("timestamp").cast("long").alias("seconds"),
        text.parsed_instant(F.when(F.col("event_id") % 5 == 0, F.lit("soon")).otherwise(iso)).cast("long").alias("parsed"),
    )


@query("b14_pacific", """SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles', '%Y-%m-%d %H:%M') ||
  CASE WHEN ts - ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles') < INTERVAL 8 HOUR THEN ' PDT' ELSE ' PST' END AS local FROM events""")
def pacific(t: Tables) -> DataFrame:
    """Pacific display time."""
    return t.events.select("event_id", text.pacific(F.col("ts").cast("timestamp")).alias("local"))


@query("b16_completed", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND NOT (o_orderpriority ILIKE '1-%' OR o_orderpriority ILIKE '4-NOT%' OR o_orderpriority ILIKE 'x%')")
def completed(t: Tables) -> DataFrame:
    """Final and none of three called-off details."""
    detail = F.coalesce("o_orderpriority", F.lit(""))
    return t.orders.where((F.col("o_orderstatus") == "F") & ~detail.ilike("1-%") & ~detail.ilike("4-NOT%") & ~detail.ilike("x%")).select("o_orderkey")


@query("b17_b18_due", """WITH done AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND user_id % 3 = 0)
SELECT event_id FROM events WHERE date_diff('second', ts, TIMESTAMP '2024-01-02 00:00:00') / 60.0 BETWEEN 30 AND 600 AND user_id NOT IN (SELECT user_id FROM done)""")
def due(t: Tables) -> DataFrame:
    """Rows in a window before an instant whose key isn't captured yet."""
    minutes = (F.lit("2024-01-02 00:00:00").cast("timestamp").cast("long") - F.date_trunc("second", "ts").cast("timestamp").cast("long")) / 60
    return t.events.where(minutes.between(30, 600)).join(t.events.where("event_type = 'error' AND user_id % 3 = 0").select("user_id").distinct(), "user_id", "left_anti").select("event_id")


@query("b19_b20_slate", "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE = DATE '1998-01-05' AND o_orderstatus IN ('P', 'O')")
def slate(t: Tables) -> DataFrame:
    """Active slate of a date."""
    return t.orders.where((F.to_date("o_orderdate") == F.lit("1998-01-05").cast("date")) & F.col("o_orderstatus").isin("P", "O")).select("o_orderkey")


@query("b24_b26_reasons", f"""WITH {G} SELECT game_pk, CASE WHEN game_pk % 7 = 0 THEN 'no_odds' WHEN predicted >= start THEN 'not_pregame' WHEN p < 0.05 OR p > 0.95 THEN 'extreme_probability' WHEN status = 'P' THEN 'pending' END AS reason FROM n""")
def reasons(t: Tables) -> DataFrame:
    """First of several reasons, in order; null passes."""
    return games(t).select("game_pk", F.when(F.col("game_pk") % 7 == 0, "no_odds").when(F.col("predicted") >= F.col("start"), "not_pregame").when(~F.col("p").between(0.05, 0.95), "extreme_probability").when(F.col("status") == "P", "pending").alias("reason"))


@query("b05_b27_unpivot", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, measure, value FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(['discount', 'tax']) AS measure, unnest([l_discount, l_tax]) AS value FROM lineitem) WHERE value > 0""")
def unpivot(t: Tables) -> DataFrame:
    """Two sides of a row as rows of their own, empty sides dropped."""
    k = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    x = t.lineitem.select(*k, F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return x.unpivot(k, ["discount", "tax"], "measure", "value").where("value > 0")


@query("b06_b08_flatten", """WITH a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events WHERE value > 1)
SELECT user_id, event_id, pos AS appearance_order, pos = 1 AS is_starter FROM a""")
def flatten(t: Tables) -> DataFrame:
    """Ordered array flattened, inactive entries dropped, the rest renumbered, the first marked."""
    from pyspark.sql import Window as W

    lists = t.events.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("a"))
    rows = lists.select("user_id", F.posexplode("a").alias("pos", "e")).where("e.value > 1")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("pos"))
    return rows.select("user_id", F.col("e.event_id").alias("event_id"), n.alias("appearance_order"), (n == 1).alias("is_starter"))


@query("b21_b23_placeholders", """WITH s AS (SELECT c_custkey FROM customer), h AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(n, 0) AS n, n IS NULL AS placeholder FROM s LEFT JOIN h ON o_custkey = c_custkey""")
def placeholders(t: Tables) -> DataFrame:
    """Keys of a slate without history get placeholder rows."""
    have = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    lack = t.customer.select("c_custkey").join(have, "c_custkey", "left_anti")
    return have.join(t.customer.select("c_custkey"), "c_custkey", "left_semi").withColumn("placeholder", F.lit(False)).unionByName(lack.select("c_custkey", F.lit(0).cast("long").alias("n"), F.lit(True).alias("placeholder")))


@query("b30_families", "SELECT name, CASE WHEN name LIKE 'l_ship%' THEN 'time' WHEN regexp_matches(name, '^l_(quantity|extendedprice|discount|tax)$') THEN 'measure' WHEN name LIKE '%key' THEN 'key' ELSE 'unclassified' END AS family FROM (SELECT unnest(['l_orderkey', 'l_quantity', 'l_shipdate', 'l_linestatus', 'l_tax']) AS name)")
def families(t: Tables) -> DataFrame:
    """Column names to families by rule."""
    names = [c for c in t.lineitem.columns if c in ("l_orderkey", "l_quantity", "l_shipdate", "l_linestatus", "l_tax")]
    df = t.spark.createDataFrame([(n,) for n in names], "name string")
    return df.select("name", F.when(F.col("name").startswith("l_ship"), "time").when(F.col("name").rlike("^l_(quantity|extendedprice|discount|tax)$"), "measure").when(F.col("name").endswith("key"), "key").otherwise("unclassified").alias("family"))


@query("b31_quarantine", "SELECT event_id, try_cast(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events WHERE json_valid(props) AND (json_extract(props, '$.k'))::BIGINT >= 50")
def quarantine(t: Tables) -> DataFrame:
    """Each record judged alone, bad ones dropped."""
    k = F.from_json("props", "k long")["k"]
    return t.events.where(k.isNotNull() & (k >= 50)).select("event_id", k.alias("k"))
