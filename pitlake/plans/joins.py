"""Join, matching, set and ordering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitlake.operators import matching, quality
from pitlake.plans.base import Tables, query
from pitlake.plans.scalars import G, market


@query("c01_match_unique", """WITH c AS (SELECT p_brand, p_size, count(*) AS n, min(p_partkey) AS id FROM part WHERE p_type <> 'PROMO' GROUP BY ALL)
SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS event_id, CASE WHEN coalesce(n, 0) = 0 THEN 'unmapped' WHEN n = 1 THEN 'mapped' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN id END AS p_partkey, coalesce(n, 0) AS candidate_count
FROM lineitem LEFT JOIN c ON p_brand = 'Brand#' || (l_suppkey % 30) AND p_size = l_quantity::INT""")
def match_unique(t: Tables) -> DataFrame:
    """Exact match, counted."""
    events = t.lineitem.select((F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("event_id"), F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 30).cast("string")).alias("p_brand"), F.col("l_quantity").cast("int").alias("p_size"))
    return matching.match_unique(events, t.part.where("p_type <> 'PROMO'"), ["p_brand", "p_size"], "event_id", "p_partkey")


@query("c02_match_with_start", """WITH c AS (SELECT o_orderkey AS id, o_custkey AS k, o_orderstatus AS s, o_orderdate AS st FROM orders),
e AS (SELECT o_orderkey AS event_id, o_custkey AS k, o_orderstatus AS s, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS st FROM orders),
a AS (SELECT k, s, count(*) AS n, min(id) AS id FROM c GROUP BY ALL), b AS (SELECT k, s, st, count(*) AS m, min(id) AS sid FROM c GROUP BY ALL),
n AS (SELECT event_id, e.st, coalesce(n, 0) AS n, id, coalesce(m, 0) AS m, sid FROM e LEFT JOIN a USING (k, s) LEFT JOIN b ON b.k = e.k AND b.s = e.s AND b.st = e.st)
SELECT event_id, CASE WHEN n = 0 THEN 'UNMATCHED' WHEN n = 1 OR m = 1 THEN 'MATCHED' ELSE 'AMBIGUOUS' END AS status,
  CASE WHEN n = 0 THEN 'no_date_team_candidate' WHEN n = 1 THEN 'unique_date_team_candidate' WHEN st IS NULL THEN 'doubleheader_no_event_start_time' WHEN m = 1 THEN 'unique_start_time_match_among_candidates'
       WHEN m = 0 THEN 'doubleheader_no_start_time_match' ELSE 'doubleheader_multiple_start_time_matches' END AS reason, CASE WHEN n = 1 THEN id WHEN m = 1 THEN sid END AS id, n AS candidate_count FROM n""")
def match_with_start(t: Tables) -> DataFrame:
    """Unique by key, else by exact start, else ambiguous with its reason."""
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderdate").alias("st"))
    e = o.select(F.col("o_orderkey").alias("event_id"), "k", "s", F.when(F.col("o_orderkey") % 3 != 0, F.col("st")).alias("st"))
    return matching.match_with_start(e, o.withColumnRenamed("o_orderkey", "id"), ["k", "s"], "st", "event_id", "id")


@query("c04_word_subset", """WITH a AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS city FROM part), b AS (SELECT DISTINCT p_name FROM part)
SELECT city, p_name FROM a, b WHERE list_has_all(string_split(p_name, ' '), string_split(city, ' '))""")
def word_subset(t: Tables) -> DataFrame:
    """Names whose words all occur in another name."""
    a = t.part.select(F.element_at(F.split("p_name", " "), 1).alias("city"))
    return matching.word_subset_pairs(a, t.part, "city", "p_name")


@query("c06_nearest_in_time", """WITH a AS (SELECT event_id, user_id, date_trunc('minute', ts) AS ts FROM events WHERE event_type = 'purchase'), b AS (SELECT event_id AS click_id, user_id, date_trunc('minute', ts) AS ts FROM events WHERE event_type = 'click'),
m AS (SELECT a.event_id, click_id, abs(epoch(a.ts) - epoch(b.ts)) AS gap FROM a JOIN b USING (user_id) WHERE abs(epoch(a.ts) - epoch(b.ts)) <= 43200),
r AS (SELECT event_id, min(gap) AS gap FROM m GROUP BY 1), n AS (SELECT event_id, gap, count(*) AS n, min(click_id) AS id FROM m JOIN r USING (event_id, gap) GROUP BY ALL)
SELECT a.event_id, CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN id END AS click_id, gap::DOUBLE AS gap_seconds FROM a LEFT JOIN n USING (event_id)""")
def nearest_in_time(t: Tables) -> DataFrame:
    """Nearest row of the same key within 12 hours, equal distance ambiguous."""
    e = t.events.withColumn("ts", F.date_trunc("minute", "ts"))
    return matching.nearest_in_time(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", "ts"), ["user_id"], "ts", "ts", "event_id", "click_id", 43200)


@query("c08_pivot_pairs", """SELECT user_id, arg_max(value, (ts, event_id)) FILTER (event_type = 'click') AS click, arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'click') > 0 AND count(*) FILTER (event_type = 'purchase') > 0""")
def pivot_pairs(t: Tables) -> DataFrame:
    """Latest value of each side per key, complete pairs only."""
    x = t.events.groupBy("user_id").pivot("event_type", ["click", "purchase"]).agg(F.max_by("value", F.struct("ts", "event_id")))
    return x.dropna(subset=["click", "purchase"])


@query("c11_orphans", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphans(t: Tables) -> DataFrame:
    """Rows without a partner."""
    return t.orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@query("c13_cardinality", "SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(l_orderkey) <> 1")
def cardinality(t: Tables) -> DataFrame:
    """One-to-one join violations."""
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return t.orders.select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


@query("c14_agreement", """WITH f AS (SELECT l_orderkey, min(l_shipdate) AS first FROM lineitem GROUP BY 1)
SELECT o_orderkey FROM orders JOIN f ON l_orderkey = o_orderkey WHERE first < o_orderdate""")
def agreement(t: Tables) -> DataFrame:
    """C14: two sources of one fact that disagree."""
    f = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first"))
    return t.orders.join(f, "o_orderkey").where("first < o_orderdate").select("o_orderkey")


@query("c16_two_sided", """WITH c AS (SELECT c_custkey AS s_suppkey, c_acctbal AS s_acctbal FROM customer), g AS (SELECT DISTINCT c_custkey // 2 AS game, c_custkey // 2 * 2 AS home, c_custkey // 2 * 2 + 1 AS away FROM customer)
SELECT game, round(h.s_acctbal, 4) AS home_acctbal, round(a.s_acctbal, 4) AS away_acctbal, round(h.s_acctbal - a.s_acctbal, 4) AS diff_acctbal FROM g JOIN c h ON h.s_suppkey = home JOIN c a ON a.s_suppkey = away""")
def two_sided(t: Tables) -> DataFrame:
    """Home and away components of a game and their difference; games with neither are excluded."""
    game = F.floor(F.col("c_custkey") / 2)
    games = t.customer.select(game.alias("game")).distinct().select("game", (F.col("game") * 2).alias("home"), (F.col("game") * 2 + 1).alias("away"))
    paired = t.customer.join(t.customer.select(F.col("c_custkey").bitwiseXOR(F.lit(1)).alias("c_custkey")), "c_custkey", "left_semi")  # a customer without a partner is in no game
    comp = paired.select(game.alias("game"), F.col("c_custkey").alias("side"), F.col("c_acctbal").alias("acctbal"))
    rows, _ = matching.two_sided(comp, games, "game", "side", "home", "away", ["acctbal"])
    return rows.select("game", F.round("home_acctbal", 4).alias("home_acctbal"), F.round("away_acctbal", 4).alias("away_acctbal"), F.round(F.col("home_acctbal") - F.col("away_acctbal"), 4).alias("diff_acctbal"))


@query("c17_resolve_identity", """WITH a AS (SELECT user_id, min(event_id) AS id FROM events WHERE event_type = 'purchase' AND value > 80 GROUP BY 1), b AS (SELECT user_id, min(event_id) AS id FROM events WHERE event_type = 'click' AND value > 90 GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NOT NULL THEN 'actual' ELSE 'probable' END AS kind FROM a FULL JOIN b ON a.user_id = b.user_id""")
def resolve_identity(t: Tables) -> DataFrame:
    """Full outer merge with priority."""
    pick = lambda kind, least, name: t.events.where((F.col("event_type") == kind) & (F.col("value") > least)).groupBy("user_id").agg(F.min("event_id").alias(name))
    x = pick("purchase", 80, "a").join(pick("click", 90, "b"), "user_id", "full_outer")
    return x.select("user_id", F.coalesce("a", "b").alias("id"), F.when(F.col("a").isNotNull(), "actual").otherwise("probable").alias("kind"))


@query("c18_resolved", """WITH j AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1), p AS (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1)
SELECT p.user_id, p.event_id, j.event_id AS result_id FROM p JOIN j USING (user_id)""")
def resolved(t: Tables) -> DataFrame:
    """Latest row ⋈ latest journal row; unresolved dropped."""
    p = t.events.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    j = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("result_id"))
    return p.join(j, "user_id")


@query("c22_attach_results", """SELECT o_orderkey, CASE WHEN l_orderkey IS NULL THEN 'no_result' WHEN o_orderstatus <> 'F' THEN 'not_final' WHEN o_orderkey % 9 = 0 THEN 'already_recorded' END AS skip
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey""")
def attach_results(t: Tables) -> DataFrame:
    """Reason-coded, idempotent attachment of results."""
    r = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("has", F.lit(True))
    return t.orders.join(r, "o_orderkey", "left").select("o_orderkey", F.when(F.col("has").isNull(), "no_result").when(F.col("o_orderstatus") != "F", "not_final").when(F.col("o_orderkey") % 9 == 0, "already_recorded").alias("skip"))


@query("c23_completed_results", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 2 AND bool_and(l_linestatus = 'F')")
def completed_results(t: Tables) -> DataFrame:
    """Groups of exactly two complete rows."""
    return t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("l_linestatus") == "F").alias("ok")).where("n = 2 AND ok").select("l_orderkey")


@query("c25_preferred_line", """SELECT l_orderkey, l_suppkey FROM (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_shipdate IS NULL)::INT, (l_returnflag <> 'R')::INT, l_returnflag, l_suppkey, l_partkey) AS rn FROM lineitem) WHERE rn = 1""")
def preferred_line(t: Tables) -> DataFrame:
    """The preferred book's line, else the first by name."""
    return t.lineitem.groupBy("l_orderkey").agg(F.min(F.struct((F.col("l_returnflag") != "R").cast("int").alias("a"), "l_returnflag", "l_suppkey", "l_partkey"))["l_suppkey"].alias("l_suppkey"))


@query("c26_failures", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(l_orderkey) AS with_lines FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey GROUP BY ALL")
def failures(t: Tables) -> DataFrame:
    """Inner and left join, grouped count."""
    r = t.lineitem.select("l_orderkey").distinct()
    return t.orders.join(r, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count("l_orderkey").alias("with_lines"))


@query("c28_training_rows", "SELECT o_orderkey, sum(l_quantity)::BIGINT AS runs FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def training_rows(t: Tables) -> DataFrame:
    """Matrix rows with their counts."""
    runs = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").cast("long").alias("runs"))
    return t.orders.where("o_orderstatus = 'F'").select("o_orderkey").join(runs, "o_orderkey")


@query("f01_best_plays", f"WITH {G} SELECT game_pk, round(abs(edge), 6) AS size, row_number() OVER (ORDER BY round(abs(edge), 6) DESC, game_pk) AS rank FROM n ORDER BY size DESC, game_pk LIMIT 5")
def best_plays(t: Tables) -> DataFrame:
    """top five by size, ranked."""
    top = market(t).select("game_pk", F.round(F.abs("edge"), 6).alias("size")).orderBy(F.desc("size"), "game_pk").limit(5)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("size"), "game_pk")))


@query("f02_notable_gaps", """SELECT s_suppkey, name, gap FROM (SELECT s_suppkey, name, gap, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(gap) DESC, pos) AS rn FROM (
  SELECT s_suppkey, unnest([1, 2, 3, 4]) AS pos, unnest(['a', 'b', 'c', 'd']) AS name, unnest([round(s_acctbal % 7, 4), round(s_acctbal % 11, 4), round(s_acctbal % 13, 4), NULL]) AS gap FROM supplier) WHERE gap IS NOT NULL) WHERE rn <= 2""")
def notable_gaps(t: Tables) -> DataFrame:
    """largest differences per row, stable order."""
    gap = [F.round(F.col("s_acctbal") % k, 4) for k in (7, 11, 13)] + [F.lit(None).cast("double")]
    entries = F.array(*(F.struct((-F.abs(g)).alias("o"), F.lit(i).alias("pos"), F.lit(n).alias("name"), g.alias("gap")) for i, (n, g) in enumerate(zip("abcd", gap))))
    top = F.slice(F.sort_array(F.filter(entries, lambda e: e["gap"].isNotNull())), 1, 2)
    return t.supplier.select("s_suppkey", F.inline(top)).select("s_suppkey", "name", "gap")


@query("f03_best_price", "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn = 1")
def best_price(t: Tables) -> DataFrame:
    """highest price, first name on ties."""
    return t.part.groupBy("p_brand").agg(F.max(F.struct("p_retailprice", (-F.col("p_partkey")).alias("k"))).alias("b")).select("p_brand", (-F.col("b.k")).alias("p_partkey"), "b.p_retailprice")


@query("f05_rank_key", "SELECT o_custkey, n, total, row_number() OVER (ORDER BY n DESC, total, o_custkey) AS rank FROM (SELECT o_custkey, count(*) AS n, sum(o_totalprice * 100)::BIGINT AS total FROM orders GROUP BY 1) ORDER BY n DESC, total, o_custkey LIMIT 50")
def rank_key(t: Tables) -> DataFrame:
    """ranking by several keys; a top-k report."""
    x = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("total"))
    key = [F.desc("n"), F.col("total"), F.col("o_custkey")]
    return x.orderBy(*key).limit(50).withColumn("rank", F.row_number().over(W.orderBy(*key)))


@query("f08_order_by_all", "SELECT * FROM nation ORDER BY ALL")
def order_by_all(t: Tables) -> DataFrame:
    """deterministic order over all columns."""
    return t.nation.orderBy(*t.nation.columns)


@query("f09_run_dates", "SELECT DISTINCT o_orderdate::DATE::VARCHAR AS run_date, o_orderdate::DATE = (SELECT max(o_orderdate::DATE) FROM orders) AS latest FROM orders")
def run_dates(t: Tables) -> DataFrame:
    """Distinct dates, the last one marked."""
    d = t.orders.select(F.to_date("o_orderdate").cast("string").alias("run_date")).distinct()
    return d.crossJoin(F.broadcast(d.agg(F.max("run_date").alias("m")))).select("run_date", (F.col("run_date") == F.col("m")).alias("latest")).orderBy("run_date")


@query("g01_common_seasons", "SELECT season FROM (SELECT DISTINCT o_orderstatus, year(o_orderdate) AS season FROM orders) GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT o_orderstatus) FROM orders)")
def common_seasons(t: Tables) -> DataFrame:
    """Intersection over groups."""
    s = t.orders.select("o_orderstatus", F.year("o_orderdate").alias("season")).distinct()
    k = s.agg(F.countDistinct("o_orderstatus").alias("k"))
    return s.groupBy("season").count().join(F.broadcast(k), F.col("count") == F.col("k")).select("season")


@query("g03_schema_drift", "SELECT 'l_comment' AS name, 'missing' AS kind UNION ALL SELECT 'l_tax', 'undeclared'")
def schema_drift(t: Tables) -> DataFrame:
    """Declared against observed columns."""
    declared = {*t.lineitem.columns, "l_comment"} - {"l_tax"}
    seen = set(t.lineitem.columns)
    return t.spark.createDataFrame([(c, "missing") for c in sorted(declared - seen)] + [(c, "undeclared") for c in sorted(seen - declared)], "name string, kind string")


@query("g04_determinism", "SELECT 'rebuild' AS \"check\", 'PASS' AS status, 0::BIGINT AS failing_count")
def determinism(t: Tables) -> DataFrame:
    """A table rebuilt another way holds the same rows."""
    a = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    part = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    b = part.groupBy("l_suppkey").agg(F.sum("n").alias("n"), F.sum("q").alias("q"))
    return quality.same_content(a, b, "rebuild").select("check", "status", "failing_count")


@query("g07_missing_ids", "SELECT id FROM (SELECT unnest([1, 5, -3, 10000000]) AS id) WHERE id NOT IN (SELECT o_orderkey FROM orders)")
def missing_ids(t: Tables) -> DataFrame:
    """Requested ids that don't exist."""
    return t.spark.createDataFrame([(1,), (5,), (-3,), (10_000_000,)], "id long").join(t.orders.select(F.col("o_orderkey").alias("id")), "id", "left_anti")


@query("g08_column_variants", "SELECT * FROM (VALUES ('without quantity', 'discount,tax'), ('without discount', 'quantity,tax'), ('without tax', 'quantity,discount'), ('first 1', 'quantity'), ('first 2', 'quantity,discount'), ('first 3', 'quantity,discount,tax')) v(variant, columns)")
def column_variants(t: Tables) -> DataFrame:
    """Leave-one-out and cumulative column sets."""
    groups = ["quantity", "discount", "tax"]
    rows = [(f"without {g}", ",".join(x for x in groups if x != g)) for g in groups] + [(f"first {i}", ",".join(groups[:i])) for i in range(1, 4)]
    return t.spark.createDataFrame(rows, "variant string, columns string")
