"""Payloads, details, silver tables and the scans made of them, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.operators import matrix, quality, stages
from pitlake.plans.base import Tables, query
from pitlake.plans.feeds import schedule_payloads, shared_folder
from pitlake.plans.league import LEAGUE, games, stats
from pitlake.sources import details, feeds, layers, stores
from pitlake.streaming import capture

OUTS = "CASE WHEN l_partkey % 31 = 0 THEN 'null' WHEN l_partkey % 19 = 0 THEN '-1' WHEN l_partkey % 23 = 0 THEN 'true' WHEN l_partkey % 29 = 0 THEN '\"7\"' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END"
PITCHER = "l_linenumber * 1000000 + l_partkey"


def detail_payloads(t: Tables) -> DataFrame:
    """A detail payload per order: odd lines pitch at home; some lines are hollow or malformed."""
    stats_json = F.when(F.col("l_partkey") % 13 == 0, F.lit("{}")).otherwise(F.concat(
        F.lit('{"inningsPitched":'), F.when(F.col("l_partkey") % 11 == 0, '"5.3"').when(F.col("l_partkey") % 17 == 0, "5").otherwise('"5.1"'), F.lit(',"outs":'), F.expr(OUTS),
        F.lit(',"pitchesThrown":80,"earnedRuns":2,"hits":4,"baseOnBalls":1,"strikeOuts":6,"battersFaced":20}'),
    ))
    pid = F.expr(PITCHER).cast("string")
    entry = F.concat(F.lit('"ID'), pid, F.lit('":{"person":{"id":'), F.when(F.col("l_partkey") % 37 == 0, "0").otherwise(pid), F.lit('},"stats":{"pitching":'), stats_json, F.lit("}}"))
    x = t.lineitem.select("l_orderkey", "l_linenumber", pid.alias("pid"), entry.alias("entry"))
    row = F.struct("l_linenumber", "pid", "entry")
    g = x.groupBy("l_orderkey").agg(*(F.sort_array(F.collect_list(F.when(F.col("l_linenumber") % 2 == k, row))).alias(s) for s, k in (("home", 1), ("away", 0))))
    side = lambda s: F.concat(F.lit(f'"{s}":{{"team":{{"id":1}},"pitchers":['), F.array_join(F.transform(s, lambda r: r["pid"]), ","), F.lit('],"players":{'), F.array_join(F.transform(s, lambda r: r["entry"]), ","), F.lit("}}"))
    body = F.concat(F.lit('{"gamePk":'), F.col("l_orderkey").cast("string"), F.lit(',"liveData":{"boxscore":{"teams":{'), side("home"), F.lit(","), side("away"), F.lit("}}}}"))
    return g.select(F.col("l_orderkey").alias("game_pk"), body.alias("payload"))


REASON = "CASE WHEN l_partkey % 37 = 0 THEN 'player_identity' WHEN l_partkey % 13 = 0 THEN 'empty_stats' WHEN l_partkey % 31 = 0 THEN 'missing_stats' WHEN l_partkey % 11 = 0 OR l_partkey % 17 = 0 THEN 'innings' WHEN l_partkey % 19 = 0 OR l_partkey % 23 = 0 OR l_partkey % 29 = 0 THEN 'whole_numbers' END"
LINES_SQL = f"""lines AS (
  SELECT l_orderkey AS game_pk, CASE WHEN l_linenumber % 2 = 1 THEN 'home' ELSE 'away' END AS side, {PITCHER} AS pitcher_id, l_partkey % 13 <> 0 AS worked,
         CASE WHEN count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey) > 1 THEN 'pitcher_ids' ELSE {REASON} END AS reason FROM lineitem)"""


@query("a11_pitcher_lines", f"WITH {LINES_SQL} SELECT game_pk, side, pitcher_id::BIGINT AS pitcher_id, reason FROM lines")
def pitcher_lines(t: Tables) -> DataFrame:
    """Every listed pitcher of nested payloads, judged by identity, presence and strict types."""
    return details.pitcher_lines(detail_payloads(t)).select("game_pk", "side", "pitcher_id", "reason")


@query("a11_hollow_payloads", f"""WITH {LINES_SQL}, g AS (SELECT game_pk, min(reason) AS reason, count(*) FILTER (side = 'home' AND worked) AS h, count(*) FILTER (side = 'away' AND worked) AS a FROM lines GROUP BY 1),
c AS (SELECT o_orderkey AS game_pk, CASE WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus = 'P' THEN false WHEN o_orderkey % 3 = 0 THEN false ELSE true END AS completed FROM orders)
SELECT game_pk, coalesce(reason, 'no_active_pitcher') AS reason FROM g JOIN c USING (game_pk) WHERE reason IS NOT NULL OR (completed AND (h = 0 OR a = 0))""")
def hollow_payloads(t: Tables) -> DataFrame:
    """Payloads refused, with the completed-lifecycle rule by code, detailed and abstract state."""
    coded = F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus"))
    done = details.completed_lifecycle(coded, F.when(F.col("o_orderkey") % 3 == 0, "Postponed: rain"), F.lit("Final"))
    return details.hollow(detail_payloads(t), t.orders.select(F.col("o_orderkey").alias("game_pk"), done.alias("completed")))


@query("b04_details", "SELECT DISTINCT l_orderkey AS game_pk FROM lineitem")
def loaded_details(t: Tables) -> DataFrame:
    """Detail payloads, each once and of its own game."""
    return details.load_details(detail_payloads(t)).select("game_pk")


@query("b09_strict_types", "SELECT o_orderkey, o_custkey::BIGINT AS k, o_orderstatus = 'F' AS final, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS name FROM orders")
def strict_types(t: Tables) -> DataFrame:
    """Whole, boolean and text values read strictly from untyped JSON."""
    body = F.to_json(F.struct(F.col("o_custkey").alias("k"), (F.col("o_orderstatus") == "F").alias("final"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("name")))
    v = F.parse_json(body)
    at = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
    return t.orders.select("o_orderkey", details.strict(at("k"), "bigint").alias("k"), details.strict(at("final"), "boolean").alias("final"), details.strict(at("name"), "string").alias("name"))


@query("b01_silver_rebuild", f"""WITH {LINES_SQL}, g AS (SELECT count(*) AS n FROM orders WHERE o_custkey % 7 <> o_custkey % 5 AND o_orderkey > 0), ok AS (SELECT * FROM lines WHERE reason IS NULL), p AS (SELECT count(*) AS n FROM part)
SELECT 'games' AS name, n AS rows FROM g UNION ALL SELECT 'team_game_statistics', 2 * n FROM g UNION ALL SELECT 'pitcher_appearances', count(*) FROM ok UNION ALL SELECT 'pitcher_starters', count(*) FROM (SELECT DISTINCT game_pk, side FROM ok) UNION ALL SELECT 'odds', n FROM p UNION ALL SELECT 'odds_mappings', n FROM p""")
def silver_rebuild(t: Tables) -> DataFrame:
    """The six silver tables from payloads, written beside the old ones, counted, then published."""
    odds = t.part.select(F.col("p_partkey").alias("event_id"), (F.col("p_size") % 7).cast("bigint").alias("home_team_id"), (F.col("p_size") % 5).cast("bigint").alias("away_team_id"), "p_retailprice")
    tables, path = details.silver(schedule_payloads(t), detail_payloads(t), odds, ["event_id"]), shared_folder(t, "silver")
    found = details.rebuild(tables, path, {"odds": odds.count()})
    back = None
    for name in tables:
        n = t.spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"))
        back = n if back is None else back.unionByName(n)
    assert set(found) == set(tables)
    return back


@query("a04_ingest", "SELECT 'first' AS run, count(*) AS appended, 0::BIGINT AS skipped FROM nation UNION ALL SELECT 'second', 0, count(*) FROM nation")
def ingest_payload(t: Tables) -> DataFrame:
    """A payload hashed, compared with the published hash, kept once and appended by key; a second run adds nothing."""
    rows = [{"id": r["n_nationkey"], "name": r["n_name"]} for r in t.nation.orderBy("n_nationkey").collect()]  # a payload arrives on the driver
    payload, root = layers.canonical_json(rows), shared_folder(t, "lake")
    layers.initialize(t.spark, root)
    parse = lambda df: df.select(F.inline(F.from_json("payload", "array<struct<id bigint, name string>>")))
    got = [layers.ingest(t.spark, root, "nations/1.json", payload, parse, f"{root}/bronze/nations", ["id"]) for _ in range(2)]
    return t.spark.createDataFrame([(n, g["appended"], g["skipped"]) for n, g in zip(("first", "second"), got)], "run string, appended long, skipped long")


def totals_payloads(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    side = lambda n, p: F.struct(F.lit(n).alias("name"), F.lit(-110).alias("price"), p.cast("double").alias("point"))
    point = k % 10 + 0.5
    market = F.struct(F.lit("totals").alias("key"), F.array(side("Over", point), side("Under", F.when(k % 9 == 0, point + 1).otherwise(point))).alias("outcomes"))
    book = F.struct(F.lit("one").alias("key"), F.lit("2024-01-01T00:00:00Z").alias("last_update"), F.array(market).alias("markets"))
    event = F.struct(k.cast("string").alias("id"), F.lit("2024-01-02T00:00:00Z").alias("commence_time"), F.lit("H").alias("home_team"), F.lit("A").alias("away_team"), F.array(book).alias("bookmakers"))
    return t.orders.select(F.to_json(F.array(event)).alias("payload"))


@query("a18_totals", "SELECT o_orderkey AS event_id, o_orderkey % 9 <> 0 AS ok FROM orders")
def totals(t: Tables) -> DataFrame:
    """Totals of a book need both sides at one point."""
    out = feeds.complete_markets(feeds.market_outcomes(totals_payloads(t), "totals"), ("over", "under"))
    return out.select(F.col("event_id").cast("long").alias("event_id"), "ok")


@query("a20_totals_store", "SELECT 2 * count(*) - count(*) FILTER (o_orderkey % 9 <> 0) AS appended, 0::BIGINT AS skipped FROM orders UNION ALL SELECT 0, 2 * count(*) - count(*) FILTER (o_orderkey % 9 <> 0) FROM orders")
def totals_store(t: Tables) -> DataFrame:
    """Lines kept by event, book, time and point; another point is another line."""
    rows = feeds.market_outcomes(totals_payloads(t), "totals").select("event_id", "bookmaker", "snapshot", "point", "american").distinct()
    path, key = shared_folder(t, "totals"), ["event_id", "bookmaker", "snapshot", "point"]
    got = [stores.append_new(rows, path, key) for _ in range(2)]
    return t.spark.createDataFrame([(g["appended"], g["skipped"]) for g in got], "appended long, skipped long")


@query("c10_totals_line", """WITH l AS (SELECT user_id, ts::DATE AS day, value AS point, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'click')
SELECT event_id, point FROM events e JOIN l ON l.user_id = e.user_id AND l.day = e.ts::DATE AND k = 1 WHERE event_type = 'purchase'""")
def totals_line(t: Tables) -> DataFrame:
    """The latest line across points of each event, later entries winning ties, brought to the schedule."""
    line = t.events.where("event_type = 'click'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("point"))
    return t.events.where("event_type = 'purchase'").select("event_id", "user_id", F.to_date("ts").alias("day")).join(line, ["user_id", "day"]).select("event_id", "point")


@query("a23_archive_compare", "SELECT 'same' AS archive, 'PASS' AS status, 0::BIGINT AS failing_count UNION ALL SELECT 'changed', 'FAIL', 2 * count(*) FROM part WHERE p_partkey % 40 = 3")
def archive_compare(t: Tables) -> DataFrame:
    """An archive read again must hold the same rows; differences are counted on both sides."""
    a = t.part.select("p_partkey", "p_brand", "p_size")
    b = a.withColumn("p_size", F.when(F.col("p_partkey") % 40 == 3, F.col("p_size") + 100).otherwise(F.col("p_size")))
    parts = [quality.same_content(a, x, n) for n, x in (("same", a.repartition(3)), ("changed", b))]
    return quality.union_all(parts).select(F.col("check").alias("archive"), "status", "failing_count")


@query("a25_unnest", "SELECT l_orderkey AS game_pk, l_linenumber AS line_no, l_discount AS price_opening_home, l_tax AS price_opening_away FROM lineitem")
def unnest(t: Tables) -> DataFrame:
    """Lists of nested structs as rows, structs flattened at any depth."""
    price = F.struct(F.struct(F.col("l_discount").alias("home"), F.col("l_tax").alias("away")).alias("opening"))
    lists = t.lineitem.groupBy(F.col("l_orderkey").alias("game_pk")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("line_no"), price.alias("price"))).alias("lines"))
    return layers.flatten(lists.select("game_pk", F.inline("lines")))


SCANS = {
    "training": ("season BETWEEN 1993 AND 1997", "season BETWEEN 1993 AND 1997"), "as_of": ("CAST(game_date AS DATE) <= DATE '1996-06-30'", "CAST(game_date AS DATE) < DATE '1996-06-30'"),
    "holdout": ("season = 1998 AND state = 'Final' AND game_type = 'R'", "season = 1998 AND state = 'Final' AND game_type = 'R'"),
}


@query("a32_scans", f"WITH {LEAGUE}, x AS (SELECT *, year(game_date) AS season FROM games) " + " UNION ALL ".join(
    f"SELECT '{n}' AS scan, (SELECT count(*) FROM x WHERE {a}) AS games, (SELECT count(*) FROM appearances JOIN x USING (game_pk) WHERE {b}) AS appearances" for n, (a, b) in SCANS.items()))
def scans(t: Tables) -> DataFrame:
    """Training seasons, the state as of a day (appearances strictly before it), and a holdout of completed regular games."""
    g = games(t).withColumn("season", F.year("game_date")).select("game_pk", "game_date", "season", "state", "game_type")
    both = g.join(t.lineitem.groupBy(F.col("l_orderkey").alias("game_pk")).agg(F.count(F.lit(1)).alias("n")), "game_pk", "left").fillna(0, ["n"])
    sums = both.agg(*(x for n, (a, b) in SCANS.items() for x in (F.count_if(F.expr(a)).alias(f"g_{n}"), F.sum(F.when(F.expr(b), F.col("n")).otherwise(0)).alias(f"a_{n}"))))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(n).alias("scan"), F.col(f"g_{n}").alias("games"), F.col(f"a_{n}").alias("appearances")) for n in SCANS))))


@query("a41_build_selection", "SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_custkey % 2 = 0)")
def build_selection(t: Tables) -> DataFrame:
    """What isn't stored yet under this build; rows of other builds don't count."""
    stored = t.orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, "this").otherwise("other").alias("build_id"))
    return t.orders.select("o_orderkey").join(stored.where("build_id = 'this'"), "o_orderkey", "left_anti")


@query("c24_results_from_json", "SELECT o_orderkey AS game_pk, unnest(['home', 'away']) AS side, unnest([(o_orderkey % 7)::INT, (o_orderkey % 5)::INT]) AS score FROM orders WHERE o_orderstatus = 'F'")
def results_from_json(t: Tables) -> DataFrame:
    """Results straight from schedule payloads, completed games alone, a row a side."""
    x = feeds.schedule_games(schedule_payloads(t)).where("state = 'F'")
    return x.select("game_pk", F.inline(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_score").alias("score")) for s in ("home", "away")))))


@query("c29_candidates", "SELECT o_orderkey AS game_pk, 'home' AS home_team, 'away' AS away_team, o_orderdate::DATE::VARCHAR AS game_date FROM orders")
def candidates(t: Tables) -> DataFrame:
    """Candidates for matching with the team names of the payload."""
    x = schedule_payloads(t).select(F.explode(F.from_json("payload", feeds.SCHEDULE)["dates"]).alias("d")).select(F.explode("d.games").alias("g"))
    return x.select("g.gamePk", "g.teams.home.team.name", F.col("g.teams.away.team.name").alias("away"), F.to_date(F.substring("g.gameDate", 1, 10)).cast("string").alias("game_date")).toDF("game_pk", "home_team", "away_team", "game_date")


@query("m04_pinned_archive", "SELECT archive, count(*) AS rows FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN sha256('a') ELSE sha256('b') END AS archive FROM part) WHERE archive = sha256('a') GROUP BY 1")
def pinned_archive(t: Tables) -> DataFrame:
    """Rows of the archive with the published hash alone."""
    x = t.part.select(F.sha2(F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b"), 256).alias("archive"))
    return x.where(F.col("archive") == F.sha2(F.lit("a"), 256)).groupBy("archive").agg(F.count(F.lit(1)).alias("rows"))


def start_rows(t: Tables) -> DataFrame:
    """The least part of each order's line number as the pitcher of that appearance."""
    x = t.lineitem.groupBy(F.col("l_orderkey").alias("game_pk"), "l_linenumber").agg(F.min("l_partkey").alias("pitcher_id"))
    return x.select("game_pk", F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(2).alias("team_id"), "pitcher_id", F.when(F.col("game_pk") % 5 != 0, F.col("l_linenumber") <= 2).alias("is_actual_starter"))


@query("m07_actual_starts", f"WITH {LEAGUE} SELECT l_orderkey AS game_pk, CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 2 END AS team_id, min(l_partkey) AS pitcher_id FROM lineitem JOIN games ON game_pk = l_orderkey WHERE l_orderkey % 5 <> 0 AND l_linenumber <= 2 AND coalesce(game_type, 'R') = 'R' AND home_team_id <> away_team_id GROUP BY l_orderkey, l_linenumber")
def actual_starts(t: Tables) -> DataFrame:
    """Actual starters of regular games, one a game and team; games are regular, known once and of two teams."""
    g = games(t).where("coalesce(game_type, 'R') <> 'R' OR home_team_id <> away_team_id")
    return matrix.actual_starts(start_rows(t), g).select("game_pk", "team_id", "pitcher_id")


@query("m08_bullpen", "SELECT l_orderkey AS game_pk, l_linenumber, l_linenumber > 2 AS bullpen FROM lineitem")
def bullpen(t: Tables) -> DataFrame:
    """Relievers by the starter flag, else by the order of appearance."""
    order = F.floor((F.col("l_linenumber") + 1) / 2)
    flag = F.when(F.col("l_orderkey") % 5 != 0, F.col("l_linenumber") <= 2)
    return t.lineitem.select(F.col("l_orderkey").alias("game_pk"), "l_linenumber", matrix.is_bullpen(flag, order).alias("bullpen"))


@query("i19_leakage_rows", f"WITH {LEAGUE} SELECT game_pk, side, s.team_id, score, g.game_date::DATE::VARCHAR AS day FROM stats s JOIN games g USING (game_pk) WHERE coalesce(game_type, 'R') = 'R'")
def leakage_rows(t: Tables) -> DataFrame:
    """Team rows with their game's date, the input of the leakage checks."""
    g = games(t).where("coalesce(game_type, 'R') = 'R'").select("game_pk", F.to_date("game_date").cast("string").alias("day"))
    return stats(t).drop("game_date").join(g, "game_pk").select("game_pk", "side", "team_id", "score", "day")


@query("k02_capture_run", """WITH due AS (SELECT user_id FROM (SELECT user_id, max(ts) AS start FROM events GROUP BY 1) WHERE user_id % 4 <> 0),
q AS (SELECT user_id, max(value) FILTER (event_type = 'click') AS home, max(value) FILTER (event_type = 'purchase') AS away FROM events GROUP BY 1)
SELECT CASE WHEN home IS NULL OR away IS NULL THEN 'one_side_missing' ELSE 'stored' END AS reason, count(*) AS n FROM q JOIN due USING (user_id) GROUP BY 1""")
def capture_run(t: Tables) -> DataFrame:
    """Due games alone, their pairs, reasons counted, complete pairs appended by key."""
    last = t.events.groupBy("user_id").agg((F.max("ts").cast("timestamp") + F.expr("INTERVAL 30 MINUTES")).alias("start"), F.max("ts").cast("timestamp").alias("now"))
    due = capture.due(last, "now", "start", t.events.where("user_id % 4 = 0").select("user_id"), "user_id").select("user_id")
    side = F.when(F.col("event_type") == "click", "home").when(F.col("event_type") == "purchase", "away")
    start = F.lit("2100-01-01 00:00:00").cast("timestamp_ntz")
    q = t.events.join(due, "user_id", "left_semi").select("user_id", side.alias("side"), "value", F.lit("2000-01-01").cast("timestamp_ntz").alias("snapshot"), F.col("ts").cast("timestamp_ntz").alias("predicted"), start.alias("start"))
    pairs = capture.capture_records(q, "user_id", "side", "value", "snapshot", "predicted", "start")
    stored = stores.append_new(pairs.where("reason IS NULL").select("user_id", "home", "away"), shared_folder(t, "pairs"), ["user_id"])
    missing = pairs.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return missing.unionByName(t.spark.createDataFrame([("stored", stored["appended"])] if stored["appended"] else [], "reason string, n long"))


@query("k05_operator_stages", "SELECT 'capture' AS stage, 'ok' AS status, count(*) AS rows FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'predict', 'ok', count(DISTINCT user_id) FROM events UNION ALL SELECT 'enrich', 'failed', NULL UNION ALL SELECT 'report', 'skipped', NULL")
def operator_stages(t: Tables) -> DataFrame:
    """Stages in order, what each gave, and what a failure leaves undone."""
    path = shared_folder(t, "stage")

    def enrich(done: dict) -> int:
        return stores.append_new(t.events.where("event_type = 'purchase'").select("event_id", (F.col("value") + 1).alias("value")), path, ["event_id"])["appended"]

    run = stages.run_stages([
        ("capture", lambda done: stores.append_new(t.events.where("event_type = 'purchase'").select("event_id", "value"), path, ["event_id"])["appended"]),
        ("predict", lambda done: t.events.select("user_id").distinct().count()),
        ("enrich", enrich),  # the same keys with other content
        ("report", lambda done: 0),
    ])
    return t.spark.createDataFrame([(r["stage"], r["status"], r["result"]) for r in run], "stage string, status string, rows long")


@query("k14_report_ranking", "SELECT p_brand AS model, count(*) AS n, round(avg(p_size), 6) AS log_loss FROM part GROUP BY 1")
def report_ranking(t: Tables) -> DataFrame:
    """A report as sorted JSON, its ranking read back as rows."""
    rows = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_size"), 6).alias("l")).collect()  # a ranking: a row a model
    path = layers.write_report(t.spark, shared_folder(t, "report") + ".json", {"ranking": [{"model": r["p_brand"], "n": r["n"], "log_loss": r["l"]} for r in rows], "kind": "comparison"})
    back = t.spark.read.schema("kind string, ranking array<struct<model string, n bigint, log_loss double>>").option("multiLine", True).json(path)
    return back.select(F.inline("ranking"))
