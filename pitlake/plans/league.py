"""Orders as games of a league: the twenty, seven and nine checks, the feature matrix and its parts.

The mapping of the driver's tables to games, team rows and appearances is the
same text in both engines; what is done with them is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitlake.functions import text
from pitlake.operators import checks, matrix
from pitlake.plans.base import Tables, query

r6 = lambda c: F.round(c, 6)

GAME = {
    "game_pk": "o_orderkey", "game_date": "o_orderdate", "game_number": "1 + o_orderkey % 2", "source": "CASE WHEN o_orderkey % 211 <> 0 THEN o_orderpriority END",
    "game_type": "CASE WHEN o_orderkey % 13 = 0 THEN 'S' WHEN o_orderkey % 17 <> 0 THEN 'R' END",
    "state": "CASE WHEN o_orderkey % 101 = 0 THEN 'Odd' WHEN o_orderstatus = 'F' THEN 'Final' WHEN o_orderstatus = 'O' THEN 'Preview' ELSE 'Live' END",
    "detailed": "CASE WHEN o_orderkey % 23 = 0 THEN 'Postponed: rain' WHEN o_orderkey % 29 <> 0 THEN 'Final' END",
    "home_team_id": "o_custkey % 29", "away_team_id": "CASE WHEN o_custkey % 37 <> 0 THEN (o_custkey * 7 + 3) % 29 END",
    "home_score": "CASE WHEN o_orderkey % 307 = 0 THEN -1 WHEN o_orderstatus = 'F' OR o_orderkey % 5 = 0 THEN (o_orderkey + o_custkey) % 9 END",
    "away_score": "CASE WHEN o_orderstatus = 'F' OR o_orderkey % 5 = 0 THEN (o_orderkey * 3 + o_custkey) % 8 END",
}
APPEARANCE = {
    "game_pk": "l_orderkey", "side": "CASE WHEN l_linenumber % 2 = 1 THEN 'home' ELSE 'away' END",
    "team_id": "CASE WHEN l_partkey % 89 = 0 THEN 99 WHEN l_linenumber % 2 = 1 THEN o_custkey % 29 WHEN o_custkey % 37 <> 0 THEN (o_custkey * 7 + 3) % 29 END",
    "pitcher_id": "l_partkey", "appearance_order": "CAST(floor((l_linenumber + 1) / 2) AS INT)", "is_actual_starter": "l_linenumber <= 2 OR l_orderkey % 71 = 0",
    "innings": "CAST(CAST(l_quantity AS INT) % 9 AS STRING) || '.' || CAST(l_orderkey % 4 AS STRING)", "outs": "CAST(l_quantity AS INT) - 2", "runs": "l_linenumber % 4",
}
SIDES = {"home": ("home_team_id", "home_score", "away_score"), "away": ("away_team_id", "away_score", "home_score")}


def listed(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


STATS_SQL = " UNION ALL ".join(
    f"SELECT game_pk, game_date, '{s}' AS side, CASE WHEN game_pk % 151 = 0 THEN 98 ELSE {t} END AS team_id, {a} AS score, CASE WHEN state = 'Final' THEN {a} > {b} WHEN game_pk % 53 = 0 THEN true END AS is_winner FROM games"
    for s, (t, a, b) in SIDES.items()
)
LEAGUE = f"""games AS (SELECT {listed(GAME)} FROM orders),
stats AS ({STATS_SQL}),
appearances AS (SELECT {listed(APPEARANCE)} FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
starters AS (SELECT game_pk, side, team_id, pitcher_id + (game_pk % 67 = 0)::INT AS actual_pitcher_id FROM appearances WHERE appearance_order = 1)"""


def games(t: Tables) -> DataFrame:
    return t.orders.select(*(F.expr(v).alias(k) for k, v in GAME.items()))


def stats(t: Tables) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(s).alias("side"), F.col(i).alias("team"), F.col(a).alias("score"), F.col(b).alias("other")) for s, (i, a, b) in SIDES.items()))
    x = games(t).select("game_pk", "game_date", "state", F.inline(rows))
    won = F.when(F.col("state") == "Final", F.col("score") > F.col("other")).when(F.col("game_pk") % 53 == 0, True)
    return x.select("game_pk", "game_date", "side", F.when(F.col("game_pk") % 151 == 0, 98).otherwise(F.col("team")).alias("team_id"), "score", won.alias("is_winner"))


def appearances(t: Tables) -> DataFrame:
    x = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return x.select(*(F.expr(v).alias(k) for k, v in APPEARANCE.items()))


def starters(a: DataFrame) -> DataFrame:
    return a.where("appearance_order = 1").select("game_pk", "side", "team_id", (F.col("pitcher_id") + (F.col("game_pk") % 67 == 0).cast("int")).alias("actual_pitcher_id"))


ORPHANS = "SELECT count(*) FROM {0} c LEFT JOIN games g ON g.game_pk = c.game_pk AND ((c.side = 'home' AND c.team_id = g.home_team_id) OR (c.side = 'away' AND c.team_id = g.away_team_id)) WHERE g.game_pk IS NULL"
DONE = "state = 'Final' AND NOT (lower(coalesce(detailed, '')) LIKE 'postponed%' OR lower(coalesce(detailed, '')) LIKE 'suspended%' OR lower(coalesce(detailed, '')) LIKE 'cancelled%' OR lower(coalesce(detailed, '')) LIKE 'rescheduled%')"
STRUCTURAL = {
    "data.silver_present": "SELECT count(*) FROM (SELECT count(*) AS n FROM games) WHERE n = 0",
    "identity.game_pk_unique": "SELECT count(*) FROM (SELECT 1 FROM games GROUP BY game_pk HAVING count(*) > 1)",
    "identity.home_away_distinct": "SELECT count(*) FROM games WHERE home_team_id = away_team_id",
    "identity.valid_team_ids": "SELECT count(*) FROM games WHERE home_team_id IS NULL OR away_team_id IS NULL",
    "identity.game_status_known": "SELECT count(*) FROM games WHERE state IS NULL OR state NOT IN ('Preview', 'Live', 'Final')",
    "bronze.provenance": "SELECT count(*) FROM games WHERE source IS NULL",
    "ref.team_statistics_game": ORPHANS.format("stats"), "ref.pitcher_appearance_game": ORPHANS.format("appearances"), "ref.pitcher_starter_game": ORPHANS.format("starters"),
    "results.valid_scores": f"SELECT count(*) FROM stats JOIN games USING (game_pk) WHERE {DONE} AND (score IS NULL OR score < 0)",
    "results.status_consistency": "SELECT count(*) FROM stats JOIN games USING (game_pk) WHERE state <> 'Final' AND is_winner",
    "results.home_win_derivation": """SELECT count(*) FROM (SELECT game_pk, max(score) FILTER (side = 'home') AS h, max(score) FILTER (side = 'away') AS a, bool_or(is_winner) FILTER (side = 'home') AS hw, bool_or(is_winner) FILTER (side = 'away') AS aw FROM stats GROUP BY 1) JOIN games USING (game_pk)
      WHERE state = 'Final' AND game_type = 'R' AND h IS NOT NULL AND a IS NOT NULL AND (h = a OR hw IS NOT DISTINCT FROM aw OR (h > a) <> coalesce(hw, false) OR (a > h) <> coalesce(aw, false))""",
    "pitching.appearance_order": "SELECT count(*) FROM (SELECT 1 FROM appearances GROUP BY game_pk, team_id HAVING min(appearance_order) <> 1 OR max(appearance_order) <> count(*) OR count(*) FILTER (is_actual_starter) <> 1)",
    "pitching.starter_agreement": "SELECT count(*) FROM starters s JOIN appearances a ON a.game_pk = s.game_pk AND a.team_id = s.team_id AND a.appearance_order = 1 WHERE actual_pitcher_id <> pitcher_id",
    "pitching.stat_domains": "SELECT count(*) FROM appearances WHERE NOT regexp_full_match(innings, '[0-9]+[.][012]') OR outs < 0 OR runs < 0",
    "pitching.non_regular_season": "SELECT count(DISTINCT game_pk) FROM appearances JOIN games USING (game_pk) WHERE game_type IS DISTINCT FROM 'R'",
    "schedule.doubleheader": "SELECT count(*) FROM (SELECT 1 FROM games GROUP BY game_date, home_team_id, away_team_id, game_number HAVING count(*) > 1)",
    "bronze.detail_payloads": "SELECT count(*) FROM events WHERE event_id % 50 = 0", "bronze.schedule_raw": "SELECT count(*) FROM pages WHERE page_id % 97 = 0 OR html IS NULL",
    "processing.determinism": "SELECT 0",
}
WARNINGS = ("identity.game_status_known", "pitching.non_regular_season")


def checks_sql(found: dict[str, str], warn: tuple[str, ...] = ()) -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS \"check\", '{'WARN' if c in warn else 'FAIL'}' AS severity, ({q}) AS failing_count" for c, q in found.items())
    return f"SELECT \"check\", CASE WHEN failing_count = 0 THEN 'PASS' ELSE severity END AS status, severity, failing_count::BIGINT AS failing_count FROM ({parts})"


@query("i01_structural", f"WITH {LEAGUE} {checks_sql(STRUCTURAL, WARNINGS)}")
def structural(t: Tables) -> DataFrame:
    """The twenty structural checks."""
    a = appearances(t)
    hashed = lambda df, path, content, changed: df.select(F.col(path).alias("path"), F.sha2(content, 256).alias("stored"), F.sha2(F.concat(content, F.when(changed, " ").otherwise("")), 256).alias("found"))
    payloads, raw = hashed(t.events, "event_id", "props", F.col("event_id") % 50 == 0), hashed(t.pages, "page_id", "html", F.col("page_id") % 97 == 0)
    raw = raw.withColumn("stored", F.coalesce("stored", F.lit("")))
    return checks.structural(games(t), stats(t), a, starters(a), payloads, raw, games(t).repartition(3, "game_date")).drop("failing")


COMPONENTS = """team AS (
  SELECT game_pk, team_id, count(score) OVER w AS games, CASE WHEN count(score) OVER w > 0 THEN sum(score) OVER w / count(score) OVER w END AS runs, coalesce(bool_or(is_winner) OVER w, false) AS ever_won
  FROM own WINDOW w AS (PARTITION BY team_id ORDER BY game_date, game_pk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pen AS (SELECT game_pk, team_id, coalesce(sum(outs) OVER (PARTITION BY team_id ORDER BY game_date, game_pk ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS outs
  FROM (SELECT o.game_pk, o.team_id, o.game_date, coalesce(outs, 0) AS outs FROM own o LEFT JOIN (SELECT game_pk, team_id, sum(outs) AS outs FROM appearances GROUP BY ALL) USING (game_pk, team_id)) WHERE game_pk % 19 <> 0)"""
REGULAR = """regular AS (SELECT * FROM games WHERE coalesce(game_type, 'R') = 'R' AND home_team_id <> away_team_id),
own AS (SELECT s.game_pk, s.game_date, CASE WHEN side = 'home' THEN home_team_id ELSE away_team_id END AS team_id, score, is_winner FROM stats s JOIN regular USING (game_pk))"""
MATRIX_SQL = f"""{LEAGUE}, {REGULAR}, {COMPONENTS},
m AS (SELECT g.game_pk, h.games AS home_team_games, a.games AS away_team_games, h.games - a.games AS diff_team_games, round(h.runs, 6) AS home_team_runs, round(a.runs, 6) AS away_team_runs, round(h.runs - a.runs, 6) AS diff_team_runs,
    h.ever_won AS home_team_ever_won, a.ever_won AS away_team_ever_won, hp.outs::BIGINT AS home_pen_outs, ap.outs::BIGINT AS away_pen_outs, (hp.outs - ap.outs)::BIGINT AS diff_pen_outs,
    CASE WHEN hr.is_winner AND NOT coalesce(ar.is_winner, false) THEN true WHEN ar.is_winner AND NOT coalesce(hr.is_winner, false) THEN false WHEN hr.score <> ar.score THEN hr.score > ar.score END AS home_win
  FROM regular g JOIN team h ON h.game_pk = g.game_pk AND h.team_id = home_team_id JOIN team a ON a.game_pk = g.game_pk AND a.team_id = away_team_id
  JOIN pen hp ON hp.game_pk = g.game_pk AND hp.team_id = home_team_id JOIN pen ap ON ap.game_pk = g.game_pk AND ap.team_id = away_team_id
  JOIN own hr ON hr.game_pk = g.game_pk AND hr.team_id = home_team_id JOIN own ar ON ar.game_pk = g.game_pk AND ar.team_id = away_team_id)"""
CERTIFICATION = {"status": "PASS", "dataset": {"fingerprint": "league"}}


def built(t: Tables) -> tuple[DataFrame, DataFrame]:
    g = games(t).where("coalesce(game_type, 'R') <> 'R' OR home_team_id <> away_team_id")
    index = matrix.game_index(g)
    own = stats(t).join(index.select("game_pk", "home_team_id", "away_team_id"), "game_pk").withColumn("team_id", F.when(F.col("side") == "home", F.col("home_team_id")).otherwise(F.col("away_team_id")))
    before = W.partitionBy("team_id").orderBy("game_date", "game_pk")
    past, three = before.rowsBetween(W.unboundedPreceding, -1), before.rowsBetween(-3, -1)
    n = F.count("score").over(past)
    team = own.select("game_pk", "team_id", n.alias("games"), F.when(n > 0, F.sum("score").over(past) / n).alias("runs"), F.coalesce(F.bool_or("is_winner").over(past), F.lit(False)).alias("ever_won"))
    outs = appearances(t).groupBy("game_pk", "team_id").agg(F.sum("outs").alias("outs"))
    pen = own.join(outs, ["game_pk", "team_id"], "left").select("game_pk", "team_id", "game_date", F.coalesce("outs", F.lit(0)).alias("outs"))
    pen = pen.where("game_pk % 19 <> 0").select("game_pk", "team_id", F.coalesce(F.sum("outs").over(three), F.lit(0)).alias("outs"))  # some games lack the component
    return matrix.build(g, {"team": team, "pen": pen}, own.select("game_pk", "team_id", "score", "is_winner"), CERTIFICATION)


@query("j01_gold_matrix", f"WITH {MATRIX_SQL} SELECT * FROM m")
def gold_matrix(t: Tables) -> DataFrame:
    """One row per regular game, home, away and difference of each component column, the target apart."""
    m, _ = built(t)
    return m.drop("game_date", "home_team_id", "away_team_id", "build_id").withColumns({c: r6(F.col(c)) for c in ("home_team_runs", "away_team_runs", "diff_team_runs")})


@query("j01_excluded", f"WITH {LEAGUE}, {REGULAR} SELECT game_pk, 'pen' AS missing FROM regular WHERE game_pk % 19 = 0")
def excluded(t: Tables) -> DataFrame:
    """Games that lack a component on both sides, with its name."""
    return built(t)[1].select("game_pk", F.array_join("missing_components", ",").alias("missing"))


NAMES = ["home_team_games", "away_team_games", "home_team_runs", "away_team_runs", "home_pen_outs", "away_pen_outs", "diff_pen_outs"]


@query("d46_missingness", f"""WITH {MATRIX_SQL}, l AS (SELECT unnest({NAMES}) AS name, unnest([{', '.join(c + '::DOUBLE' for c in NAMES)}]) AS v FROM m)
SELECT name AS "column", count(*) AS n, count(v) AS non_null, round(1 - count(v) / count(*), 6) AS null_rate,
  CASE WHEN count(v) = 0 THEN 'FAIL' WHEN count(*) >= 30 AND count(DISTINCT v) <= 1 THEN 'FAIL' WHEN 1 - count(v) / count(*) > 0.02 THEN 'WARN' ELSE 'PASS' END AS status FROM l GROUP BY name""")
def missingness(t: Tables) -> DataFrame:
    """Matrix columns by share of nulls, with the verdict that gates model work."""
    return matrix.completeness(built(t)[0], NAMES).withColumn("null_rate", r6(F.col("null_rate")))


FAMILIES = {"team": ["home_team_games", "home_team_runs"], "starter": ["away_team_games", "away_team_runs"], "bullpen": ["home_pen_outs", "away_pen_outs"], "rest_schedule": ["diff_pen_outs"]}


def group_sql(check: str, table: str, columns: list[str]) -> str:
    names = "[" + ", ".join(f"'{c}'" for c in columns) + "]"
    values = "[" + ", ".join(f"{c}::DOUBLE" for c in columns) + "]"
    return f"""SELECT '{check}' AS "check", CASE WHEN bool_or(s = 'FAIL') THEN 'FAIL' WHEN bool_or(s = 'WARN') THEN 'WARN' ELSE 'PASS' END AS status, round(max(r), 6) AS null_rate
FROM (SELECT 1 - count(v) / count(*) AS r, CASE WHEN count(v) = 0 THEN 'FAIL' WHEN count(*) >= 100 AND (count(DISTINCT v) <= 1) THEN 'FAIL' WHEN 1 - count(v) / count(*) > 0.02 THEN 'WARN' ELSE 'PASS' END AS s
  FROM (SELECT unnest({names}) AS name, unnest({values}) AS v FROM {table}) GROUP BY name)"""


COVERAGE_SQL = " UNION ALL ".join([
    group_sql("semantic.pitcher_stats", "appearances", ["outs", "runs"]), group_sql("semantic.team_outcomes", "(SELECT score, is_winner::INT AS won FROM stats)", ["score", "won"]),
    *(group_sql(f"semantic.family_{n}", "m", c) for n, c in FAMILIES.items()),
    "SELECT 'semantic.distribution_sanity', CASE WHEN avg(home_win::INT) BETWEEN 0.45 AND 0.6 THEN 'PASS' ELSE 'FAIL' END, NULL FROM m",
])


@query("i02_coverage", f"WITH {MATRIX_SQL} {COVERAGE_SQL}")
def coverage(t: Tables) -> DataFrame:
    """The seven coverage checks, measures and feature families by their worst column."""
    s = stats(t).withColumn("won", F.col("is_winner").cast("int"))
    return checks.coverage(appearances(t), s, built(t)[0], FAMILIES, F.col("home_win"), (0.45, 0.60)).withColumn("null_rate", r6(F.col("null_rate")))


EVENT = "o_orderkey AS event_id, 'Team ' || CAST(o_custkey % 29 AS STRING) AS home_team, 'team ' || CAST((o_custkey * 7 + 3) % 29 AS STRING) AS away_team, o_orderdate AS game_date"
CANDIDATE = "o_orderkey AS game_pk, 'TEAM ' || CAST(o_custkey % 29 AS STRING) AS home_team, CASE WHEN o_orderkey % 31 = 0 THEN 'other' ELSE 'Team ' || CAST((o_custkey * 7 + 3) % 29 AS STRING) END AS away_team, CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE o_orderdate END AS game_date"
LINE = "l_orderkey AS event_id, CASE WHEN l_partkey % 83 = 0 THEN ' ' ELSE 'book ' || CAST(l_suppkey % 9 AS STRING) END AS sportsbook, 'Team ' || CAST(l_orderkey % 29 AS STRING) AS home_team, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_quantity AS INT) * 9 END AS opening_home, CASE WHEN l_linenumber % 2 <> 0 THEN -110 END AS opening_away"
MAPPING = "CASE WHEN event_id % 7 = 0 THEN 'AMBIGUOUS' ELSE 'MATCHED' END AS status, CASE WHEN event_id % 7 <> 0 OR event_id % 14 = 0 THEN event_id + CASE WHEN event_id % 59 = 0 THEN 100000000 ELSE 0 END END AS game_pk"
ARCHIVE = {
    "odds_archive.published_sha256": "SELECT count(*) FROM documents WHERE doc_id % 61 = 0", "odds_archive.source_file_immutable": "SELECT count(*) FROM documents WHERE doc_id % 71 = 0",
    "odds_archive.moneylines_parse": "SELECT count(*) FROM lines WHERE NOT ((opening_home IS NULL OR abs(opening_home) >= 100) AND (opening_away IS NULL OR abs(opening_away) >= 100))",
    "odds_archive.sportsbook_identity": "SELECT count(*) FROM (SELECT 1 FROM lines GROUP BY event_id HAVING count(*) FILTER (trim(sportsbook) = '') > 0 OR count(DISTINCT sportsbook) < count(*))",
    "odds_archive.team_name_normalization": "SELECT count(*) FROM (SELECT DISTINCT home_team FROM lines) WHERE lower(trim(lower(trim(home_team)))) <> lower(trim(home_team))",
    "odds_archive.home_away_orientation": "SELECT count(*) FROM mappings m JOIN candidates c USING (game_pk) WHERE status = 'MATCHED' AND NOT (lower(m.home_team) = lower(c.home_team) AND lower(m.away_team) = lower(c.away_team))",
    "odds_archive.mapped_resolve": "SELECT count(*) FROM mappings m LEFT JOIN candidates c USING (game_pk) WHERE status = 'MATCHED' AND (c.game_pk IS NULL OR NOT coalesce(m.game_date = c.game_date, false))",
    "odds_archive.no_ambiguous_attachment": "SELECT count(*) FROM mappings WHERE status <> 'MATCHED' AND game_pk IS NOT NULL",
    "odds_archive.matched_opening_present": "SELECT count(*) FROM mappings WHERE status = 'MATCHED' AND event_id NOT IN (SELECT event_id FROM lines WHERE opening_home IS NOT NULL AND opening_away IS NOT NULL)",
}
ARCHIVE_TABLES = f"lines AS (SELECT {LINE} FROM lineitem), candidates AS (SELECT {CANDIDATE} FROM orders), mappings AS (SELECT *, {MAPPING} FROM (SELECT {EVENT} FROM orders))"


@query("i24_archive_checks", f"WITH {ARCHIVE_TABLES} {checks_sql(ARCHIVE)}")
def archive_checks(t: Tables) -> DataFrame:
    """The nine checks of an archive and its mapping to games."""
    lines, candidates = t.lineitem.selectExpr(*_columns(LINE)), t.orders.selectExpr(*_columns(CANDIDATE))
    mappings = t.orders.selectExpr(*_columns(EVENT)).selectExpr("*", *_columns(MAPPING))
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    files = t.documents.select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 61 == 0, "other").otherwise(sha).alias("published"), sha.alias("recorded"), F.when(F.col("doc_id") % 71 == 0, "changed").otherwise(sha).alias("found"))
    return checks.archive(lines, mappings, candidates, files, text.normal_name).drop("failing")


def _columns(listing: str) -> list[str]:
    """A select list cut at the commas outside of brackets and CASE."""
    out, depth, now = [], 0, ""
    for word in listing.replace("(", " ( ").replace(")", " ) ").replace(",", " , ").split(" "):
        depth += (word in ("(", "CASE")) - (word in (")", "END"))
        if word == "," and depth == 0:
            out.append(now)
            now = ""
        else:
            now += " " + word
    return [*out, now]
