"""Many checks over a table in one pass, and the catalogue of structural, coverage and archive checks.

Counts of all rules of a table come from one aggregate; the first failing records
of each rule from one bounded ranking, which keeps a few rows a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitlake.operators.quality import SAMPLE, column_stats, column_status, content_hash
from pitlake.sources.layers import fingerprint


@dataclass(frozen=True)
class Rule:
    """Rows where `bad` is true fail the check; `record` names them."""

    check: str
    bad: Column
    record: Column
    severity: str = "FAIL"


def measure(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(check, status, severity, failing_count, failing): one row a rule, failing its first records in order of their text."""
    bad = [F.coalesce(r.bad, F.lit(False)) for r in rules]
    counts = df.agg(*(F.count_if(b).alias(f"n{i}") for i, b in enumerate(bad))).select(F.inline(F.array(*(
        F.struct(F.lit(i).alias("i"), F.lit(r.check).alias("check"), F.lit(r.severity).alias("severity"), F.col(f"n{i}").alias("failing_count")) for i, r in enumerate(rules)
    ))))
    hits = df.select(F.explode(F.array_compact(F.array(*(F.when(b, F.struct(F.lit(i).alias("i"), r.record.cast("string").alias("r"))) for i, (b, r) in enumerate(zip(bad, rules)))))).alias("h")).select("h.*")
    first = hits.withColumn("k", F.row_number().over(W.partitionBy("i").orderBy("r"))).where(F.col("k") <= SAMPLE).groupBy("i").agg(F.sort_array(F.collect_list("r")).alias("failing"))
    status = F.when(F.col("failing_count") == 0, "PASS").otherwise(F.col("severity"))
    return counts.join(F.broadcast(first), "i", "left").select("check", status.alias("status"), "severity", "failing_count", F.coalesce("failing", F.array().cast("array<string>")).alias("failing"))


def key_of(*columns: str) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def all_of(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def run_all(groups: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(pos, group, check, status) of several groups of checks, the groups in order."""
    return all_of([df.select(F.lit(i).alias("pos"), F.lit(name).alias("group"), "check", "status") for i, (name, df) in enumerate(groups)])


def folds(spark: SparkSession, some: Sequence[tuple[tuple[int, ...], int]], development: Sequence[int], holdout: int, check: str = "leakage.chronological_folds") -> DataFrame:
    """(check, status, failing_count, failing): folds must train on earlier seasons alone, and the holdout must be in none of them."""
    bad = [f"{holdout}|holdout_in_development"] if holdout in development else []
    for train, test in some:
        rules = {"train_test_overlap": test in train, "not_chronological": bool(train) and max(train) >= test, "holdout_in_fold": holdout == test or holdout in train}
        bad += [f"{test}|{name}" for name, broken in rules.items() if broken]
    return spark.createDataFrame([(check, "FAIL" if bad else "PASS", len(bad), bad[:SAMPLE])], "check string, status string, failing_count long, failing array<string>")


def certify(tables: Mapping[str, DataFrame], results: DataFrame, code_version: str, certified_at: str) -> dict[str, Any]:
    """An artifact that names the content of the tables and what the checks (check, status) found.

    Only a row a table and a row a check reach the driver; the fingerprint leaves out the time.
    """
    held = {n: df.transform(content_hash, df.columns).collect()[0] for n, df in tables.items()}
    rows = [{"check": r["check"], "status": r["status"]} for r in results.select("check", "status").orderBy("check").collect()]
    by = {s: [r["check"] for r in rows if r["status"] == s] for s in ("PASS", "WARN", "FAIL")}
    artifact = {
        "status": "FAIL" if by["FAIL"] else "PASS", "dataset": {n: {"rows": r["rows"], "sha256": r["hash"]} for n, r in held.items()}, "checks": rows,
        "summary": {s.lower(): len(c) for s, c in by.items()}, "failures": by["FAIL"], "warnings": by["WARN"], "code_version": code_version, "certified_at": certified_at,
    }
    return artifact | {"fingerprint": fingerprint(artifact)}


#: fixed values: detailed states that begin like this mean that no result was reached
NOT_PLAYED = ["postponed", "suspended", "cancelled", "rescheduled"]
#: fixed values: abstract states of a game
STATES = ["Preview", "Live", "Final"]


def completed(state: Column, detailed: Column) -> Column:
    """Whether a game reached a result: final, and not put off."""
    put_off = reduce(lambda a, b: a | b, (F.lower(F.coalesce(detailed, F.lit(""))).startswith(p) for p in NOT_PLAYED))
    return (state == "Final") & ~put_off


def structural(games: DataFrame, stats: DataFrame, appearances: DataFrame, starters: DataFrame, payloads: DataFrame, raw: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """The twenty structural checks.

    games (game_pk, game_date, game_number, game_type, state, detailed, home_team_id, away_team_id, source), stats (game_pk, side, team_id,
    score, is_winner), appearances (game_pk, side, team_id, pitcher_id, appearance_order, is_actual_starter, innings, outs, runs), starters
    (game_pk, side, team_id, actual_pitcher_id), payloads and raw (path, stored, found), rebuilt: games built once more.
    """
    own_team = F.when(F.col("side") == "home", F.col("home_team_id")).when(F.col("side") == "away", F.col("away_team_id"))
    slim = games.select("game_pk", "game_type", "state", "detailed", "home_team_id", "away_team_id", F.lit(True).alias("known"))
    orphan = F.col("known").isNull() | ~F.coalesce(F.col("team_id") == own_team, F.lit(False))
    joined = {n: df.join(slim, "game_pk", "left") for n, df in (("stats", stats), ("appearances", appearances), ("starters", starters))}
    side = key_of("game_pk", "team_id", "side")

    sides = stats.groupBy("game_pk").agg(*(F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("home", "away") for c in ("score", "is_winner")))
    h, a, hw, aw = (F.col(c) for c in ("home_score", "away_score", "home_is_winner", "away_is_winner"))
    won = lambda w: F.coalesce(w, F.lit(False))
    odd = (h == a) | hw.eqNullSafe(aw) | ((h > a) != won(hw)) | ((a > h) != won(aw))
    pairs = sides.join(slim, "game_pk")

    order = appearances.groupBy("game_pk", "team_id").agg(
        F.min("appearance_order").alias("lo"), F.max("appearance_order").alias("hi"), F.count(F.lit(1)).alias("n"), F.count_if("is_actual_starter").alias("m")
    )
    first = appearances.where("appearance_order = 1").select("game_pk", "team_id", "pitcher_id")
    agree = starters.join(first, ["game_pk", "team_id"])
    exhibition = joined["appearances"].where("known").select("game_pk", "game_type").distinct()
    double = games.groupBy("game_date", "home_team_id", "away_team_id", "game_number").agg(F.count(F.lit(1)).alias("n"))
    same = content_hash(games, games.columns).select(F.col("hash").alias("a")).crossJoin(content_hash(rebuilt, games.columns).select(F.col("hash").alias("b")))  # one row each
    return all_of([
        measure(games.agg(F.count(F.lit(1)).alias("n")), [Rule("data.silver_present", F.col("n") == 0, F.lit("games"))]),
        measure(games.groupBy("game_pk").agg(F.count(F.lit(1)).alias("n")), [Rule("identity.game_pk_unique", F.col("n") > 1, F.col("game_pk"))]),
        measure(games, [
            Rule("identity.home_away_distinct", F.col("home_team_id") == F.col("away_team_id"), F.col("game_pk")),
            Rule("identity.valid_team_ids", F.col("home_team_id").isNull() | F.col("away_team_id").isNull(), F.col("game_pk")),
            Rule("identity.game_status_known", F.col("state").isNull() | ~F.col("state").isin(STATES), F.col("game_pk"), "WARN"),
            Rule("bronze.provenance", F.col("source").isNull(), F.col("game_pk")),
        ]),
        measure(joined["stats"], [
            Rule("ref.team_statistics_game", orphan, side),
            Rule("results.valid_scores", F.col("known") & completed(F.col("state"), F.col("detailed")) & (F.col("score").isNull() | (F.col("score") < 0)), key_of("game_pk", "side")),
            Rule("results.status_consistency", F.col("known") & (F.col("state") != "Final") & F.col("is_winner"), F.col("game_pk")),
        ]),
        measure(joined["appearances"], [
            Rule("ref.pitcher_appearance_game", orphan, side),
            Rule("pitching.stat_domains", ~F.col("innings").rlike(r"^[0-9]+\.[012]$") | (F.col("outs") < 0) | (F.col("runs") < 0), key_of("game_pk", "team_id", "pitcher_id")),
        ]),
        measure(joined["starters"], [Rule("ref.pitcher_starter_game", orphan, side)]),
        measure(pairs, [Rule("results.home_win_derivation", (F.col("state") == "Final") & (F.col("game_type") == "R") & h.isNotNull() & a.isNotNull() & odd, F.col("game_pk"))]),
        measure(order, [Rule("pitching.appearance_order", (F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("m") != 1), key_of("game_pk", "team_id"))]),
        measure(agree, [Rule("pitching.starter_agreement", F.col("actual_pitcher_id") != F.col("pitcher_id"), key_of("game_pk", "team_id"))]),
        measure(exhibition, [Rule("pitching.non_regular_season", ~F.col("game_type").eqNullSafe(F.lit("R")), F.col("game_pk"), "WARN")]),
        measure(double, [Rule("schedule.doubleheader", F.col("n") > 1, key_of("game_date", "home_team_id", "away_team_id", "game_number"))]),
        measure(payloads, [Rule("bronze.detail_payloads", ~F.col("stored").eqNullSafe(F.col("found")), F.col("path"))]),
        measure(raw, [Rule("bronze.schedule_raw", ~F.col("stored").eqNullSafe(F.col("found")), F.col("path"))]),
        measure(same, [Rule("processing.determinism", F.col("a") != F.col("b"), F.lit("games"))]),
    ])


def group_verdict(check: str, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(check, status, null_rate): the worst status of some columns of column_stats, and their worst null rate."""
    rate = 1 - F.col("non_null") / F.col("n")
    each = stats.where(F.col("column").isin(list(columns))).select(column_status(rate, F.col("all_zero"), F.col("constant"), F.col("n")).alias("s"), rate.alias("r"))
    worst = F.when(F.count_if(F.col("s") == "FAIL") > 0, "FAIL").when(F.count_if(F.col("s") == "WARN") > 0, "WARN").otherwise("PASS")
    return each.agg(F.lit(check).alias("check"), worst.alias("status"), F.max("r").alias("null_rate"))


def coverage(appearances: DataFrame, stats: DataFrame, matrix: DataFrame, families: Mapping[str, Sequence[str]], home_win: Column, plausible: tuple[float, float]) -> DataFrame:
    """The seven coverage checks: pitching and outcome measures, four feature families, and the share of home wins."""
    ps, ts = column_stats(appearances, ["outs", "runs"]), column_stats(stats, ["score", "won"])
    names = [c for f in families.values() for c in f]
    ms = column_stats(matrix, names)
    rate = F.avg(home_win.cast("double"))
    sane = matrix.agg(rate.alias("rate")).select(
        F.lit("semantic.distribution_sanity").alias("check"), F.when(F.col("rate").between(*plausible), "PASS").otherwise("FAIL").alias("status"), F.lit(None).cast("double").alias("null_rate")
    )
    return all_of([
        group_verdict("semantic.pitcher_stats", ps, ["outs", "runs"]), group_verdict("semantic.team_outcomes", ts, ["score", "won"]),
        *(group_verdict(f"semantic.family_{n}", ms, c) for n, c in families.items()), sane,
    ])


def archive(lines: DataFrame, mappings: DataFrame, candidates: DataFrame, files: DataFrame, normal_name) -> DataFrame:
    """The nine checks of an odds archive.

    lines (event_id, sportsbook, home_team, opening_home, opening_away), mappings (event_id, home_team, away_team, game_date, status, game_pk),
    candidates (game_pk, home_team, away_team, game_date), files (path, published, recorded, found); normal_name: Column -> Column.
    """
    ok_price = lambda c: F.col(c).isNull() | (F.abs(F.col(c)) >= 100)
    books = lines.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("sportsbook").alias("d"), F.count_if(F.coalesce(F.trim("sportsbook"), F.lit("")) == "").alias("blank"),
        F.bool_or(F.col("opening_home").isNotNull() & F.col("opening_away").isNotNull()).alias("pair"),
    )
    c = candidates.select(F.col("game_pk"), F.col("home_team").alias("c_home"), F.col("away_team").alias("c_away"), F.col("game_date").alias("c_date"), F.lit(True).alias("known"))
    matched = F.col("status") == "MATCHED"
    m = mappings.join(c, "game_pk", "left").join(books.select("event_id", "pair"), "event_id", "left")
    once, same = normal_name(F.col("home_team")), lambda a, b: normal_name(F.col(a)) == normal_name(F.col(b))
    return all_of([
        measure(files, [
            Rule("odds_archive.published_sha256", ~F.col("published").eqNullSafe(F.col("recorded")), F.col("path")),
            Rule("odds_archive.source_file_immutable", ~F.col("recorded").eqNullSafe(F.col("found")), F.col("path")),
        ]),
        measure(lines, [
            Rule("odds_archive.moneylines_parse", ~(ok_price("opening_home") & ok_price("opening_away")), key_of("event_id", "sportsbook")),
        ]),
        measure(books, [Rule("odds_archive.sportsbook_identity", (F.col("blank") > 0) | (F.col("d") < F.col("n")), F.col("event_id"))]),
        measure(lines.select("home_team").distinct(), [Rule("odds_archive.team_name_normalization", normal_name(once) != once, F.col("home_team"))]),
        measure(m, [
            Rule("odds_archive.home_away_orientation", matched & F.col("known") & ~(same("home_team", "c_home") & same("away_team", "c_away")), F.col("event_id")),
            Rule("odds_archive.mapped_resolve", matched & (F.col("known").isNull() | ~F.coalesce(F.col("game_date") == F.col("c_date"), F.lit(False))), F.col("event_id")),
            Rule("odds_archive.no_ambiguous_attachment", ~matched & F.col("game_pk").isNotNull(), F.col("event_id")),
            Rule("odds_archive.matched_opening_present", matched & ~F.coalesce(F.col("pair"), F.lit(False)), F.col("event_id")),
        ]),
    ])
