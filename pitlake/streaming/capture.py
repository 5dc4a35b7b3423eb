"""Idempotent capture of keyed snapshots from a stream.

Within the watermark duplicates are dropped by the engine; each micro-batch is
then appended by key, so a replayed batch changes nothing and a key with other
content fails the query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.sources.stores import append_new


def keyed(stream: DataFrame, key: Sequence[str], at: str, delay: str) -> DataFrame:
    """The stream without repeated rows of a key inside the delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([*key])


def capture(stream: DataFrame, path: str, checkpoint: str, key: Sequence[str], prepare=lambda df: df):
    """Start a query that appends prepare(batch) by key to a store, all available data once."""

    def batch(df: DataFrame, epoch: int) -> None:
        append_new(prepare(df), path, key)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def due(games: DataFrame, at: str, start: str, captured: DataFrame, key: str, opens: int = 60, closes: int = 5) -> DataFrame:
    """Games between `opens` and `closes` minutes before their start that aren't captured yet."""
    minutes = (F.unix_timestamp(F.col(start)) - F.unix_timestamp(F.col(at))) / 60
    return games.where(minutes.between(closes, opens)).join(captured.select(key).distinct(), key, "left_anti")


def capture_records(quotes: DataFrame, game: str, side: str, price: str, snapshot: str, predicted: str, start: str) -> DataFrame:
    """(game, home, away, snapshot, reason): the latest snapshot's pair per game; reason says why there is none.

    Late or one-sided quotes are kept with a reason instead of being dropped silently.
    """
    pairs = quotes.groupBy(game, snapshot).agg(
        F.max(F.when(F.col(side) == "home", F.col(price))).alias("home"), F.max(F.when(F.col(side) == "away", F.col(price))).alias("away"), F.max(predicted).alias("predicted"), F.max(start).alias("start")
    )
    last = pairs.groupBy(game).agg(F.max_by(F.struct("home", "away", snapshot, "predicted", "start"), snapshot).alias("x")).select(game, "x.*")
    pregame = (F.col(snapshot) < F.col("predicted")) & (F.col("predicted") < F.col("start"))
    return last.select(game, "home", "away", snapshot, F.when(F.col("home").isNull() | F.col("away").isNull(), "one_side_missing").when(~F.coalesce(pregame, F.lit(False)), "not_pregame").alias("reason"))


def windowed_counts(stream: DataFrame, at: str, width: str, delay: str, *by: str) -> DataFrame:
    """Rows per event-time window, final once the watermark has passed it."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")
