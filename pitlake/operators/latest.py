"""One row per key under explicit rules; every tie has a named winner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitlake.operators.ranks import running_total


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def latest(df: DataFrame, key: Sequence[str], at: Column, ordinal: str, nulls: str = "last", later_wins: bool = True) -> DataFrame:
    """The latest row of each key; nulls 'last' lose to any instant, 'lowest' count as the smallest one.

    Ties go to the later ordinal, or with later_wins=False to the first.
    """
    when = at.desc_nulls_last()
    tie = F.col(ordinal).desc() if later_wins else F.col(ordinal).asc()
    if nulls == "last" and later_wins:
        # a null instant never replaces anything: among nulls alone the first stays
        tie = F.when(at.isNull(), -F.col(ordinal)).otherwise(F.col(ordinal)).desc()
    return first_by(df, key, [when, tie])


def latest_by_max(df: DataFrame, key: Sequence[str], at: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The latest row by an aggregate, which combines before the shuffle; `at` must decide every tie."""
    best = df.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*at)).alias("_b"))
    return best.select(*key, "_b.*")


def canonical(df: DataFrame, key: Sequence[str], rank: Column, resumed: Column, date: Column, pos: str, outcome: Column) -> DataFrame:
    """The entry with the highest rank, then a resumed one, then the latest date, then the first met.

    Adds `conflict`: whether entries of the top rank disagree on the outcome.
    """
    df = df.withColumns({"_rank": rank, "_outcome": outcome})
    top = W.partitionBy(*key)
    df = df.withColumn("_top", F.max("_rank").over(top))
    seen = F.when(F.col("_rank") == F.col("_top"), F.col("_outcome"))
    df = df.withColumn("conflict", F.min(seen).over(top) != F.max(seen).over(top))
    return first_by(df, key, [F.col("_rank").desc(), resumed.cast("int").desc(), date.desc_nulls_last(), F.col(pos).asc()]).drop("_rank", "_outcome", "_top")


def carry_first(df: DataFrame, key: Sequence[str], pos: str, columns: Sequence[str]) -> DataFrame:
    """Per key the first non-null value of each column in order of pos."""
    return df.groupBy(*key).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(pos))).alias(c) for c in columns))


def tail_split(df: DataFrame, at: str, tie: str, share: float) -> DataFrame:
    """Adds `calibration`: whether a row is in the last share of all rows (halves to even) in order of (at, tie).

    Counts run over distinct instants in ranges; rows are ordered only inside the one instant that holds the cut. Rows without an instant come first.
    """
    total = df.count()
    cut = total - round(total * share)
    instants = df.groupBy(at).agg(F.count(F.lit(1)).alias("_n"))
    run = running_total(instants, at, "_n", "_upto")
    holds = run.where((F.col("_upto") > cut) & (F.col("_upto") - F.col("_n") < cut)).select(F.col(at).alias("_at"), (F.lit(cut) - F.col("_upto") + F.col("_n")).alias("_take")).collect()
    after = run.where(F.col("_upto") - F.col("_n") >= cut).agg(F.min(at).alias("_from"), F.count_if(F.col(at).isNull()).alias("_null")).collect()[0]
    late = F.coalesce(F.col(at) >= F.lit(after["_from"]), F.lit(bool(after["_null"])))
    if not holds:
        return df.withColumn("calibration", late)
    instant = F.col(at).eqNullSafe(F.lit(holds[0]["_at"]))
    inside = df.where(instant).withColumn("calibration", F.row_number().over(W.partitionBy(at).orderBy(tie)) > holds[0]["_take"])
    return df.where(~instant).withColumn("calibration", late).unionByName(inside)
