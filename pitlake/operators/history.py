"""Leak-free history: what was known about an entity strictly before each of its rows.

Rows are ordered by explicit keys, the current row never counts, and rows that
aren't eligible get features but add nothing to anyone's history. All frames are
plain window aggregates, so a long history costs no arrays.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BEFORE = (W.unboundedPreceding, -1)


def cumulative(df: DataFrame, entity: Sequence[str], order: Sequence[str], eligible: Column, measures: Mapping[str, Column], suffix: str = "before") -> DataFrame:
    """Adds n_<suffix> and <measure>_<suffix>: count and sums over earlier eligible rows of the entity."""
    w = W.partitionBy(*entity).orderBy(*order).rowsBetween(*BEFORE)
    out = {f"n_{suffix}": F.coalesce(F.sum(F.when(eligible, 1)).over(w), F.lit(0)).cast("long")}
    for name, x in measures.items():
        out[f"{name}_{suffix}"] = F.coalesce(F.sum(F.when(eligible, x)).over(w), F.lit(0))
    return df.withColumns(out)


def last_eligible(df: DataFrame, entity: Sequence[str], order: Sequence[str], eligible: Column, measures: Mapping[str, Column], windows: Sequence[int]) -> DataFrame:
    """Adds n_L<k> and <measure>_L<k> for each window k: over the last k earlier eligible rows, however many others lie between.

    Among eligible rows alone the last k, this one included, are a row frame; each row then takes that of the latest earlier eligible row.
    """
    df = df.withColumn("_ok", F.coalesce(eligible, F.lit(False)))
    own, added = W.partitionBy(*entity, "_ok").orderBy(*order), []
    for k in windows:
        frame = own.rowsBetween(-(k - 1), 0)
        cols = {f"n_L{k}": F.when(F.col("_ok"), F.count(F.lit(1)).over(frame))}
        cols |= {f"{m}_L{k}": F.when(F.col("_ok"), F.sum(x).over(frame)) for m, x in measures.items()}
        df = df.withColumns(cols)
        added += cols
    before = W.partitionBy(*entity).orderBy(*order).rowsBetween(*BEFORE)
    df = df.withColumns({c: F.last(c, ignorenulls=True).over(before) for c in added})
    return df.withColumns({c: F.coalesce(c, F.lit(0)) for c in added if c.startswith("n_L")}).drop("_ok")


def last_rows(df: DataFrame, entity: Sequence[str], order: Sequence[str], measures: Mapping[str, Column], windows: Sequence[int]) -> DataFrame:
    """As last_eligible where every row counts: a plain row frame."""
    for k in windows:
        w = W.partitionBy(*entity).orderBy(*order).rowsBetween(-k, -1)
        df = df.withColumns({f"n_L{k}": F.count(F.lit(1)).over(w)} | {f"{m}_L{k}": F.coalesce(F.sum(x).over(w), F.lit(0)) for m, x in measures.items()})
    return df


def prior_days(df: DataFrame, entity: Sequence[str], ts: str, tie: Sequence[str], measures: Mapping[str, Column], days: Sequence[int]) -> DataFrame:
    """Adds <measure>_<d>d: sums over rows at most d days back (inclusive) that come earlier in (ts, tie) order.

    A range frame also holds the row itself and all rows of the same instant; what isn't earlier among those is taken off again.
    """
    seconds = F.col(ts).cast("timestamp").cast("double")
    later_peers = W.partitionBy(*entity, ts).orderBy(*tie).rowsBetween(0, W.unboundedFollowing)
    for d in days:
        w = W.partitionBy(*entity).orderBy(seconds).rangeBetween(-d * 86_400, 0)
        df = df.withColumns({f"{m}_{d}d": F.coalesce(F.sum(x).over(w), F.lit(0)) - F.coalesce(F.sum(x).over(later_peers), F.lit(0)) for m, x in measures.items()})
    return df


def previous(df: DataFrame, entity: Sequence[str], order: Sequence[str], eligible: Column, value: Column, name: str) -> DataFrame:
    """Adds the value of the latest earlier eligible row."""
    w = W.partitionBy(*entity).orderBy(*order).rowsBetween(*BEFORE)
    return df.withColumn(name, F.last(F.when(eligible, value), ignorenulls=True).over(w))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.when(b != 0, a / b)
