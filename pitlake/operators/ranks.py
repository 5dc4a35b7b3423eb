"""Running totals over a whole table without one ordered partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = 128


def as_number(df: DataFrame, x: str) -> Column:
    """The column as a double in the same order."""
    kind = df.schema[x].dataType
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        return F.unix_micros(F.col(x).cast("timestamp")).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(x)).cast("double")
    return F.col(x).cast("double")


def range_of(df: DataFrame, x: str, parts: int = PARTS) -> Column:
    """The number of the value range that holds x, 0 for null: ranges of about equally many rows, cut at approximate percentiles."""
    number = as_number(df, x)
    found = df.agg(F.percentile_approx(number, [k / parts for k in range(1, parts)], 10_000)).collect()[0][0]  # as many numbers as ranges
    cuts = sorted(set(found or []))
    if not cuts:
        return F.when(F.col(x).isNull(), 0).otherwise(1)
    above = F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: c < number))
    return F.when(F.col(x).isNull(), 0).otherwise(above + 1)


def running_total(df: DataFrame, x: str, n: str, name: str, by: Sequence[str] = (), parts: int = PARTS) -> DataFrame:
    """df, one row per (by, x), with the sum of n over all rows of the same group up to x, nulls first.

    Ranges of values are summed first; order is needed only among their sums and inside each of them.
    """
    placed = df.withColumn("_range", range_of(df, x, parts))
    sums = placed.groupBy(*by, "_range").agg(F.sum(n).alias("_in"))
    before = F.coalesce(F.sum("_in").over(W.partitionBy(*by, F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_range").alias("_of"), before.alias("_before"))
    on = [placed[c].eqNullSafe(sums[f"_by_{c}"]) for c in by] + [placed["_range"] == sums["_of"]]
    inside = F.sum(n).over(W.partitionBy(*by, "_range").orderBy(x))
    return placed.join(sums, on).withColumn(name, F.col("_before") + inside).select(*df.columns, name)
