"""Data-quality checks as one-row frames with a verdict."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20


def finding(df: DataFrame, check: str, bad: Column, record: Column, severity: str = "ERROR") -> DataFrame:
    """(check, status, severity, failing_count, failing): PASS without bad rows, else FAIL (or WARN) with the first few of them in order.

    The sample is the smallest records, kept by a bounded aggregate, not a list of all.
    """
    x = df.where(bad).select(record.cast("string").alias("r"))
    first = x.groupBy("r").count().orderBy("r").limit(SAMPLE).agg(F.sort_array(F.collect_list("r")).alias("failing"))
    n = x.agg(F.count(F.lit(1)).alias("failing_count"))
    status = F.when(F.col("failing_count") == 0, "PASS").otherwise("WARN" if severity == "WARN" else "FAIL")
    return n.crossJoin(first).select(F.lit(check).alias("check"), status.alias("status"), F.lit(severity).alias("severity"), "failing_count", "failing")


def unique(df: DataFrame, key: Sequence[str], check: str) -> DataFrame:
    """Duplicate keys."""
    n = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return finding(n, check, F.col("_n") > 1, F.concat_ws("|", *(F.col(k).cast("string") for k in key)))


def references(df: DataFrame, other: DataFrame, left: str, right: str, check: str) -> DataFrame:
    """Rows whose key has no partner; null keys count as dangling too."""
    gone = df.join(other.select(F.col(right).alias(left)).distinct(), left, "left_anti")
    return finding(gone, check, F.lit(True), F.col(left))


def contiguous(df: DataFrame, key: Sequence[str], order: str, marked: Column, check: str) -> DataFrame:
    """Per key the order runs from 1 to the count without gaps and exactly one row is marked."""
    g = df.groupBy(*key).agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count(F.lit(1)).alias("n"), F.countDistinct(order).alias("d"), F.count_if(marked).alias("m"))
    return finding(g, check, (F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("d") != F.col("n")) | (F.col("m") != 1), F.concat_ws("|", *(F.col(k).cast("string") for k in key)))


def union_all(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def verdict(checks: DataFrame) -> DataFrame:
    """One row: checks by status and the worst of them."""
    return checks.agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "WARN").alias("warned"), F.count_if(F.col("status") == "FAIL").alias("failed")
    ).withColumn("verdict", F.when(F.col("failed") > 0, "FAIL").when(F.col("warned") > 0, "WARN").otherwise("PASS"))


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, non_null, n_distinct, lo, hi, all_zero, constant) of numeric columns, not-a-number counted as missing, in one pass."""
    x = df.select(*(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns))
    long = x.unpivot([], list(columns), "column", "value")
    return long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("non_null"), F.countDistinct("value").alias("n_distinct"), F.min("value").alias("lo"), F.max("value").alias("hi"),
    ).withColumns({"all_zero": (F.col("lo") == 0) & (F.col("hi") == 0), "constant": F.col("n_distinct") <= 1})


def column_status(null_rate: Column, all_zero: Column, constant: Column, n: Column, warn: float = 0.02, least: int = 100) -> Column:
    return F.when(null_rate >= 1.0, "FAIL").when((n >= least) & (all_zero | constant), "FAIL").when(null_rate > warn, "WARN").otherwise("PASS")


def content_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(rows, hash): the same for any order of rows, by sums of row hashes that combine before the shuffle."""
    h = F.xxhash64(*(F.col(c) for c in columns)).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.coalesce(F.sum(h), F.lit(0)).cast("string"), 256).alias("hash"))


def same_content(a: DataFrame, b: DataFrame, check: str) -> DataFrame:
    """Whether two tables hold the same rows as often."""
    return finding(a.exceptAll(b).unionByName(b.exceptAll(a)), check, F.lit(True), F.to_json(F.struct(*a.columns)))
