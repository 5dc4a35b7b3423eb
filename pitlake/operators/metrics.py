"""Probability metrics as aggregates: one pass, any grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.operators.ranks import running_total

EPS = 1e-15
#: fixed values: inner edges of ten equal bins as binary floating point has them
BIN_EDGES = [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]


def log_loss(y: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return -F.avg(F.when(y == 1, F.ln(q)).otherwise(F.ln(1 - q)))


def brier(y: Column, p: Column) -> Column:
    return F.avg((p - y) * (p - y))


def accuracy(y: Column, p: Column) -> Column:
    return F.avg(((p >= 0.5).cast("int") == y).cast("double"))


def bin_of(p: Column) -> Column:
    """0..9 by comparison with the edges; a value on an edge moves up."""
    return sum(((p >= e).cast("int") for e in BIN_EDGES), F.lit(0))


def calibration_error(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., ece): mean gap of mean probability and rate over bins, weighted by their size."""
    bins = df.groupBy(*by, bin_of(F.col(p)).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), F.sum(p).alias("_p"), F.sum(y).alias("_y"))
    return bins.groupBy(*by).agg((F.sum(F.abs(F.col("_p") - F.col("_y"))) / F.sum("_n")).alias("ece"))


def reliability_curve(df: DataFrame, y: str, p: str) -> DataFrame:
    """(bin, n, mean_p, rate) of ten bins, empty ones with n = 0."""
    found = df.groupBy(bin_of(F.col(p)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))
    frame = df.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    return F.broadcast(frame).join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def auc(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., auc): area under the curve, ties counted half; null where one class is missing.

    Rows are counted per value first; ranks run over distinct values, by ranges of values.
    """
    v = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, p).agg(F.sum((F.col(y) == 1).cast("long")).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    run = running_total(v, p, "_n", "_upto", by)
    rank = F.col("_upto") - (F.col("_n") - 1) / 2
    s = run.groupBy(*by).agg(F.sum(rank * F.col("_pos")).alias("_r"), F.sum("_pos").alias("_p"), F.sum("_n").alias("_t"))
    neg = F.col("_t") - F.col("_p")
    return s.select(*by, F.when((F.col("_p") > 0) & (neg > 0), (F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p") * neg)).alias("auc"))


def slice_metrics(df: DataFrame, y: str, p: str, by: Sequence[str], low: int = 30) -> DataFrame:
    """One row per group: n, mean probability, rate, gap, log loss, Brier, accuracy, AUC, and whether n is low."""
    yc, pc = F.col(y), F.col(p)
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(pc).alias("mean_p"), F.avg(yc).alias("rate"), F.abs(F.avg(pc) - F.avg(yc)).alias("gap"),
        log_loss(yc, pc).alias("log_loss"), brier(yc, pc).alias("brier"), accuracy(yc, pc).alias("accuracy"),
    )
    a = auc(df, y, p, by)
    joined = base.join(a, list(by), "left") if by else base.crossJoin(F.broadcast(a))
    return joined.withColumn("low_confidence", F.col("n") < low)


def slice_by(df: DataFrame, label: Column, y: str, p: str, low: int = 30) -> DataFrame:
    """`slice_metrics` by any expression over the rows; rows that it gives no label are left out."""
    return slice_metrics(df.select(label.cast("string").alias("slice"), y, p).where(F.col("slice").isNotNull()), y, p, ["slice"], low)


def buckets(df: DataFrame, x: Column, specs: Sequence[tuple[str, float, float | None]], aggregates: dict[str, Column]) -> DataFrame:
    """One row per bucket of specs (label, from, below), empty ones too, with n and the aggregates."""
    from pitlake.functions.text import bucket

    frame = df.sparkSession.createDataFrame([(i, s[0]) for i, s in enumerate(specs)], "pos int, bucket string")
    found = df.withColumn("_x", x).withColumn("bucket", bucket(F.col("_x"), list(specs))).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *(v.alias(k) for k, v in aggregates.items()))
    return F.broadcast(frame).join(found, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def terciles(df: DataFrame, x: str, name: str = "tercile") -> DataFrame:
    """Adds low, middle or high by the values at sorted positions n//3 and 2n//3; null stays missing.

    The two values are found from counts per distinct value, by ranges of values.
    """
    counts = running_total(df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("_n")), x, "_n", "_upto")
    total = counts.agg(F.sum("_n").alias("_t"))
    at = lambda k: F.min(F.when(F.col("_upto") > F.floor(F.col("_t") * k / 3), F.col(x)))
    cuts = counts.crossJoin(F.broadcast(total)).agg(at(1).alias("_lo"), at(2).alias("_hi"))
    label = F.when(F.col(x).isNull(), "missing").when(F.col(x) < F.col("_lo"), "low").when(F.col(x) >= F.col("_hi"), "high").otherwise("middle")
    return df.crossJoin(F.broadcast(cuts)).withColumn(name, label).drop("_lo", "_hi")


def pairwise_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for all pairs of columns by one pass of sums; nulls take the mean, constant columns are left out."""
    means = df.agg(*(F.avg(c).alias(c) for c in columns))
    filled = df.select(*columns).crossJoin(F.broadcast(means.select(*(F.col(c).alias(f"_m_{c}") for c in columns))))
    x = {c: F.coalesce(F.col(c), F.col(f"_m_{c}")) - F.col(f"_m_{c}") for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    sums = filled.agg(*(F.sum(x[c] * x[c]).alias(f"s_{c}") for c in columns), *(F.sum(x[a] * x[b]).alias(f"p_{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when((F.col(f"s_{a}") > 0) & (F.col(f"s_{b}") > 0), F.col(f"p_{i}") / F.sqrt(F.col(f"s_{a}") * F.col(f"s_{b}"))).alias("r"))
        for i, (a, b) in enumerate(pairs)
    ))
    return sums.select(F.inline(rows)).where("r IS NOT NULL")


def connected_columns(pairs: Sequence[tuple[str, str]]) -> dict[str, str]:
    """Union-find over flagged column pairs, a few hundred at most: each column's first name in its group."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}
