"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where that is unset a local session, as in tests, gets a temporary one; a cluster raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='pitlake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._pitlake_path = path
    return out


def drop_cut(*frames: DataFrame) -> None:
    """Remove the files behind cut() frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_pitlake_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_prefix(columns: Sequence[str], prefix: str) -> str:
    """The prefix with as many underscores in front as it takes for no column to begin with it."""
    while any(c.lower().startswith(prefix.lower()) for c in columns):
        prefix = "_" + prefix
    return prefix


def named(columns: Sequence[str]) -> list[Column]:
    """The columns by their whole names, dots and backticks included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def hot_keys(df: DataFrame, key: str, share: float = 1e-3, least: int = 1000) -> DataFrame:
    """Keys with at least `least` rows and at least `share` of all rows.

    There can't be more than 1/share of them whatever the size of df, so the
    result may be broadcast. df needs the column `key` alone.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return (
        counts.join(F.broadcast(total), F.col("_n") >= F.col("_total") * F.lit(share))
        .select(key, F.lit(True).alias("_hot"))
    )


def salted(df: DataFrame, hot: DataFrame, key: str, by: Column, salts: int) -> DataFrame:
    """df with `_salt`: 0 for ordinary keys, 1..salts by a hash of `by` for hot ones."""
    return df.join(F.broadcast(hot), key, "left").withColumn(
        "_salt",
        F.when(F.col("_hot"), F.lit(1) + F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).otherwise(F.lit(0)),
    ).drop("_hot")


def small_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most: int = 50_000) -> DataFrame:
    """Join with a table by node; that side is broadcast only if it has at most `most` rows (a few MB), whatever its files' compressed size suggests."""
    few = small.limit(most + 1).count() <= most
    return big.join(F.broadcast(small) if few else small.hint("merge"), on, how)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of edges (src, dst): one row (id, component) per vertex, component the smallest id.

    Alternating large-star and small-star steps; each round only groups by a
    vertex with partial aggregation and joins on it, and is cut to the shared
    folder, so that no component is ever gathered in one place. Nulls and loops
    are ignored. An empty table gives an empty result.
    """
    def tidy(e: DataFrame) -> DataFrame:
        return e.where(F.col("src") > F.col("dst")).distinct()

    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    e = cut(tidy(e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))), "edges")
    mark = None
    for _ in range(rounds):
        # large star: every larger neighbour of u moves to the least of u's neighbourhood
        both = e.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(e.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
        large = tidy(large)
        # small star: u and its smaller neighbours move to the least of them
        small_least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(small_least, "src")
        nxt = cut(tidy(small.select("src", F.col("m").alias("dst")).union(small.select(F.col("dst").alias("src"), F.col("m").alias("dst")))), "edges")
        now = nxt.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("s")).collect()[0]
        drop_cut(e)
        e = nxt
        if mark == (now["n"], now["s"]):
            break
        mark = (now["n"], now["s"])
    else:
        raise RuntimeError("components: not converged")
    return e.select(F.col("src").alias("id"), F.col("dst").alias("component")).union(
        e.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct()
    )
