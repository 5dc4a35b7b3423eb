"""Append-only, upsert and partition-overwrite stores over parquet.

Conflicts are found by joins on the key before anything is written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class KeyConflict(ValueError):
    """A key is stored, or came twice, with other content."""


def read_store(spark: SparkSession, path: str, schema) -> DataFrame:
    """The store, empty where its folder doesn't exist yet; anything else that can't be read raises."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def content(df: DataFrame, key: Sequence[str]):
    return F.xxhash64(*(F.col(c) for c in sorted(df.columns) if c not in key))


def append_new(df: DataFrame, path: str, key: Sequence[str]) -> dict[str, int]:
    """Append rows with new keys; keys stored with equal content are skipped, with other content they raise and nothing is written."""
    spark = df.sparkSession
    once = df.withColumn("_c", content(df, key)).groupBy(*key).agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi"), F.first(F.struct(*df.columns)).alias("_r"))
    stored = read_store(spark, path, df.schema)
    stored = stored.select(*key, content(stored, key).alias("_old"))
    judged = once.join(stored, list(key), "left").select(
        "_r", F.when((F.col("_lo") != F.col("_hi")) | (F.col("_old") != F.col("_lo")), "conflict").when(F.col("_old").isNotNull(), "skipped").otherwise("appended").alias("what")
    )
    counts = {r["what"]: r["count"] for r in judged.groupBy("what").count().collect()}
    if counts.get("conflict"):
        raise KeyConflict(f"{counts['conflict']} keys with other content in {path}")
    judged.where("what = 'appended'").select("_r.*").write.mode("append").parquet(path)
    return {k: counts.get(k, 0) for k in ("appended", "skipped")}


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """The newer row of each key, the last of several new ones by `_ordinal`."""
    if "_ordinal" not in new.columns:
        raise ValueError("new rows need _ordinal")
    both = old.withColumn("_ordinal", F.lit(-1).cast("long")).unionByName(new, allowMissingColumns=True)
    return both.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("_ordinal")))).where("_rn = 1").drop("_rn", "_ordinal")


def replace_partition(df: DataFrame, path: str, partition: str) -> None:
    """Overwrite just the partitions df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def delete_keys(store: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """The store without some keys (files have no delete)."""
    return store.join(keys.select(*key).distinct(), list(key), "left_anti")


def verified(files: DataFrame, published: DataFrame) -> DataFrame:
    """(path, ok): raw files (path, content) against published hashes (path, sha256)."""
    return files.select("path", F.sha2("content", 256).alias("found")).join(published, "path", "full_outer").select("path", F.coalesce(F.col("found") == F.col("sha256"), F.lit(False)).alias("ok"))
