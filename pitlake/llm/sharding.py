"""Sharding by extendible hashing.

A document's shard is a prefix of its hash. The directory is indexed by as many
hash bits as any part of it needs; a shard keeps fewer bits where its bucket
already fits, and only buckets over the byte limit take another bit. Sizes are
summed once at a depth where cells are far smaller than a shard and rolled up
from there, STEP bits at a time, so no sum has more than 2^STEP parts. The
directory is settled from the top: a bucket that fits is a shard, the others
split on another bit. Cells that are still too large at the deepest level are
refined with more bits, over their own documents alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitlake.llm.common import cut, small_join

BITS = 60
STEP = 8


def hash_bits(id_col: str, text_col: str) -> Column:
    """The first 60 bits of the md5 of the id as text; of the text where the id is null."""
    by = F.coalesce(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(by), 1, BITS // 4), 16, 10).cast("long")


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_bytes, shard, depth, shard_bytes, fits).

    shard is the hash prefix as a string of bits, empty for the single shard of
    a small table, depth its length and shard_bytes the UTF-8 bytes of all its
    texts; fits is false only where no bit can help: one text over the limit.
    * null texts have no bytes; rows with a null id are placed by the hash of their text.
    * rows that share an id share the hash; if they alone exceed the limit they
      go to numbered overflow pages (`bits+page`), each within the limit.
    * other columns are ignored; an empty table gives an empty result.
    """
    base = cut(docs.select(
        F.col(id_col).alias("doc_id"), hash_bits(id_col, text_col).alias("h"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes")
    ), "sizes")
    total = base.agg(F.sum("n_bytes")).collect()[0][0] or 0
    depth = min(BITS, max(1, math.ceil(math.log2(max(2, 16 * total / limit)))))
    todo, parts, low = base, [], 0
    while True:
        cells = cut(todo.groupBy(prefix("h", BITS, depth).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n")), "cells")
        shards, left = settle(cells, low, depth, limit)
        for level, found in shards:
            placed = small_join(todo.withColumn("cell", prefix("h", BITS, level)), found, ["cell"])
            parts.append(placed.select("doc_id", "n_bytes", bits("node", "depth").alias("shard"), "depth", "shard_bytes"))
        if left.isEmpty():
            break
        todo = cut(small_join(todo.withColumn("cell", prefix("h", BITS, depth)), left, ["cell"], how="left_semi").drop("cell"), "large")
        if depth == BITS:
            parts.append(pages(todo, limit))
            break
        low, depth = depth + 1, min(BITS, depth + STEP)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("fits", F.col("shard_bytes") <= limit)


def prefix(column: str, have: int, want: int) -> Column:
    """The first `want` of so many bits."""
    return F.expr(f"shiftright({column}, {have - want})")


def settle(cells: DataFrame, low: int, depth: int, limit: int) -> tuple[list[tuple[int, DataFrame]], DataFrame]:
    """The directory over cells (cell, b bytes, n rows) at a depth, for shards of `low` bits or more.

    Gives, for some levels, (cell, depth, node, shard_bytes): the shard of each
    prefix of that many bits that lies in one; and the cells that fit nowhere.
    """
    levels = [depth]
    while levels[0] - STEP > low:
        levels.insert(0, levels[0] - STEP)
    sums = {depth: cells}
    for level, below in zip(levels[-2::-1], levels[:0:-1]):
        sums[level] = cut(sums[below].groupBy(prefix("cell", below, level).alias("cell")).agg(F.sum("b").alias("b"), F.sum("n").alias("n")), "cells")
    shards, left, first = [], None, low
    for k, level in enumerate(levels):
        open_ = sums[level]
        if left is not None:
            above = left.select(F.col("cell").alias("above"))
            open_ = small_join(open_.withColumn("above", prefix("cell", level, levels[k - 1])), above, ["above"], how="left_semi").drop("above")
        nodes = open_.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(level)))).withColumn("node", F.expr(f"shiftright(cell, {level} - depth)"))
        of_node = nodes.groupBy("depth", "node").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        fit = of_node.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)).select("depth", "node", "shard_bytes")
        found = small_join(nodes.select("cell", "depth", "node"), fit, ["depth", "node"]).groupBy("cell").agg(F.min_by(F.struct("depth", "node", "shard_bytes"), "depth").alias("s")).select("cell", "s.*")
        found = cut(found, "directory")
        if level == depth or not found.isEmpty():
            shards.append((level, found))
        left = cut(open_.join(found, "cell", "left_anti").select("cell"), "open")
        first = level + 1
    return shards, left


def bits(node: str, depth: str) -> Column:
    return F.when(F.col(depth) == 0, F.lit("")).otherwise(F.expr(f"lpad(conv({node}, 10, 2), cast({depth} as int), '0')"))


def pages(same: DataFrame, limit: int) -> DataFrame:
    """Overflow pages for rows that share all hash bits: largest texts alone, the rest filled to half the limit at least."""
    w = W.partitionBy("h").orderBy("n_bytes", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    half = F.lit(limit // 2)
    run = same.withColumn("page", F.when(F.col("n_bytes") > half, F.concat(F.lit("L"), F.row_number().over(W.partitionBy("h").orderBy("n_bytes", "doc_id"))))
                          .otherwise(F.floor(F.sum("n_bytes").over(w) / half).cast("string")))
    of_page = run.groupBy("h", "page").agg(F.sum("n_bytes").alias("shard_bytes"))
    whole = F.expr(f"lpad(conv(h, 10, 2), {BITS}, '0')")
    return run.join(of_page, ["h", "page"]).select(
        "doc_id", "n_bytes", F.concat(whole, F.lit("+"), F.col("page")).alias("shard"), F.lit(BITS).alias("depth"), "shard_bytes"
    )


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id") -> None:
    """Write docs as one parquet folder per shard; ids must be unique and not null."""
    where = shard(docs, limit, id_col).select(F.col("doc_id").alias(id_col), F.col("shard").alias("_shard"))
    docs.join(where, id_col).repartition("_shard").write.partitionBy("_shard").parquet(path)


LIMIT = 1 << 20


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of at most 1 MiB of text over `documents`."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), LIMIT)


OP5_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS h
  FROM documents),
e AS (SELECT d.*, depth, h >> (60 - depth) AS node FROM d, range(0, 41) r(depth)),
s AS (SELECT depth, node, sum(n_bytes) AS shard_bytes, count(*) AS n FROM e GROUP BY ALL),
f AS (
  SELECT doc_id, n_bytes, e.depth, node, shard_bytes, row_number() OVER (PARTITION BY doc_id, n_bytes ORDER BY e.depth) AS k
  FROM e JOIN s USING (depth, node) WHERE shard_bytes <= 1048576 OR n = 1)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(node), depth::INT, '0') END AS shard,
       depth::INT AS depth, shard_bytes::BIGINT AS shard_bytes, shard_bytes <= 1048576 AS fits
FROM f WHERE k = 1
"""
