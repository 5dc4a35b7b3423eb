"""Exact deduplication by skew-safe combining.

Rows are first combined inside each input partition (Spark's partial
aggregation), then in salted digest groups, and the salts' winners are combined
globally. The text is itself a grouping key at every stage, so equality is
always decided by full content; the digest only places the rows. Only digests
that hold a large share of all rows get more than one salt: there are at most
1/share of them, so their list may be broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.llm.common import cut, hot_keys, salted

SALTS = 64


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None,
    salts: int = SALTS, digest: Callable[[Column], Column] = lambda text: F.sha2(text, 256),
) -> DataFrame:
    """One row per input row: (doc_id, keep_id, group_size, kept, text_sha256).

    * null text counts as empty; `normalise` maps the text column before comparison.
    * of equal texts the row with the largest id stays; rows that repeat an id
      are counted each, and each row with the winning id is marked kept.
    * a null id loses to any other; if a whole group has null ids, keep_id is null and kept is true.
    * other columns are ignored, whatever their names; an empty table gives an empty result.
    * texts that differ but share a digest stay apart.
    """
    text = F.col(text_col).cast("string")
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(normalise(text) if normalise else text, F.lit("")).alias("text")
    ).withColumn("digest", digest(F.col("text")))
    base = salted(base, hot_keys(base.select("digest"), "digest"), "digest", F.col("doc_id"), salts)
    # local combining is the partial side of this aggregation, salted merging its final side
    merged = base.groupBy("digest", "_salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # ordinary digests have one salt and are complete; the winners of hot ones are combined by full content again
    spread = (
        merged.where("_salt > 0").groupBy("digest", "text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(1), F.lit(salts))))
    )
    found = merged.where("_salt = 0").unionByName(spread)
    # where a digest has one content, its members need no text to find their winner
    winners = cut(found.groupBy("digest", "_salt").agg(
        F.count(F.lit(1)).alias("contents"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
    ), "winners")
    key = ["digest", "_salt"]
    out = base.select("doc_id", "digest", "_salt", F.sha2("text", 256).alias("text_sha256"))
    clash = winners.where("contents > 1").select(*key)
    if clash.isEmpty():
        out = out.join(winners.drop("contents"), key)
    else:
        out = out.join(winners.where("contents = 1").drop("contents"), key).unionByName(
            base.join(clash, key, "left_semi").join(found.join(clash, key, "left_semi"), [*key, "text"])
            .withColumn("text_sha256", F.sha2("text", 256)).drop("text")
        )
    return out.select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256"
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of `documents`."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
