"""Mixing sources to target weights by hierarchical budgeting.

The token budget flows down a domain - language - source tree. A node never gets
more than its subtree can give (its tokens times the epochs allowed); what a
node can't take goes to its siblings by weight, and only what all siblings
together can't take is missing from their parent's share and so goes to the
parent's siblings. In each leaf documents are ordered anew for each epoch by a
seeded hash; whole epochs are taken first, then the prefix of the next that fits
the rest. The order is never sorted as a whole: hash ranges are summed, and only
the one range that holds the cut is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitlake.llm.common import cut, drop_cut, free_prefix, named, small_join

RANGE_ROWS = 4096
PATH = ["domain", "lang", "source"]


def n_tokens(text: Column) -> Column:
    """Runs of characters other than blank, tab and line ends; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \t\n\r]+")), F.lit(0)).cast("long")


def order_key(id_: Column, seed: int, epoch: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(id_.cast("string"), F.lit(""))))


def level(nodes: DataFrame, depth: int) -> DataFrame:
    """Split each parent's `given` among children (weight, capacity) by weight, no child over its capacity."""
    parent = PATH[:depth]
    w = W.partitionBy(*parent, F.lit(0)).orderBy(F.col("capacity") / F.col("weight"), PATH[depth])
    before = w.rowsBetween(W.unboundedPreceding, -1)
    after = w.rowsBetween(0, W.unboundedFollowing)
    nodes = nodes.withColumn("level_now", (F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0))) / F.sum("weight").over(after))
    nodes = nodes.withColumn("full", F.col("level_now") >= F.col("capacity") / F.col("weight"))
    first = F.min(F.when(~F.col("full"), F.struct(F.col("capacity") / F.col("weight"), F.col(PATH[depth]), "level_now"))).over(W.partitionBy(*parent, F.lit(0)))
    return nodes.withColumn("cut_level", first["level_now"]).select(
        *PATH[: depth + 1], F.when(F.col("full"), F.col("capacity")).otherwise(F.floor(F.col("weight") * F.col("cut_level"))).cast("long").alias("given")
    )


def weight_of(column: str, weights: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, value in weights.items():
        out = F.when(F.col(column) == name, F.lit(value)).otherwise(out)
    return out.cast("long")


def leaf_plan(leaves: DataFrame, weights: dict[str, dict[str, int]], budget: int | None, share: float, epochs: int) -> DataFrame:
    """leaves (domain, lang, source, tokens, rows) with `given`, the tokens each may take.

    weights: positive whole numbers for names of each level, 'other' for names
    not listed there; 0 leaves a node out. budget: tokens, or share of all.
    """
    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)
    for k, name in enumerate(PATH):
        known = {a: b for a, b in weights.get(name, {}).items() if a != "other"}
        leaves = leaves.withColumn(f"w{k}", weight_of(name, known, weights.get(name, {}).get("other", 1)))
    leaves = leaves.where("w0 > 0 and w1 > 0 and w2 > 0")
    total = leaves.agg(F.sum("capacity").alias("can"), F.sum("tokens").alias("all"))
    given = total.select(F.least(F.col("can"), F.lit(budget) if budget is not None else F.floor(F.col("all") * F.lit(share)).cast("long")).alias("given"))
    for k in range(len(PATH)):
        nodes = leaves.groupBy(*PATH[: k + 1]).agg(F.sum("capacity").alias("capacity"), F.max(f"w{k}").alias("weight"))
        nodes = nodes.join(F.broadcast(given)) if k == 0 else nodes.join(given, PATH[:k])
        given = level(nodes, k)
    return leaves.select(*PATH, "tokens", "rows").join(given, PATH)


def mix(
    docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], budget: int | None = None, share: float = 0.5, epochs: int = 1, seed: int = 7,
    id_col: str = "doc_id", tokens: Column | None = None,
) -> DataFrame:
    """docs with (_domain, _n_tokens, _copies), only rows with a copy: the sampled mixture.

    tokens: the number of tokens of a row, counted from `text` where not given.

    * lang and source null count as empty names; a null text has no tokens.
    * rows with one id share their place in the order and are taken or left together.
    * a table without tokens gives an empty result.
    * the first row that doesn't fit ends a leaf's prefix, so a leaf may fall short by less than one row.
    * docs may have columns of any names; where one is called like an added
      column, all added names get another underscore in front (`added_names`).
    """
    p = free_prefix(docs.columns, "_mix_")
    leaf, n, given = [p + c for c in PATH], p + "n", added_names(docs.columns)
    own = docs.withColumns({
        leaf[0]: F.coalesce(domain, F.lit("")), leaf[1]: F.coalesce(F.col("lang"), F.lit("")), leaf[2]: F.coalesce(F.col("source"), F.lit("")),
        n: n_tokens(F.col("text")) if tokens is None else tokens,
    })
    slim = cut(own.select(*(F.col(a).alias(b) for a, b in zip(leaf, PATH)), F.col(id_col).alias("id"), F.col(n).alias("n")), "tokens")
    leaves = slim.groupBy(*PATH).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows")).where("tokens > 0")
    plan = leaf_plan(leaves, weights, budget, share, epochs)
    plan = cut(plan.select(
        *PATH, "given", F.floor(F.col("given") / F.col("tokens")).cast("int").alias("whole"),
        (F.col("given") % F.col("tokens")).alias("rest"), F.ceil(F.col("rows") / RANGE_ROWS).alias("ranges"),
    ), "plan")
    # the last, partial epoch: sums by hash range, the range with the cut, then the cut in it
    keyed = small_join(slim, plan.where("rest > 0"), PATH).withColumn("key", order_key(F.col("id"), seed, F.col("whole") + 1))
    keyed = keyed.withColumn("range", F.expr("shiftright(cast(conv(substr(key, 1, 7), 16, 10) as long) * ranges, 28)"))
    sums = keyed.groupBy(*PATH, "range").agg(F.sum("n").alias("n"), F.max("rest").alias("rest"))
    so_far = sums.withColumn("before", F.sum("n").over(W.partitionBy(*PATH).orderBy("range")) - F.col("n"))
    edge = so_far.where("before <= rest and before + n > rest").select(*PATH, "range", "before")
    in_edge = small_join(keyed, edge, [*PATH, "range"]).groupBy(*PATH, "before", "rest", "key").agg(F.sum("n").alias("n"))
    # the first key of the range that doesn't fit; everything below it is taken
    run = in_edge.withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy(*PATH).orderBy("key")))
    ends = run.where("upto > rest").groupBy(*PATH).agg(F.min("key").alias("end"))
    whole, end = p + "whole", p + "end"
    cuts = cut(plan.join(ends, PATH, "left").select(*(F.col(a).alias(b) for a, b in zip(PATH, leaf)), F.col("whole").alias(whole), F.col("end").alias(end)), "cuts")
    drop_cut(slim, plan)
    out = small_join(own, cuts, leaf)
    copies = F.col(whole) + F.when(F.col(end).isNotNull() & (order_key(F.col(id_col), seed, F.col(whole) + 1) < F.col(end)), 1).otherwise(0)
    out = out.withColumn(p + "copies", copies.cast("int")).where(F.col(p + "copies") > 0)
    return out.select(*named(docs.columns), *(F.col(a).alias(b) for a, b in zip((leaf[0], n, p + "copies"), given)))


def added_names(columns: list[str]) -> list[str]:
    """What mix() calls its added columns beside these."""
    taken = {c.lower() for c in columns}
    out = ["_domain", "_n_tokens", "_copies"]
    while taken & set(out):
        out = ["_" + c for c in out]
    return out


#: fixed values: which sources make up which domain, and the weights of each level
DOMAINS = {"web": 6, "news": 11, "books": 16}
WEIGHTS = {
    "domain": {"web": 40, "news": 25, "books": 20, "other": 15},
    "lang": {"en": 50, "de": 20, "fr": 20, "other": 10},
    "source": {"other": 1},
}


def domain_of(source: Column) -> Column:
    """src0-5 web, src6-10 news, src11-15 books, the rest other."""
    number = F.expr("try_cast(regexp_extract(source, '^src([0-9]+)$', 1) as int)")
    out = F.lit("other")
    for name, end in reversed(DOMAINS.items()):
        out = F.when(number < end, F.lit(name)).otherwise(out)
    return out


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of `documents` goes into a mixture of half its tokens, small sources up to twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = cut(docs.select("doc_id", "lang", "source", n_tokens(F.col("text")).alias("n_tokens")), "counted")  # each text is read once
    got = mix(counted, domain_of(F.col("source")), WEIGHTS, share=0.5, epochs=2, tokens=F.col("n_tokens"))
    return got.select("doc_id", F.col("_domain").alias("domain"), "lang", "source", "n_tokens", F.col("_copies").alias("copies"))


def _sql_level(k: int) -> str:
    on, parent = ", ".join(PATH[: k + 1]), ", ".join(PATH[:k])
    over = f"PARTITION BY {parent}" if parent else ""
    join = f"JOIN g{k} USING ({parent})" if parent else "CROSS JOIN g0"
    return f"""
n{k} AS (SELECT {on}, sum(capacity)::BIGINT AS capacity, max(w{k}) AS weight FROM leaf GROUP BY {on}),
a{k} AS (
  SELECT n{k}.*, given, (given - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS now
  FROM n{k} {join} WINDOW w AS ({over} ORDER BY capacity / weight, {PATH[k]})),
b{k} AS (SELECT *, now >= capacity / weight AS is_full FROM a{k}),
g{k + 1} AS (
  SELECT {on}, CASE WHEN is_full THEN capacity ELSE floor(weight * (min(struct_pack(r := capacity / weight, s := {PATH[k]}, now := now)) FILTER (NOT is_full) OVER ({over})).now)::BIGINT END AS given
  FROM b{k}),"""


OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS n,
         try_cast(regexp_extract(source, '^src([0-9]+)$', 1) AS INT) AS number,
         CASE WHEN number < 6 THEN 'web' WHEN number < 11 THEN 'news' WHEN number < 16 THEN 'books' ELSE 'other' END AS domain
  FROM documents),
leaf AS (
  SELECT domain, lang, source, sum(n)::BIGINT AS tokens, 2 * sum(n)::BIGINT AS capacity,
         CASE domain WHEN 'web' THEN 40 WHEN 'news' THEN 25 WHEN 'books' THEN 20 ELSE 15 END AS w0,
         CASE lang WHEN 'en' THEN 50 WHEN 'de' THEN 20 WHEN 'fr' THEN 20 ELSE 10 END AS w1, 1 AS w2
  FROM d GROUP BY domain, lang, source HAVING sum(n) > 0),
g0 AS (SELECT floor(sum(tokens) * 0.5::DOUBLE)::BIGINT AS given FROM leaf),{_sql_level(0)}{_sql_level(1)}{_sql_level(2)}
p AS (SELECT *, (given // tokens)::INT AS whole, given % tokens AS rest FROM leaf JOIN g3 USING (domain, lang, source)),
k AS (SELECT d.*, whole, rest, md5('7:' || (whole + 1)::VARCHAR || ':' || doc_id::VARCHAR) AS key FROM d JOIN p USING (domain, lang, source)),
c AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM k),
e AS (SELECT domain, lang, source, min(key) FILTER (upto > rest) AS last FROM c GROUP BY ALL)
SELECT doc_id, domain, lang, source, n AS n_tokens, whole + (rest > 0 AND key < last)::INT AS copies
FROM c JOIN e USING (domain, lang, source) WHERE whole + (rest > 0 AND key < last)::INT > 0
"""
