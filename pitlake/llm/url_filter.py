"""URL filtering by association rules.

Every labelled url becomes a basket of its host labels and path words, with one
more item if it is labelled bad. Spark's FP-growth finds the frequent
combinations; those that imply the bad item with enough support and confidence
become rules. Two things are settled before it runs, as they double the
combinations with each token and add no page to what matches: a token that is a
rule alone needs no company, and tokens that always come together are one item,
of which a page needs any. A rule is indexed under its item that is rarest on the
pages, so a page meets the rules of its own rare tokens and not those of the
common ones; the rest of a rule is then looked up in the page's basket. Fixed
rules, where they fit, come first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.llm.common import cut, small_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "!bad"
MIN_ROWS, MIN_SHARE, MIN_CONFIDENCE = 20, 1e-4, 0.5
#: fixed values: (verdict, host, path)
FIXED_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty where there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def basket(host: Column, path: Column) -> Column:
    """Host labels and path words of a url, each once; digits in a path word count as one sign."""
    words = F.transform(F.split(path, "/"), lambda w: F.when(w != "", F.concat(F.lit("p:"), F.regexp_replace(w, "[0-9]+", "#"))))
    labels = F.transform(F.split(host, "\\."), lambda w: F.when(w != "", F.concat(F.lit("h:"), w)))
    return F.array_distinct(F.array_compact(F.concat(labels, words)))


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fixed rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def mine_rules(baskets: DataFrame, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE, min_confidence: float = MIN_CONFIDENCE) -> DataFrame | None:
    """Rules (tokens, confidence, support) from baskets (tokens array<string>, bad boolean); None without enough baskets.

    A rule holds at least min_rows labelled urls and min_share of them.
    """
    baskets = baskets.where(F.size("tokens") > 0)
    n = baskets.count()
    least = max(min_rows, int(n * min_share))
    if n < least:
        return None
    items = baskets.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=min_confidence).fit(items)
    return model.associationRules.where(F.element_at("consequent", 1) == BAD).select(F.col("antecedent").alias("tokens"), "confidence", "support")


def condensed_rules(baskets: DataFrame, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE, min_confidence: float = MIN_CONFIDENCE) -> DataFrame | None:
    """Rules (groups array<array<string>>) that match what all rules of mine_rules match: a basket with a token of each group. None without any.

    Groups are the tokens that occur in the same baskets.
    """
    baskets = cut(baskets.where(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "baskets")
    n = baskets.count()
    least = max(min_rows, int(n * min_share))
    each = baskets.select("row", "bad", F.xxhash64("tokens").alias("a"), F.xxhash64("tokens", F.lit(1)).alias("b"), F.explode("tokens").alias("token"))
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    seen = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), whole("a"), whole("b")).where(F.col("n_bad") >= least)
    seen = cut(seen.withColumn("alone", F.col("n_bad") / F.col("n") >= min_confidence), "tokens")  # at most 1/min_share of them for each token of a mean basket
    same = seen.groupBy("n", "n_bad", "a", "b", "alone").agg(F.min("token").alias("item"), F.sort_array(F.collect_list("token")).alias("members"))
    same = cut(same.select("item", "members", "alone"), "items")
    rules = same.where("alone").select(F.array("members").alias("groups"))
    items = same.where("NOT alone").select("item", F.explode("members").alias("token"))
    fewer = cut(small_join(each.select("row", "bad", "token"), items, ["token"]).groupBy("row").agg(F.collect_set("item").alias("tokens"), F.first("bad").alias("bad")), "condensed")
    longer = mine_rules(fewer.select("tokens", "bad"), least, 0.0, min_confidence)
    if longer is not None:
        named = longer.select(F.monotonically_increasing_id().alias("rule"), "tokens")
        named = cut(named.withColumn("item", F.explode("tokens")).drop("tokens"), "rules")
        rules = rules.unionByName(small_join(named, same.select("item", "members"), ["item"]).groupBy("rule").agg(F.collect_list("members").alias("groups")).select("groups"))
    return None if rules.isEmpty() else rules


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, url) of pages (page_id, url, tokens) that hold a token of each group of some rule (groups), each once."""
    numbered = cut(rules.select(F.monotonically_increasing_id().alias("rule"), "groups"), "rules")
    parts = numbered.select("rule", F.posexplode("groups").alias("pos", "members")).withColumn("token", F.explode("members")).drop("members")
    met = small_join(pages.select(F.explode("tokens").alias("token")), parts.select("token").distinct(), ["token"]).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarity = parts.join(met, "token").groupBy("rule", "pos").agg(F.sum("n").alias("n"))
    rarest = rarity.groupBy("rule").agg(F.min_by("pos", F.struct("n", "pos")).alias("pos"))
    index = cut(parts.join(rarest, ["rule", "pos"]).join(numbered, "rule").select("token", "groups"), "index")
    held = F.forall("groups", lambda g: F.arrays_overlap(g, F.col("tokens")))
    return small_join(pages.withColumn("token", F.explode("tokens")), index, ["token"]).where(held).select("page_id", "url").distinct()


def judge_urls(
    pages: DataFrame, labelled: DataFrame, fixed: Sequence[tuple[str, str, str]] = tuple(FIXED_RULES), id_col: str = "page_id", url_col: str = "url", **limits: float
) -> DataFrame:
    """One row per page: (page_id, host, path, rule, verdict).

    labelled: (page_id, bad boolean), the labels to mine; it may be empty, then no rule is mined.
    * the fixed rule decides where one fits, else pages a mined rule matches are blocked, the rest allowed.
    * a null url, or one without ://, has an empty host and path, and is allowed unless a fixed rule fits.
    * repeated rows stay; null ids are judged by their url; other columns are ignored.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    own = own.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("tokens", basket(F.col("host"), F.col("path")))
    marks = labelled.where(F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    rules = condensed_rules(own.join(marks, "page_id").select("tokens", "bad"), **limits)
    if rules is None:
        judged = own.withColumn("hit", F.lit(False))
    else:
        hits = match_rules(own.select("page_id", "url", "tokens"), rules).select(F.col("page_id").alias("_id"), F.col("url").alias("_url"), F.lit(True).alias("hit"))
        judged = own.join(hits, own["page_id"].eqNullSafe(hits["_id"]) & own["url"].eqNullSafe(hits["_url"]), "left")
    judged = judged.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), fixed))
    return judged.select(
        "page_id", "host", "path", F.col("fixed.rule").alias("rule"),
        F.coalesce(F.col("fixed.verdict"), F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of `pages`; labels of the same id that are toxic or of low quality count as bad."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = labels.select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), bad)


OP1_SQL = """
WITH u AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
t AS (
  SELECT *, list_distinct(list_concat(
      list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
      list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '#', 'g')))) AS tokens
  FROM u),
m AS (SELECT doc_id, max(toxic = 1 OR quality = 0) AS bad FROM labels GROUP BY doc_id HAVING max(toxic = 1 OR quality = 0) IS NOT NULL),
b AS (SELECT row_number() OVER () AS rn, page_id, bad, tokens FROM t JOIN m ON doc_id = page_id WHERE len(tokens) > 0),
n AS (SELECT greatest(20, floor(count(*) * 1e-4)) AS least FROM b),
e AS (SELECT rn, bad, unnest(tokens) AS token FROM b),
s AS (SELECT token, count(*) AS n, count(*) FILTER (bad) AS nb, list(rn ORDER BY rn) AS rows FROM e GROUP BY token HAVING count(*) FILTER (bad) >= (SELECT least FROM n)),
alone AS (SELECT token FROM s WHERE nb / n >= 0.5),
item AS (SELECT token, min(token) OVER (PARTITION BY rows) AS item FROM s WHERE nb / n < 0.5),
c AS (SELECT rn, bad, list(DISTINCT item) AS items FROM e JOIN item USING (token) GROUP BY rn, bad),
subsets AS (
  SELECT bad, list_sort(list_filter(items, lambda x, i: (mask >> (i - 1)) % 2 = 1)) AS s
  FROM (SELECT bad, items, unnest(range(1, (1 << len(items))::BIGINT)) AS mask FROM c)),
rules AS (
  SELECT s FROM subsets GROUP BY s
  HAVING count(*) FILTER (bad) >= (SELECT least FROM n) AND count(*) FILTER (bad) / count(*) >= 0.5),
p AS (SELECT DISTINCT page_id, url, unnest(tokens) AS token FROM t),
pi AS (SELECT page_id, url, list(DISTINCT item) AS items FROM p JOIN item USING (token) GROUP BY ALL),
hits AS (SELECT page_id, url FROM p JOIN alone USING (token) UNION SELECT page_id, url FROM pi, rules WHERE list_has_all(items, s)),
f AS (
  SELECT t.page_id, t.url, host, path, h.page_id IS NOT NULL AS hit,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM t LEFT JOIN hits h ON h.page_id IS NOT DISTINCT FROM t.page_id AND h.url IS NOT DISTINCT FROM t.url)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow' WHEN hit THEN 'block' ELSE 'allow' END AS verdict
FROM f
"""
