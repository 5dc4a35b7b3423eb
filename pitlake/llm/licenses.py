"""License scans: header and licence-file similarity to templates, then inheritance by directory.

Every line of a text is a possible header. Lines and templates are sparse TF-IDF
vectors; the document frequencies of the templates' terms are counted over all
documents, and a term of no template weighs as one never seen. A line can only
reach the threshold with one of a template's weightier terms (the rest of the
template is too short a vector), so other lines are dropped by an exact bound. A
file that is mostly licence lines is the licence file of its directory; files
without a licence of their own take that of the nearest directory above them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.llm.common import cut, drop_cut, small_join

TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
THRESHOLD = 0.6
FILE_SHARE = 0.5
#: fixed values: (license, statement)
TEMPLATES = [
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Released under the ISC License"),
    ("CC0-1.0", "Released under CC0 1.0 Universal public domain dedication"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def listed_frame(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A few rows as literals of the plan."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(r, names.split()))) for r in rows))))


def scan_licenses(
    files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per file: (doc_id, path, license, score, found, from_dir).

    found is header, file (a licence file), inherited (then from_dir names the directory) or null.
    * every row is judged by its own text, also where rows share a path or have none.
    * null texts are empty and null paths have no directory: such files inherit nothing and give nothing.
    * of equally similar templates the first listed counts; of several licence
      files in a directory the most similar, then the first path.
    * other columns are ignored; an empty table gives an empty result.
    """
    spark = files.sparkSession
    own = files.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    statements = listed_frame(spark, [(i, name, text) for i, (name, text) in enumerate(templates or TEMPLATES)], "t license statement")
    terms = statements.withColumn("term", F.explode(tokens(F.col("statement")))).groupBy("t", "license", "term").agg(F.count(F.lit(1)).alias("tf"))
    listed = [(r["t"], r["license"], r["term"], r["tf"]) for r in terms.collect()]  # the templates themselves
    vocabulary = sorted({x[2] for x in listed})
    words = F.array(*map(F.lit, vocabulary))
    # document frequencies of the template terms over all files
    counted = own.select(F.explode(F.array_append(F.array_intersect(tokens(F.col("text")), words), F.lit(""))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = {r["term"]: r["df"] for r in counted.collect()}  # a row for each template term and one, "", for all files
    n = df.get("", 0)
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    unseen = math.log(1 + n) + 1
    weights: dict[int, dict[str, float]] = {}
    for t, _, term, tf in listed:
        weights.setdefault(t, {})[term] = tf * idf[term]
    norms = {t: math.sqrt(sum(x * x for x in w.values())) for t, w in weights.items()}
    needed = set()
    for t, w in weights.items():
        light = 0.0
        for term, x in sorted(w.items(), key=lambda p: (p[1], p[0])):
            light += x * x
            if light >= (threshold * 0.999 * norms[t]) ** 2:
                needed.add(term)
    names = dict((t, name) for t, name, *_ in listed)
    model = F.broadcast(listed_frame(spark, [(t, names[t], term, x / norms[t]) for t, w in sorted(weights.items()) for term, x in sorted(w.items())], "t license term tw"))
    idfs = F.broadcast(listed_frame(spark, sorted(idf.items()), "term idf"))
    # the texts are cut into lines and the lines into terms once more, and only then weighed
    lines = own.select("path", "mark", F.posexplode(F.split("text", "\n")).alias("line", "words"))
    lines = lines.select("path", "mark", "line", F.length("words").alias("chars"), tokens(F.col("words")).alias("words"))
    lines = cut(lines.where(F.arrays_overlap("words", F.array(*map(F.lit, sorted(needed))))), "lines")
    key = ["path", "mark", "line", "chars"]
    each = lines.select(*key, F.explode("words").alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))
    each = each.join(idfs, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    sizes = each.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    dots = each.join(model, "term").groupBy(*key, "t", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    same = [dots["path"].eqNullSafe(sizes["path"]), *(dots[c] == sizes[c] for c in key[1:])]
    scored = dots.join(sizes, same).select(*(dots[c] for c in key), "t", "license", F.round(F.col("dot") / F.col("size"), 6).alias("score"))
    best = F.struct("score", (-F.col("t")).alias("t"), "license")
    headers = scored.where(F.col("score") >= threshold).groupBy(*key).agg(F.max(best).alias("best"))
    found = headers.groupBy("path", "mark").agg(F.max("best").alias("best"), F.sum("chars").alias("chars"))
    found = cut(found.select("path", "mark", "best.license", "best.score", "chars"), "licenses")
    drop_cut(lines)
    where = own.select("doc_id", "path", "mark", F.length("text").alias("length"))
    joined = where.alias("f").join(found.alias("l"), F.col("f.path").eqNullSafe(F.col("l.path")) & (F.col("f.mark") == F.col("l.mark")), "left").select(
        "doc_id", "f.path", "license", "score", (F.col("chars") >= FILE_SHARE * F.col("length")).alias("is_file")
    ).withColumn("dir", F.when(F.instr("path", "/") > 0, F.regexp_extract("path", r"^(.*)/[^/]*$", 1)))
    joined = cut(joined, "files")
    # licence files by directory, and for each directory the nearest at or above it
    given = joined.where(F.col("is_file") & F.col("dir").isNotNull()).groupBy("dir").agg(F.max_by("license", F.struct("score", F.reverse("path"))).alias("dir_license"))
    steps = F.split("dir", "/")
    above = joined.where(F.col("dir").isNotNull()).select("dir").distinct().withColumn(
        "up", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/")))
    )
    nearest = above.join(given.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("up", "dir_license"), F.length("up")).alias("from"))
    nearest = cut(nearest.select("dir", F.col("from.up").alias("from_dir"), F.col("from.dir_license").alias("dir_license")), "nearest")
    out = small_join(joined, nearest, ["dir"], how="left")
    had = F.col("license").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("license", "dir_license").alias("license"), "score",
        F.when(had & F.col("is_file"), "file").when(had, "header").when(F.col("dir_license").isNotNull(), "inherited").alias("found"),
        F.when(~had, F.col("from_dir")).alias("from_dir"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all `documents`, taken as files: source/doc_id where the id ends in 0, source/lang/doc_id elsewhere."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_licenses(docs, F.concat_ws("/", "source", F.when(F.col("doc_id") % 10 != 0, F.col("lang")), F.col("doc_id").cast("string")))


def _sql() -> str:
    rows = ",\n  ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))
    return f"""
WITH templates(t, license, statement) AS (VALUES
  {rows}),
term AS (
  SELECT t, license, term, count(*) AS tf
  FROM (SELECT t, license, unnest(regexp_extract_all(lower(statement), '{TOKEN}')) AS term FROM templates) GROUP BY ALL),
files AS (
  SELECT doc_id, dir || '/' || doc_id AS path, dir, top, coalesce(text, '') AS text
  FROM (SELECT *, CASE WHEN doc_id % 10 = 0 THEN source ELSE source || '/' || lang END AS dir, source AS top FROM documents)),
n AS (SELECT count(*) AS n FROM files),
df AS (
  SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '{TOKEN}'))) AS term FROM files)
  WHERE term IN (SELECT term FROM term) GROUP BY term),
idf AS (SELECT DISTINCT term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM term LEFT JOIN df USING (term), n),
tw AS (SELECT t, license, term, tf * idf AS w, sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY t)) AS size FROM term JOIN idf USING (term)),
lines AS (SELECT path, unnest(range(len(l))) AS line, unnest(l) AS words FROM (SELECT path, string_split(text, chr(10)) AS l FROM files)),
each AS (
  SELECT path, line, length(words) AS chars, term, count(*) AS tf
  FROM (SELECT path, line, words, unnest(regexp_extract_all(lower(words), '{TOKEN}')) AS term FROM lines) GROUP BY ALL),
lw AS (SELECT each.*, tf * coalesce(idf, (SELECT ln(1 + n) + 1 FROM n)) AS w FROM each LEFT JOIN idf USING (term)),
size AS (SELECT path, line, sqrt(sum(w * w)) AS size FROM lw GROUP BY ALL),
scored AS (
  SELECT lw.path, lw.line, chars, t, license, round(sum(lw.w * tw.w / tw.size) / any_value(size.size), 6) AS score
  FROM lw JOIN tw USING (term) JOIN size ON size.path = lw.path AND size.line = lw.line GROUP BY ALL),
head AS (SELECT path, line, chars, max(struct_pack(score := score, t := -t, license := license)) AS best FROM scored WHERE score >= {THRESHOLD} GROUP BY ALL),
found AS (SELECT path, max(best) AS best, sum(chars) AS chars FROM head GROUP BY path),
joined AS (
  SELECT doc_id, files.path, dir, top, best.license AS license, best.score AS score, chars >= {FILE_SHARE} * length(text) AS is_file
  FROM files LEFT JOIN found ON found.path = files.path),
given AS (SELECT dir, max_by(license, struct_pack(s := score, p := reverse(path))) AS dir_license FROM joined WHERE is_file GROUP BY dir)
SELECT doc_id, path, coalesce(license, own.dir_license, up.dir_license) AS license, score,
       CASE WHEN license IS NOT NULL AND is_file THEN 'file' WHEN license IS NOT NULL THEN 'header' WHEN coalesce(own.dir_license, up.dir_license) IS NOT NULL THEN 'inherited' END AS found,
       CASE WHEN license IS NULL THEN coalesce(own.dir, up.dir) END AS from_dir
FROM joined LEFT JOIN given own ON own.dir = joined.dir LEFT JOIN given up ON up.dir = joined.top
"""


OP8_SQL = _sql()
