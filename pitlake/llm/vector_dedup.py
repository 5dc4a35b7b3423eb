"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned into the principal axes of all
vectors, so that the first coordinates say most. Rows are dealt into blocks along
the first axis, and every pair of blocks that can hold a pair over the threshold
is one tile. In a tile products are summed a few leading coordinates at a time;
what the rest can still add is bounded by the lengths of the two suffixes, and a
pair is given up as soon as the bound falls below the threshold. What is left is
decided by the cosine in double precision of the vectors as they came.

Equal vectors are one row before that, with a count, so copies cost nothing. A
tile tells for each of its vectors how many others it links with there and one
vector that stands for all it reaches there, so what a tile sends on grows with
its rows and not with the pairs in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlake.llm.common import components, cut, hot_keys, salted

SIMILAR = 0.9
BLOCK = 4096
STEP = 8
SIDE = 4  # tiles of one block that a place takes
KINDS = {"float": np.float32, "double": np.float64}  # vectors travel as they came
MARGIN = 1e-4  # what single precision may err by in the bounds


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as one array."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest part first, so that nothing overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_axes(vectors: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes (columns) of all unit vectors and the share of each in their squared length, by falling share; second moments are summed where the rows are."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                u = unit(matrix(batch.column(0)))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    sums = (
        vectors.select("embedding").mapInArrow(moments, "i long, row array<double>")
        .select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    )
    out = np.zeros((width, width))
    for r in sums.collect():  # width * width numbers whatever the rows
        out[r["i"], r["j"]] = r["x"]
    values, axes = np.linalg.eigh((out + out.T) / 2)
    order = np.argsort(-values)
    return axes[:, order], values[order] / values.sum()


def stops(shares: np.ndarray, limit: float) -> tuple[int, ...]:
    """Where the scan looks at its bound: first where the rest of two ordinary vectors is clearly too short for the limit, then every few coordinates."""
    left = 1 - np.cumsum(shares)
    enough = np.nonzero(left <= 0.7 * limit)[0]
    first = min(len(shares), -(-(int(enough[0]) + 1) // STEP) * STEP) if len(enough) else len(shares)
    return (*range(first, len(shares), STEP), len(shares))


def prefix_scan(a: np.ndarray, b: np.ndarray, limit: float, ends: tuple[int, ...], rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit rows in principal axes whose product may reach limit: leading coordinates first, the rest by its bound."""
    a32, b32 = a.astype(np.float32), b.astype(np.float32)

    def tails(x: np.ndarray) -> list[np.ndarray]:
        return [np.sqrt(np.maximum(0, (x[:, k:] ** 2).sum(1))).astype(np.float32) for k in ends]

    ta, tb = tails(a), tails(b)
    low = np.float32(limit - MARGIN)
    first, second = [], []
    for at in range(0, len(a), rows):
        top = min(at + rows, len(a))
        k = ends[0]
        bound = a32[at:top, :k] @ b32[:, :k].T
        part_limit = low - bound
        i, j = np.nonzero(np.multiply.outer(ta[0][at:top], tb[0]) >= part_limit)
        part = bound[i, j]
        i += at
        for n in range(1, len(ends)):
            if not len(i):
                break
            lo, hi = ends[n - 1], ends[n]
            part = part + np.einsum("ij,ij->i", a32[i, lo:hi], b32[j, lo:hi])
            live = part + ta[n][i] * tb[n][j] >= low
            i, j, part = i[live], j[live], part[live]
        first.append(i)
        second.append(j)
    return np.concatenate(first), np.concatenate(second)


def tile_links(axes: np.ndarray, ends: tuple[int, ...], limit: float, kind: str):
    """What tiles (ids, counts, vectors of two blocks as bytes, same) hold, by exact cosines of limit or more.

    Gives (vec_id, more, root): the rows that a class links with, and the least class that it reaches, in this tile.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ia, na, xa, ib, nb, xb, same = (batch.column(c)[r].as_py() for c in range(7))
                ia, na, ib, nb = (np.frombuffer(x, np.int64) for x in (ia, na, ib, nb))
                xa, xb = (np.frombuffer(x, KINDS[kind]).reshape(len(i), -1).astype(np.float64) for x, i in ((xa, ia), (xb, ib)))
                i, j = prefix_scan(unit(xa) @ axes, unit(xb) @ axes, limit, ends)
                ok = ia[i] < ib[j] if same else ia[i] != ib[j]
                i, j = i[ok], j[ok]
                ok = exact_cosine(xa, xb, i, j) >= limit
                i, j = i[ok], j[ok]
                ids, at = np.unique(np.concatenate([ia[i], ib[j]]), return_inverse=True)
                more = np.bincount(at, np.concatenate([nb[j], na[i]]), len(ids)).astype(np.int64)
                roots = ids[least_reached(len(ids), at[: len(i)], at[len(i) :])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, more, roots)], ["vec_id", "more", "root"])

    return run


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of 0..n-1 that each reaches along the edges (a, b)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        np.minimum.at(new, low, new)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def exact_cosine(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    return np.einsum("ij,ij->i", a[i], b[j]) / (na[i] * nb[j])


def pack(kind: str):
    """(blk, vec_id, n, embedding, p) rows to (blk, ids, counts, vectors, lo, hi), three of them as bytes; a block may come in several pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            blk, ids, n, p = (np.asarray(batch.column(c)) for c in (0, 1, 2, 4))
            x = matrix(batch.column(3)).astype(KINDS[kind])
            rows = [(int(k), ids[m].tobytes(), n[m].tobytes(), x[m].tobytes(), float(p[m].min()), float(p[m].max())) for k in np.unique(blk) for m in (blk == k,)]
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["blk", "ids", "counts", "vectors", "lo", "hi"])

    return run


def link_vectors(vectors: DataFrame, limit: float = SIMILAR, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row per input row: (vec_id, n_links, component_id, kept).

    n_links counts the other rows with a cosine of limit (over 0) or more, component_id
    is the smallest id reachable, kept says whether it is the row's own.
    * null, empty and zero vectors, and those with null or non-finite parts, link with nothing.
    * vectors of different lengths don't link.
    * a row with a null id links with nothing and is kept; rows that repeat an id count each.
    * parts of any type but float count as double.
    * other columns are ignored; an empty table gives an empty result.
    """
    kind = "float" if isinstance(vectors.select(vector_col).schema[0].dataType.elementType, T.FloatType) else "double"
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    good = F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    marked = own.withColumn("good", good)
    alone = marked.where(~F.col("good")).select("vec_id")
    # equal vectors are one class, known by its smallest id; 0.0 and -0.0 are equal
    clean = marked.where("good").select("vec_id", F.transform("embedding", lambda x: x + F.lit(0.0).cast(kind)).alias("embedding"))
    clean = clean.withColumn("key", F.sha2(F.to_binary(F.to_json("embedding"), F.lit("utf-8")), 256))
    clean = salted(clean, hot_keys(clean.select("key"), "key"), "key", F.col("vec_id"), 64)
    parts = cut(clean.groupBy("key", "_salt").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")), "parts")
    classes = cut(parts.groupBy("key").agg(F.min("low").alias("vec_id"), F.sum("n").alias("n"), F.first("embedding").alias("embedding")), "classes")

    links = None
    for width, rows in sorted(tuple(r) for r in classes.groupBy(F.size("embedding")).count().collect()):
        found = links_of_width(classes.where(F.size("embedding") == width), width, rows, limit, block, kind)
        links = found if links is None else links.union(found)
    if links is None:
        return alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = cut(links, "links")
    near = links.groupBy("vec_id").agg(F.sum("more").alias("more"))
    groups = components(links.select(F.col("vec_id").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("id", "vec_id")
    told = classes.select("key", "vec_id", "n").join(near, "vec_id", "left").join(groups, "vec_id", "left").select(
        "key", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    )
    told = parts.select("key", "_salt").join(told, "key")
    out = clean.select("vec_id", "key", "_salt").join(told, ["key", "_salt"]).select("vec_id", "n_links", "component_id")
    out = out.union(alone.select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def links_of_width(classes: DataFrame, width: int, rows: int, limit: float, block: int, kind: str) -> DataFrame:
    """(vec_id, more, root) of the tiles over the classes of one vector length."""
    spark = classes.sparkSession
    axes, shares = principal_axes(classes, width)
    ends = stops(shares, limit)
    blocks = max(1, math.ceil(rows / block))
    lead = spark.sparkContext.broadcast(axes[:, 0].copy())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = unit(matrix(batch.column(0))) @ lead.value if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.float64())], ["p"])

    places = classes.select("embedding").mapInArrow(project, "p double")
    marks = [k / blocks for k in range(1, blocks)]
    borders = np.unique(places.select(F.percentile_approx("p", marks, 10_000)).collect()[0][0]) if marks else np.zeros(0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = unit(matrix(batch.column(2))) @ lead.value if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(borders, p, side="left")), *batch.columns, pa.array(p, pa.float64())], ["blk", "vec_id", "n", "embedding", "p"])

    dealt = classes.select("vec_id", "n", "embedding").mapInArrow(deal, f"blk long, vec_id long, n long, embedding array<{kind}>, p double")
    packed = cut(dealt.repartition(blocks, "blk").mapInArrow(pack(kind), "blk long, ids binary, counts binary, vectors binary, lo double, hi double"), "pieces").withColumn("piece", F.xxhash64("ids"))
    spans = sorted((r["blk"], r["lo"], r["hi"]) for r in packed.groupBy("blk").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect())  # a row for each block
    plan = spark.createDataFrame([(k, reach(spans, i, limit)) for i, (k, *_) in enumerate(spans)], "blk long, most long")
    # each block goes to the tiles it opens, and the block it faces there to one place for every SIDE of them
    parts = ("ids", "counts", "vectors", "piece")
    tasks = max(1, min(blocks * (blocks + 1) // 2, 20_000))
    sides = -(-blocks // SIDE)
    near = plan.join(packed.select("blk", *parts), "blk").withColumn("blk2", F.explode(F.sequence("blk", "most"))).withColumn("side", F.col("blk") % sides)
    other = packed.select(F.col("blk").alias("blk2"), *(F.col(c).alias(f"{c}2") for c in parts)).withColumn("side", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sides - 1).cast("long"))))
    faced = near.repartition(tasks, "blk2", "side").join(other.repartition(tasks, "blk2", "side"), ["blk2", "side"])
    faced = faced.where((F.col("blk") < F.col("blk2")) | (F.col("piece") <= F.col("piece2")))
    same = (F.col("blk") == F.col("blk2")) & (F.col("piece") == F.col("piece2"))
    faced = faced.select("ids", "counts", "vectors", "ids2", "counts2", "vectors2", same.alias("same"))
    return faced.mapInArrow(tile_links(axes, ends, limit, kind), "vec_id long, more long, root long")


def reach(spans: list[tuple[int, float, float]], i: int, limit: float) -> int:
    """The last block whose first coordinates can meet those of block i; what can't lies beyond it, as blocks are in order."""
    lo, hi = i, len(spans) - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if possible(spans[i][1:], spans[mid][1:], limit) else (lo, mid - 1)
    return spans[lo][0]


def possible(a: tuple[float, float], b: tuple[float, float], limit: float) -> bool:
    """Whether unit vectors with first coordinates in these spans can have a product of limit: it is at most p q + sqrt((1-p^2)(1-q^2))."""
    lo, hi = max(a[0], b[0]), min(a[1], b[1])
    if lo <= hi:
        return True
    p, q = (a[1], b[0]) if a[1] < b[0] else (b[1], a[0])
    p, q = (min(1.0, max(-1.0, x)) for x in (p, q))
    return p * q + math.sqrt((1 - p * p) * (1 - q * q)) >= limit - MARGIN


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked vectors of `embeddings`."""
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (
  WITH RECURSIVE r(x, y) AS (SELECT x, y FROM pairs UNION SELECT r.x, pairs.y FROM r JOIN pairs ON r.y = pairs.x)
  SELECT x, min(y) AS low FROM r GROUP BY x),
links AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN links ON links.x = vec_id LEFT JOIN reach ON reach.x = vec_id
"""
