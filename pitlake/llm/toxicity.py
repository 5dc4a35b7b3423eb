"""Toxicity scores from a counterfactual-regularised linear classifier.

Features are the distinct words of a text and their leading letters. Besides
the logistic loss on labelled texts the training penalises how much the score
moves when the terms for a group of people in a labelled text are swapped for
those of another group, so that naming a group is no evidence by itself. Long
texts aren't diluted: features count once, and only those whose share of toxic
texts stands out are kept, with an L1 penalty on top.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7, 8)
#: fixed values: terms that may stand for each other, by language
IDENTITY = [
    ["women", "men"], ["girls", "boys"], ["woman", "man"], ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"], ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["black", "white", "asian", "latino"], ["immigrants", "natives", "refugees"], ["disabled", "blind", "deaf"],
    ["frauen", "männer"], ["christen", "muslime", "juden"], ["femmes", "hommes"], ["chrétiens", "musulmans", "juifs"],
    ["mujeres", "hombres"], ["cristianos", "musulmanes", "judíos"],
]
SWAP = {t: group[(i + 1) % len(group)] for group in IDENTITY for i, t in enumerate(group)}


@dataclass
class Settings:
    """Bounds and weights of the training.

    sample_per_class bounds the labelled texts of each label that are used, the
    ones with the smallest hash of their id; max_features bounds the model.
    """

    sample_per_class: int = 8000
    max_features: int = 20_000
    least_texts: int = 3
    least_z: float = 4.0
    l1: float = 2e-5
    l2: float = 1e-4
    counterfactual: float = 1.0
    rounds: int = 2000


def features_of(words: set[str]) -> set[str]:
    out = set()
    for w in words:
        out.add(w + "$")
        for n in PREFIXES:
            if len(w) >= n:
                out.add(w[:n])
    return out


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def sampled(docs: DataFrame, labels: DataFrame, s: Settings) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of the training sample, and how many labels of each kind there are."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.where(~held_out())
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    picked = [marks.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample_per_class) for k in (0, 1)]
    ids = picked[0].union(picked[1])  # at most two rows per bound
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic"), counts


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


@dataclass
class Model:
    bias: float
    weights: dict[str, float]

    def score(self, features: set[str]) -> float:
        z = self.bias + sum(self.weights.get(f, 0.0) for f in sorted(features))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def fit(docs: DataFrame, labels: DataFrame, s: Settings | None = None) -> Model:
    """Train on the labels that aren't held out; without labels of both kinds, or without a labelled text, the score is constant."""
    s = s or Settings()
    texts, counts = sampled(docs, labels, s)
    if not counts.get(0) or not counts.get(1):
        rate = 1e-6 if not counts.get(1) else 1 - 1e-6
        return Model(math.log(rate / (1 - rate)), {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, hit = Counter(), Counter()
        for batch in batches:
            for t, y in zip(batch.column(0), batch.column(1).to_pylist()):
                f = features_of(words_of(t.as_py()))
                n.update(f)
                if y:
                    hit.update(f)
        keys = list(n)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[k] for k in keys], pa.int64()), pa.array([hit[k] for k in keys], pa.int64())], ["f", "n", "hit"])

    used = {k: min(v, s.sample_per_class) for k, v in counts.items()}
    p = used[1] / (used[0] + used[1])
    stats = texts.mapInArrow(count, "f string, n long, hit long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"))
    z = (F.col("hit") - F.col("n") * F.lit(p)) / F.sqrt(F.col("n") * F.lit(p * (1 - p)))
    identity = [w + "$" for w in SWAP]
    kept = stats.where(F.col("n") >= s.least_texts).withColumn("z", F.abs(z)).where((F.col("z") >= s.least_z) | F.col("f").isin(identity))
    names = [r["f"] for r in kept.orderBy(F.desc("z"), "f").limit(s.max_features).select("f").collect()]
    place = {f: i for i, f in enumerate(names)}
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in batches:
            own, other = [], []
            for t in batch.column(0):
                words = words_of(t.as_py())
                f = features_of(words)
                own.append(sorted(at[x] for x in f if x in at))
                if words & SWAP.keys():
                    g = features_of({SWAP.get(w, w) for w in words})
                    other.append(sorted(at[x] for x in g if x in at))
                else:
                    other.append(None)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(own, kind), pa.array(other, kind), batch.column(1)], ["own", "other", "toxic"])

    rows = texts.mapInArrow(pick, "own array<int>, other array<int>, toxic int").toPandas()
    # copies in the sample count once
    if not len(rows):  # no labelled text is among docs
        return Model(math.log(counts[1] / counts[0]), {})
    rows = rows[~rows.assign(k=[(tuple(a), y) for a, y in zip(rows["own"], rows["toxic"])]).duplicated("k")]
    w, b = train(len(names), list(rows["own"]), list(rows["other"]), rows["toxic"].to_numpy(float), s)
    sample_odds = max(1, rows["toxic"].sum()) / max(1, (1 - rows["toxic"]).sum())
    b += math.log(counts[1] / counts[0]) - math.log(sample_odds)
    return Model(float(b), {f: float(x) for f, x in zip(names, w) if x})


def train(width: int, own: list, other: list, y: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient on the logistic loss, the counterfactual penalty and the L1 and L2 terms.

    The step comes from the largest curvature, found by power iteration; momentum restarts where the loss rises.
    """
    n = len(y)

    def flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
        sizes = [len(x) for x in lists]
        return np.repeat(np.arange(len(lists)), sizes), (np.concatenate([np.asarray(x, np.int64) for x in lists]) if sum(sizes) else np.zeros(0, np.int64))

    row, col = flat(own)
    swapped = [i for i, x in enumerate(other) if x is not None]
    r1, c1 = flat([own[i] for i in swapped])
    r2, c2 = flat([other[i] for i in swapped])
    m = max(1, len(swapped))
    forward = lambda v: np.bincount(row, v[col], n)
    back = lambda g: np.bincount(col, g[row], width)
    moved = lambda v: np.bincount(r1, v[c1], m) - np.bincount(r2, v[c2], m)
    unmoved = lambda g: np.bincount(c1, g[r1], width) - np.bincount(c2, g[r2], width)

    v, c, curve = np.ones(width), 1.0, 1.0
    for _ in range(30):
        z = (forward(v) + c) / (4 * n)
        v, c = back(z) + s.l2 * v + 2 * s.counterfactual / m * unmoved(moved(v)), z.sum()
        curve = math.sqrt(v @ v + c * c)
        v, c = v / curve, c / curve
    step = 1 / (1.1 * curve)

    w, b, t = np.zeros(width), math.log((y.sum() + 1) / (n - y.sum() + 1)), 1.0
    v, c, before = w, b, np.inf
    for k in range(s.rounds):
        z, gap = forward(v) + c, moved(v)
        loss = np.mean(np.logaddexp(0, z) - y * z) + s.l2 / 2 * (v @ v) + s.l1 * np.abs(v).sum() + s.counterfactual / m * (gap @ gap)
        if loss > before and t > 1:
            v, c, t, before = w, b, 1.0, np.inf
            continue
        if k > 50 and before - loss < 1e-8:
            break
        before = loss
        off = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        nw = v - step * (back(off) + s.l2 * v + 2 * s.counterfactual / m * unmoved(gap))
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * s.l1, 0)
        nb = c - step * off.sum()
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "_score") -> DataFrame:
    """docs with the score added as `score_col`; a column of docs with that name raises.

    * one row per input row, repeated ones too; null and empty texts get the score of no evidence.
    * only the text enters the score; every word of it does, whatever its length.
    """
    if score_col.lower() in [c.lower() for c in docs.columns]:
        raise ValueError(f"docs have a column {score_col} already")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_features weights
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            scores = []
            for t in batch.column(at):
                found: set[str] = set()
                for piece in set((t.as_py() or "").lower().split()):
                    hit = known.get(piece)
                    if hit is None:
                        hit = tuple(f for f in features_of(set(WORD.findall(piece))) if f in m.weights)
                        if len(known) > 300_000:
                            known.clear()
                        if len(piece) < 64:
                            known[piece] = hit
                    if hit:
                        found.update(hit)
                scores.append(m.score(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*places, "score"])

    places = [f"c{i}" for i in range(len(docs.columns))]  # names that need no quoting on the way
    fields = [StructField(p, f.dataType, f.nullable) for p, f in zip(places, docs.schema.fields)]
    return docs.toDF(*places).mapInArrow(run, StructType([*fields, StructField("score", DoubleType())])).toDF(*docs.columns, score_col)


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None, threshold: float = 0.3
) -> DataFrame:
    """Train on `labels` (doc_id, toxic) and score every row of docs: (doc_id, held_out, score, predicted).

    * labels with a null id or value are left out; of repeated labels the largest counts.
    * rows with a null id are scored and never held out; extra columns are ignored.
    * without labels of both kinds the score is constant; an empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = score(own, fit(own, labels.select("doc_id", "toxic"), settings))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all `documents` by what `labels.toxic` teaches."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
