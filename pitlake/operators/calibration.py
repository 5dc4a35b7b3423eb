"""Calibrators of probabilities, and their comparison on a model that is fitted again on all training rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.functions.odds import safe_logit
from pitlake.operators import modelling
from pitlake.operators.ranks import running_total

METHODS = ("sigmoid", "isotonic")


def _logits(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=["_z"], outputCol="_v").transform(df.withColumn("_z", safe_logit(F.col("p"))))


@dataclass(frozen=True)
class Calibrator:
    """Adds `calibrated`, from 0 to 1, to rows with p."""

    method: str
    model: Any

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.method == "sigmoid":
            return self.model.transform(_logits(df)).withColumn("calibrated", vector_to_array("_cp")[1]).drop("_z", "_v", "_cp", "_cr", "_cl")
        return self.model.transform(df).withColumn("calibrated", F.least(F.greatest("_c", F.lit(0.0)), F.lit(1.0))).drop("_c")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/{self.method}")


def load(path: str, method: str) -> Calibrator:
    kind = LogisticRegressionModel if method == "sigmoid" else IsotonicRegressionModel
    return Calibrator(method, kind.load(f"{path}/{method}"))


def fit(predictions: DataFrame, method: str, label: str = "label") -> Calibrator:
    """A calibrator from rows with p and label: sigmoid on the logit, or isotonic."""
    if method not in METHODS:
        raise ValueError(f"no such method: {method!r}")
    if method == "sigmoid":
        return Calibrator(method, LogisticRegression(featuresCol="_v", labelCol=label, probabilityCol="_cp", rawPredictionCol="_cr", predictionCol="_cl").fit(_logits(predictions)))
    return Calibrator(method, IsotonicRegression(featuresCol="p", labelCol=label, predictionCol="_c").fit(predictions))


def split_later(df: DataFrame, date: str, key: str, share: float) -> tuple[DataFrame, DataFrame]:
    """(earlier rows, the last share of rows) by date and key; rows of one date and key stay together, without a date raises.

    The date of the cut comes from counts per date, the key from counts inside that date, so nothing is sorted as a whole.
    """
    if not 0 < share < 1:
        raise ValueError(f"not a share: {share!r}")
    size = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(date).isNull()).alias("undated")).collect()[0]
    early = size["n"] - round(size["n"] * share)
    if size["undated"] or early in (0, size["n"]):
        raise ValueError(f"{size['n']} rows, {size['undated']} without a date, can't be split at {share}")

    def first_at(rows: DataFrame, x: str, upto: int):
        counts = running_total(rows.groupBy(x).agg(F.count(F.lit(1)).alias("_n")), x, "_n", "_upto")
        return counts.where(F.col("_upto") >= upto).agg(F.min(F.struct("_upto", "_n", x)).alias("r")).collect()[0]["r"]

    day = first_at(df, date, early)
    inside = first_at(df.where(F.col(date) == F.lit(day[date])), key, early - (day["_upto"] - day["_n"]))
    is_early = (F.col(date) < F.lit(day[date])) | ((F.col(date) == F.lit(day[date])) & (F.col(key) <= F.lit(inside[key])))
    return df.where(is_early), df.where(~is_early)


def refit_variants(df: DataFrame, folds: Sequence[tuple[tuple[int, ...], int]], build: Callable[[], Pipeline], keep: Callable[[DataFrame, str], DataFrame], date: str, key: str, share: float = 0.2, methods: Sequence[str] = METHODS, season: str = "season", label: str = "label") -> tuple[DataFrame, list[dict[str, Any]]]:
    """Predictions (fold, key, variant, label, p) of raw and calibrated probabilities of one model, and the rows of each partition by fold.

    In each fold a model of the earlier training rows scores the last share of them, and
    the calibrators are fitted on these scores alone; the model is then fitted again on
    all training rows, and every variant starts from its scores of the test season.
    `keep(frame, name)` stores a frame that is read several times.
    """
    modelling.check_folds(folds)
    known = F.col(label).isNotNull()
    out, parts = None, []
    for train, test in folds:
        rows = df.where(F.col(season).isin(*train))
        early, late = (x.where(known) for x in split_later(rows, date, key, share))
        inner = keep(modelling.score(early, late, build, label).select(label, "p"), "inner")
        p = modelling.score(rows.where(known), df.where((F.col(season) == test) & known), build, label).select(key, label, "p")
        for m in methods:
            p = fit(inner, m, label)(p).withColumnRenamed("calibrated", f"_{m}")
        each = F.array(*(F.struct(F.lit(n).alias("variant"), F.col(c).alias("p")) for n, c in (("raw", "p"), *((m, f"_{m}") for m in methods))))
        p = keep(p.select(F.lit(test).alias("fold"), key, label, F.inline(each)), "variants")
        n_test = p.where("variant = 'raw'").count()
        if not n_test:
            raise ValueError(f"no labelled rows in season {test}")
        parts.append({"fold": test, "base_fit": early.count(), "calibration": inner.count(), "refit": rows.where(known).count(), "test": n_test})
        out = p if out is None else out.unionByName(p)
    return out, parts


def compare(predictions: DataFrame, key: str, label: str = "label") -> DataFrame:
    """(variant, fold, n, metrics, lowest, highest, digest) by fold and pooled, fold -1; the digest doesn't depend on the order of rows."""
    both = predictions.unionByName(predictions.withColumn("fold", F.lit(-1)))
    extra = both.groupBy("variant", "fold").agg(F.min("p").alias("lowest"), F.max("p").alias("highest"), F.sha2(F.sum(F.xxhash64(key, F.round("p", 9)).cast("decimal(38,0)")).cast("string"), 256).alias("digest"))
    return modelling.pooled(predictions, label=label, by=["variant"]).join(extra, ["variant", "fold"])


def recommend(figures: Sequence[Any], methods: Sequence[str] = METHODS) -> str:
    """Which variant to use, from the rows of `compare`.

    A calibrated variant needs a better pooled log loss and Brier score, and a better log
    loss in more than half of the folds; the best pooled log loss wins, then Brier, then ece.
    """
    at = {(r["variant"], r["fold"]): r for r in figures}
    seasons = sorted({f for _, f in at} - {-1})

    def gates(m: str) -> bool:
        gains = [at[m, s]["log_loss"] < at["raw", s]["log_loss"] for s in seasons]
        return all(at[m, -1][c] < at["raw", -1][c] for c in ("log_loss", "brier")) and 2 * sum(gains) > len(gains)

    passed = sorted((at[m, -1]["log_loss"], at[m, -1]["brier"], at[m, -1]["ece"], m) for m in methods if gates(m))
    return {"sigmoid": "USE PLATT", "isotonic": "USE ISOTONIC"}[passed[0][-1]] if passed else "KEEP RAW"
