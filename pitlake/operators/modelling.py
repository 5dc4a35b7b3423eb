"""Walk-forward evaluation, locked models and simulation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.operators import metrics


def expanding_folds(seasons: Sequence[int], first: int = 1) -> list[tuple[tuple[int, ...], int]]:
    """(train seasons, test season): all before each season."""
    s = sorted(set(seasons))
    return [(tuple(s[:i]), s[i]) for i in range(first, len(s))]


def rolling_folds(seasons: Sequence[int], history: int, longest: int) -> list[tuple[tuple[int, ...], int]]:
    """The last `history` seasons before each season; test seasons are those the longest history has too."""
    s = sorted(set(seasons))
    return [(tuple(s[i - history : i]), s[i]) for i in range(longest, len(s))]


def check_folds(folds: Sequence[tuple[tuple[int, ...], int]]) -> None:
    for train, test in folds:
        if not train or max(train) >= test or len(set(train)) != len(train):
            raise ValueError(f"fold {train} -> {test} isn't chronological")


def pipeline(kind: str, features: Sequence[str], seed: int = 0) -> Pipeline:
    """Mean imputation and a classifier: logistic, forest or boosted."""
    filled = [f"{c}_filled" for c in features]
    stages = [Imputer(inputCols=list(features), outputCols=filled, strategy="mean"), VectorAssembler(inputCols=filled, outputCol="raw_features")]
    if kind == "logistic":
        stages += [StandardScaler(inputCol="raw_features", outputCol="features", withMean=True), LogisticRegression(maxIter=1000, regParam=1e-6)]
    elif kind == "forest":
        stages += [RandomForestClassifier(featuresCol="raw_features", numTrees=40, seed=seed)]
    elif kind == "boosted":
        stages += [GBTClassifier(featuresCol="raw_features", maxIter=20, seed=seed)]
    else:
        raise ValueError(kind)
    return Pipeline(stages=stages)


def builder(model) -> Callable[[], Pipeline]:
    """The function that builds a model: a module (or object) with `build_model`, or the function itself."""
    found = getattr(model, "build_model", model)
    if not callable(found):
        raise TypeError(f"{model!r} neither is nor has a function that builds a model")
    return found


def fitted(model):
    """A fitted model: the one given, or what a function without arguments loads."""
    return model if hasattr(model, "transform") else model()


def score(train: DataFrame, held: DataFrame, build: Callable[[], Pipeline], label: str = "label") -> DataFrame:
    """The held rows with p, by a model of the training rows; a training set of one class predicts that class."""
    rates = train.agg(F.min(label).alias("lo"), F.max(label).alias("hi")).collect()[0]
    if rates["lo"] == rates["hi"]:
        p = held.withColumn("p", F.lit(None if rates["lo"] is None else float(rates["lo"])).cast("double"))
    else:
        p = build().fit(train).transform(held).withColumn("p", vector_to_array("probability")[1])
    return p.select(*held.columns, "p")


def walk_forward(df: DataFrame, features: Sequence[str], folds: Sequence[tuple[tuple[int, ...], int]], build: Callable[[], Pipeline], season: str = "season", label: str = "label") -> DataFrame:
    """Predictions (the rows, fold, p) of each test season by a model of its training seasons; unlabelled rows are left out."""
    check_folds(folds)
    out = None
    known = df.where(F.col(label).isNotNull())
    for train, test in folds:
        p = score(known.where(F.col(season).isin(*train)), known.where(F.col(season) == test), builder(build), label).select(*df.columns, F.lit(test).alias("fold"), "p")
        out = p if out is None else out.unionByName(p)
    return out


def lock(df: DataFrame, seasons: Sequence[int], build: Callable[[], Pipeline], path: str, season: str = "season", label: str = "label") -> int:
    """Fit on the labelled rows of the seasons, save the model and give the number of rows; `PipelineModel.load` reads it back."""
    train = df.where(F.col(season).isin(*seasons) & F.col(label).isNotNull())
    n = train.count()
    if not n:
        raise ValueError(f"no labelled rows in {list(seasons)}")
    builder(build)().fit(train).write().overwrite().save(path)
    return n


def run_rate_pipeline(features: Sequence[str], label: str) -> Pipeline:
    filled = [f"{c}_filled" for c in features]
    glr = GeneralizedLinearRegression(family="poisson", link="log", regParam=1.0, labelCol=label, featuresCol="features", predictionCol="rate")
    return Pipeline(stages=[Imputer(inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"), glr])


def run_rates(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The rows with their expected rate, floored."""
    return fitted(model).transform(df).withColumn("rate", F.greatest("rate", F.lit(0.05))).drop("features", *(f"{c}_filled" for c in features))


def fit_run_rates(df: DataFrame, features: Sequence[str], label: str):
    """Poisson regression with imputed features; rates are floored."""
    model = run_rate_pipeline(features, label).fit(df.where(F.col(label).isNotNull()))
    return lambda x: run_rates(model, x, features)


def simulate(games: DataFrame, trials: int, seed: int = 0) -> DataFrame:
    """Games (game_pk, home_rate, away_rate) with p_home, mean_home, mean_away and median_total of Poisson trials; each game has its own stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):  # games at once: a few MB of draws
                part = pdf.iloc[at : at + 256]
                x, y = np.empty((2, len(part), trials), np.int64)
                for i, (pk, h, a) in enumerate(part[["game_pk", "home_rate", "away_rate"]].itertuples(index=False)):
                    rng = np.random.default_rng([seed, int(pk)])
                    x[i], y[i] = rng.poisson(h, trials), rng.poisson(a, trials)
                won = ((x > y).sum(1) + 0.5 * (x == y).sum(1)) / trials
                yield pd.DataFrame({"game_pk": part["game_pk"], "p_home": won, "mean_home": x.mean(1), "mean_away": y.mean(1), "median_total": np.median(x + y, axis=1)})

    return games.select("game_pk", "home_rate", "away_rate").mapInPandas(run, "game_pk long, p_home double, mean_home double, mean_away double, median_total double")


def pooled(predictions: DataFrame, label: str = "label", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Metrics of each fold and of all of them, fold -1, for each group."""
    both = predictions.select(*by, "fold", label, p).unionByName(predictions.select(*by, F.lit(-1).alias("fold"), label, p))
    keys = [*by, "fold"]
    return metrics.slice_metrics(both, label, p, keys).join(metrics.calibration_error(both, label, p, keys), keys)
