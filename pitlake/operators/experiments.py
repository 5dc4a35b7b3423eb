"""Experiments over the feature matrix: windows, ablation, tuning, holdout, and the rules that read their figures."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import product
from typing import Any

from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitlake.operators import matrix, metrics, modelling

Build = Callable[[Sequence[str]], Pipeline]


def window_folds(seasons: Sequence[int], histories: Sequence[int] = (2, 3)) -> dict[str, list[tuple[tuple[int, ...], int]]]:
    """Folds by window: expanding, and rolling over the last seasons; all rolling windows test the same seasons."""
    return {"expanding": modelling.expanding_folds(seasons)} | {f"rolling_{h}": modelling.rolling_folds(seasons, h, max(histories)) for h in histories}


def run_windows(df: DataFrame, features: Sequence[str], folds: Mapping[str, Sequence[tuple[tuple[int, ...], int]]], models: Mapping[str, Build]) -> DataFrame:
    """Predictions (model, window, and those of walk_forward) for each model and window."""
    out = None
    for (name, build), (window, some) in product(models.items(), folds.items()):
        p = modelling.walk_forward(df, features, some, lambda b=build: b(features)).select(F.lit(name).alias("model"), F.lit(window).alias("window"), "*")
        out = p if out is None else out.unionByName(p)
    return out


def variants(families: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """Column subsets: all, each family left out, and families added one by one (the last of these is all again and left out)."""
    names = list(families)
    out = {"all": [c for f in names for c in families[f]]}
    out |= {f"leave_one_out:{f}": [c for g in names if g != f for c in families[g]] for f in names}
    out |= {f"incremental:{'+'.join(names[: k + 1])}": [c for f in names[: k + 1] for c in families[f]] for k in range(len(names) - 1)}
    return {k: v for k, v in out.items() if v}


def ablation(df: DataFrame, families: Mapping[str, Sequence[str]], folds: Mapping[str, Sequence[tuple[tuple[int, ...], int]]], build: Build) -> DataFrame:
    """Predictions (variant, window, fold, label, p) of one model on every variant of the columns."""
    out = None
    for name, columns in variants(families).items():
        p = run_windows(df, columns, folds, {"m": build}).select(F.lit(name).alias("variant"), "window", "fold", "label", "p")
        out = p if out is None else out.unionByName(p)
    return out


def concentration(folds: DataFrame, benefit: str, threshold: float = 0.5) -> DataFrame:
    """(family, window, total, largest_share, concentrated): how much of the positive benefit over folds comes from one of them."""
    gain = F.when(F.col(benefit) > 0, F.col(benefit)).otherwise(0.0)
    g = folds.groupBy("family", "window").agg(F.sum(gain).alias("total"), F.max(gain).alias("most"))
    share = F.when(F.col("total") > 0, F.col("most") / F.col("total"))
    return g.select("family", "window", "total", share.alias("largest_share"), F.coalesce(share > threshold, F.lit(False)).alias("concentrated"))


def holdout(df: DataFrame, features: Sequence[str], train: Sequence[int], test: int, build: Build, methodology: str) -> DataFrame:
    """Metrics of one fit on the training seasons over one later season, once the methodology is locked."""
    matrix.locked(methodology)
    p = modelling.walk_forward(df, features, [(tuple(train), test)], lambda: build(features))
    return metrics.slice_metrics(p, "label", "p", []).crossJoin(F.broadcast(metrics.calibration_error(p, "label", "p")))  # one row each


#: fixed values: (learning rate, trees) and the others of the first grid; one conservative candidate; an empty one is the default
RATES = [(0.03, 200), (0.05, 150), (0.08, 100)]
DEPTHS, LAMBDAS = (2, 3, 4), (1.0, 5.0)
CONSERVATIVE = {"max_depth": 2, "learning_rate": 0.03, "n_estimators": 300, "reg_lambda": 10.0, "min_child_weight": 3.0, "subsample": 0.8, "colsample_bytree": 0.8}


def tuning_grid() -> list[dict[str, Any]]:
    """The candidates of a first tuning pass: every depth, rate and penalty together, a conservative one and the default."""
    even = {"min_child_weight": 1.0, "subsample": 1.0, "colsample_bytree": 1.0}
    grid = [{"max_depth": d, "learning_rate": r, "n_estimators": n, "reg_lambda": x} | even for d, (r, n), x in product(DEPTHS, RATES, LAMBDAS)]
    return [*grid, CONSERVATIVE, {}]


def tune(df: DataFrame, features: Sequence[str], folds: Sequence[tuple[tuple[int, ...], int]], candidates: Mapping[str, Build]) -> DataFrame:
    """(model, n, log_loss, brier, ece, ..., rank): candidates by pooled log loss, then Brier, calibration error and name."""
    p = run_windows(df, features, {"tuning": folds}, candidates)
    m = metrics.slice_metrics(p, "label", "p", ["model"]).join(metrics.calibration_error(p, "label", "p", ["model"]), "model")
    return m.withColumn("rank", F.row_number().over(W.orderBy("log_loss", "brier", "ece", "model")))  # a row for each candidate


def flags(gaps: Mapping[str, float | None], extreme_share: float) -> list[str]:
    """What the gaps between holdout and development, and the share of extreme probabilities, say."""
    loss, auc, out = gaps.get("log_loss"), gaps.get("roc_auc"), []
    if loss is not None and loss > 0.005:
        out.append("large_holdout_log_loss_degradation" if loss > 0.02 else "modest_holdout_log_loss_degradation")
    if auc is not None and auc < -0.03:
        out.append("holdout_auc_drop")
    if extreme_share < 0.05:
        out.append("probabilities_not_extreme")
    return out


def edge_side(edge: Column) -> Column:
    """Whether the home side is picked, by the edge alone: null without one."""
    return F.when(edge.isNotNull(), edge >= 0)
