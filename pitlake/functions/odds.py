"""Odds and probability arithmetic as column expressions.

Invalid input gives null, never a guess: American prices are whole, of magnitude
100 or more; probabilities lie in [0, 1].
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_american(price: Column) -> Column:
    """The price as a double, or null where it isn't a whole number of magnitude 100 or more."""
    p = price.cast("double")
    return F.when((p == F.rint(p)) & (F.abs(p) >= 100), p)


def valid_probability(p: Column) -> Column:
    p = p.cast("double")
    return F.when(~F.isnan(p) & p.between(0.0, 1.0), p)


def american_to_decimal(price: Column) -> Column:
    p = valid_american(price)
    return F.when(p < 0, 1.0 + 100.0 / F.abs(p)).otherwise(1.0 + p / 100.0)


def american_to_implied(price: Column) -> Column:
    return 1.0 / american_to_decimal(price)


def decimal_to_implied(decimal_odds: Column) -> Column:
    return F.when(decimal_odds > 1.0, 1.0 / decimal_odds)


def probability_to_american(p: Column) -> Column:
    """Whole American price, halves to even; from 0.5 on the favourite's side."""
    p = valid_probability(p)
    raw = F.when(p >= 0.5, -100.0 * p / (1.0 - p)).otherwise(100.0 * (1.0 - p) / p)
    return F.when((p > 0) & (p < 1), F.rint(raw)).cast("long")


def no_vig(home: Column, away: Column) -> Column:
    """Two-way market without the bookmaker's margin, as a struct."""
    h, a = american_to_implied(home), american_to_implied(away)
    book = h + a
    return F.struct(
        h.alias("raw_home"), a.alias("raw_away"), book.alias("booksum"), (book - 1.0).alias("overround"), ((book - 1.0) / book).alias("vig"),
        (h / book).alias("home"), (a / book).alias("away"),
    )


def edge(model_p: Column, market_p: Column) -> Column:
    return valid_probability(model_p) - valid_probability(market_p)


def expected_value(model_p: Column, price: Column) -> Column:
    """Profit expected per unit staked."""
    p = valid_probability(model_p)
    return p * (american_to_decimal(price) - 1.0) - (1.0 - p)


def side(market: Column, home: Column, away: Column, model_home: Column, which: str) -> Column:
    """One side's view of the model against the market, as a struct."""
    price = home if which == "home" else away
    p = valid_probability(model_home) if which == "home" else 1.0 - valid_probability(model_home)
    return F.struct(
        F.lit(which).alias("side"), price.alias("american"), american_to_decimal(price).alias("decimal"), market[which].alias("market_p"), p.alias("model_p"),
        edge(p, market[which]).alias("edge"), expected_value(p, price).alias("ev"),
    )


def is_pregame(snapshot: Column, prediction: Column, start: Column) -> Column:
    """Snapshot before prediction before start, both strictly."""
    return (snapshot < prediction) & (prediction < start)


def pregame_problem(label: Column, snapshot: Column, prediction: Column, start: Column) -> Column:
    """Why a market can't be used for a live evaluation, or null."""
    return F.when(label == "OPENING", "opening_not_live").when(~F.coalesce(is_pregame(snapshot, prediction, start), F.lit(False)), "not_pregame")


def midpoint_probability(bid: Column, ask: Column) -> Column:
    """Middle of a quote; none for a quote at 0 or 1, where the market is empty."""
    mid = (bid + ask) / 2
    return F.when((mid > 0) & (mid < 1), mid.cast("double"))


def is_play(edge_: Column, least: float = 0.02) -> Column:
    return F.coalesce(F.abs(edge_) >= least, F.lit(False))


def picked_home(edge_: Column, p: Column) -> Column:
    """The side the edge points to; without an edge the likelier one; else home."""
    return F.coalesce(edge_ >= 0, p >= 0.5, F.lit(True))


def model_picks_home(p: Column) -> Column:
    return p >= 0.5


def selected_probability(home_picked: Column, p: Column) -> Column:
    return F.when(home_picked, p).otherwise(1 - p)


def flat_stake_profit(won: Column, price: Column) -> Column:
    return F.when(won, american_to_decimal(price) - 1.0).otherwise(F.lit(-1.0))


#: fixed values
LARGE_EDGE, LOW_EDGE, NEAR_FIFTY, STALE_ODDS_HOURS, STALE_PREDICTION_HOURS, SOON_MINUTES = 0.08, 0.01, (0.48, 0.52), 4, 12, 30


def signal_label(edge_: Column, p: Column) -> Column:
    return (
        F.when(edge_.isNull(), "DATA WARNING").when(F.abs(edge_) >= LARGE_EDGE, "REVIEW LARGE EDGE").when(~is_play(edge_), "NO EDGE")
        .when(picked_home(edge_, p), "VALUE ON HOME").otherwise("VALUE ON AWAY")
    )


def risk_flags(
    now: Column, edge_: Column, p: Column, market_p: Column, home_price: Column, away_price: Column, odds_at: Column, predicted_at: Column, start: Column,
    pending_starter: Column, features_available: Column, complete: Column,
) -> Column:
    """Warnings in a fixed order; missing values can be named twice, for the features and for the record."""
    hours = lambda later, earlier: (later.cast("timestamp").cast("double") - earlier.cast("timestamp").cast("double")) / 3600
    chosen = selected_probability(picked_home(edge_, p), p)
    flags = [
        (home_price.isNull() | away_price.isNull(), "MISSING_ODDS"),
        (hours(now, odds_at) > STALE_ODDS_HOURS, "STALE_ODDS"),
        (hours(now, predicted_at) > STALE_PREDICTION_HOURS, "STALE_PREDICTION"),
        (now >= start, "GAME_ALREADY_STARTED"),
        ((now < start) & (hours(start, now) <= SOON_MINUTES / 60), "GAME_STARTING_SOON"),
        (predicted_at >= start, "DATA WARNING"),
        (chosen.between(*NEAR_FIFTY), "MODEL_PROB_NEAR_50"),
        (F.abs(edge_) < LOW_EDGE, "LOW_EDGE"),
        (F.abs(edge_) >= LARGE_EDGE, "LARGE_MODEL_MARKET_DISAGREEMENT"),
        (~features_available, "MISSING_FEATURE_VALUES"),
        (pending_starter, "UNKNOWN_STARTER_RISK"),
        (~complete | p.isNull() | market_p.isNull() | edge_.isNull(), "MISSING_FEATURE_VALUES"),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in flags)))


def safe_logit(p: Column, eps: float = 1e-12) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))
