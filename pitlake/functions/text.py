"""Names, instants and strings."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def normal_name(x: Column) -> Column:
    """Trimmed, lower case."""
    return F.lower(F.trim(x))


def plain_name(x: Column) -> Column:
    """Lower case without dots, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[.]", ""), r"\s+", " "))


@F.pandas_udf(StringType())
def folded_name(x: pd.Series) -> pd.Series:
    """Compatibility form without accents and dots, case folded, white space collapsed: no built-in function folds case or decomposes."""

    def fold(s: str | None) -> str | None:
        if s is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
        return " ".join(plain.replace(".", "").casefold().split())

    return x.map(fold)


def words_within(a: Column, b: Column) -> Column:
    """Whether all words of a name occur in another one."""
    x, y = F.filter(F.split(a, " "), lambda w: w != ""), F.split(b, " ")
    return (F.size(x) > 0) & (F.size(F.array_except(x, y)) == 0)


def parsed_instant(x: Column) -> Column:
    """ISO text (Z or offset, naive is UTC) to an instant, null where it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(x, "Z$", "+00:00"))


def lenient_double(x: Column, kind: str) -> Column:
    """Booleans to 0 or 1, numbers to double, everything else null; kind is the column's type."""
    if kind == "boolean":
        return F.when(x, 1.0).when(~x, 0.0)
    return x.cast("double") if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal") else F.lit(None).cast("double")


def signed_points(x: Column) -> Column:
    return F.format_string("%+.1f pp", F.floor(F.round(x * 1000, 6) + 0.5) / 10)


def pacific(ts: Column) -> Column:
    """yyyy-MM-dd HH:mm with PST or PDT."""
    local = F.from_utc_timestamp(ts, "America/Los_Angeles")
    summer = (ts.cast("timestamp").cast("double") - local.cast("timestamp").cast("double")) < 8 * 3600
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm"), F.when(summer, " PDT").otherwise(" PST"))


#: fixed values: how far along a game is
LIFECYCLE = {"C": 0, "D": 0, "U": 0, "T": 0, "S": 1, "P": 2, "I": 3, "M": 3, "O": 4, "F": 5}


def lifecycle_rank(code: Column, ranks: dict[str, int] | None = None, other: int = 1) -> Column:
    pairs = [F.lit(x) for p in (ranks or LIFECYCLE).items() for x in p]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(other))


def bucket(x: Column, specs: list[tuple[str, float, float | None]]) -> Column:
    """Label of the half-open interval that holds x; intervals adjoin, the last one may be open. x is evaluated once."""
    edges = [s[1] for s in specs] + ([specs[-1][2]] if specs[-1][2] is not None else [])
    reached = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: x >= e))
    return F.get(F.array(*(F.lit(s[0]) for s in specs)), F.when(x.isNotNull(), reached - 1))


def digitised(x: Column, edges: list[float]) -> Column:
    """How many of the inner edges x reaches, by comparison with the edges themselves and not by division."""
    return sum(((x >= e).cast("int") for e in edges[1:]), (x >= edges[0]).cast("int"))
