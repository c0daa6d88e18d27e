"""The registry: name -> (query, SQL). Modules of queries fill it on import."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = " ".join(sql.split("\n")) if "\n" not in sql else sql


def r6(text: str) -> str:
    """Rounded to six decimals, with no negative zero; the same in either engine."""
    return f"(round({text}, 6) + 0.0E0)"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """The same rounding of the named columns (all doubles, if none is named)."""
    names = names or tuple(n for n, t in df.dtypes if t == "double")
    return df.withColumns({n: F.round(F.col(n), 6) + F.lit(0.0) for n in names})
