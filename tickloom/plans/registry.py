"""Where queries and the SQL they are checked against are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.plans.views import view_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Spellings of the checking engine.
_SQL = {
    "k": "CAST(json_extract_string(props, '$.k') AS INT)",
    "list": "list_value",
    "ts": "to_timestamp_utc",
    "bin": "bin",
}


def oracle_view(name: str) -> str:
    sql = view_sql(name, _SQL)
    return sql.replace("to_timestamp_utc(", "make_timestamp(CAST(1000000 AS BIGINT) * ")


def _plain(df: DataFrame) -> DataFrame:
    """Instants without a zone, so that no client shifts them."""
    return df.select(*(
        F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c)
        for c, t in df.dtypes
    ))


def query(name: str, *views: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` may use the named views as tables."""

    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: _plain(fn(spark, sf_dir))
        if oracle is not None:
            shared = ", ".join(f"{v} AS ({oracle_view(v)})" for v in views)
            text = oracle.strip()
            if not shared:
                ORACLES[name] = text
            elif text.upper().startswith("WITH RECURSIVE "):
                ORACLES[name] = f"WITH RECURSIVE {shared}, {text[len('WITH RECURSIVE '):]}"
            elif text.upper().startswith("WITH "):
                ORACLES[name] = f"WITH {shared}, {text[len('WITH '):]}"
            else:
                ORACLES[name] = f"WITH {shared} {text}"
        return fn

    return register
