"""Lists of names as tables: for lists too long to stand in a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def listed(df: DataFrame, value: Column, names: DataFrame, flag: str) -> DataFrame:
    """``df`` with the boolean ``flag``: ``value`` is in the one column of ``names``.

    Repeats and NULLs in the list count for nothing. Spark broadcasts the list if its size
    is below the session's limit and otherwise joins by value, where it can split a value
    that very many rows have.
    """
    name = F.col(names.columns[0])
    known = names.select(name.alias("_listed")).where("_listed IS NOT NULL").distinct()
    return (
        df.withColumn("_value", value)
        .join(known, F.col("_value") == F.col("_listed"), "left")
        .withColumn(flag, F.col("_listed").isNotNull())
        .drop("_value", "_listed")
    )


def only_listed(df: DataFrame, value: Column, names: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``value`` is in the one column of ``names``."""
    known = names.select(F.col(names.columns[0]).alias("_listed"))
    return df.withColumn("_value", value).join(
        known, F.col("_value") == F.col("_listed"), "left_semi").drop("_value")
