"""Computing costly columns once."""

from pyspark.sql import Column, DataFrame, functions as F


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A filter on a projected column is otherwise pushed below the projection
    with the whole expression copied into it, at every mention. Filters on
    other columns still reach the scan.
    """
    return df.select(
        "*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    )
