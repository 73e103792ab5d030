"""What the plans may and may not contain."""

import datetime as dt
import re

import pytest

from tickloom.operators import lookup
from tickloom.plans.catalog import QUERIES
from tickloom.plans.views import table, view


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_pairs(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark, data):
    rows = view(spark, data, "captures", "id", "device_id", "ts", "app")
    text = plan(lookup.captures_by_app(rows, "click"))
    assert "EqualTo(event_type,click)" in text
    assert "TakeOrderedAndProject" in text
    schema = re.search(r"ReadSchema: (\S+)", text).group(1)
    assert "value" not in schema and "props" not in schema
    assert "EqualTo(event_id,7)" in plan(lookup.by_id(rows, 7))
    kept = table(spark, data, "events").select("event_id", "ts")
    stored = kept.withColumnRenamed("event_id", "id")
    text = plan(lookup.captures_between(stored, dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3)))
    assert "GreaterThanOrEqual(ts" in text and "LessThanOrEqual(ts" in text


def test_rows_are_windowed_by_slice(spark, data):
    """Windows over the bare key see one row per slice, not the rows."""
    lines = plan(QUERIES["W6_transitions"](spark, data)).splitlines()
    windows = [
        (i, line.split("], [")[1]) for i, line in enumerate(lines) if " Window [" in line
    ]
    assert any("_slice" in by for _, by in windows)
    bare = [i for i, by in windows if "_slice" not in by]
    assert len(bare) == 1
    assert any("Aggregate" in line for line in lines[bare[0]:])
