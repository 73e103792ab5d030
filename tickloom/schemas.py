"""Row shapes. Every table carries ``device_id`` so that many devices share it."""

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(),
    "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


def flat(columns: str) -> T.StructType:
    """``"a long, b string"`` as a schema, without a running session."""
    return T.StructType([
        T.StructField(name, _TYPES[kind])
        for name, kind in (part.split() for part in columns.split(","))
    ])


BOUNDS = T.StructType([
    T.StructField("X", T.IntegerType()),
    T.StructField("Y", T.IntegerType()),
    T.StructField("Width", T.IntegerType()),
    T.StructField("Height", T.IntegerType()),
])

PANE = T.StructType([
    T.StructField("window_id", T.LongType()),
    T.StructField("app", T.StringType()),
    T.StructField("pid", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("bounds", BOUNDS),
])

CAPTURE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("device_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("app", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("text_raw", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("idle_s", T.DoubleType()),
    T.StructField("idle", T.BooleanType()),
    T.StructField("filtered", T.StringType()),
    T.StructField("transition", T.BooleanType()),
    T.StructField("pid", T.IntegerType()),
    T.StructField("window_id", T.LongType()),
])

LAYOUT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("device_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("panes", T.ArrayType(PANE)),
])

SESSION = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("device_id", T.LongType()),
    T.StructField("start_ts", T.TimestampType()),
    T.StructField("end_ts", T.TimestampType()),
    T.StructField("app", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("capture_count", T.IntegerType()),
    T.StructField("duration_s", T.DoubleType()),
])

SUMMARY = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("device_id", T.LongType()),
    T.StructField("session_id", T.LongType()),
    T.StructField("summary", T.StringType()),
    T.StructField("summary_json", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("tokens", T.IntegerType()),
    T.StructField("created_ts", T.TimestampType()),
])

EVENT = T.StructType([
    T.StructField("device_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("source", T.StringType()),
    T.StructField("bucket", T.StringType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("data", T.StringType()),
])

NODE = T.StructType([
    T.StructField("tree_id", T.LongType()),
    T.StructField("node_id", T.LongType()),
    T.StructField("parent_id", T.LongType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("preorder", T.LongType()),
    T.StructField("path", T.ArrayType(T.LongType())),
    T.StructField("role", T.StringType()),
    T.StructField("subrole", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("descr", T.StringType()),
])

TABLES = {
    "captures": CAPTURE,
    "layout": LAYOUT,
    "sessions": SESSION,
    "session_summaries": SUMMARY,
}

# Columns a stored row must have, by table.
REQUIRED = {
    "captures": ["ts", "app", "title"],
    "layout": ["ts", "panes"],
    "sessions": ["start_ts", "end_ts", "app"],
    "session_summaries": ["session_id", "summary", "created_ts"],
}

# Time column that dates a stored row, by table.
TIME_COLUMN = {
    "captures": "ts",
    "layout": "ts",
    "sessions": "start_ts",
    "session_summaries": "created_ts",
}
