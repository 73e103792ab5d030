"""Stored tables: reading, appending, and keeping bad rows apart."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tickloom import schemas, settings as S
from tickloom.session import write_and_reread

CORRUPT = "_corrupt_record"


def read_captures_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Captures from JSON lines; blank lines are skipped, and lines that do not
    parse come back as rows with ``_corrupt_record`` set."""
    schema = T.StructType([*schemas.CAPTURE.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def quarantine(df: DataFrame) -> DataFrame:
    """Turn rows that failed to read into marked rows instead of failing."""
    failed = F.col(CORRUPT).isNotNull()
    replaced = {
        "app": F.lit(S.ERROR_APP),
        "title": F.lit(""),
        "text": F.concat(F.lit("capture failed: "), F.col(CORRUPT)),
        "pid": F.lit(-1),
    }
    return df.select(*(
        F.when(failed, replaced[c]).otherwise(F.col(c)).alias(c) if c in replaced else F.col(c)
        for c in df.columns if c != CORRUPT
    ))


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table that this module has written, with its fixed shape and its ``date``;
    columns missing in old files are NULL. Filters on ``date`` read those days only."""
    schema = schemas.TABLES[name]
    dated = T.StructType([*schema.fields, T.StructField("date", T.DateType())])
    return spark.read.schema(dated).parquet(path).select(*schema.names, "date")


def align_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the given shape: missing columns NULL, others cast, extra dropped."""
    return df.select(*(
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ))


def fill_captures(df: DataFrame) -> DataFrame:
    """Captures with every column; flags default to false."""
    full = align_schema(df, schemas.CAPTURE)
    return full.withColumns({
        "idle": F.coalesce("idle", F.lit(False)),
        "transition": F.coalesce("transition", F.lit(False)),
    })


def with_id(df: DataFrame) -> DataFrame:
    """Fill missing ids with a stable hash of the row: the same row gets the
    same id on every attempt, and no global numbering is needed. Names and NULLs
    are part of what is hashed, so that no value can stand for another column's."""
    others = F.to_json(F.struct(*(c for c in df.columns if c != "id")), {"ignoreNullFields": "false"})
    return df.withColumn("id", F.coalesce("id", F.xxhash64(others)))


def split_required(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by the columns the table may not have NULL."""
    complete = reduce(and_, [F.col(c).isNotNull() for c in schemas.REQUIRED[name]])
    return df.filter(complete), df.filter(~complete)


#: Batch of rows that were appended without a name.
UNNAMED = "rows"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _not_stored(rows: DataFrame, path: str, name: str) -> DataFrame:
    """``rows`` that the table lacks. Reads id, time and device of the days concerned."""
    spark = rows.sparkSession
    if not _exists(spark, path):
        return rows
    rows = write_and_reread(rows)
    days = rows.agg(F.min("date").alias("first"), F.max("date").alias("last")).first()
    if days["first"] is None:
        return rows
    same = ["id", schemas.TIME_COLUMN[name], *(c for c in ["device_id"] if c in rows.columns)]
    there = read_table(spark, path, name).where(F.col("date").between(F.lit(days["first"]), F.lit(days["last"])))
    there = there.select("date", *same).toDF("_date", *(f"_{c}" for c in same))
    match = reduce(and_, [rows[c].eqNullSafe(there[f"_{c}"]) for c in ["date", *same]])
    return rows.join(there, match, "left_anti")


def _append(df: DataFrame, path: str, name: str, batch: str | None = None) -> DataFrame:
    """Append rows by date; returns the rejected ones. To append again adds nothing.

    With a ``batch`` name the rows are the content of that batch in each of their days,
    and replace what a run before this one has left of it: nothing else is read. Without,
    rows that are there already, by id, time and device, are left out.
    """
    accepted, rejected = split_required(with_id(df), name)
    dated = accepted.withColumn("date", F.to_date(schemas.TIME_COLUMN[name]))
    if batch is None:
        dated = _not_stored(dated, path, name)
    elif batch == UNNAMED:
        raise ValueError(f"{UNNAMED!r} holds the rows without a batch; take another name")
    # Rebalancing packs each day into files of the advised size: small days into
    # one file, crowded days into several.
    (
        dated.withColumn("batch", F.lit(batch or UNNAMED)).hint("rebalance", F.col("date"))
        .write.mode("append" if batch is None else "overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(path)
    )
    return rejected


def write_captures(df: DataFrame, path: str, batch: str | None = None) -> DataFrame:
    """Append captures by date; returns the rejected rows."""
    return _append(fill_captures(df), path, "captures", batch)


def write_layout(df: DataFrame, path: str, batch: str | None = None) -> DataFrame:
    """Append layout snapshots by date; returns the rejected rows."""
    return _append(align_schema(df, schemas.LAYOUT), path, "layout", batch)


def write_sessions(df: DataFrame, path: str, batch: str | None = None) -> DataFrame:
    """Append sessions by start date; returns the rejected rows."""
    return _append(align_schema(df, schemas.SESSION), path, "sessions", batch)


def split_known_sessions(
    summaries: DataFrame, sessions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by whether the session of a summary exists."""
    known = sessions.select(F.col("id").alias("session_id"))
    return (
        summaries.join(known, "session_id", "left_semi").select(*summaries.columns),
        summaries.join(known, "session_id", "left_anti").select(*summaries.columns),
    )


def write_summaries(
    df: DataFrame, sessions: DataFrame, path: str, batch: str | None = None
) -> DataFrame:
    """Append summaries of known sessions; returns the rejected rows."""
    known, unknown = split_known_sessions(align_schema(df, schemas.SUMMARY), sessions)
    return _append(known, path, "session_summaries", batch).unionByName(with_id(unknown))


def to_json_records(df: DataFrame, *beside: str) -> DataFrame:
    """Each row as one JSON record, NULL fields included, non-ASCII as it is.
    ``beside`` names columns to have next to the record as well."""
    record = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return df.select(*beside, record.alias("record"))
