"""Readers. Paths may be Hadoop globs (``2020/01/*``, ``{2019,2020}/*``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.days import date_literal
from tidemark.sources.layouts import layout, log_layout


def read_log(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Nested JSON(.gz) records of one access source, flattened.

    The fixed schema spares the inference pass over the files and lets the parser skip every
    field that is not listed.
    """
    return spark.read.schema(log_layout(source)).json(path).select("data.*")


def read_log_lines(spark: SparkSession, source: str, path: str) -> DataFrame:
    """(file, line, data, reason) of every line of a log that is not blank.

    ``reason`` says what is wrong with a line, and is null for a record: ``malformed`` where it is no
    JSON object or a field has another type than the source's, ``no data`` where the wrapper is empty.
    """
    schema = T.StructType([*log_layout(source).fields, T.StructField("_malformed", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")
    )
    parsed = lines.where("line rlike '[^ \\t\\r]'").withColumn("record", F.from_json("line", schema, options))
    malformed = F.col("record").isNull() | F.col("record._malformed").isNotNull()
    reason = F.when(malformed, "malformed").when(F.col("record.data").isNull(), "no data")
    return parsed.select("file", "line", F.col("record.data").alias("data"), reason.alias("reason"))


def read_csv(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType | None = None,
    header: bool = False,
) -> DataFrame:
    """CSV with the word ``null`` as NULL; a record that does not fit fails the read.

    ``schema`` is a layout name, a ``StructType`` or DDL text; without it all columns are strings.
    """
    reader = spark.read.options(header=header, nullValue="null", mode="FAILFAST")
    if schema is not None:
        if isinstance(schema, str) and " " not in schema.strip():
            schema = layout(schema)
        reader = reader.schema(schema)
    return reader.csv(path)


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_json(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None
) -> DataFrame:
    """JSON lines; the schema is inferred unless given."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def read_snapshots(
    spark: SparkSession, root: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Daily replica snapshots under ``root/time=YYYY-MM-DD``.

    ``time`` is a partition column, so the date bounds prune directories instead of rows.
    """
    snapshots = read_csv(spark, root, _with_snapshot_day("block_replicas"))
    if start is not None:
        snapshots = snapshots.where(F.col("time") >= date_literal(start))
    if end is not None:
        snapshots = snapshots.where(F.col("time") <= date_literal(end))
    return snapshots


def _with_snapshot_day(name: str) -> T.StructType:
    # naming the partition column fixes its type, instead of letting it be guessed from paths
    return T.StructType(layout(name).fields + [T.StructField("time", T.DateType())])


def read_catalog_replicas(spark: SparkSession, path: str, format: str = "avro") -> DataFrame:
    """Replica catalogue files with the path each row came from, as ``filename``.

    ``format="avro"`` needs Spark's Avro module on the classpath; Parquet copies read as well.
    """
    return spark.read.format(format).load(path).withColumn("filename", F.col("_metadata.file_path"))


# One object of strings and whole numbers and nothing after it. Possessive repeats keep a long list
# from recursing.
_OVERRIDES = (
    r'(?s)^\s*+\{\s*+(?:"(?:[^"\\]++|\\.)*+"\s*+:\s*+-?[0-9]++\s*+(?:,\s*+(?=")|(?=\})))*+\}\s*+$'
)


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Rows (dataset_name, value) of hand-kept JSON objects ``{dataset_name: value}``.

    ``path`` may hold several files, each one object. A name given twice keeps its last value, as
    JSON objects do; of two files the later by name wins. A file that is not one whole object of
    whole numbers fails the read; a file of no bytes holds no override.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), "value"
    )
    wrong = F.concat(F.lit("not one JSON object of whole numbers: "), "file")
    checked = F.when(F.col("value").rlike(_OVERRIDES), F.col("value")).otherwise(
        F.raise_error(wrong)
    )
    entries = files.select(
        "file", F.posexplode(F.from_json(checked, "map<string,int>", {"mode": "FAILFAST"}))
    )
    return entries.groupBy(F.col("key").alias("dataset_name")).agg(
        F.max_by("value", F.struct("file", "pos")).alias("value")
    )
