"""Tables bucketed by a key whose layout is kept beside their data.

``<path>/manifest`` holds one record of each write: its number and id, the key, the number of buckets, the
schema and the number of rows. The data of a write lie in ``<path>/data-<id>``. A write adds its record last,
so a reader sees the old data or the new, never a part; and as each write has a directory and a table name of
its own, no session goes on reading files that are gone or with the buckets of another write.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of input that a bucket is meant for.
BUCKET_BYTES = 256 << 20
_MANIFEST = "number BIGINT, id STRING, key STRING, buckets INT, schema STRING, row_count BIGINT"


class LayoutError(ValueError):
    """The data at a path are not laid out as the reader takes for granted."""


@dataclass(frozen=True)
class Layout:
    number: int
    id: str
    key: str
    buckets: int
    schema: T.StructType
    rows: int
    path: str

    @property
    def table(self) -> str:
        return f"bucketed_{self.id}"

    @property
    def data(self) -> str:
        return f"{self.path}/data-{self.id}"


def input_bytes(spark: SparkSession, path: str) -> int:
    """Size of all files under ``path``, which may be a glob; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.sum("length")).first()[0] or 0


def buckets_for(size: int, per_bucket: int = BUCKET_BYTES) -> int:
    """Number of buckets for so many bytes: a power of two, as counts that divide each other join unshuffled."""
    return 1 << max(0, -(-size // per_bucket) - 1).bit_length()


def layouts(spark: SparkSession, path: str) -> list[Layout]:
    """All writes recorded at ``path``, the newest first."""
    path = path.rstrip("/")
    manifest = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not manifest.getFileSystem(spark._jsc.hadoopConfiguration()).exists(manifest):
        return []
    records = spark.read.schema(_MANIFEST).json(f"{path}/manifest").collect()
    found = [
        Layout(r["number"], r["id"], r["key"], r["buckets"], T.StructType.fromJson(json.loads(r["schema"])), r["row_count"], path)
        for r in records
    ]
    return sorted(found, key=lambda w: (w.number, w.id), reverse=True)


def write_bucketed_table(df: DataFrame, path: str, key: str, buckets: int) -> Layout:
    """``df`` bucketed and sorted by ``key`` as a new write at ``path``; older ones stay until ``expire``.

    Rows are brought to their bucket first, so that each bucket is one file.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    written = layouts(spark, path)
    layout = Layout(written[0].number + 1 if written else 1, uuid4().hex, key, buckets, df.schema, 0, path)
    (
        df.repartition(buckets, key)
        .write.option("path", layout.data)
        .option("compression", "snappy")
        .bucketBy(buckets, key)
        .sortBy(key)
        .saveAsTable(layout.table)
    )
    rows = spark.read.schema(df.schema).parquet(layout.data).count()
    record = (layout.number, layout.id, key, buckets, df.schema.json(), rows)
    spark.createDataFrame([record], _MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")
    return Layout(*record[:4], df.schema, rows, path)


def current_layout(
    spark: SparkSession, path: str, key: str | None = None, buckets: int | None = None, schema: str | None = None
) -> Layout:
    """The newest write at ``path``; raises LayoutError where it is not as told.

    ``key`` and ``buckets`` have to be those of the write; each column of ``schema`` (DDL) has to be there
    with its type.
    """
    written = layouts(spark, path)
    if not written:
        raise LayoutError(f"{path}: no bucketed table, or one without a manifest")
    layout = written[0]
    if key is not None and key != layout.key:
        raise LayoutError(f"{path}: bucketed by {layout.key}, not by {key}")
    if buckets is not None and buckets != layout.buckets:
        raise LayoutError(f"{path}: written with {layout.buckets} buckets, read with {buckets}")
    if schema is not None:
        there = {f.name: f.dataType for f in layout.schema.fields}
        for field in T.StructType.fromDDL(schema).fields:
            if there.get(field.name) != field.dataType:
                found = there.get(field.name)
                raise LayoutError(f"{path}: {field.name} is {found and found.simpleString()}, not {field.dataType.simpleString()}")
    return layout


def read_bucketed_table(
    spark: SparkSession, path: str, key: str | None = None, buckets: int | None = None, schema: str | None = None
) -> DataFrame:
    """The newest write at ``path``, with its buckets known to the planner; checked like ``current_layout``."""
    layout = current_layout(spark, path, key, buckets, schema)
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in layout.schema.fields)
    location = layout.data.replace("\\", "\\\\").replace("'", "\\'")
    by = _quoted(layout.key)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {layout.table} ({columns}) USING parquet "
        f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {layout.buckets} BUCKETS LOCATION '{location}'"
    )
    return spark.table(layout.table)


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Removes the data of all but the ``keep`` newest writes; their directories.

    Jobs that read an older write fail from then on. Records stay, and tables of removed writes are dropped.
    """
    if keep < 1:
        raise ValueError("the newest write has to stay")
    gone = []
    for layout in layouts(spark, path)[keep:]:
        data = spark._jvm.org.apache.hadoop.fs.Path(layout.data)
        files = data.getFileSystem(spark._jsc.hadoopConfiguration())
        spark.sql(f"DROP TABLE IF EXISTS {layout.table}")
        if files.exists(data):
            files.delete(data, True)
            gone.append(layout.data)
    return gone


def bucket_report(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, n, misplaced, unsorted) of the newest write, one row for each bucket that has rows.

    ``misplaced`` counts rows whose key belongs to another bucket than that of their file, ``unsorted`` the files
    that come on top of a bucket's first one, as only a bucket of one file is read in order.
    """
    layout = current_layout(spark, path)
    name = F.regexp_extract("_metadata.file_name", r"_(\d+)(?:\.[^_]*)$", 1)
    rows = spark.read.schema(layout.schema).parquet(layout.data)
    rows = rows.select(
        name.cast("int").alias("bucket"), F.col("_metadata.file_name").alias("file"), _bucket(layout).alias("own")
    )
    return rows.groupBy("bucket").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("own") != F.col("bucket")).alias("misplaced"),
        (F.count_distinct("file") - 1).alias("unsorted"),
    )


def check_buckets(spark: SparkSession, path: str) -> None:
    """Raises LayoutError where rows of the newest write are lost, doubled or in the wrong bucket."""
    layout = current_layout(spark, path)
    totals = bucket_report(spark, path).agg(F.sum("n"), F.sum("misplaced"), F.max("bucket")).first()
    rows, misplaced, last = (value or 0 for value in totals)
    if rows != layout.rows:
        raise LayoutError(f"{path}: {rows} rows, {layout.rows} written")
    if misplaced or last >= layout.buckets:
        raise LayoutError(f"{path}: {misplaced} rows outside their bucket, buckets up to {last} of {layout.buckets}")


def _bucket(layout: Layout) -> Column:
    """The bucket that a row belongs to."""
    return F.pmod(F.hash(F.col(_quoted(layout.key))), F.lit(layout.buckets))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
