"""Replica lifetimes: from daily snapshots to spans, disk subset, tape usage."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.days import as_date, date_literal, day_key, epoch_day
from tidemark.functions.names import tally_day_of_path, tape_campaign, tier
from tidemark.operators.skew import join_spread


#: What makes a block replica; a state has one row for each.
SPAN_KEYS = (
    "block_id",
    "replica_time_create",
    "node_name",
    "br_user_group_id",
    "dataset_name",
    "dataset_id",
)


def span_state(snapshots: DataFrame) -> DataFrame:
    """First and last second, and sum and number of sizes, of every block replica in ``snapshots``.

    States of different days are put together by ``merged_span_states``, without reading the
    snapshots again. Snapshots collapse on the map side as far as a task reads several days.
    """
    return snapshots.groupBy(*SPAN_KEYS).agg(
        F.min("now_sec").alias("first_sec"),
        F.max("now_sec").alias("last_sec"),
        F.sum(F.col("block_bytes").cast("double")).alias("bytes_sum"),
        F.count("block_bytes").alias("bytes_count"),
    )


def merged_span_states(*states: DataFrame) -> DataFrame:
    """One state of several, which must not share a snapshot."""
    union = reduce(DataFrame.unionByName, states)
    return union.groupBy(*SPAN_KEYS).agg(
        F.min("first_sec").alias("first_sec"),
        F.max("last_sec").alias("last_sec"),
        F.sum("bytes_sum").alias("bytes_sum"),
        F.sum("bytes_count").alias("bytes_count"),
    )


def spans_of_state(state: DataFrame) -> DataFrame:
    """First and last snapshot day and mean size of every block replica, summed per dataset."""
    mean = F.when(F.col("bytes_count") > 0, F.col("bytes_sum") / F.col("bytes_count"))
    blocks = state.select(
        "dataset_name",
        "dataset_id",
        epoch_day(F.col("replica_time_create")).alias("create_day"),
        "node_name",
        epoch_day(F.col("first_sec")).alias("first_day"),
        epoch_day(F.col("last_sec")).alias("last_day"),
        "br_user_group_id",
        mean.alias("block_size"),
    )
    return (
        blocks.groupBy(*[name for name in blocks.columns if name != "block_size"])
        .agg(F.sum("block_size").alias("rep_size"))
        .select(
            "dataset_name",
            "dataset_id",
            day_key(F.col("create_day")).alias("replica_time_create"),
            "node_name",
            "rep_size",
            day_key(F.col("first_day")).alias("min_time"),
            day_key(F.col("last_day")).alias("max_time"),
            "br_user_group_id",
        )
    )


def replica_spans(snapshots: DataFrame) -> DataFrame:
    """First and last snapshot day and mean size of every block replica, summed per dataset.

    Days on which a replica was missing between its first and last snapshot are ignored.
    """
    return spans_of_state(span_state(snapshots))


def is_disk_node(node: Column) -> Column:
    """Disk at a tier 0 to 2 site; NULL for a NULL node, which a filter drops."""
    elsewhere = node.startswith("T3") | node.startswith("X")
    not_disk = node.endswith("Buffer") | node.endswith("MSS") | node.endswith("Export")
    return ~(elsewhere | not_disk)


def disk_replicas(spans: DataFrame) -> DataFrame:
    """Spans on disk nodes, with ``min_time`` and ``max_time`` as dates."""
    return spans.where(is_disk_node(F.col("node_name"))).withColumns(
        {name: as_date(spans, name) for name in ("min_time", "max_time")}
    )


def catalogued(replicas: DataFrame, catalog: DataFrame) -> DataFrame:
    """Replicas of catalogued datasets, with the catalogue's id in place of the snapshot's own.

    For replica-level checks. Operators that aggregate look the id up after grouping instead, so
    that a dataset with very many replicas reaches the join as few rows.
    """
    ids = catalog.select(F.col("d_dataset"), F.col("d_dataset_id").alias("dataset_id"))
    return (
        replicas.drop("dataset_id")
        .join(ids, F.col("dataset_name") == F.col("d_dataset"))
        .drop("d_dataset")
    )


def tape_usage(spans: DataFrame, active_since: str | date | None = None) -> DataFrame:
    """Bytes on tape per (tier, input campaign).

    ``active_since`` keeps replicas last seen after that day; by default any last day counts.
    """
    last_day = as_date(spans, "max_time")
    active = last_day.isNotNull() if active_since is None else last_day > date_literal(active_since)
    name = F.col("dataset_name")
    on_tape = spans.where(F.col("node_name").endswith("MSS") & active)
    return on_tape.groupBy(
        tier(name).alias("tier"), tape_campaign(name).alias("input_campaign")
    ).agg(F.sum(_number(spans, "rep_size")).alias("size"))


def catalog_replicas_daily(
    replicas: DataFrame, files: DataFrame, spread: bool = False
) -> DataFrame:
    """Bytes per (RSE, dataset, scope, tally day, create day) of the newer replica catalogue.

    ``filename`` names the tally day; ``CREATED_AT`` is in milliseconds. Replicas go straight into
    the join on the file name: a file has one row per RSE, scope and day, so that grouping them
    first would shuffle the largest input once more and merge nothing. Where a name may have many
    more rows than that, ``spread`` looks hot names up apart, for one more grouping of the names.
    """
    named = replicas.select(
        "NAME",
        "RSE_ID",
        "SCOPE",
        tally_day_of_path(F.col("filename")).alias("tally"),
        epoch_day(F.col("CREATED_AT"), "ms").alias("created"),
        "BYTES",
    )
    owners = files.select(F.col("f_logical_file_name").alias("NAME"), "f_dataset_id")
    located = join_spread(named, owners, ["NAME"]) if spread else named.join(owners, "NAME")
    return (
        located.groupBy("RSE_ID", "f_dataset_id", "SCOPE", "tally", "created")
        .agg(F.sum("BYTES").alias("rep_size"))
        .select(
            "RSE_ID",
            "f_dataset_id",
            "SCOPE",
            day_key(F.col("tally")).alias("tally_day"),
            day_key(F.col("created")).alias("create_day"),
            "rep_size",
        )
    )


def _number(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    return column.cast("double") if isinstance(df.schema[name].dataType, T.StringType) else column
