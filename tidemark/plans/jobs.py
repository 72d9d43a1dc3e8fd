"""Whole jobs: each reads source files or earlier stages and writes stages or reports.

Stages live under one root directory (``Stages``); every job replaces what it writes. Jobs share
nothing but files, so each can be rerun alone and a lost executor costs only its own tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.metrics import ROLLING_WINDOWS, WINDOWS
from tidemark.functions.names import input_campaign
from tidemark.operators.access import (
    broken_lines,
    count_lines,
    counted_tally,
    dataset_totals,
    line_totals,
)
from tidemark.operators.constraints import Reference, Unique, violations
from tidemark.operators.histogram import (
    histogram_arrays,
    histogram_from_arrays,
    popularity_histogram,
)
from tidemark.operators.occupancy import daily_size, replica_window_sizes
from tidemark.operators.popularity import (
    apply_overrides,
    override_daily,
    popularity,
    resolve_overrides,
    top_unused,
    unused_by_campaign,
)
from tidemark.operators.reads import merge_reads, read_windows
from tidemark.operators.replicas import (
    catalog_replicas_daily,
    disk_replicas,
    merged_span_states,
    span_state,
    spans_of_state,
    tape_usage,
)
from tidemark.operators.rolling import rolling_popularity
from tidemark.sinks.bucketed import (
    buckets_for,
    check_buckets,
    expire,
    input_bytes,
    read_bucketed_table,
    write_bucketed_table,
)
from tidemark.sinks.writers import (
    stage_label,
    write_csv,
    write_json,
    write_parquet,
    write_single_csv,
    write_sorted_parquet,
)
from tidemark.sources.readers import (
    read_catalog_replicas,
    read_csv,
    read_json,
    read_log_lines,
    read_overrides,
    read_parquet,
    read_snapshots,
)
from tidemark.sources.spine import SPINE_END, SPINE_START

SOURCES = ("cmssw", "xrootd", "classads")


FILE_COLUMNS = (
    "f_logical_file_name STRING, f_dataset_id INT, f_event_count INT, f_file_size DOUBLE"
)


FILE_KEY = "f_logical_file_name"


@dataclass(frozen=True)
class Stages:
    """Directories of the stages and reports under ``root``.

    ``file_buckets`` is the number of buckets of the file catalogue, by file name; by default it
    follows the size of the dump. Jobs take it from the stage, and raise where another is asked for.
    """

    root: str
    file_buckets: int | None = None

    def path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *[p for p in parts if p]])


def load_catalog(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Dataset catalogue dump, with each dataset's input campaign."""
    catalog = read_csv(spark, path, "datasets", header)
    return catalog.withColumn("input_campaign", input_campaign(catalog["d_dataset"]))


def tally_totals(spark: SparkSession, files_path: str, catalog_path: str, stages: Stages) -> None:
    """The file catalogue by file name, and dataset totals, once for all sources and months.

    The dump is parsed and shuffled here only; joins on the file name then take it as it lies. Each
    run is a new write: jobs that still read the one before go on, older ones are removed.
    """
    types = dict(column.split(" ") for column in FILE_COLUMNS.split(", "))
    columns = [f"CAST({name} AS {kind}) AS {name}" for name, kind in types.items()]
    files = read_csv(spark, files_path, "files").selectExpr(*columns)
    buckets = stages.file_buckets or buckets_for(input_bytes(spark, files_path))
    write_bucketed_table(files, stages.path("files"), FILE_KEY, buckets)
    check_buckets(spark, stages.path("files"))
    totals = dataset_totals(load_files(spark, stages), load_catalog(spark, catalog_path))
    write_parquet(totals, stages.path("dataset_totals"))
    expire(spark, stages.path("files"))


def check_catalog(
    spark: SparkSession, catalog_path: str, stages: Stages, tolerated: int = 0, header: bool = False
) -> DataFrame:
    """Names and ids of the catalogue that are not unique, and files of unknown datasets; also written.

    The joins of all jobs take them to be unique. More than ``tolerated`` violating keys raise. Files
    without a dataset are reported only, as totals leave them out anyway.
    """
    catalog, files = load_catalog(spark, catalog_path, header), load_files(spark, stages)
    path = stages.path("key_violations")
    found = violations(
        Unique("dataset names", catalog, ("d_dataset",)),
        Unique("dataset ids", catalog, ("d_dataset_id",)),
        Unique("file names", files, (FILE_KEY,)),
        Reference("owners of files", files, ("f_dataset_id",), catalog, ("d_dataset_id",)),
    )
    write_parquet(found, path)
    report = read_parquet(spark, path)
    keys = report.where("kind != 'missing'").count()
    if keys > tolerated:
        raise ValueError(f"{keys} keys of the catalogue are doubled or null, listed in {path}")
    return report


def load_files(spark: SparkSession, stages: Stages) -> DataFrame:
    """The file catalogue, bucketed and sorted by file name."""
    return read_bucketed_table(
        spark, stages.path("files"), FILE_KEY, stages.file_buckets, FILE_COLUMNS
    )


def tally_access(
    spark: SparkSession,
    source: str,
    log_root: str,
    dates: str,
    stages: Stages,
    log_glob: str = "*.json.gz",
    tolerated: float = 0.01,
) -> str:
    """Daily access of one source for the log directories ``log_root/dates``.

    The log is parsed once, into counts. Broken lines are kept under ``quarantine``; where they are
    more than the share ``tolerated`` of all lines, the job fails before it replaces the tally.
    """
    if source not in SOURCES:
        raise ValueError(f"unknown access source {source!r}, not one of {SOURCES}")
    label = stage_label(dates)
    lines = read_log_lines(spark, source, f"{log_root}/{dates}/{log_glob}")
    counts = stages.path("counts", source, label)
    write_parquet(count_lines(lines, source), counts)
    counted = read_parquet(spark, counts)
    write_parquet(broken_lines(counted), stages.path("quarantine", source, label))
    total, broken, _ = line_totals(counted).first()
    if broken > tolerated * total:
        raise ValueError(
            f"{broken} of {total} lines of {source} {label} are broken, kept in "
            f"{stages.path('quarantine', source, label)}; {tolerated:.2%} are tolerated"
        )
    totals = read_parquet(spark, stages.path("dataset_totals"))
    path = stages.path(source, label)
    write_parquet(counted_tally(counted, source, load_files(spark, stages), totals, True), path)
    return path


def tally_replicas(
    spark: SparkSession,
    snapshot_root: str,
    stages: Stages,
    start: str = "2019-01-01",
    end: str = "2020-12-31",
) -> None:
    """Replica spans from the daily snapshots, and their disk subset.

    The state of the spans is kept, so that ``fold_replicas`` adds later days without reading these.
    """
    state = span_state(read_snapshots(spark, snapshot_root, start, end))
    _write_state(spark, state, stages, date.fromisoformat(end))


def fold_replicas(spark: SparkSession, snapshot_root: str, stages: Stages, day: str | date) -> None:
    """Snapshots of the days after the newest state up to ``day``, added to the spans and their disk subset.

    A rerun for the same day starts from the state before it and gives the same. Snapshots that
    come late, for days that a state already has, need ``tally_replicas``.
    """
    last = date.fromisoformat(day) if isinstance(day, str) else day
    known = [d for d in _state_days(spark, stages) if d < last]
    if not known:
        raise ValueError(f"no state of spans before {last}; run tally_replicas first")
    old = read_parquet(spark, _state_path(stages, max(known)))
    since = (max(known) + timedelta(days=1)).isoformat()
    new = span_state(read_snapshots(spark, snapshot_root, since, last.isoformat()))
    _write_state(spark, merged_span_states(old, new), stages, last)


def _state_path(stages: Stages, through: date) -> str:
    return stages.path("span_state", f"through={through.isoformat()}")


def _state_days(spark: SparkSession, stages: Stages) -> list[date]:
    """Days up to which a state is complete, as the names of its directories tell."""
    root = spark._jvm.org.apache.hadoop.fs.Path(stages.path("span_state"))
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    folders = [status.getPath() for status in files.listStatus(root)]
    done = "_SUCCESS"
    path = spark._jvm.org.apache.hadoop.fs.Path
    return [
        date.fromisoformat(folder.getName().removeprefix("through="))
        for folder in folders
        if folder.getName().startswith("through=") and files.exists(path(folder, done))
    ]


def _write_state(spark: SparkSession, state: DataFrame, stages: Stages, through: date) -> None:
    path = _state_path(stages, through)
    write_parquet(state, path)
    spans = stages.path("replica_spans")
    write_parquet(spans_of_state(read_parquet(spark, path)), spans)
    write_parquet(disk_replicas(read_parquet(spark, spans)), stages.path("disk_replicas"))


def tally_occupancy(
    spark: SparkSession,
    catalog_path: str,
    stages: Stages,
    end_date: str | date = "2021-01-01",
    windows: Sequence[int] = WINDOWS,
    start: str | date = SPINE_START,
    end: str | date = SPINE_END,
) -> None:
    """Window sizes and daily sizes of the disk replicas."""
    catalog = load_catalog(spark, catalog_path)
    replicas = read_parquet(spark, stages.path("disk_replicas"))
    write_parquet(
        replica_window_sizes(replicas, catalog, end_date, windows), stages.path("replica_windows")
    )
    write_sorted_parquet(
        daily_size(replicas, catalog, start, end),
        stages.path("replica_daily"),
        "date",
        "dataset_id",
    )


def report_tape(
    spark: SparkSession, stages: Stages, active_since: str | date | None = None
) -> None:
    spans = read_parquet(spark, stages.path("replica_spans"))
    write_csv(tape_usage(spans, active_since), stages.path("tape_usage"))


def tally_overrides(
    spark: SparkSession, overrides_path: str, catalog_path: str, stages: Stages
) -> None:
    overrides = resolve_overrides(
        read_overrides(spark, overrides_path), load_catalog(spark, catalog_path)
    )
    write_csv(overrides, stages.path("overrides"))


def merge_access(
    spark: SparkSession,
    stages: Stages,
    dates: str = "{2019,2020}/*",
    end_date: str | date = "2020-11-24",
    windows: Sequence[int] = WINDOWS,
) -> None:
    """Merged reads of all sources, and read bins over trailing windows."""
    daily = [read_parquet(spark, stages.path(source, dates)) for source in SOURCES]
    write_parquet(merge_reads(*daily), stages.path("merged_reads"))
    merged = read_parquet(spark, stages.path("merged_reads"))
    write_parquet(read_windows(merged, end_date, windows), stages.path("read_windows"))


def report_popularity(
    spark: SparkSession,
    catalog_path: str,
    stages: Stages,
    windows: Sequence[int] = WINDOWS,
    unused_window: int = 180,
    k: int = 5000,
) -> None:
    """Largest unused datasets, and the popularity histogram as JSON arrays and as CSV rows."""
    pop = apply_overrides(
        popularity(
            read_parquet(spark, stages.path("replica_windows")),
            read_parquet(spark, stages.path("read_windows")),
            windows,
        ),
        _load_overrides(spark, stages),
        windows,
    )
    # both reports start from it
    write_parquet(pop, stages.path("popularity"))
    pop = read_parquet(spark, stages.path("popularity"))
    unused = top_unused(pop, load_catalog(spark, catalog_path), unused_window, k, windows)
    write_csv(unused, stages.path("top_unused"))
    arrays = histogram_arrays(popularity_histogram(pop, windows), windows)
    write_json(arrays, stages.path("popularity_arrays"))
    arrays = read_json(spark, stages.path("popularity_arrays"), arrays.schema)
    write_csv(histogram_from_arrays(arrays), stages.path("popularity_histogram"))


def report_unused_campaigns(
    spark: SparkSession, stages: Stages, windows: Sequence[int] = WINDOWS
) -> DataFrame:
    """Unused terabytes per campaign, over the longest window of the unused report; also written."""
    sizes = ", ".join(f"allSize{window} DOUBLE" for window in windows)
    unused = read_csv(spark, stages.path("top_unused"), f"d_dataset STRING, {sizes}", header=True)
    report = unused_by_campaign(unused, f"allSize{max(windows)}")
    write_csv(report, stages.path("unused_by_campaign"))
    return read_csv(spark, stages.path("unused_by_campaign"), report.schema, header=True)


def report_rolling(
    spark: SparkSession,
    stages: Stages,
    windows: Sequence[int] = ROLLING_WINDOWS,
    start: str | date = SPINE_START,
    end: str | date = SPINE_END,
) -> None:
    """Rolling popularity, one CSV file per window.

    All windows are computed at once and kept as a stage; the exports read it back.
    """
    rolling = rolling_popularity(
        read_parquet(spark, stages.path("merged_reads")),
        read_parquet(spark, stages.path("replica_daily")),
        windows,
        start,
        end,
    )
    write_parquet(rolling, stages.path("rolling_windows"))
    written = read_parquet(spark, stages.path("rolling_windows"))
    for window in windows:
        rows = written.where(written["window"] == window).select("date", "fraction", "size")
        write_single_csv(rows, stages.path("rolling_popularity", str(window)))


def report_override_daily(spark: SparkSession, stages: Stages) -> None:
    daily = read_parquet(spark, stages.path("replica_daily"))
    write_single_csv(
        override_daily(daily, _load_overrides(spark, stages)), stages.path("overrides_daily")
    )


def tally_catalog_replicas(
    spark: SparkSession,
    replicas_root: str,
    dates: str,
    stages: Stages,
    pattern: str = "replicas/part*.avro",
    format: str = "avro",
) -> str:
    """Daily bytes per RSE from the newer replica catalogue under ``replicas_root/<date>``.

    Needs the file catalogue that ``tally_totals`` stages.
    """
    replicas = read_catalog_replicas(spark, f"{replicas_root}/{dates}/{pattern}", format)
    tally = catalog_replicas_daily(replicas, load_files(spark, stages))
    path = stages.path("catalog_replicas", stage_label(dates, "-"))
    write_parquet(tally, path)
    return path


def _load_overrides(spark: SparkSession, stages: Stages) -> DataFrame:
    return read_csv(spark, stages.path("overrides"), "d_dataset_id INT, value INT", header=True)
