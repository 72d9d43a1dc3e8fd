"""Daily access per dataset from the access logs.

The logs are by far the largest input and a popular file or dataset can fill much of them. Each
operator therefore counts log records per join key *before* joining: Spark combines on the map
side, so a hot key reaches the join as one row per day and site instead of one per record.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.days import day_key, epoch_day
from tidemark.functions.metrics import ratio
from tidemark.operators.skew import join_spread


@dataclass(frozen=True)
class Log:
    """Which records of a log count, their columns, and what is summed of those with equal ``keys``."""

    wanted: Callable[[], Column]
    columns: Callable[[], dict[str, Column]]
    keys: tuple[str, ...]
    sums: tuple[str, ...] = ()

    def clean(self, log: DataFrame) -> DataFrame:
        return log.where(self.wanted()).select(*[c.alias(name) for name, c in self.columns().items()])


def _file_read_columns() -> dict[str, Column]:
    crab = F.when(F.col("app_info").contains(":crab:"), F.lit("1")).otherwise(F.lit("0"))
    day = epoch_day(F.col("end_time"), "s")
    return {"file_lfn": F.col("file_lfn"), "day": day, "site_name": F.col("site_name"), "is_crab": crab}


def _transfer_columns() -> dict[str, Column]:
    domain = F.col("client_domain")
    day = epoch_day(F.col("end_time"), "ms")
    return {"file_lfn": F.col("file_lfn"), "day": day, "client_domain": F.when(~domain.endswith("]"), domain)}


def _job_columns() -> dict[str, Column]:
    onsite = F.when(F.col("InputData") == "Onsite", F.col("Site")).otherwise(F.lit("Remote"))
    return {
        "dataset_name": F.col("DESIRED_CMSDataset"),
        "day": epoch_day(F.col("RecordTime"), "ms"),
        "site_name": onsite,
        **{name: F.col(name) for name in ("KEvents", "CMS_SubmissionTool", "InputData")},
    }


LOGS: dict[str, Log] = {
    "cmssw": Log(
        lambda: F.col("file_lfn").startswith("/store/"),
        _file_read_columns,
        ("file_lfn", "day", "site_name", "is_crab"),
    ),
    "xrootd": Log(
        lambda: (F.col("vo") == "cms") & F.col("file_lfn").startswith("/store/"),
        _transfer_columns,
        ("file_lfn", "day", "client_domain"),
    ),
    "classads": Log(
        lambda: F.col("DESIRED_CMSDataset").isNotNull() & (F.col("Status") == "Completed"),
        _job_columns,
        ("dataset_name", "day", "site_name"),
        ("KEvents",),
    ),
}


def clean_file_reads(log: DataFrame) -> DataFrame:
    """File reads: (file_lfn, day, site_name, is_crab) of files under ``/store/``; seconds."""
    return LOGS["cmssw"].clean(log)


def clean_transfers(log: DataFrame) -> DataFrame:
    """Transfers: (file_lfn, day, client_domain) of files under ``/store/`` read by ``vo`` cms;
    milliseconds. A bare address (``...]``) is no domain: NULL.
    """
    return LOGS["xrootd"].clean(log)


def clean_jobs(log: DataFrame) -> DataFrame:
    """Completed jobs that name a dataset: (dataset_name, day, site_name, KEvents,
    CMS_SubmissionTool, InputData); milliseconds. Input that is not known to be on site is
    ``Remote``.
    """
    return LOGS["classads"].clean(log)


def count_lines(lines: DataFrame, source: str) -> DataFrame:
    """Every line of a log of ``source``, counted in one grouping: what is read, and what is broken.

    ``lines`` come from ``read_log_lines``. Rows are (wanted, reason, file, line, the log's keys, n and
    sum_<name> of what it sums). Wanted records are counted by the keys, as ``clean_...`` gives them;
    broken lines by file, line and reason; all others are one row. As each line is in one row,
    ``line_totals`` are exact however often a task is repeated, and the log is parsed once.
    """
    log = LOGS[source]
    broken = F.col("reason").isNotNull()
    wanted = ~broken & F.coalesce(log.wanted(), F.lit(False))
    columns = {name: c for name, c in log.columns().items() if name in log.keys + log.sums}
    rows = lines.select("reason", "file", "line", "data.*").select(
        wanted.alias("wanted"),
        "reason",
        *[F.when(broken, F.col(name)).alias(name) for name in ("file", "line")],
        *[F.when(wanted, c).alias(name) for name, c in columns.items()],
    )
    sums = [F.sum(F.col(name).cast("double")).alias(f"sum_{name}") for name in log.sums]
    return rows.groupBy("wanted", "reason", "file", "line", *log.keys).agg(F.count("*").alias("n"), *sums)


def read_counts(counted: DataFrame, source: str) -> DataFrame:
    """The wanted records of ``count_lines``: the log's keys, n and its sums."""
    log = LOGS[source]
    return counted.where("wanted").select(*log.keys, "n", *[f"sum_{name}" for name in log.sums])


def broken_lines(counted: DataFrame) -> DataFrame:
    """(file, line, reason, n): the broken lines of ``count_lines`` and how often each came."""
    return counted.where(F.col("reason").isNotNull()).select("file", "line", "reason", "n")


def line_totals(counted: DataFrame) -> DataFrame:
    """(lines, broken, counted): how many lines ``count_lines`` saw, found broken, and counted."""
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("lines"),
        F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("n"))), F.lit(0)).alias("broken"),
        F.coalesce(F.sum(F.when(F.col("wanted"), F.col("n"))), F.lit(0)).alias("counted"),
    )


def dataset_totals(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Bytes, files and events of every catalogued dataset that has files."""
    per_dataset = files.groupBy("f_dataset_id").agg(
        F.sum("f_file_size").alias("dsize"),
        F.count("*").alias("nfiles"),
        F.sum("f_event_count").alias("devts"),
    )
    named = catalog.select("d_dataset", "d_dataset_id")
    return per_dataset.join(named, F.col("f_dataset_id") == F.col("d_dataset_id")).select(
        "d_dataset", "d_dataset_id", "dsize", "nfiles", "devts"
    )


def daily_file_access(
    log: DataFrame, files: DataFrame, totals: DataFrame, dims: tuple[str, ...] = ("site_name",)
) -> DataFrame:
    """Bytes and files read per (day, dataset, ``dims``) and the fraction of the dataset they are.

    ``log`` is a cleaned file-level log, ``totals`` comes from ``dataset_totals`` and so limits the
    result to catalogued datasets. A record counts its whole file, however much of it was read.
    """
    reads = log.groupBy("file_lfn", "day", *dims).agg(F.count("*").alias("n"))
    return located_access(reads, files, totals, dims)


def located_access(
    reads: DataFrame,
    files: DataFrame,
    totals: DataFrame,
    dims: tuple[str, ...] = ("site_name",),
    spread: bool = False,
) -> DataFrame:
    """``daily_file_access`` of records that are counted already: (file_lfn, day, ``dims``, n).

    With ``spread``, files that have more than a thousandth of the counts are looked up apart, so
    that a hot file does not fill one bucket of the catalogue; the counts are read three times then
    and should be a stage.
    """
    owners = files.select(
        F.col("f_logical_file_name").alias("file_lfn"), "f_dataset_id", "f_file_size"
    )
    if spread:
        located = join_spread(reads, owners, ["file_lfn"])
    else:
        located = reads.join(owners, "file_lfn")
    # totals are one row for each dataset: hashed, they spare the daily rows a sort in the task that goes on with them
    per_day = located.groupBy("day", "f_dataset_id", *dims).agg(
        F.sum(F.col("f_file_size") * F.col("n")).alias("size_read"),
        F.sum("n").alias("nfiles_read"),
    )
    return per_day.join(
        totals.select("d_dataset_id", "dsize").hint("shuffle_hash"),
        F.col("f_dataset_id") == F.col("d_dataset_id"),
    ).select(
        "d_dataset_id",
        day_key(F.col("day")).alias("day"),
        *dims,
        "nfiles_read",
        "size_read",
        ratio(F.col("size_read"), F.col("dsize")).alias("fract_read"),
    )


def file_read_tally(log: DataFrame, files: DataFrame, totals: DataFrame) -> DataFrame:
    """Stage output of the file-read log.

    Reads by crab and by other jobs stay apart although the flag is not kept: a (dataset, day,
    site) may come twice, and its readers sum it.
    """
    tally = daily_file_access(clean_file_reads(log), files, totals, ("site_name", "is_crab"))
    return tally.drop("is_crab")


def transfer_tally(log: DataFrame, files: DataFrame, totals: DataFrame) -> DataFrame:
    """Stage output of the transfer log, per client domain."""
    return daily_file_access(clean_transfers(log), files, totals, ("client_domain",))


def daily_event_access(jobs: DataFrame, totals: DataFrame) -> DataFrame:
    """Events read per (day, dataset, site) and the fraction of the dataset's events they are.

    ``jobs`` is a cleaned job log and counts thousands of events; one event is added to every
    dataset, which spares empty ones a division by zero. ``totals`` brings name and id of every
    catalogued dataset that has files.
    """
    per_day = jobs.groupBy("dataset_name", "day", "site_name").agg(
        F.sum(F.col("KEvents").cast("double")).alias("sum_evts"), F.count("*").alias("nrecs")
    )
    return named_events(per_day, totals)


def named_events(per_day: DataFrame, totals: DataFrame) -> DataFrame:
    """``daily_event_access`` of records that are counted already: (dataset_name, day, site_name,
    sum_evts, nrecs).
    """
    named = totals.select("d_dataset", "d_dataset_id", "devts").hint("shuffle_hash")
    return per_day.join(named, F.col("dataset_name") == F.col("d_dataset")).select(
        "d_dataset_id",
        day_key(F.col("day")).alias("day"),
        "sum_evts",
        "nrecs",
        "site_name",
        ratio(1000 * F.col("sum_evts"), 1 + F.col("devts")).alias("fract_read"),
    )


def job_tally(log: DataFrame, totals: DataFrame) -> DataFrame:
    """Stage output of the job log, per site."""
    return daily_event_access(clean_jobs(log), totals)


def counted_tally(
    counted: DataFrame, source: str, files: DataFrame, totals: DataFrame, spread: bool = False
) -> DataFrame:
    """Stage output of one source from its ``count_lines``; ``files`` matter to the file logs only."""
    reads = read_counts(counted, source)
    if source == "classads":
        named = {"sum_KEvents": "sum_evts", "n": "nrecs"}
        return named_events(reads.withColumnsRenamed(named), totals)
    tally = located_access(reads, files, totals, LOGS[source].keys[2:], spread)
    return tally.drop("is_crab")
