"""Registered queries: name -> function of (session, table directory)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import (
    END_DATE,
    EVENT_END_DATE,
    EVENT_SPINE,
    SPINE,
    YOUNG_END_DATE,
    Fixtures,
)
from tidemark.functions import names
from tidemark.functions.days import day_key, epoch_day
from tidemark.functions.metrics import READ_METRICS, SIZE_METRICS, read_bin, windowed
from tidemark.operators import (
    access,
    compaction,
    constraints,
    histogram,
    intervals,
    occupancy,
    popularity,
    profile,
    quality,
    reads,
    replicas,
    rolling,
)
from tidemark.plans.jobs import SOURCES, Stages
from tidemark.plans.refresh import refresh_merged
from tidemark.plans.session import shared_dir
from tidemark.sinks.bucketed import (
    bucket_report,
    buckets_for,
    check_buckets,
    input_bytes,
    read_bucketed_table,
    write_bucketed_table,
)
from tidemark.sinks.writers import (
    write_by_month,
    write_csv,
    write_json,
    write_parquet,
    write_single_csv,
    write_sorted_parquet,
)
from tidemark.sources.layouts import layout
from tidemark.sources.readers import (
    read_catalog_replicas,
    read_csv,
    read_json,
    read_log,
    read_log_lines,
    read_overrides,
    read_parquet,
    read_snapshots,
)
from tidemark.sources.spine import spine_over

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Bytes of the line items for which the file catalogue is written in 3 and in 8 buckets, as one task sorts a bucket.
BUCKET_INPUT = 64 << 20

_BIN_COLUMNS = [str(i) for i in range(16)]


def query(build: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Fixtures(spark, sf_dir))
    return build


def typed(df: DataFrame, **types: str) -> DataFrame:
    """The named columns in order, each cast: both engines then agree on result types."""
    return df.selectExpr(*[f"CAST(`{name}` AS {kind}) AS `{name}`" for name, kind in types.items()])


# ---- access ----------------------------------------------------------------------------------


def _file_tally(df: DataFrame, dim: str) -> DataFrame:
    return typed(
        df,
        d_dataset_id="bigint",
        day="string",
        **{dim: "string"},
        nfiles_read="bigint",
        size_read="double",
        fract_read="double",
    )


def _totals(fx: Fixtures) -> DataFrame:
    return access.dataset_totals(fx.files(), fx.catalog())


@query
def dataset_totals(fx: Fixtures) -> DataFrame:
    return typed(
        _totals(fx),
        d_dataset="string",
        d_dataset_id="bigint",
        dsize="double",
        nfiles="bigint",
        devts="bigint",
    )


@query
def daily_access(fx: Fixtures) -> DataFrame:
    tally = access.file_read_tally(fx.file_read_log(), fx.files(), _totals(fx))
    return _file_tally(tally, "site_name")


@query
def daily_access_domains(fx: Fixtures) -> DataFrame:
    tally = access.transfer_tally(fx.transfer_log(), fx.files(), _totals(fx))
    return _file_tally(tally, "client_domain")


@query
def daily_access_events(fx: Fixtures) -> DataFrame:
    return typed(
        access.job_tally(fx.job_log(), _totals(fx)),
        d_dataset_id="bigint",
        day="string",
        sum_evts="double",
        nrecs="bigint",
        site_name="string",
        fract_read="double",
    )


def _stored_log(fx: Fixtures, source: str, log: DataFrame) -> DataFrame:
    """The log as compressed nested JSON on disk, read back."""
    path = shared_dir(fx.spark, "log")
    log.select(F.struct(*log.columns).alias("data")).write.json(path, compression="gzip")
    return read_log(fx.spark, source, f"{path}/*.json.gz")


@query
def daily_access_from_json(fx: Fixtures) -> DataFrame:
    """The file-read tally from compressed JSON logs on disk."""
    log = _stored_log(fx, "cmssw", fx.file_read_log())
    return _file_tally(access.file_read_tally(log, fx.files(), _totals(fx)), "site_name")


@query
def daily_access_domains_from_json(fx: Fixtures) -> DataFrame:
    """The transfer tally from JSON logs: epochs in milliseconds, missing domains."""
    log = _stored_log(fx, "xrootd", fx.transfer_log())
    return _file_tally(access.transfer_tally(log, fx.files(), _totals(fx)), "client_domain")


@query
def daily_access_events_from_json(fx: Fixtures) -> DataFrame:
    """The job tally from JSON logs: thousands of events as FLOAT."""
    log = _stored_log(fx, "classads", fx.job_log())
    return typed(
        access.job_tally(log, _totals(fx)),
        d_dataset_id="bigint",
        day="string",
        sum_evts="double",
        nrecs="bigint",
        site_name="string",
        fract_read="double",
    )


@query
def daily_access_hot_file(fx: Fixtures) -> DataFrame:
    """The tally of a log with one hot file, looked up apart from the others."""
    path = shared_dir(fx.spark, "counts")
    dims = ("site_name", "is_crab")
    reads = access.clean_file_reads(fx.hot_file_log()).groupBy("file_lfn", "day", *dims)
    write_parquet(reads.agg(F.count("*").alias("n")), path)
    counted = read_parquet(fx.spark, path)
    return _file_tally(access.located_access(counted, fx.files(), _totals(fx), dims, True), "site_name")


def _spoilt_counts(fx: Fixtures) -> DataFrame:
    """A log with broken lines, stored, and counted line by line into a stage."""
    root = shared_dir(fx.spark, "spoilt")
    fx.spoilt_lines().write.text(f"{root}/log", compression="gzip")
    lines = read_log_lines(fx.spark, "cmssw", f"{root}/log/*.gz")
    write_parquet(access.count_lines(lines, "cmssw"), f"{root}/counts")
    return read_parquet(fx.spark, f"{root}/counts")


@query
def daily_access_quarantined(fx: Fixtures) -> DataFrame:
    """The tally of the good lines of a log that has broken ones."""
    tally = access.counted_tally(_spoilt_counts(fx), "cmssw", fx.files(), _totals(fx), True)
    return _file_tally(tally, "site_name")


@query
def quarantined_lines(fx: Fixtures) -> DataFrame:
    """The broken lines by what is wrong with them."""
    broken = access.broken_lines(_spoilt_counts(fx))
    return typed(
        broken.groupBy("reason").agg(F.sum("n").alias("n"), F.count_distinct("line").alias("texts")),
        reason="string",
        n="bigint",
        texts="bigint",
    )


@query
def log_line_totals(fx: Fixtures) -> DataFrame:
    """How many lines of a log with broken ones were seen, found broken, and counted."""
    totals = access.line_totals(_spoilt_counts(fx))
    return typed(totals, lines="bigint", broken="bigint", counted="bigint")


def _bucketed_files(fx: Fixtures) -> tuple[str, int]:
    """The file catalogue bucketed twice at one path, with another number of buckets each time: 3, then 8,
    and as many times more as the table is larger than BUCKET_INPUT. Gives the path and the last number.
    """
    path = shared_dir(fx.spark, "bucketed")
    more = buckets_for(input_bytes(fx.spark, f"{fx.sf_dir}/lineitem.parquet"), BUCKET_INPUT)
    for buckets in (3 * more, 8 * more):
        write_bucketed_table(fx.files(), path, "f_logical_file_name", buckets)
    check_buckets(fx.spark, path)
    return path, buckets


@query
def dataset_totals_bucketed(fx: Fixtures) -> DataFrame:
    """Dataset totals from the catalogue as it was written last."""
    path, buckets = _bucketed_files(fx)
    files = read_bucketed_table(fx.spark, path, "f_logical_file_name", buckets)
    return typed(
        access.dataset_totals(files, fx.catalog()),
        d_dataset="string",
        d_dataset_id="bigint",
        dsize="double",
        nfiles="bigint",
        devts="bigint",
    )


@query
def bucket_layout(fx: Fixtures) -> DataFrame:
    """Rows of the bucketed catalogue, those outside their bucket, and files beyond one a bucket."""
    report = bucket_report(fx.spark, _bucketed_files(fx)[0])
    sums = report.agg(*[F.sum(name).alias(name) for name in ("n", "misplaced", "unsorted")])
    return typed(sums, n="bigint", misplaced="bigint", unsorted="bigint")


@query
def dataset_totals_from_csv(fx: Fixtures) -> DataFrame:
    """Dataset totals from headerless catalogue dumps on disk."""
    root = shared_dir(fx.spark, "catalog")
    for name, df in (("files", fx.files()), ("datasets", fx.catalog())):
        fields = [
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in layout(name).fields
        ]
        df.select(*fields).write.csv(f"{root}/{name}", nullValue="null")
    files = read_csv(fx.spark, f"{root}/files", "files")
    totals = access.dataset_totals(files, read_csv(fx.spark, f"{root}/datasets", "datasets"))
    return typed(
        totals.withColumn("dsize", F.round("dsize", 2)),
        d_dataset="string",
        d_dataset_id="bigint",
        dsize="double",
        nfiles="bigint",
        devts="bigint",
    )


# ---- replicas --------------------------------------------------------------------------------


def _spans(df: DataFrame) -> DataFrame:
    return typed(
        df.withColumn("rep_size", F.round("rep_size", 6)),
        dataset_name="string",
        dataset_id="int",
        replica_time_create="string",
        node_name="string",
        rep_size="double",
        min_time="string",
        max_time="string",
        br_user_group_id="int",
    )


@query
def replica_spans(fx: Fixtures) -> DataFrame:
    return _spans(replicas.replica_spans(fx.snapshots()))


@query
def replica_spans_folded(fx: Fixtures) -> DataFrame:
    """Replica spans from a state into which one month of snapshots after another is merged."""
    root = shared_dir(fx.spark, "state")
    month = F.month(F.timestamp_seconds("now_sec")).alias("month")
    fx.snapshots().select("*", month).write.partitionBy("month").parquet(f"{root}/snapshots")
    snapshots = read_parquet(fx.spark, f"{root}/snapshots")
    state = replicas.span_state(snapshots.where("month = 1"))
    for later in range(2, 13):
        new = replicas.span_state(snapshots.where(F.col("month") == later))
        write_parquet(replicas.merged_span_states(state, new), f"{root}/state-{later}")
        state = read_parquet(fx.spark, f"{root}/state-{later}")
    return _spans(replicas.spans_of_state(state))


@query
def replica_spans_from_csv(fx: Fixtures) -> DataFrame:
    """Replica spans from one directory of headerless CSV per snapshot day."""
    root = shared_dir(fx.spark, "snapshots")
    snapshots = fx.snapshots()
    fields = [
        (F.col(f.name) if f.name in snapshots.columns else F.lit(None))
        .cast(f.dataType)
        .alias(f.name)
        for f in layout("block_replicas").fields
    ]
    day = epoch_day(F.col("now_sec")).alias("time")
    snapshots.select(*fields, day).write.partitionBy("time").csv(root, nullValue="null")
    stored = read_snapshots(fx.spark, root, "2024-01-01", "2024-12-31")
    return _spans(replicas.replica_spans(stored))


@query
def disk_replicas(fx: Fixtures) -> DataFrame:
    return typed(
        fx.disk(),
        dataset_name="string",
        node_name="string",
        br_user_group_id="int",
        replica_time_create="date",
        min_time="date",
        max_time="date",
        rep_size="double",
    )


def _daily(df: DataFrame) -> DataFrame:
    return typed(df, date="date", dataset_id="bigint", allOpsSize="double")


@query
def daily_size(fx: Fixtures) -> DataFrame:
    return _daily(fx.daily())


@query
def daily_size_sweep(fx: Fixtures) -> DataFrame:
    return _daily(fx.daily("sweep"))


@query
def daily_size_explode(fx: Fixtures) -> DataFrame:
    return _daily(fx.daily("explode"))


@query
def daily_size_sorted(fx: Fixtures) -> DataFrame:
    """Daily sizes stored sorted by date and read back."""
    path = shared_dir(fx.spark, "daily")
    write_sorted_parquet(fx.daily(), path, "date", "dataset_id")
    return _daily(read_parquet(fx.spark, path))


def _window_sizes(df: DataFrame) -> DataFrame:
    return typed(
        df,
        dataset_id="bigint",
        tier="string",
        **{name: "double" for name in windowed(SIZE_METRICS)},
    )


@query
def replica_windows(fx: Fixtures) -> DataFrame:
    return _window_sizes(fx.window_sizes())


@query
def replica_windows_young(fx: Fixtures) -> DataFrame:
    """At a date when many datasets are younger than a window."""
    return _window_sizes(fx.window_sizes(YOUNG_END_DATE))


@query
def tape_usage(fx: Fixtures) -> DataFrame:
    usage = replicas.tape_usage(fx.replicas())
    return typed(usage, tier="string", input_campaign="string", size="double")


@query
def tape_usage_active(fx: Fixtures) -> DataFrame:
    usage = replicas.tape_usage(fx.replicas(), active_since=END_DATE)
    return typed(usage, tier="string", input_campaign="string", size="double")


@query
def tape_usage_from_csv(fx: Fixtures) -> DataFrame:
    """Tape usage from CSV read as strings only: days and sizes are text."""
    path = shared_dir(fx.spark, "tape")
    days = {name: day_key(F.col(name)) for name in ("min_time", "max_time", "replica_time_create")}
    write_csv(fx.replicas().withColumns(days), path)
    usage = replicas.tape_usage(read_csv(fx.spark, path, header=True))
    return typed(
        usage.withColumn("size", F.round("size", 2)),
        tier="string",
        input_campaign="string",
        size="double",
    )


# Chains: each starts from what the stage before really gives, string days and DOUBLE sizes.


@query
def spans_to_disk(fx: Fixtures) -> DataFrame:
    """Spans of snapshots, their disk subset."""
    disk = replicas.disk_replicas(fx.spans())
    return typed(
        disk.withColumn("rep_size", F.round("rep_size", 4)),
        dataset_name="string",
        node_name="string",
        br_user_group_id="int",
        replica_time_create="string",
        min_time="date",
        max_time="date",
        rep_size="double",
    )


@query
def spans_to_daily_size(fx: Fixtures) -> DataFrame:
    """Snapshots to spans, disk subset and daily sizes."""
    disk = replicas.disk_replicas(fx.spans())
    daily = occupancy.daily_size(disk, fx.catalog(), *EVENT_SPINE)
    return _daily(daily.withColumn("allOpsSize", F.round("allOpsSize", 4)))


@query
def spans_to_windows(fx: Fixtures) -> DataFrame:
    """Snapshots to spans, disk subset and window sizes."""
    disk = replicas.disk_replicas(fx.spans())
    sizes = occupancy.replica_window_sizes(disk, fx.catalog(), EVENT_END_DATE)
    rounded = {name: F.round(name, 4) for name in windowed(SIZE_METRICS)}
    return _window_sizes(sizes.withColumns(rounded))


@query
def spans_to_tape(fx: Fixtures) -> DataFrame:
    """Snapshots to spans and tape usage."""
    usage = replicas.tape_usage(fx.spans(), active_since="2024-01-02")
    return typed(
        usage.withColumn("size", F.round("size", 4)),
        tier="string",
        input_campaign="string",
        size="double",
    )


def _catalog_replicas(df: DataFrame) -> DataFrame:
    return typed(
        df,
        RSE_ID="string",
        f_dataset_id="bigint",
        SCOPE="string",
        tally_day="string",
        create_day="string",
        rep_size="bigint",
    )


@query
def catalog_replicas_daily(fx: Fixtures) -> DataFrame:
    return _catalog_replicas(replicas.catalog_replicas_daily(fx.catalog_replicas(), fx.files()))


@query
def catalog_replicas_hot_file(fx: Fixtures) -> DataFrame:
    """The same of a catalogue in which one name has about a ninth of the rows, looked up apart."""
    return _catalog_replicas(
        replicas.catalog_replicas_daily(fx.hot_catalog_replicas(), fx.files(), spread=True)
    )


@query
def catalog_replicas_from_files(fx: Fixtures) -> DataFrame:
    """The tally day taken from the directory each replica row was read from."""
    root = shared_dir(fx.spark, "replicas")
    rows = fx.catalog_replicas()
    day = F.substring("filename", len("hdfs://store/rucio/") + 1, 10)
    days = rows.withColumn("part", day).drop("filename")
    days.repartition(8, "part").write.partitionBy("part").parquet(f"{root}/rucio")
    files = read_catalog_replicas(fx.spark, f"{root}/rucio", "parquet")
    # a partition directory reads part=<day>; the tally looks for the bare day
    files = files.withColumn("filename", F.replace("filename", F.lit("part="), F.lit("")))
    return _catalog_replicas(replicas.catalog_replicas_daily(files, fx.files()))


# ---- reads -----------------------------------------------------------------------------------


@query
def merge_reads(fx: Fixtures) -> DataFrame:
    return typed(
        fx.merged_reads(),
        d_dataset_id="bigint",
        day="date",
        **{name: "double" for name in READ_METRICS},
    )


@query
def read_windows(fx: Fixtures) -> DataFrame:
    return typed(
        fx.read_bins(),
        d_dataset_id="bigint",
        **{name: "bigint" for name in windowed(READ_METRICS)},
    )


@query
def tallies_merged(fx: Fixtures) -> DataFrame:
    """The three logs to tallies to merged reads, with the days as the tallies write them."""
    return typed(
        fx.tallied_reads(),
        d_dataset_id="bigint",
        day="string",
        **{name: "double" for name in READ_METRICS},
    )


@query
def tallies_to_windows(fx: Fixtures) -> DataFrame:
    """The three logs to tallies, merged reads and read bins."""
    return typed(
        reads.read_windows(fx.tallied_reads(), END_DATE),
        d_dataset_id="bigint",
        **{name: "bigint" for name in windowed(READ_METRICS)},
    )


@query
def quantize(fx: Fixtures) -> DataFrame:
    """Bins of amounts below 0, 0, around 1.5, around 15 and above."""
    amount = (F.col("l_quantity") - 10) / 2.0
    counted = (
        fx.table("lineitem").groupBy(amount.alias("amount")).agg(F.count("*").alias("n"))
    )
    binned = counted.withColumn("bin", read_bin(F.col("amount")))
    return typed(binned, amount="double", bin="bigint", n="bigint")


# ---- overrides and popularity ----------------------------------------------------------------


@query
def overrides_resolved(fx: Fixtures) -> DataFrame:
    return typed(fx.overrides(), d_dataset_id="bigint", value="int")


@query
def overrides_from_json(fx: Fixtures) -> DataFrame:
    """Overrides kept by hand as JSON objects, about a hundred names in each file, resolved by name."""
    path = shared_dir(fx.spark, "overrides")
    listed = fx.override_list()
    files = max(1, -(-listed.count() // 100))
    dealt = F.pmod(F.xxhash64("dataset_name"), F.lit(files))
    entries = F.map_from_entries(F.collect_list(F.struct("dataset_name", "value")))
    objects = listed.groupBy(dealt.alias("file")).agg(F.to_json(entries).alias("value"))
    objects.write.partitionBy("file").text(path)
    listed = read_overrides(fx.spark, f"{path}/*")
    return typed(
        popularity.resolve_overrides(listed, fx.catalog()), d_dataset_id="bigint", value="int"
    )


@query
def popularity_joined(fx: Fixtures) -> DataFrame:
    return _popularity(fx.popularity())


@query
def overrides_applied(fx: Fixtures) -> DataFrame:
    return _popularity(fx.overridden(), value="int")


def _popularity(df: DataFrame, **more: str) -> DataFrame:
    return typed(
        df,
        dataset_id="bigint",
        tier="string",
        **{name: "double" for name in windowed(SIZE_METRICS)},
        **{name: "bigint" for name in windowed(READ_METRICS)},
        **more,
    )


@query
def override_daily(fx: Fixtures) -> DataFrame:
    return typed(popularity.override_daily(fx.daily(), fx.overrides()), date="date", size="double")


@query
def override_daily_csv(fx: Fixtures) -> DataFrame:
    """The same report exported as one CSV file and read back."""
    path = shared_dir(fx.spark, "report")
    write_single_csv(override_daily(fx), path)
    return read_csv(fx.spark, path, "date DATE, size DOUBLE", header=True)


def _unused(df: DataFrame) -> DataFrame:
    return typed(
        df, d_dataset="string", allSize90="double", allSize180="double", allSize365="double"
    )


@query
def top_unused(fx: Fixtures) -> DataFrame:
    return _unused(popularity.top_unused(fx.overridden(), fx.catalog()))


@query
def top_unused_25(fx: Fixtures) -> DataFrame:
    return _unused(popularity.top_unused(fx.overridden(), fx.catalog(), window=90, k=25))


@query
def unused_by_campaign(fx: Fixtures) -> DataFrame:
    unused = popularity.top_unused(fx.overridden(), fx.catalog())
    return typed(popularity.unused_by_campaign(unused), campaign="string", tb="double")


@query
def unused_by_campaign_csv(fx: Fixtures) -> DataFrame:
    """The same from the exported unused report."""
    path = shared_dir(fx.spark, "unused")
    write_csv(popularity.top_unused(fx.overridden(), fx.catalog()), path)
    size = "decimal(28,6)"
    columns = f"d_dataset STRING, allSize90 {size}, allSize180 {size}, allSize365 {size}"
    unused = read_csv(fx.spark, path, columns, header=True)
    return typed(popularity.unused_by_campaign(unused), campaign="string", tb="double")


# ---- histogram -------------------------------------------------------------------------------


def _histogram(df: DataFrame) -> DataFrame:
    return typed(df, name="string", **{name: "double" for name in _BIN_COLUMNS})


@query
def popularity_histogram_wide(fx: Fixtures) -> DataFrame:
    return _histogram(histogram.popularity_histogram(fx.overridden()))


@query
def popularity_histogram_long(fx: Fixtures) -> DataFrame:
    long = histogram.histogram_long(histogram.popularity_histogram(fx.overridden()))
    return typed(long, name="string", bin="int", bytes="double")


@query
def popularity_histogram_json(fx: Fixtures) -> DataFrame:
    """The histogram stored as JSON arrays, re-read and turned back into rows."""
    path = shared_dir(fx.spark, "arrays")
    write_json(histogram.histogram_arrays(histogram.popularity_histogram(fx.overridden())), path)
    return _histogram(histogram.histogram_from_arrays(read_json(fx.spark, path)))


# ---- rolling ---------------------------------------------------------------------------------


def _rolling(fx: Fixtures, window: int) -> DataFrame:
    popular = rolling.rolling_popularity(fx.merged_reads(), fx.daily(), (window,), *SPINE)
    return typed(popular, date="date", fraction="double", size="double")


@query
def rolling_popularity_30(fx: Fixtures) -> DataFrame:
    return _rolling(fx, 30)


@query
def rolling_popularity_90(fx: Fixtures) -> DataFrame:
    return _rolling(fx, 90)


@query
def rolling_popularity_180(fx: Fixtures) -> DataFrame:
    return _rolling(fx, 180)


@query
def rolling_popularity_windows(fx: Fixtures) -> DataFrame:
    """All three windows in one pass."""
    popular = rolling.rolling_popularity(
        fx.merged_reads(), fx.daily(), start=SPINE[0], end=SPINE[1]
    )
    return typed(popular, window="int", date="date", fraction="double", size="double")


# ---- names and days --------------------------------------------------------------------------


@query
def dataset_names(fx: Fixtures) -> DataFrame:
    """Tier and the three campaign notions of every dataset."""
    name = F.col("d_dataset")
    return fx.catalog().select(
        "d_dataset_id",
        names.tier(name).alias("tier"),
        names.input_campaign(name).alias("input_campaign"),
        names.tape_campaign(name).alias("tape_campaign"),
        names.unused_campaign(name).alias("unused_campaign"),
    )


@query
def input_campaign(fx: Fixtures) -> DataFrame:
    """Datasets per input campaign."""
    campaign = names.input_campaign(F.col("d_dataset")).alias("input_campaign")
    return fx.catalog().groupBy(campaign).agg(F.count("*").alias("n"))


@query
def tape_campaign(fx: Fixtures) -> DataFrame:
    """Datasets per tape campaign."""
    campaign = names.tape_campaign(F.col("d_dataset")).alias("tape_campaign")
    return fx.catalog().groupBy(campaign).agg(F.count("*").alias("n"))


@query
def tier_categories(fx: Fixtures) -> DataFrame:
    tiers = fx.catalog().select("d_dataset_id", names.tier(F.col("d_dataset")).alias("tier"))
    return tiers.select(
        "d_dataset_id", *[test.alias(name) for name, test in names.tier_categories().items()]
    )


@query
def epoch_days(fx: Fixtures) -> DataFrame:
    """Orders per day, the day taken from seconds and from milliseconds."""
    seconds = F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint") * 86400 + 86399
    orders = fx.table("orders").select(
        epoch_day(seconds).alias("day"), epoch_day(seconds * 1000 + 999, "ms").alias("ms_day")
    )
    counted = orders.groupBy("day", "ms_day").agg(F.count("*").alias("n"))
    return typed(
        counted.withColumns({name: day_key(F.col(name)) for name in ("day", "ms_day")}),
        day="string",
        ms_day="string",
        n="bigint",
    )


@query
def date_spine(fx: Fixtures) -> DataFrame:
    orders = fx.table("orders").select(F.col("o_orderdate").cast("date").alias("day"))
    return spine_over(orders, "day")


# ---- data quality and maintenance ------------------------------------------------------------


@query
def size_check(fx: Fixtures) -> DataFrame:
    return typed(
        quality.dataset_sizes_check(fx.disk(), END_DATE),
        rep_size="double",
        allOpsSize="double",
        anaOpsSize="double",
    )


@query
def size_check_catalogued(fx: Fixtures) -> DataFrame:
    """The same totals over replicas of catalogued datasets only."""
    known = replicas.catalogued(fx.disk(), fx.catalog())
    return typed(
        quality.dataset_sizes_check(known, END_DATE),
        rep_size="double",
        allOpsSize="double",
        anaOpsSize="double",
    )


@query
def window_totals(fx: Fixtures) -> DataFrame:
    totals = quality.window_totals(fx.exact_sizes())
    return typed(totals, **{name: "double" for name in windowed(SIZE_METRICS)})


@query
def null_counts(fx: Fixtures) -> DataFrame:
    merged = fx.merged_reads().select("d_dataset_id", "day", *READ_METRICS)
    return typed(quality.null_counts(merged), **{name: "bigint" for name in merged.columns})


@query
def alive_during(fx: Fixtures) -> DataFrame:
    """Replicas, datasets and bytes alive in each supplier's period."""
    return typed(
        intervals.alive_during(fx.disk(), fx.periods()),
        period_id="bigint",
        replicas="bigint",
        datasets="bigint",
        rep_size="double",
        byte_days="double",
    )


@query
def overlapping_lifetimes(fx: Fixtures) -> DataFrame:
    """Replicas of one dataset whose lifetimes overlap, on disk and elsewhere, counted by node."""
    days = ("min_time", "max_time")
    kept = ["dataset_name", "node_name", *days]
    other = fx.replicas().where(~replicas.is_disk_node(F.col("node_name"))).select(kept)
    other = other.withColumnsRenamed({name: f"other_{name}" for name in kept[1:]})
    pairs = intervals.overlapping(
        fx.disk().select(kept), other, days, ("other_min_time", "other_max_time"), ["dataset_name"], 10
    )
    return typed(
        pairs.groupBy("node_name", "other_node_name").agg(F.count("*").alias("n")),
        node_name="string",
        other_node_name="string",
        n="bigint",
    )


def _catalog_checks(fx: Fixtures) -> list:
    catalog = fx.faulty_catalog()
    return [
        constraints.Unique("dataset names", catalog, ("d_dataset",)),
        constraints.Unique("dataset ids", catalog, ("d_dataset_id",)),
        constraints.Unique("file names", fx.files(), ("f_logical_file_name",)),
        constraints.Reference("owners of files", fx.files(), ("f_dataset_id",), catalog, ("d_dataset_id",)),
    ]


@query
def key_violations(fx: Fixtures) -> DataFrame:
    """Names that come twice, ids that are missing, files without a dataset."""
    found = constraints.violations(*_catalog_checks(fx))
    return typed(found, name="string", kind="string", key="string", n="bigint")


@query
def key_violation_totals(fx: Fixtures) -> DataFrame:
    found = constraints.violation_totals(*_catalog_checks(fx))
    return typed(found, name="string", kind="string", keys="bigint", n="bigint")


@query
def sketched_months(fx: Fixtures) -> DataFrame:
    """Days of events sketched and stored, merged by month, and held against exact figures."""
    events = fx.table("events").select(F.col("ts").cast("date").alias("day"), "user_id", "value")
    path = shared_dir(fx.spark, "sketches")
    write_parquet(profile.sketched(events, ["day"], ["user_id"], ["value"]), path)
    month = F.month("day").cast("bigint").alias("month")
    merged = profile.merged_sketches(read_parquet(fx.spark, path), [month])
    told = profile.estimates(merged, (0.25, 0.75)).alias("t")
    # the share of values that are not above each estimated quantile
    exact = events.select(month, "user_id", "value").join(told.select("month", "quantiles_value"), "month")
    ranks = [
        F.avg(F.when(F.col("value") <= F.get("quantiles_value", F.lit(i)), 1.0).otherwise(0.0)).alias(f"rank_{i}")
        for i in range(2)
    ]
    exact = exact.groupBy("month").agg(F.count_distinct("user_id").alias("users"), *ranks)
    held = told.join(exact, "month")
    close = F.abs(F.col("distinct_user_id") - F.col("users")) <= 0.08 * F.col("users")
    near = [F.abs(F.col(f"rank_{i}") - rank) <= 0.05 for i, rank in enumerate((0.25, 0.75))]
    return held.select("month", F.col("n").cast("bigint").alias("n"), "users", close.alias("users_close"), near[0].alias("low_close"), near[1].alias("high_close"))


@query
def compaction_by_size(fx: Fixtures) -> DataFrame:
    """Many small files of replicas put together to a few, twice: the second time nothing is left to do."""
    path = f"{shared_dir(fx.spark, 'many')}/disk"
    write_parquet(fx.disk().repartition(24), path)
    listed = fx.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    target = 4 * (listed.agg(F.max("length")).first()[0] + 1)
    before, after = compaction.compact_by_size(fx.spark, path, target)
    again = compaction.compact_by_size(fx.spark, path, target)
    if not (after < before == 24 and again[0] == after):
        raise ValueError(f"{before} files became {after}, then {again}")
    return _disk(read_parquet(fx.spark, path))


def _stored_tallies(fx: Fixtures, stages: Stages, keep: Column) -> None:
    """The three sources' daily reads, where ``keep`` holds, added to directories of years and months."""
    for source, flag in zip(SOURCES, "RAN", strict=True):
        daily = fx.daily_reads(flag).where(keep).withColumns({"year": F.year("day"), "month": F.month("day")})
        stored = daily.withColumn("day", F.date_format("day", "yyyyMMdd")).repartition(1)
        stored.write.mode("append").partitionBy("year", "month").parquet(stages.path(source))


@query
def merged_months_refreshed(fx: Fixtures) -> DataFrame:
    """Merged reads by month after logs of one year came late: only that year's months are made anew."""
    stages = Stages(shared_dir(fx.spark, "refreshed"))
    late = F.year("day") == 1998
    early = F.year("day").isin(1997, 1999)
    _stored_tallies(fx, stages, early)
    refresh_merged(fx.spark, stages)
    _stored_tallies(fx, stages, late)
    months = refresh_merged(fx.spark, stages)
    if {month[:4] for month in months} != {"1998"} or refresh_merged(fx.spark, stages):
        raise ValueError(f"made anew: {months}")
    return typed(
        read_parquet(fx.spark, stages.path("merged_months")),
        d_dataset_id="bigint",
        day="date",
        **{name: "double" for name in READ_METRICS},
    )


@query
def compaction_roundtrip(fx: Fixtures) -> DataFrame:
    path = f"{shared_dir(fx.spark, 'compact')}/disk"
    write_parquet(fx.disk(), path)
    return _disk(read_parquet(fx.spark, compaction.compact(fx.spark, path, files=2)))


def _disk(df: DataFrame) -> DataFrame:
    return typed(
        df,
        dataset_name="string",
        node_name="string",
        br_user_group_id="int",
        replica_time_create="date",
        min_time="date",
        max_time="date",
        rep_size="double",
    )


@query
def merged_reads_by_month(fx: Fixtures) -> DataFrame:
    """Merged reads stored under year and month and read back."""
    path = shared_dir(fx.spark, "months")
    write_by_month(fx.merged_reads(), path, "day")
    return typed(
        read_parquet(fx.spark, path),
        d_dataset_id="bigint",
        day="date",
        **{name: "double" for name in READ_METRICS},
    )
