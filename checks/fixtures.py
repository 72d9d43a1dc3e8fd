"""The operators' inputs, derived from the test tables. Every row of a table is used.

Sizes are decimals and read amounts are multiples of 1/8, so that sums do not depend on order and
can be compared exactly with another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.metrics import SIZE_METRICS, windowed
from tidemark.operators.access import (
    dataset_totals,
    file_read_tally,
    job_tally,
    transfer_tally,
)
from tidemark.operators.occupancy import daily_size, replica_window_sizes
from tidemark.operators.popularity import apply_overrides, popularity, resolve_overrides
from tidemark.operators.reads import merge_reads, read_windows
from tidemark.operators.replicas import disk_replicas, replica_spans

MONEY = "decimal(18,2)"
PRECISE = "decimal(28,6)"

# The tables span 1995-01-01 to 2001-12-24; the spine covers all of it.
SPINE = ("1995-01-01", "2001-12-31")
END_DATE = "2001-08-01"
YOUNG_END_DATE = "1996-05-01"
# The events are of one year.
EVENT_SPINE = ("2024-01-01", "2024-12-31")
EVENT_END_DATE = "2024-12-01"
OVERRIDDEN_BRAND = "Brand#11"


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.tables[name]

    # catalogue

    def catalog(self) -> DataFrame:
        campaign = F.expr(
            """CASE p_size % 4 WHEN 0 THEN 'Run2018A-12Nov2019'
                               WHEN 1 THEN 'RunIIAutumn18-102X_v15_ext1'
                               WHEN 2 THEN 'RunIISummer16-94X_v3' ELSE 'CMSSW_10-102X' END"""
        )
        tier = F.expr(
            """CASE p_type WHEN 'ECONOMY' THEN 'AODSIM' WHEN 'SMALL' THEN 'MINIAODSIM'
                           WHEN 'MEDIUM' THEN 'GEN-SIM' WHEN 'LARGE' THEN 'AOD'
                           WHEN 'STANDARD' THEN 'NANOAOD' ELSE 'RAW' END"""
        )
        path = F.concat(
            F.lit("/"),
            F.replace("p_name", F.lit(" "), F.lit("_")),
            F.lit("/"),
            campaign,
            F.lit("-v"),
            (F.col("p_size") % 3 + 1).cast("string"),
            F.lit("/"),
            tier,
            F.lit("/"),
            F.col("p_partkey").cast("string"),
        )
        return self.table("part").select(
            F.col("p_partkey").alias("d_dataset_id"), path.alias("d_dataset")
        )

    def files(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy("l_orderkey", "l_linenumber", "l_partkey")
            .agg(F.max("l_quantity").alias("events"), F.max("l_extendedprice").alias("bytes"))
            .select(
                _file_name().alias("f_logical_file_name"),
                F.col("l_partkey").alias("f_dataset_id"),
                F.col("events").cast("bigint").alias("f_event_count"),
                F.col("bytes").cast(MONEY).alias("f_file_size"),
            )
        )

    # access logs, as the sources write them

    def file_read_log(self) -> DataFrame:
        crab = F.when(F.col("l_linestatus") == "O", F.lit("1_2:user:crab:3"))
        return self._records("R").select(
            _logged_name().alias("file_lfn"),
            (_ship_day() * 86400 + F.col("l_linenumber") * 3600).alias("end_time"),
            crab.alias("app_info"),
            _site().alias("site_name"),
        )

    def hot_file_log(self) -> DataFrame:
        """The file reads, about a ninth of them of one file: that of the least name."""
        hot = self.files().agg(F.min("f_logical_file_name")).first()[0]
        return self._records("R").select(
            F.when(F.col("l_discount") == 0.07, F.lit(hot)).otherwise(_logged_name()).alias("file_lfn"),
            (_ship_day() * 86400 + F.col("l_linenumber") * 3600).alias("end_time"),
            F.lit("job").alias("app_info"),
            _site().alias("site_name"),
        )

    def spoilt_lines(self) -> DataFrame:
        """The file-read log as lines of JSON, some cut short, some without data, some with a word for a time."""
        time = (_ship_day() * 86400 + F.col("l_linenumber") * 3600).alias("end_time")
        rest = [_logged_name().alias("file_lfn"), F.lit("job").alias("app_info"), _site().alias("site_name")]
        whole = F.to_json(F.struct(F.struct(time, *rest).alias("data")))
        worded = F.to_json(F.struct(F.struct(F.lit("soon").alias("end_time"), *rest).alias("data")))
        tax = F.round(F.col("l_tax") * 100)
        line = (
            F.when(tax == 3, F.expr("'{\"data\": {\"file_lfn\": \"' || l_orderkey"))
            .when(tax == 4, F.lit('{"data": null}'))
            .when(tax == 5, worded)
            .otherwise(whole)
        )
        return self._records("R").select(line.alias("line"))

    def transfer_log(self) -> DataFrame:
        domain = (
            F.when(F.col("l_discount") == 0.05, F.lit("[::1]"))
            .when(F.col("l_discount") == 0.06, F.lit(None))
            .otherwise(F.concat(F.lit("site"), F.col("l_linenumber").cast("string"), F.lit(".net")))
        )
        return self._records("A").select(
            _logged_name().alias("file_lfn"),
            _millis().alias("end_time"),
            domain.alias("client_domain"),
            F.when(F.col("l_tax") == 0, F.lit("other")).otherwise(F.lit("cms")).alias("vo"),
        )

    def job_log(self) -> DataFrame:
        records = self._records("N").join(
            self.catalog(), F.col("l_partkey") == F.col("d_dataset_id"), "left"
        )
        return records.select(
            F.when(F.col("l_discount") != 0.1, F.col("d_dataset")).alias("DESIRED_CMSDataset"),
            _millis().alias("RecordTime"),
            F.col("l_quantity").cast("float").alias("KEvents"),
            _site().alias("Site"),
            F.when(F.col("l_tax") == 0.01, F.lit(None))
            .when(F.col("l_linestatus") == "O", F.lit("Onsite"))
            .otherwise(F.lit("Offsite"))
            .alias("InputData"),
            F.lit("tool").alias("CMS_SubmissionTool"),
            F.when(F.col("l_tax") == 0, F.lit("Removed"))
            .otherwise(F.lit("Completed"))
            .alias("Status"),
        )

    def _records(self, flag: str) -> DataFrame:
        lineitem = self.table("lineitem")
        if flag == "N":
            return lineitem.where(~F.col("l_returnflag").isin("R", "A"))
        return lineitem.where(F.col("l_returnflag") == flag)

    # daily tallies, merged reads, read bins

    def daily_reads(self, flag: str) -> DataFrame:
        return self._records(flag).select(
            F.col("l_partkey").alias("d_dataset_id"),
            F.col("l_shipdate").cast("date").alias("day"),
            (F.col("l_quantity") / 8.0).alias("fract_read"),
        )

    def merged_reads(self) -> DataFrame:
        return merge_reads(*[self.daily_reads(flag) for flag in "RAN"])

    def read_bins(self) -> DataFrame:
        return read_windows(self.merged_reads(), END_DATE)

    # replicas

    def replicas(self) -> DataFrame:
        node = F.expr(
            """CASE l_suppkey % 8 WHEN 0 THEN 'T3_US_A' WHEN 1 THEN 'X_TEST'
                                  WHEN 2 THEN 'T1_DE_B_Buffer' WHEN 3 THEN 'T1_US_C_MSS' WHEN 4 THEN 'T0_CH_D_Export'
                                  ELSE 'T2_CH_' || l_suppkey END"""
        )
        group = F.expr("element_at(array(42, 18, 19, 7), l_linenumber % 4 + 1)")
        shipped = F.col("l_shipdate").cast("date")
        return (
            self.table("lineitem")
            .join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.catalog(), F.col("l_partkey") == F.col("d_dataset_id"))
            .select(
                F.col("d_dataset").alias("dataset_name"),
                F.lit(-1).alias("dataset_id"),
                node.alias("node_name"),
                group.alias("br_user_group_id"),
                F.col("o_orderdate").cast("date").alias("replica_time_create"),
                shipped.alias("min_time"),
                F.date_add(shipped, F.col("l_quantity").cast("int")).alias("max_time"),
                F.col("l_extendedprice").cast(MONEY).alias("rep_size"),
            )
        )

    def disk(self) -> DataFrame:
        return disk_replicas(self.replicas())

    def snapshots(self) -> DataFrame:
        """Snapshots of blocks; the events' user stands for the block."""
        group = F.expr("element_at(array(42, 18, 19, 7), CAST(user_id % 4 + 1 AS int))")
        dataset = (F.col("user_id") % 20).cast("int")
        return self.table("events").select(
            (F.unix_date(F.col("ts").cast("date")) * 86400.0).alias("now_sec"),
            F.concat(F.lit("/set/"), dataset.cast("string")).alias("dataset_name"),
            dataset.alias("dataset_id"),
            F.col("user_id").cast("int").alias("block_id"),
            F.round(F.col("value") * 100).cast("bigint").alias("block_bytes"),
            F.concat(F.lit("T2_"), "event_type").alias("node_name"),
            group.alias("br_user_group_id"),
            (F.col("user_id") % 7 * 86400 + 1546300800).cast("double").alias("replica_time_create"),
        )

    def catalog_snapshots(self) -> DataFrame:
        """The same snapshots of catalogued datasets, a fifth of them on tape."""
        names = self.catalog().select(F.col("d_dataset_id").alias("known"), "d_dataset")
        node = F.when(F.col("block_id") % 5 == 0, F.concat("node_name", F.lit("_MSS")))
        joined = self.snapshots().join(names, F.col("known") == F.col("dataset_id") + 1)
        return joined.withColumns(
            {"dataset_name": F.col("d_dataset"), "node_name": F.coalesce(node, "node_name")}
        ).drop("known", "d_dataset")

    def tallied_reads(self) -> DataFrame:
        """Merged reads of the three tallies: string days, several rows of a key, fractions as decimals
        so that sums of them are exact.
        """
        totals = dataset_totals(self.files(), self.catalog())
        tallies = [
            file_read_tally(self.file_read_log(), self.files(), totals),
            transfer_tally(self.transfer_log(), self.files(), totals),
            job_tally(self.job_log(), totals),
        ]
        fraction = F.expr("CAST(round(fract_read, 9) AS decimal(18,9))")
        return merge_reads(*[tally.withColumn("fract_read", fraction) for tally in tallies])

    def spans(self) -> DataFrame:
        return replica_spans(self.catalog_snapshots())

    def catalog_replicas(self) -> DataFrame:
        day = F.col("l_shipdate").cast("date").cast("string")
        path = F.concat(F.lit("hdfs://store/rucio/"), day, F.lit("/replicas/part-0.avro"))
        return self.table("lineitem").select(
            _site().alias("RSE_ID"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("BYTES"),
            _logged_name().alias("NAME"),
            F.col("l_linestatus").alias("SCOPE"),
            ((_ship_day() - 5) * 86_400_000 + 1234).alias("CREATED_AT"),
            path.alias("filename"),
        )

    def hot_catalog_replicas(self) -> DataFrame:
        hot = self.files().agg(F.min("f_logical_file_name")).first()[0]
        name = F.when(F.col("BYTES") % 9 == 4, F.lit(hot)).otherwise(F.col("NAME"))
        return self.catalog_replicas().withColumn("NAME", name)

    def daily(self, method: str = "sweep") -> DataFrame:
        return daily_size(self.disk(), self.catalog(), *SPINE, method=method)

    def window_sizes(self, end_date: str = END_DATE) -> DataFrame:
        return replica_window_sizes(self.disk(), self.catalog(), end_date)

    def periods(self) -> DataFrame:
        """A period of up to ten weeks for each supplier; some end before they begin."""
        first = F.date_add(F.lit(SPINE[0]).cast("date"), (F.col("s_suppkey") * 17 % 2400).cast("int"))
        length = (F.col("s_nationkey") * 3 - 3).cast("int")
        return self.table("supplier").select(
            F.col("s_suppkey").alias("period_id"),
            first.alias("first_day"),
            F.date_add(first, length).alias("last_day"),
        )

    def faulty_catalog(self) -> DataFrame:
        """The catalogue, the names of one brand twice and the ids of some small parts NULL."""
        part = self.table("part")
        named = self.catalog().join(part, F.col("d_dataset_id") == F.col("p_partkey"))
        unnumbered = F.when(F.col("p_size") != 7, F.col("d_dataset_id"))
        rows = named.select(unnumbered.alias("d_dataset_id"), "d_dataset")
        again = named.where(F.col("p_brand") == OVERRIDDEN_BRAND)
        return rows.unionByName(again.select((-F.col("d_dataset_id")).alias("d_dataset_id"), "d_dataset"))

    # overrides, popularity

    def override_list(self) -> DataFrame:
        """Bins set by hand for the datasets of one brand, plus one name the catalogue lacks."""
        by_hand = self.table("part").where(F.col("p_brand") == OVERRIDDEN_BRAND).select("p_partkey")
        named = by_hand.join(self.catalog(), F.col("p_partkey") == F.col("d_dataset_id")).select(
            F.col("d_dataset").alias("dataset_name"),
            (F.col("d_dataset_id") % 16).cast("int").alias("value"),
        )
        unknown = self.table("region").select(
            F.concat(F.lit("/unknown/"), "r_name").alias("dataset_name"), F.lit(3).alias("value")
        )
        return named.unionByName(unknown)

    def overrides(self) -> DataFrame:
        return resolve_overrides(self.override_list(), self.catalog())

    def exact_sizes(self) -> DataFrame:
        """Window sizes as decimals: their sums then come out the same in any order."""
        sizes = self.window_sizes()
        return sizes.withColumns(
            {n: F.expr(f"CAST(round({n}, 6) AS {PRECISE})") for n in windowed(SIZE_METRICS)}
        )

    def popularity(self) -> DataFrame:
        return popularity(self.exact_sizes(), self.read_bins())

    def overridden(self) -> DataFrame:
        return apply_overrides(self.popularity(), self.overrides())


def _file_name(prefix: Column | None = None) -> Column:
    key = F.concat_ws("/", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"))
    return F.concat(F.lit("/store/") if prefix is None else prefix, key)


def _logged_name() -> Column:
    """File name as logged; some reads are of files outside the store."""
    outside = F.col("l_discount") == 0.1
    return _file_name(F.when(outside, F.lit("/user/")).otherwise(F.lit("/store/")))


def _ship_day() -> Column:
    return F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint")


def _millis() -> Column:
    return (_ship_day() * 86400 + F.col("l_linenumber") * 3600) * 1000 + 999


def _site() -> Column:
    return F.concat(F.lit("SITE_"), (F.col("l_suppkey") % 25).cast("string"))
