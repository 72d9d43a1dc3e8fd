"""Operators timed against plain SQL for the same result, from the same stored stages.

The SQL is what one would write first: a range join with the calendar for sizes per day and for
recent reads, one conditional sum per histogram cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.fixtures import SPINE, Fixtures
from tidemark.functions.metrics import READ_METRICS, ROLLING_WINDOWS, SIZE_METRICS, WINDOWS
from tidemark.operators.histogram import popularity_histogram
from tidemark.operators.occupancy import daily_size
from tidemark.operators.rolling import rolling_popularity
from tidemark.plans.session import shared_dir

_DAILY = """
    SELECT s.date, c.d_dataset_id AS dataset_id,
           sum(CASE WHEN r.br_user_group_id IN (42, 18, 19) THEN r.rep_size ELSE 0 END) AS size
    FROM disk r JOIN catalog c ON r.dataset_name = c.d_dataset
    JOIN spine s ON s.date BETWEEN r.min_time AND r.max_time
    GROUP BY s.date, c.d_dataset_id"""

_ROLLING = """
    SELECT {w} AS window, t.date, r.size / t.size AS fraction, t.size
    FROM (SELECT date, sum(allOpsSize) AS size FROM daily GROUP BY date) t
    JOIN (SELECT d.date, sum(d.allOpsSize) AS size
          FROM daily d JOIN (SELECT DISTINCT s.date, m.d_dataset_id
                             FROM merged m JOIN spine s ON s.date BETWEEN m.day AND m.day + {w}) u
          ON u.date = d.date AND u.d_dataset_id = d.dataset_id GROUP BY d.date) r
    ON r.date = t.date"""

_CATEGORIES = {
    "All": "true",
    "sAODs": "contains(lower(tier), 'aod')",
    "sMINIAODs": "contains(lower(tier), 'miniaod')",
    "AODs": "startswith(lower(tier), 'aod')",
    "notsAODs": "NOT contains(lower(tier), 'aod')",
}


def _plain_histogram() -> str:
    cells = [
        f"array({', '.join(_cell(size, read, test, w, i) for i in range(16))}) AS c{number}"
        for number, (w, size, read, test) in enumerate(
            (w, size, read, test)
            for w in WINDOWS
            for size in SIZE_METRICS
            for read in READ_METRICS
            for test in _CATEGORIES.values()
        )
    ]
    return f"SELECT {', '.join(cells)} FROM overridden"


def _cell(size: str, read: str, test: str, window: int, bin_: int) -> str:
    return f"sum(CASE WHEN {read}{window} = {bin_} AND {test} THEN {size}{window} ELSE 0 END)"


def compare_shapes(
    spark: SparkSession, sf_dir: str, timed: Callable[..., float]
) -> dict:
    fx = Fixtures(spark, sf_dir)
    root = shared_dir(spark, "shapes")
    stages = {
        "disk": fx.disk(),
        "catalog": fx.catalog(),
        "merged": fx.merged_reads(),
        "daily": fx.daily(),
        "overridden": fx.overridden(),
        "spine": spark.sql(
            f"SELECT explode(sequence(DATE'{SPINE[0]}', DATE'{SPINE[1]}')) AS date"
        ),
    }
    for name, df in stages.items():
        df.write.parquet(f"{root}/{name}")
        stages[name] = spark.read.parquet(f"{root}/{name}")
        stages[name].createOrReplaceTempView(name)

    def daily(method: str) -> DataFrame:
        return daily_size(stages["disk"], stages["catalog"], *SPINE, method=method)

    rolling_sql = " UNION ALL ".join(f"({_ROLLING.format(w=w)})" for w in ROLLING_WINDOWS)
    seconds = {
        "daily_size": timed(lambda: daily("sweep")),
        "daily_size_explode": timed(lambda: daily("explode")),
        "daily_size_plain": timed(lambda: spark.sql(_DAILY), 1),
        "histogram": timed(lambda: popularity_histogram(stages["overridden"])),
        "rolling": timed(
            lambda: rolling_popularity(
                stages["merged"], stages["daily"], start=SPINE[0], end=SPINE[1]
            )
        ),
        "rolling_plain": timed(lambda: spark.sql(rolling_sql), 1),
        "histogram_plain": timed(lambda: spark.sql(_plain_histogram()), 1),
    }
    return {
        "metric": "operator_seconds",
        "value": seconds["daily_size"] + seconds["histogram"] + seconds["rolling"],
        "unit": "sec",
        "queries": seconds,
    }
