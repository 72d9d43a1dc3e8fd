import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.plans.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session(
        "tests",
        "local[4]",
        partitions=4,
        **{
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """DataFrame from a DDL schema and tuples."""

    def build(ddl, *tuples):
        return spark.createDataFrame(list(tuples), ddl)

    return build


def as_set(df):
    """Rows as a sorted list of tuples, NULLs first, so that repeats count."""
    return sorted(map(tuple, df.collect()), key=lambda row: [(v is not None, v) for v in row])
