"""Every flat layout read from a CSV dump, and the Avro branch where Spark has the module."""

import csv

import pytest
from pyspark.sql import types as T

from tidemark.sources.layouts import LAYOUTS, layout
from tidemark.sources.readers import read_catalog_replicas, read_csv

VALUES = {
    T.IntegerType(): [1, -7, None],
    T.LongType(): [2**40, 0, None],
    T.DoubleType(): [0.5, 1e18, None],
    T.StringType(): ['a "quoted", text', "", None],
}


@pytest.mark.parametrize("header", [False, True])
@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layout_from_a_dump(spark, tmp_path, name, header):
    fields = layout(name).fields
    rows = [[VALUES[f.dataType][(i + j) % 3] for j, f in enumerate(fields)] for i in range(3)]
    with (tmp_path / "part-0").open("w", newline="") as out:
        writer = csv.writer(out, doublequote=False, escapechar="\\")
        if header:
            writer.writerow([f.name for f in fields])
        writer.writerows([["null" if v is None else v for v in row] for row in rows])
    read = read_csv(spark, str(tmp_path), name, header)
    assert read.schema.simpleString() == layout(name).simpleString()
    got = [list(r) for r in read.collect()]
    # an empty text reads as missing, as the word null does
    want = [[None if v == "" else v for v in row] for row in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_avro_replicas(spark, rows, tmp_path):
    schema = "RSE_ID string, BYTES bigint, NAME string, SCOPE string, CREATED_AT bigint"
    data = rows(schema, ("r", 5, "/store/a", "cms", 0), (None, None, None, None, None))
    try:
        data.write.format("avro").save(f"{tmp_path}/2020-12-11")
    except Exception as error:
        if "avro" not in str(error).lower():
            raise
        pytest.skip("Spark's Avro module is not on the classpath")
    read = read_catalog_replicas(spark, f"{tmp_path}/2020-12-11/*.avro")
    assert sorted(map(str, (tuple(r)[:5] for r in read.collect()))) == sorted(map(str, map(tuple, data.collect())))
    assert "2020-12-11" in read.first()["filename"]
