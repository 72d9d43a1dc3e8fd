"""Compaction by size."""

import pytest
from conftest import as_set

from tidemark.operators import compaction


def sizes(path):
    return sorted(f.stat().st_size for f in path.glob("*.parquet"))


def test_first_fit(spark, rows):
    files = rows("file string, length bigint", *[(f"f{i}", n) for i, n in enumerate([60, 50, 40, 30, 20, 10, 5, 5, 100, 150])])
    found = compaction.fitted(files, 100).collect()
    outputs = {}
    for r in found:
        outputs.setdefault(r.output, []).append(r.length)
    assert sorted(outputs) == list(range(len(outputs)))
    assert sorted(map(sorted, outputs.values())) == [[5, 5, 20, 30], [10, 40, 50], [60], [100], [150]]
    again = rows("file string, length bigint", *[(f"g{i}", sum(o)) for i, o in enumerate(outputs.values())])
    assert compaction.fitted(again, 100).select("output").distinct().count() == len(outputs)


def test_several_groups(spark, rows, monkeypatch):
    monkeypatch.setattr(compaction, "FILES_AT_ONCE", 7)
    files = rows("file string, length bigint", *[(f"f{i}", 1 + i % 9) for i in range(60)])
    found = compaction.fitted(files, 20).collect()
    assert sorted({r.output for r in found}) == list(range(len({r.output for r in found})))
    assert sorted(r.file for r in found) == sorted(f"f{i}" for i in range(60))
    for output in {r.output for r in found}:
        assert sum(r.length for r in found if r.output == output) <= 20


def test_directory_is_replaced(spark, tmp_path):
    path = tmp_path / "it's many"
    df = spark.range(6000).selectExpr("id", "CAST(id % 7 AS STRING) AS `a b`", "id * 2 AS _output2")
    df.repartition(30).write.parquet(str(path))
    small = sizes(path)
    target = 6 * max(small)
    assert compaction.compact_by_size(spark, str(path), target) == (30, len(sizes(path)))
    after = sizes(path)
    assert len(after) < 10 and after[-1] <= target and sum(2 * s <= target for s in after) <= 1
    assert as_set(spark.read.parquet(str(path))) == as_set(df)
    assert [p.name for p in tmp_path.iterdir()] == [path.name]
    before = [(f.name, f.stat().st_mtime_ns) for f in path.iterdir()]
    assert compaction.compact_by_size(spark, str(path), target) == (len(after), len(after))
    assert sorted(before) == sorted((f.name, f.stat().st_mtime_ns) for f in path.iterdir())


def test_failed_rename_raises(spark, tmp_path):
    with pytest.raises(Exception):
        compaction._rename(spark, f"{tmp_path}/none", f"{tmp_path}/other")


def test_partitions(spark, tmp_path):
    df = spark.range(400).selectExpr("id", "id % 2 AS part")
    df.repartition(12).write.partitionBy("part").parquet(f"{tmp_path}/t")
    paths = [f"{tmp_path}/t/part={i}" for i in (0, 1)]
    done = compaction.compact_partitions(spark, paths)
    assert {after for _, after in done.values()} == {1}
    assert as_set(spark.read.parquet(f"{tmp_path}/t").select("id", "part")) == as_set(df.selectExpr("id", "CAST(part AS INT)"))
