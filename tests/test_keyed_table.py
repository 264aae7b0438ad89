"""The manifest of a table that is appended to by key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mandatewatch.sources import keyed_table, writers


def test_filters_hold_their_keys_and_few_others():
    rng = np.random.default_rng(1)
    own, other = rng.integers(-(2**63), 2**63 - 1, 5000), rng.integers(-(2**63), 2**63 - 1, 20_000)
    made = keyed_table.bloom(own)
    assert keyed_table.may_hold(made, own).all() and keyed_table.may_hold(made, other).sum() < 20
    assert not keyed_table.may_hold(keyed_table.bloom(own[:0]), other).any()


def test_new_keys_open_no_file_however_long_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch in range(6):
        rows = spark.range(100 * batch, 100 * batch + 100).withColumn("v", F.lit(batch))
        files = keyed_table.table_files(spark, path)
        assert keyed_table.files_holding(rows, "id", path, files) == []
        writers.append_new(rows.coalesce(1), "id", path)
    files = keyed_table.table_files(spark, path)
    assert len(files) == 6
    # Old keys open just their own files, and only what is new is added.
    mixed = spark.createDataFrame([(5, -1), (405, -1), (900, -1), (900, -2), (None, -1)], "id bigint, v int")
    assert len(keyed_table.files_holding(mixed.filter("id in (5, 405)"), "id", path, files)) == 2
    writers.append_new(mixed, "id", path)
    rows = spark.read.parquet(path)
    assert rows.count() == 601 and rows.filter("v < 0").select("id").collect()[0][0] == 900


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_keys_in_no_order(spark, tmp_path, kind):
    """Hashed keys overlap in range, so the filters decide."""
    path = str(tmp_path / "t")
    key = F.md5(F.col("n").cast("string")) if kind == "string" else F.xxhash64("n")
    for batch in range(5):
        writers.append_new(spark.range(60 * batch, 60 * batch + 60).withColumnRenamed("id", "n").withColumn("k", key).coalesce(1), "k", path)
    files = keyed_table.table_files(spark, path)
    again = spark.range(130, 140).withColumnRenamed("id", "n").withColumn("k", key)
    assert len(files) == 5 and len(keyed_table.files_holding(again, "k", path, files)) == 1
    writers.append_new(spark.range(290, 310).withColumnRenamed("id", "n").withColumn("k", key), "k", path)
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == list(range(310))


def test_files_of_other_writers_are_found(spark, tmp_path):
    """A file without an entry, as after a failure, is entered before it is needed; one that is gone does no harm."""
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    writers.append_new(spark.range(5, 15), "id", path)
    spark.range(10, 20).write.mode("append").parquet(path)  # repeats 10 to 14 on its own account
    gone = next(p for p in (tmp_path / "t").glob("*.parquet"))
    writers.append_new(spark.range(0, 25), "id", path)
    assert spark.read.parquet(path).select("id").distinct().count() == 25 and spark.read.parquet(path).count() == 30
    lost = spark.read.parquet(str(gone)).count()
    gone.unlink()
    writers.append_new(spark.range(0, 25), "id", path)
    assert lost and spark.read.parquet(path).select("id").distinct().count() == 25


def test_filters_of_large_files_are_built_and_met_in_bounded_groups(spark, tmp_path, monkeypatch):
    """no filter holds more than its share of a file's keys, and no task a whole batch's."""
    monkeypatch.setattr(keyed_table, "KEYS_PER_FILTER", 64)
    monkeypatch.setattr(keyed_table, "KEYS_PER_SLOT", 32)
    path = str(tmp_path / "t")
    key = F.md5(F.col("n").cast("string"))
    for low, high in ((0, 2000), (2000, 2050), (2050, 4000)):
        writers.append_new(spark.range(low, high).withColumnRenamed("id", "n").withColumn("k", key).coalesce(1), "k", path)
    files = keyed_table.table_files(spark, path)
    again = spark.range(100, 500).withColumnRenamed("id", "n").withColumn("k", key)
    assert len(keyed_table.files_holding(again, "k", path, files)) == 1
    entries = spark.read.parquet(f"{path}/{keyed_table.MANIFEST}").collect()
    assert len(entries) > 30 and max(len(r["filter"]) for r in entries) < 2 * 64 * keyed_table.BITS_PER_KEY // 8
    writers.append_new(spark.range(0, 4500).withColumnRenamed("id", "n").withColumn("k", key), "k", path)
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == list(range(4500))
