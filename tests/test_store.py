import os

import pytest
from pyspark.sql import functions as F

from quorumtab.sources.store import SampleStore

ROWS = "image_id string, sample_idx int, tsv_data string, input_tokens bigint, output_tokens bigint"


def rows(spark, found):
    return spark.createDataFrame([(k, i, t, 1, None) for k, i, t in found], ROWS)


def told(df):
    return sorted((r.image_id, r.sample_idx, r.tsv_data) for r in df.collect())


def test_appends_cursors_and_compaction(spark, tmp_path):
    store = SampleStore(spark, str(tmp_path / "s"))
    assert store.read().count() == 0 and store.files() == 0
    store.append(rows(spark, [("a", 0, "x"), ("a", 1, None), ("ü/ b", 0, "")]))
    before = store.read()
    first = store.take(spark.createDataFrame([("a",), ("a",), ("new",), (None,)], "image_id string"), 2)
    store.append(rows(spark, [("a", 0, "y"), ("new", 0, "z")]).withColumn("tsv_data", F.col("tsv_data")).withColumn("n", F.lit(9)).drop("n"))
    want = [("a", 0, "x"), ("a", 1, None), ("a", 2, "y"), ("new", 0, "z"), ("ü/ b", 0, "")]
    assert sorted(told(store.read()), key=str) == sorted(want, key=str)
    assert before.count() == 3  # as it was
    got = {(r.image_id, r.sample_idx): (r.tsv_data, r.stored) for r in first.collect()}
    assert got == {("a", 0): ("x", True), ("a", 1): (None, True), ("new", 0): (None, False), ("new", 1): (None, False)}
    again = {(r.image_id, r.sample_idx, r.tsv_data) for r in SampleStore(spark, store.path).take(spark.createDataFrame([("a",)], "image_id string")).collect()}
    assert again == {("a", 2, "y")}  # the cursor is the store's, not the object's
    many = store.files()
    store.compact()
    assert store.files() < many and sorted(told(store.read()), key=str) == sorted(want, key=str)
    assert {(r.image_id, r.next_idx) for r in store.cursors().collect()} == {("a", 3), ("new", 2)}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    store = SampleStore(spark, str(tmp_path / "s"))
    store.append(rows(spark, [("a", 0, "x")]))
    bad = spark.range(2000).select(F.concat(F.lit("k"), F.col("id")).alias("image_id"), F.lit(0).alias("sample_idx"), F.when(F.col("id") == 1500, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.lit("t")).alias("tsv_data"), F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"))
    for what in (bad, rows(spark, [("b", 0, "x"), (None, 0, "y")])):
        with pytest.raises(Exception):
            store.append(what)
        assert told(store.read()) == [("a", 0, "x")]
    assert len([f for f in os.listdir(tmp_path / "s" / "samples") if f.endswith(".parquet")]) == 1


def test_many_keys_in_few_files_and_filters_choose_them(spark, tmp_path):
    store = SampleStore(spark, str(tmp_path / "s"))
    n = 1_000_000
    store.append(spark.range(n).select(F.format_string("k%07d", "id").alias("image_id"), F.lit(0).alias("sample_idx"), F.lit("t").alias("tsv_data"), F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens")))
    assert store.files() <= 16 and store.read().count() == n
    one = store.read().filter("image_id = 'k0777777'")
    assert told(one) == [("k0777777", 0, "t")] and one.rdd.getNumPartitions() == 1
    assert store.read().filter("image_id IN ('k0000001', 'k0999999', 'zz')").count() == 2
    assert store.read().filter("image_id >= 'k0999990' AND image_id < 'k0999995'").count() == 5
    assert store.read().filter("image_id > 'zz'").count() == 0
