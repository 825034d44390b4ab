import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumtab.llm import substring_dedup
from quorumtab.llm.common import kept_buckets
from quorumtab.llm.substring_dedup import deduped, op7_substring_dedup, packed, unpacked


def plain(rows, size=20):
    """Windows in the order of documents, each word covered by one that was seen before removed."""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            if g in seen:
                gone.update(range(i, i + size))
            seen.add(g)
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(500)]
    passages = [rng.choices(vocab, k=n) for n in (19, 20, 21, 60, 200)]
    rows = []
    for d in rng.sample(range(10_000), 300):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += rng.choice(passages) if rng.random() < 0.4 else rng.choices(vocab, k=rng.randrange(1, 60))
        rows.append((d, rng.choice([" ", "\n", " \t"]).join(w)))
    copies = [(20_000 + i, rows[0][1]) for i in range(150)]
    return rows + copies + [(30_000, None), (30_001, ""), (30_002, "a " * 500), (30_003, "é ü " * 30_000), (None, rows[1][1])]


@pytest.mark.parametrize("bucket", [8 << 20, 20_000])
def test_equals_plain_scan(spark, monkeypatch, bucket):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", bucket)
    rows = fixture()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, k string").withColumnRenamed("k", "bucket")
    got = sorted((tuple(r) for r in deduped(df).collect()), key=str)
    assert got == plain(rows)


@pytest.mark.parametrize("cells", [1, 4])
def test_repeated_rows_and_shared_ids(spark, monkeypatch, cells):
    monkeypatch.setattr(substring_dedup, "CELLS", cells)  # few counters: many false estimates, the same result
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(300)]
    shared = rng.choices(vocab, k=40)
    rows = [(d, " ".join(rng.choices(vocab, k=30) + shared * (d % 2))) for d in range(40)]
    rows += [(5, rows[5][1])] * 2 + [(100, " ".join(rng.choices(vocab, k=25)))] * 3 + [(None, " ".join(shared))] * 2
    got = sorted((tuple(r) for r in deduped(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == plain(rows)


def test_counters_add_up_and_saturate():
    rng = np.random.default_rng(2)
    parts = [np.sort(rng.integers(0, 500, 60)) for _ in range(9)]
    want = np.minimum(np.bincount(np.concatenate(parts), minlength=600), 2)
    assert (substring_dedup.counters(parts, 600) == want).all()


def test_documents_are_shuffled_once(spark, sf_dir):
    plan = deduped(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(slot") == 1


def test_query_equals_plain_scan(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = sorted((d, n, gone, hashlib.sha256(t.encode()).hexdigest()) for d, n, gone, t in plain(rows))
    assert sorted(tuple(r) for r in op7_substring_dedup(spark, sf_dir).collect()) == want


def test_packed_numbers():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 50, 5000))
    x = np.sort(np.concatenate([x, x[:100], [0, 127, 128, 1 << 40]]))
    assert (unpacked(packed(x)) == x).all() and len(unpacked(packed(x[:0]))) == 0


def test_empty_table(spark):
    assert deduped(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_catalog_entry_nor_setting_is_left_and_buckets_stay(spark):
    setting = "spark.sql.sources.bucketing.maxBuckets"
    before, tables = spark.conf.get(setting), spark.catalog.listTables()
    spark.conf.set(setting, "4")
    try:
        rows = spark.range(1000).withColumn("bucket", F.pmod("id", F.lit(8)))
        kept = kept_buckets(rows.repartition(8, "bucket"), 8, "bucket", "slot", "t")
        assert spark.conf.get(setting) == "4" and spark.catalog.listTables() == tables
        counted = kept.groupBy("slot").count()
        assert sorted(r["count"] for r in counted.collect()) == [125] * 8
        assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(setting, before)
