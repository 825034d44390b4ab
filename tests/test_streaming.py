import random

from pyspark.sql import functions as F

from quorumtab.operators import strategies
from quorumtab.streaming.consensus import PROVIDER, incremental
from quorumtab.streaming.online import converging


def test_stream_converges_once(spark, tmp_path):
    schema = "image_id string, sample_idx int, tsv_data string"
    batches = [[("a", 0, "x"), ("b", 0, "p")], [("a", 1, "y"), ("b", 1, " ")], [("a", 2, "y"), ("b", 2, "q")], [("a", 3, "z"), ("b", 3, None)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = converging(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
        query.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 1, 0, False), ("a", 2, 0, False), ("a", 3, 1, True), ("b", 1, 0, False), ("b", 3, 0, False)]


def test_consensus_on_a_stream_equals_the_replay(spark, tmp_path):
    """Batches of two samples a chart; charts that settle, that don't, blank and late samples; state of settled charts is gone."""
    rng = random.Random(2)
    rows = []
    for c in range(12):
        for i in range(8):
            base = [1, 2] if c % 3 == 0 else [rng.randint(1, 3), rng.randint(1, 99)]
            text = None if (c + i) % 7 == 0 else f'\ta\t"b"\n2000\t{base[0]}\t{base[1]}\n2001\t{base[1]}\tn/a'
            rows.append((f"c{c}", i, text, 3, 4))
    rows += [("short", 0, "\ta\nx\t1", 1, 1), ("blank", 0, " ", 1, 1)]
    schema = "image_id string, sample_idx int, tsv_data string, input_tokens long, output_tokens long"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        for k in range(0, 8, 2):
            spark.createDataFrame([r for r in rows if r[1] in (k, k + 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = incremental(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
            query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
            query = query.foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(str(tmp_path / "out"))).start()
            query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    out = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r.batch):
        assert not out.get(r.image_id, (None, False))[1]  # nothing after it has settled
        out[r.image_id] = tuple(r)[1:-1]
    want = {r.image_id: (r.tsv_data, r.converged, r.convergence_iteration, r.num_samples, r.total_input_tokens, r.total_output_tokens) for r in strategies.incremental(spark.createDataFrame(rows, schema)).collect()}
    assert out == want and {v[1] for v in want.values()} == {True, False}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    left = spark.read.format("statestore").option("stateVarName", "chart").load(str(tmp_path / "state")).select("key.*").collect()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert {r[0] for r in left} == {k for k, v in want.items() if not v[1]}
