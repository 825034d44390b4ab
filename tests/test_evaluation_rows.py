"""Scores of pairs of tables as rows (F3 to F7): the same as over long datapoints, and like key lists are matched once."""

from pyspark.sql import functions as F

from quorumtab.operators import evaluation
from quorumtab.operators.tables import plain_table

TEXTS = ["", "a", "title\tx y\n\tb\tc\n1\t2\t3", "q\tb\tb\nr\t1\t2\nr\t3\t4\ns\t5", "q\tb\nr\t1\t9\t8\n\nr\t7\n", "k\tb\tc\nrow\t10\t2%\nrom\tx\t3"]


def test_points_equal_datapoints(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").withColumn("table", plain_table(F.col("text")))
    want = sorted((r.i, r.pos, r.key, r.value) for r in evaluation.datapoints(df, ["i"]).collect())
    got = [(r.i, d.pos, d.key, d.value) for r in df.select("i", evaluation._points(F.col("table")).alias("d")).collect() for d in r.d]
    assert sorted(got) == want


def test_rows_equal_long_tables(spark):
    rows = [(f"{i}-{j}", a, b) for i, a in enumerate(TEXTS) for j, b in enumerate(TEXTS)]
    flat = spark.createDataFrame(rows, "pair_id string, a string, b string").select("pair_id", plain_table(F.col("a")).alias("a"), plain_table(F.col("b")).alias("b"))
    long = evaluation.scores(evaluation.datapoints(flat, ["pair_id"], "a"), evaluation.datapoints(flat, ["pair_id"], "b"), ["pair_id"])
    told = flat.select("pair_id", evaluation._points(F.col("a")).alias("t"), evaluation._points(F.col("b")).alias("p"))
    ours = evaluation._row_scores(told, ["pair_id"], 0.5, 0.1, "match")
    key = lambda r: [r.pair_id, *(round(x, 9) for x in r[1:])]
    assert sorted(map(key, ours.select(*long.columns).collect())) == sorted(map(key, long.collect()))


def test_like_key_lists_are_matched_once(spark, monkeypatch):
    seen = []
    anls = evaluation.anls
    monkeypatch.setattr(evaluation, "anls", lambda *x: seen.append(1) or anls(*x))
    t = [(0, "row b", "1"), (1, "row c", "2")]
    p = [(0, "rom b", "1"), (1, "row d", "2")]
    rows = spark.createDataFrame([(i, t, p) for i in range(500)], "i int, t array<struct<pos:int,key:string,value:string>>, p array<struct<pos:int,key:string,value:string>>")
    out = evaluation._picked(rows, 0.5)
    assert seen and out.count() == 500 and out.select(F.to_json("picked")).distinct().count() == 1
    assert "Aggregate [t_keys" in out._jdf.queryExecution().optimizedPlan().toString()
