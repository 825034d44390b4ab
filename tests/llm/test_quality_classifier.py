import zlib

import numpy as np

from quorumtab.llm import quality_classifier as q


def test_held_out_documents_are_told_apart(spark, sf_dir):
    out = q.op8_quality_classifier(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out").collect()
    good, bad = [r.score for r in out if r.quality == 1], [r.score for r in out if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.93 and np.mean([g >= q.THRESHOLD for g in good]) > 0.97
    assert all(r.predicted == (r.score >= q.THRESHOLD) and 0 <= r.score <= 1 for r in out)


def test_votes_equal_plain_loops(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = q.fit(docs.select("doc_id", "text"), labels.select("doc_id", labels.quality.alias("label")))
    terms = q.Terms()
    texts = [r.text.encode() for r in docs.limit(40).collect()]
    fast = q.voted(model, np.stack([terms(t) for t in texts]))
    for t, got in zip(texts, fast):
        row = [np.log1p(c) * w for c, w in zip(q.Terms()(t).tolist(), model["idf"].tolist())]
        v = np.array(row) @ model["projection"]
        sims = sorted(((float(v @ x) / np.linalg.norm(v), y) for x, y in zip(model["vectors"], model["votes"])), reverse=True)[: q.K]
        weight = [max(s, 1e-3) ** q.POWER for s, _ in sims]
        assert abs(got - sum(w * y for w, (_, y) in zip(weight, sims)) / sum(weight)) < 1e-3


def test_labels_of_the_held_out_fold_are_not_used(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = [r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    other = labels.withColumn("quality", q.F.when(labels.doc_id.isin(held), 1 - labels.quality).otherwise(labels.quality))
    assert sorted(q.scored(docs, labels).collect()) == sorted(q.scored(docs, other).collect())


def test_odd_rows(spark):
    rows = [(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (None, "a b", "x"), (1, "a b", "x"), (4, "w " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score string").withColumnRenamed("Score", "score")
    none = spark.createDataFrame([], "doc_id long, quality int, text string")
    assert sorted(r.score for r in q.scored(docs, none).collect()) == [0.5] * 6
    some = spark.createDataFrame([(1, 1, "t"), (1, 0, "t"), (4, 0, "t"), (77, 1, "gone"), (None, 1, "t"), (2, None, "t")], "doc_id long, quality int, text string")
    out = q.scored(docs, some).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 1}) == 1
    assert q.scored(docs.limit(0), some).count() == 0


def test_an_id_is_learnt_from_once(spark):
    copies = [(3, f"text number {i} of one id") for i in range(400)] + [(3, "the same again")] * 600
    rows = [(i, f"fine words {i}") for i in range(10, 40)]
    docs = spark.createDataFrame(copies + rows, "doc_id long, text string").repartition(16)
    labels = spark.createDataFrame([(3, 0)] + [(i, 1) for i, _ in rows], "doc_id long, label int")
    model = q.fit(docs, labels)
    used = [i for i in [3] + [i for i, _ in rows] if zlib.crc32(str(i).encode()) % 5]
    assert len(model["votes"]) == len(used) and 3 in used and (model["votes"] == 0).sum() == 1
    assert np.array_equal(model["vectors"], q.fit(docs.repartition(5), labels)["vectors"])
