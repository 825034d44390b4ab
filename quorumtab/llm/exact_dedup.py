"""Exact duplicates by a content sort.

Sampled splitters range-partition the rows by the head of their normalised text (HEAD characters, so that splitters have a
bounded size however long texts are), every partition is sorted externally by the whole normalised text, so that equal
texts stand next to each other, and neighbours are compared in full.

Only where one head or one text has more rows than its share of a partition are rows told apart further. A hot head is
cut by a hash of the whole text, which equal texts share (it comes from a coarser folding than the normalisation). A text
with so many copies is dealt by its ids, so its copies lie in as many ranges as they need; each range then has one best
row for it, and those few are compared by digest. Hot heads and texts are found by one count of hashes with partial
aggregation; there are at most four for each partition, so they are broadcast.

Null counts as empty; empty texts are one group. Of rows with one id and one text all are returned and one of them is
kept when that id is the group's. An empty table gives an empty result. content_sort() ignores other columns; survivors()
carries them along, and gives a null text that stays back as an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumtab.llm.common import kept, lower_ascii, pick, task_count, whole

HEAD = 64
#: A partition's share of the rows is never set lower than this.
LEAST_SHARE = 64


def _hot(rows: DataFrame, head: Column, fold: Column) -> DataFrame:
    """(hot, ways): hashes of heads and of texts with more rows than a share, and into how many parts they are dealt."""
    share = max(LEAST_SHARE, rows.count() // (2 * task_count(rows.sparkSession)))
    counts = rows.select(F.explode(F.array(head, fold)).alias("hot")).groupBy("hot").count().filter(F.col("count") > share)
    return kept(counts.select("hot", F.ceil(F.col("count") / share).cast("int").alias("ways")), "dedup-hot")


def _runs(rows: DataFrame, keep: str, carried: list[str]) -> DataFrame:
    """rows (doc_id, text, carried...) with keep_id, group_size, text_sha256, parts (null: the text isn't hot), and place: 1 for the best row here."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = rows.withColumn("text", whole(F.col("text")))
    rows = rows.withColumn("head", lower_ascii(F.substring("text", 1, HEAD))).withColumn("fold", F.xxhash64(F.lower("text")))
    head = F.xxhash64("head", F.lit("head"))
    hot = F.broadcast(_hot(rows, head, F.col("fold")))
    rows = rows.withColumn("head_hash", head).join(hot.select(F.col("hot").alias("head_hash"), F.col("ways").alias("cuts")), "head_hash", "left")
    rows = rows.join(hot.select(F.col("hot").alias("fold"), F.col("ways").alias("parts")), "fold", "left")
    rows = rows.withColumn("cut", F.coalesce(F.pmod("fold", F.col("cuts")), F.lit(0)).cast("int"))
    rows = rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")) + 1, F.lit(0)).cast("int"))

    key = ["head", "cut", "part"]
    ranged = rows.repartitionByRange(*key).withColumn("norm", lower_ascii(F.col("text")))
    sort = Window.partitionBy(*key).orderBy("norm")
    run = Window.partitionBy(*key, "run")
    first = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    return (
        ranged.withColumn("starts", F.coalesce((F.lag("norm").over(sort) != F.col("norm")).cast("int"), F.lit(0)))
        .withColumn("run", F.sum("starts").over(sort.rowsBetween(Window.unboundedPreceding, 0)))
        .select("doc_id", *carried, *key, "run", "parts", F.sha2("norm", 256).alias("text_sha256"))
        .withColumn("place", F.row_number().over(run.orderBy(first)))
        .withColumn("keep_id", best("doc_id").over(run))
        .withColumn("group_size", F.count(F.lit(1)).over(run))
        .drop(*key, "run")
    )


def _whole_groups(runs: DataFrame, keep: str) -> DataFrame:
    """_runs() rows, kept, with keep_id and group_size over all parts of a hot text: at most two parts a partition in all."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    parts = runs.filter((F.col("place") == 1) & F.col("parts").isNotNull()).groupBy("text_sha256")
    totals = parts.agg(best("keep_id").alias("all_id"), F.sum("group_size").alias("all_size"))
    both = runs.join(F.broadcast(totals), "text_sha256", "left")
    both = both.withColumn("keep_id", F.when(F.col("all_size").isNull(), F.col("keep_id")).otherwise(F.col("all_id")))
    return both.withColumn("group_size", F.coalesce("all_size", "group_size")).drop("all_id", "all_size")


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    keep: "smallest" or "largest" id of a group of equal texts stays.
    """
    out = _whole_groups(kept(_runs(pick(docs, doc_id=id_col, text=text_col), keep, []), "dedup-runs"), keep)
    stays = (F.col("place") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256")


def survivors(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The documents that stay, with all their columns: one row of each group of equal texts, also where rows repeat."""
    cols, own = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*own)
    rows = rows.withColumns({"doc_id": F.col(own[cols.index("doc_id")]), "text": F.col(own[cols.index("text")])})
    rows = rows.drop(own[cols.index("text")])
    carried = [c for c in own if c != own[cols.index("text")]] + ["text"]
    out = kept(_runs(rows, keep, carried).filter("place = 1"), "dedup-runs")
    out = _whole_groups(out, keep).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return out.select(*[F.col("text" if c == "text" else o).alias(c) for c, o in zip(cols, own)])


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


ORACLE = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AND row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
