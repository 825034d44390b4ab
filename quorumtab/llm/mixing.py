"""Mixing sources to target weights.

Token counts are aggregated per source, each source gets a target number of tokens and from it a repetition rate, and
each document is emitted floor(rate) times plus once more with the fraction's probability, drawn from a seeded hash of
its id; so reruns agree, and rows with one id draw alike.

Targets: sources ordered by code point, null last, weigh `weights`, repeating, and share `share` of all tokens; no
target exceeds `limit` times its source's size, and what is cut off is shared again by weight until none is above.

A null or blank text has size 0; a null source is a source of its own; a source without words has target 0 and rate 0.
An empty table gives an empty result. Only sums per source travel, so one source may hold most rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumtab.llm.common import kept, pick, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0
SEED = "mix-1"
#: Up to this many sources the plan is broadcast (about 60 bytes a source); more take a shuffled join.
BROADCAST_SOURCES = 100_000


def ranked(sizes: DataFrame) -> DataFrame:
    """Sources with their place in code-point order, null last, counted over sorted ranges: no single task sees them all."""
    ranges = sizes.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    numbered = kept(ranges.withColumn("seen", F.monotonically_increasing_id()), "mix-ranks")
    part, at = F.shiftright("seen", 33), F.col("seen").bitwiseAND((1 << 33) - 1)
    tops = numbered.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row a range, not a source
    before, so_far = {}, 0
    for r in tops:
        before[r.part], so_far = so_far, so_far + r["count"]
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map().cast("map<bigint,int>")
    return numbered.withColumn("rank", at + F.try_element_at(offset, part)).drop("seen")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """sizes (source, source_size) with target and rate: shares by weight, capped, the excess shared again."""
    plan = ranked(sizes)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("rank", F.lit(len(weights))).cast("int") + 1)
    plan = plan.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(limit))
    total = plan.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while total:  # tokens a unit of weight gets; it only rises, and each round caps at least one more source
        capped = F.col("most") <= F.lit(level) * F.col("weight")
        cut, rest = plan.agg(F.sum(F.when(capped, F.col("most"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if not rest:
            break
        raised = max(0.0, share * total - (cut or 0.0)) / rest
        if raised <= level:
            break
        level = raised
    plan = plan.withColumn("target", F.least(F.col("most"), F.lit(level) * F.col("weight")))
    return plan.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id alone: 32 bits of an MD5, which other engines can repeat."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def copies_of(docs: DataFrame, plan: DataFrame, seed: str = SEED) -> DataFrame:
    """docs (source, doc_id, ...) with its source's target and copies, the number of times that it is emitted."""
    plan = plan.select(F.col("source").alias("plan_source"), "source_size", "target", "rate")
    if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    both = docs.join(plan, F.col("source").eqNullSafe(F.col("plan_source")), "left").drop("plan_source")
    whole = F.floor("rate")
    return both.withColumn("copies", (whole + (draw(F.col("doc_id"), seed) < F.col("rate") - whole).cast("long")).cast("long")).drop("rate")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (tokens that the mix takes), copies."""
    rows = pick(docs, "doc_id", "source", "text").select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    rows = kept(rows, "mix-sizes")  # a few bytes a document, so the texts are read once
    plan = kept(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit), "mix-plan")
    out = copies_of(rows, plan, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def emitted(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: str = SEED) -> DataFrame:
    """The mix itself: documents with all their columns, each as many times as it is taken."""
    cols, own = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    at = {c: F.col(own[cols.index(c)]) for c in ("doc_id", "source", "text")}
    sizes = pick(docs, "source", "text").groupBy("source").agg(F.sum(F.size(words(F.col("text")))).cast("long").alias("source_size"))
    plan = kept(targets(sizes, weights, share, limit), "mix-plan")
    rows = docs.toDF(*own).withColumns({"doc_id": at["doc_id"], "source": at["source"]})
    out = copies_of(rows, plan, seed).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*own).toDF(*cols)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source),
r AS (  -- sources by the level at which they are capped; those before are capped, the rest share what is left
  SELECT *, 2.0 * source_size AS most, 2.0 * source_size / weight AS cap_level,
         1.5 * sum(source_size) OVER () AS total,
         coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_before,
         sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM s),
l AS (SELECT arg_min((total - capped_before) / weight_left, cap_level) FILTER (WHERE (total - capped_before) / weight_left <= cap_level) AS level FROM r),
p AS (SELECT source, source_size, CAST(least(most, coalesce(level, 1e300) * weight) AS DOUBLE) AS target FROM r, l),
c AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0.0 END AS rate,
         CAST('0x' || left(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':mix-1'), 8) AS BIGINT) / 4294967296.0 AS draw
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM c
"""
