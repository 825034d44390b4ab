"""A trie of conversations that share their first turns, with sums over subtrees by heavy-path decomposition.

A node is a sequence of turns (role, text) that some conversation starts with. Texts stay where they are: a turn is its
SHA-256 and its size. A conversation's prefixes are numbered by running sums of 128-bit hashes of place and turn, so that
also a very long conversation is cut over many tasks; each node is then checked to have one last turn and one parent in all
its members, so equal numbers are equal sequences.

Each node's largest child (most members, then the smallest member) continues its path, other children begin paths of their
own. A path is the end of the smallest member of the childless node that it leads to. Subtree sums are suffix sums along
the paths: those below the most light edges first, each path's total then goes to its parent on another path. As a light
edge at least halves the members, there are logarithmically many rounds.

Null roles and texts are empty; a null turn comes first, and rows of one turn are ordered by role, the first 64 characters
of the text and its hash, and all kept, repeated rows too. Rows without conv_id belong to no conversation and are left out. An empty
table has no nodes. Other columns are ignored, also those that share a name but for its case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumtab.llm.common import kept, pick, shared_path, sql_crc32
from quorumtab.llm.ordered import columns, looked_up, ones, running

NODE = ["k1", "k2"]
PARENT = ["p1", "p2"]
SHARED = 8
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(table: DataFrame) -> DataFrame:
    """Turns in order: conv_id, pos (from 1), said (hash of role and text), bytes (of the text)."""
    rows = pick(table, "conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL")
    rows = rows.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    flat = kept(rows.select("conv_id", "turn", "role", F.substring("text", 1, 64).alias("head"), said.alias("said"), F.octet_length("text").cast("long").alias("bytes")), "turns")
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("head").asc(), F.col("said").asc()]
    return running(flat, "conv_id", order, ones, ["pos"], "numbered").select("conv_id", "pos", "said", "bytes")


def plain(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are, for trie(): turns and conversations."""
    rows = kept(numbered(table).withColumnRenamed("pos", "depth"), "plain")
    return rows, kept(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size")), "conversations")


def rebuilt(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversation c as the first h turns of c - c % 5 and its own after its first h, with h = crc32(c) % 9, for trie()."""
    turns = numbered(table)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1)
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({"base": F.col("conv_id") - F.col("conv_id") % 5, "h": h})
    bases = sizes.filter("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.least("n", F.lit(SHARED)).alias("has"))
    p = F.least("h", F.coalesce("has", F.lit(0)))
    plans = sizes.join(bases, "base", "left").select("conv_id", "base", "n", p.alias("p"), (p + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"))
    plans = kept(plans, "plans")
    total = plans.agg(F.sum("n")).first()[0] or 0
    heads = turns.filter(f"conv_id % 5 = 0 AND pos <= {SHARED}").select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "said", "bytes")
    front = plans.filter("p > 0").join(heads, "base").filter("depth <= p").select("conv_id", "depth", "said", "bytes")
    own = looked_up(turns.withColumn("h", h).filter("pos > h"), plans.select("conv_id", "p", "n"), ["conv_id"], "n", total)
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("p")).alias("depth"), "said", "bytes")
    return kept(front.unionByName(own), "rebuilt"), plans.select("conv_id", "size")


def _places(batch: pa.RecordBatch) -> np.ndarray:
    """128 bits of the hash of each turn and its place."""
    told = zip(batch.column("depth").to_pylist(), batch.column("said").to_pylist())
    data = b"".join([hashlib.sha256(f"{d}:{said}".encode()).digest()[:16] for d, said in told])
    return np.frombuffer(data, "<i8").reshape(-1, 2)


def _nodes(rows: DataFrame) -> DataFrame:
    """One row per node but the root: k1, k2, p1, p2 (its parent's), conv_id, depth, n_convs, bytes."""
    parent = F.struct(*PARENT)
    mixed = (F.min("said") != F.max("said")) | (F.min(parent) != F.max(parent)) | (F.min("depth") != F.max("depth"))
    depth = F.when(mixed, F.raise_error(F.lit("two sequences of turns have one hash")).cast("long")).otherwise(F.min("depth"))
    found = rows.groupBy(*NODE).agg(depth.alias("depth"), F.min(parent).alias("up"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"))
    return found.select(*NODE, "up.*", "conv_id", "depth", "n_convs", "bytes")


def hashed_ids(ends: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256: the hash of the conv_ids of each node in order, joined by commas, whatever their number.

    Ids are sorted by range, so those of one node may lie in many tasks; each writes texts of at most a batch of ids, and
    these go through a running hash in order.
    """
    order = [*NODE, "conv_id"]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                k1, k2, ids = (b.column(c).to_numpy() for c in order)
                cuts = [0, *(np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1), b.num_rows]
                told = [",".join(map(str, ids[x:y].tolist())) for x, y in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(k1[cuts[:-1]]), pa.array(k2[cuts[:-1]]), pa.array(ids[cuts[:-1]]), pa.array(told)], [*order, "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running_ = None, None
        for b in batches:
            out = []
            for k1, k2, told in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids"))):
                if now != (k1, k2):
                    if now:
                        out.append((*now, running_.hexdigest()))
                    now, running_ = (k1, k2), hashlib.sha256(told.encode())
                else:
                    running_.update(b"," + told.encode())
            yield made(out)
        if now:
            yield made([(*now, running_.hexdigest())])

    def made(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], [*NODE, "ends_sha256"])

    parts = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(texts, "k1 bigint, k2 bigint, conv_id bigint, ids string")
    return parts.repartition(*NODE).sortWithinPartitions(*order).select(*NODE, "ids").mapInArrow(hashes, "k1 bigint, k2 bigint, ends_sha256 string")


def _paths(rows: DataFrame, nodes: DataFrame, total: int) -> str:
    """Writes each node once, on its heavy path: conv_id (the path), depth, light edges above it as level=, light at its top."""
    ends = nodes.filter("n_children = 0").select("conv_id", F.col("depth").alias("weight"))  # a row for each node above
    along = looked_up(rows.select("conv_id", "depth", *NODE), ends, ["conv_id"], "weight", total)
    told = nodes.select(*NODE, *PARENT, F.col("light").cast("int").alias("light"), "n_children", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), F.col("n_convs").alias("weight"))
    along = kept(looked_up(along, told, NODE, "weight", total), "along")
    below = running(along, "conv_id", [F.col("depth").desc()], columns("light"), ["lights"], "lights").filter("lights_before = 0")
    levels = along.groupBy("conv_id").agg(F.sum("light").alias("level"), F.count(F.lit(1)).alias("weight"))
    path = shared_path(rows.sparkSession, "paths")
    leaves = (F.col("n_children") == 0).cast("long").alias("leaves")
    looked_up(below, levels, ["conv_id"], "weight", total).select("conv_id", "depth", *NODE, *PARENT, "light", leaves, "saved", "level").write.partitionBy("level").parquet(path)
    return path


def _subtrees(spark: SparkSession, path: str) -> tuple[list[DataFrame], DataFrame | None]:
    """Sums over subtrees (k1, k2, leaves, saved), a table for each round, and what the last paths bring to the root."""
    schema = "conv_id bigint, depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, light int, leaves bigint, saved bigint, level bigint"
    paths = spark.read.schema(schema).parquet(path)
    done, brought = [], None
    for level in range(paths.agg(F.max("level")).first()[0] or 0, 0, -1):
        rows = paths.filter(F.col("level") == level)
        if brought is not None:
            rows = rows.join(brought, NODE, "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}).drop("more_leaves", "more_saved")
        sums = running(kept(rows, f"level-{level}"), "conv_id", [F.col("depth").desc()], columns("leaves", "saved"), ["all_leaves", "all_saved"], f"sums-{level}")
        done.append(sums.select(*NODE, F.col("all_leaves").alias("n_leaves"), F.col("all_saved").alias("saved_tokens")))
        tops = sums.filter("light = 1").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"))
        brought = tops.agg(F.sum("all_leaves").alias("more_leaves"), F.sum("all_saved").alias("more_saved"))
    return done, brought


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of conversations' prefixes. turns: conv_id, depth (from 1), said, bytes; convs: conv_id, size (turns); kept() tables.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = turns.sparkSession
    top = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.sum("size").alias("total")).first()
    total = top.total or 0
    rows = running(turns, "conv_id", [F.col("depth").asc()], _places, NODE, "prefixes").withColumnsRenamed({"k1_before": "p1", "k2_before": "p2"})
    rows = kept(rows, "members")
    nodes = kept(_nodes(rows), "nodes")
    families = nodes.groupBy(*PARENT).agg(F.count(F.lit(1)).alias("n_children"), F.max_by(F.struct(*NODE), F.struct("n_convs", -F.col("conv_id"))).alias("heavy"))
    families = kept(families, "families")
    nodes = nodes.join(families.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children"), NODE, "left").join(families.select("heavy.*", F.lit(True).alias("heavy")), NODE, "left")
    light = (F.col("depth") == 1) | F.col("heavy").isNull()  # the root, which has no turn, is a path by itself
    nodes = kept(nodes.withColumns({"n_children": F.coalesce("n_children", F.lit(0)).cast("long"), "light": light}).drop("heavy"), "children")
    sums, brought = _subtrees(spark, _paths(rows, nodes, total))
    at_root = brought.filter("k1 = 0 AND k2 = 0").first() if brought is not None else None
    first = families.filter("p1 = 0 AND p2 = 0").select("n_children").first()

    ends = rows.join(convs.withColumnRenamed("size", "depth"), ["conv_id", "depth"]).select(*NODE, "conv_id")
    none = convs.filter("size = 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id")
    ends = hashed_ids(kept(ends.unionByName(none), "ends"))
    root = [(0, 0, None, None, top.conv_id, 0, top.n, first.n_children if first else 0)] if top.n else []
    root = spark.createDataFrame(root, "k1 long, k2 long, p1 long, p2 long, conv_id long, depth long, n_convs long, n_children long")
    root_sums = spark.createDataFrame([(0, 0, *((at_root.more_leaves, at_root.more_saved) if at_root else (1, 0)))], "k1 long, k2 long, n_leaves long, saved_tokens long")
    all_sums = root_sums
    for more in sums:
        all_sums = all_sums.unionByName(more)
    every = nodes.select(*root.columns).unionByName(root)
    out = every.join(all_sums, NODE).join(ends, NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    parents = every.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    out = kept(out, "summed")
    known = looked_up(out.filter("depth > 0"), parents.withColumnRenamed("n_children", "weight"), PARENT, "weight", nodes.count())
    known = known.unionByName(out.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return known.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, strlen(coalesce(text, '')) AS bytes, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), left(coalesce(text, ''), 64), said) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, {sql_crc32("conv_id")} % {SHARED + 1} AS h, conv_id - conv_id % 5 AS base FROM t GROUP BY conv_id),
p AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS p FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (
  SELECT p.conv_id, pos AS d, said, bytes FROM p JOIN t ON t.conv_id = base AND pos <= p
  UNION ALL SELECT t.conv_id, pos - h + p, said, bytes FROM t JOIN p USING (conv_id) WHERE pos > h),
k AS (SELECT conv_id, d, bytes, sha256(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM r),
x AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY conv_id ORDER BY d), 'root') AS parent FROM k UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM p),
n AS (SELECT k, min(conv_id) AS conv_id, any_value(d) AS depth, any_value(parent) AS parent, count(*) AS n_convs, any_value(bytes) AS bytes FROM x GROUP BY k),
ch AS (SELECT parent AS k, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
s AS (
  SELECT a.k, CAST(sum((n.n_convs - 1) * n.bytes) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE ch.k IS NULL) AS n_leaves
  FROM n JOIN x a ON a.conv_id = n.conv_id AND a.d <= n.depth LEFT JOIN ch ON ch.k = n.k GROUP BY a.k),
e AS (
  SELECT k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS last FROM x) WHERE d = last GROUP BY k)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(ch.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM n JOIN s USING (k) LEFT JOIN ch USING (k) LEFT JOIN e USING (k) LEFT JOIN n u ON u.k = n.parent"""
