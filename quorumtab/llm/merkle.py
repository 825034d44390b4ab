"""A Merkle manifest of a dataset, its nodes in a Parquet folder by level.

Every row is a leaf: the SHA-256 of its fields. Leaves are sorted by group and id in runs, each in one partition, and numbered
across the runs; so a node's coordinates are its group, its level and its place there. FAN consecutive nodes have one
parent. grown() writes leaves and levels into a node store (level=0, level=1, ...), each level made from the rows of the
level below, read once. The groups' roots are the leaves of one more tree of the same kind.

Proofs come from a merge-scan: leaves and the parents' rows, which hold their children, are dealt by blocks of consecutive
leaves and sorted by coordinate, a parent before what is under it. One pass keeps one row a level, and so has for each leaf
its siblings up to the root. Rows above a block are copied to each block under them, fewer than one for its every leaf.

Null fields are "-". Rows with equal ids are ordered by their leaf hashes, repeated rows are leaves each by itself; null
ids come first, null groups are a group of their own that comes first. An empty table gives an empty result. Other columns
are ignored, also those that share a name but for its case.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumtab.llm.common import kept, lower_ascii, pick, shared_path, sql_crc32
from quorumtab.llm.ordered import ones, running

FAN = 8
BLOCK_LEVELS = 4
PATH = "array<struct<slot:int,children:array<string>>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 of the fields in turn: "-" for null, else the bytes of its UTF-8 form, a colon and that."""
    parts = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in (c.cast("string") for c in fields)]
    return F.sha2(F.concat(*parts), 256)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def group_key(group: Column) -> Column:
    """A group as text that sorts null first and then by bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


@dataclass(frozen=True)
class Store:
    """A node store: its folder, the highest level, and the number of leaves of the largest group."""

    spark: SparkSession
    path: str
    height: int
    width: int

    def level(self, k: int, more: str = "children array<string>") -> DataFrame:
        return self.spark.read.schema(f"group string, at bigint, digest string, {more}").parquet(f"{self.path}/level={k}")

    def roots(self) -> DataFrame:
        """group, root: the first node of a group's highest level."""
        firsts = [self.level(k).filter("at = 0").select("group", "digest", F.lit(k).alias("level")) for k in range(self.height + 1)]
        return reduce(DataFrame.unionByName, firsts).groupBy("group").agg(F.max_by("digest", "level").alias("root"))


def grown(leaves: DataFrame, order: list[Column], name: str) -> Store:
    """Writes a tree for each group of leaves (group, leaf, and columns to carry; a kept() table).

    All levels have group, at (place in the level) and digest; level 0 has what is carried besides, the others children
    (digests of the nodes below). A group ends at the level where it has one node.
    """
    spark, path = leaves.sparkSession, shared_path(leaves.sparkSession, name)
    placed = running(leaves, "group", order, ones, ["n"], f"{name}-runs")
    carry = [c for c in leaves.columns if c not in ("group", "leaf")]
    placed.select("group", F.col("n_before").alias("at"), F.col("leaf").alias("digest"), *carry).write.parquet(f"{path}/level=0")
    wide = (spark.read.schema("at bigint").parquet(f"{path}/level=0").agg(F.max("at")).first()[0] or 0) + 1
    store, nodes = Store(spark, path, 0, wide), wide
    while nodes > 1:
        one = F.struct(F.col("at").alias("of"), "digest")
        runs = store.level(store.height).groupBy("group", F.floor(F.col("at") / FAN).cast("long").alias("at")).agg(F.array_sort(F.collect_list(one)).alias("run"))
        runs = runs.filter((F.col("at") > 0) | (F.size("run") > 1))  # a node alone in its level is its group's root
        runs = runs.select("group", "at", F.transform("run", lambda x: x["digest"]).alias("children"))
        store, nodes = Store(spark, path, store.height + 1, wide), -(-nodes // FAN)
        runs.select("group", "at", F.sha2(F.array_join("children", ""), 256).alias("digest"), "children").write.parquet(f"{path}/level={store.height}")
    return store


def _coordinates(store: Store, leaves: DataFrame, above: DataFrame | None, block_levels: int) -> DataFrame:
    """Heads of blocks, parents and leaves as rows with group, block, coord (of the first leaf below) and level."""
    block = FAN**block_levels
    of = lambda c: F.floor(F.col(c) / block).cast("long").alias("block")
    rows = leaves.filter(F.col("at") % block == 0).select("group", of("at"), F.col("at").alias("coord"), F.lit(store.height + 1).alias("level"))
    rows = rows.join(above, "group") if above is not None else rows.withColumn("path", F.array().cast(PATH))
    for k in range(1, store.height + 1):
        runs = store.level(k).select("group", F.lit(k).alias("level"), (F.col("at") * FAN**k).alias("coord"), "children")
        if k > block_levels:  # to each block below, as its first row
            first = F.floor(F.col("coord") / block).cast("long")
            under = F.sequence(first, F.least(first + FAN ** (k - block_levels), F.lit((store.width - 1) // block + 1)) - 1)
            runs = runs.withColumn("block", F.explode(under)).withColumn("coord", F.col("block") * block)
        else:
            runs = runs.withColumn("block", of("coord"))
        rows = rows.unionByName(runs, allowMissingColumns=True)
    own = [F.col(c).alias(f"own_{c}") for c in leaves.columns if c not in ("group", "at")]
    return rows.unionByName(leaves.select("group", of("at"), F.col("at").alias("coord"), F.lit(0).alias("level"), *own), allowMissingColumns=True)


def proven(store: Store, leaves: DataFrame, told: str | None = None, above: DataFrame | None = None, paths: bool = False, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """The leaves of a store's level 0 (group, at, digest, and what is carried) with proof_sha256, folded, and on demand path.

    A path has for each level, from the leaf's up to the root, the run of nodes and the slot that this one has in it. above,
    a table of group, path, and columns to carry, continues the paths of a group; groups that it lacks are left out.
    proof_sha256 is the hash of the runs' other nodes, level by level; folded is the root that they give with the leaf, or
    with what the column told has instead of it.
    """
    rows = _coordinates(store, leaves, above, block_levels)
    carry = [c for c in leaves.columns if c not in ("group", "at")]
    labels = [c for c in above.columns if c not in ("group", "path")] if above is not None else []
    rows = rows.repartition("group", "block").sortWithinPartitions("group", "block", "coord", F.col("level").desc())
    rows = rows.select("group", "coord", "level", *([] if store.height == 0 else ["children"]), "path", *labels, *[f"own_{c}" for c in carry])
    height = store.height

    def sides(run: list[str], slot: int) -> tuple[str, str]:
        return "".join(run[:slot]), "".join(run[slot + 1 :])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: dict = {}
        stack: dict[int, list[str]] = {}  # by level, the run that the scan is in
        under, way, upper, joined = None, [], [], ""
        for batch in batches:
            levels, coords = batch.column("level").to_pylist(), batch.column("coord").to_pylist()
            children = batch.column("children").to_pylist() if height else None
            digests, others = batch.column("own_digest").to_pylist(), batch.column(f"own_{told}").to_pylist() if told else None
            at, proofs, folds, ways, named = [], [], [], [], {c: [] for c in labels}
            for i, (k, coord) in enumerate(zip(levels, coords)):
                if k > height:
                    head, stack, under = {c: batch.column(c)[i].as_py() for c in ("path", *labels)}, {}, None
                elif k:
                    stack[k], under = children[i], None
                else:
                    if under != coord // FAN:  # what is above a run is the same for each of its nodes
                        under = coord // FAN
                        way = [(coord // FAN ** (j - 1) % FAN, stack[j]) for j in sorted(stack) if j > 1] + [(p["slot"], p["children"]) for p in head["path"]]
                        upper = [sides(run, slot) for slot, run in way]
                        joined = "".join(a + b for a, b in upper)
                    first = [(coord % FAN, stack[1])] if stack else []
                    lower = [sides(run, slot) for slot, run in first]
                    node = others[i] if others and others[i] is not None else digests[i]
                    for a, b in (*lower, *upper):
                        node = sha256(a + node + b)
                    at.append(i)
                    proofs.append(sha256("".join(a + b for a, b in lower) + joined))
                    folds.append(node)
                    if paths:
                        ways.append([{"slot": s, "children": run} for s, run in first + way])
                    for c in labels:
                        named[c].append(head[c])
            taken = batch.take(pa.array(at, pa.int64()))
            cols = [taken.column(f"own_{c}") for c in carry] + [pa.array(named[c], batch.schema.field(c).type) for c in labels]
            cols += [pa.array(proofs, pa.string()), pa.array(folds, pa.string())]
            if paths:
                cols.append(pa.array(ways, pa.list_(pa.struct([("slot", pa.int32()), ("children", pa.list_(pa.string()))]))))
            yield pa.RecordBatch.from_arrays([taken.column("group"), *cols], ["group", *carry, *labels, "proof_sha256", "folded", *(["path"] if paths else [])])

    kinds = [f"`{c}` {leaves.schema[c].dataType.simpleString()}" for c in carry] + [f"`{c}` {above.schema[c].dataType.simpleString()}" for c in labels]
    return rows.mapInArrow(scan, ", ".join(["group string", *kinds, "proof_sha256 string", "folded string", *([f"path {PATH}"] if paths else [])]))


def manifest(docs: DataFrame, group: str = "lang", fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", told: Column | None = None, paths: bool = False) -> DataFrame:
    """Each document's place in the manifest: id, leaf, subroot (its group's root), root, proof_sha256, folded_root, on demand path.

    told, an expression over the fields, is a leaf hash that is folded instead of the document's own where it isn't null.
    """
    rows = pick(docs, *dict.fromkeys((*fields, group, id_col)))
    leaf = leaf_hash(*[F.col(f) for f in fields])
    rows = rows.select(F.col(id_col).alias("id"), group_key(F.col(group)).alias("group"), leaf.alias("leaf"), (F.lit(None).cast("string") if told is None else told).alias("told"))
    store = grown(kept(rows, "leaves"), [F.col("id").asc_nulls_first(), F.col("leaf").asc()], "manifest")
    subroots = store.roots().select(F.lit("groups").alias("group"), F.col("root").alias("leaf"), F.col("group").alias("of"))
    upper = grown(kept(subroots, "subroots"), [F.col("of").asc()], "manifest-groups")
    root = upper.roots().first()
    tops = proven(upper, upper.level(0, "of string"), paths=True)
    above = kept(tops.select(F.col("of").alias("group"), F.col("digest").alias("subroot"), F.lit(root and root.root).alias("root"), "path"), "groups")
    leaves = store.level(0, f"id {rows.schema['id'].dataType.simpleString()}, told string")
    out = proven(store, leaves, "told", above, paths)
    return out.select("id", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", F.col("folded").alias("folded_root"), *(["path"] if paths else []))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents by lang, where tampering has put the texts of some ids in lower case (A-Z)."""
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    told = F.when(touched, leaf_hash(*[lower_ascii(F.col(f)) if f == "text" else F.col(f) for f in FIELDS]))
    out = manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), told=told)
    return out.withColumnRenamed("id", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


#: As many levels as that many leaves of a group need; where a group has one node, a level just passes it on.
_UP = """
{l}{k} AS (
  SELECT grp, nth // 8 AS nth, CASE WHEN any_value(total) > 1 THEN sha256(string_agg(digest, '' ORDER BY nth)) ELSE any_value(digest) END AS digest, any_value((total + 7) // 8) AS total
  FROM {l}{j} GROUP BY grp, nth // 8)"""
_PROOF = """
{p}{k} AS (
  SELECT p.rid, any_value(p.doc_id) AS doc_id, any_value(p.leaf) AS leaf, any_value(p.lang) AS lang, any_value(p.grp) AS grp, any_value(p.pos) AS pos,
         any_value(p.proof) || coalesce(string_agg(s.digest, '' ORDER BY s.nth) FILTER (WHERE s.nth <> p.pos // {w}), '') AS proof,
         CASE WHEN any_value(s.total) > 1 THEN sha256(string_agg(CASE WHEN s.nth = p.pos // {w} THEN p.told ELSE s.digest END, '' ORDER BY s.nth)) ELSE any_value(p.told) END AS told
  FROM {p}{j} p JOIN {l}{j} s ON s.grp = p.grp AND s.nth // 8 = p.pos // {w} // 8 GROUP BY p.rid)"""


def _sql_levels(l: str, p: str, levels: int) -> str:
    return ",".join(t.format(l=l, p=p, k=k, j=k - 1, w=8 ** (k - 1)) for k in range(1, levels + 1) for t in (_UP, _PROOF))


def _sql_leaf(text: str = "text") -> str:
    of = [f"CAST({c} AS VARCHAR)" if c != "text" else text for c in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in of) + ")"


ORACLE = f"""
WITH docs AS (SELECT *, row_number() OVER () AS rid, coalesce('=' || lang, '') AS grp, {_sql_leaf()} AS leaf FROM documents),
l0 AS (SELECT rid, grp, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nth, leaf AS digest, count(*) OVER (PARTITION BY grp) AS total FROM docs),
p0 AS (
  SELECT rid, doc_id, leaf, docs.grp AS lang, docs.grp, nth AS pos, '' AS proof,
         CASE WHEN {sql_crc32("doc_id")} % 3 = 0 THEN {_sql_leaf(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} ELSE leaf END AS told
  FROM docs JOIN l0 USING (rid)),{_sql_levels("l", "p", 6)},
g0 AS (SELECT 'groups' AS grp, grp AS lang, row_number() OVER (ORDER BY grp) - 1 AS nth, digest, count(*) OVER () AS total FROM l6),
q0 AS (SELECT p.* EXCLUDE (grp, pos), 'groups' AS grp, g.nth AS pos FROM p6 p JOIN g0 g ON g.lang = p.lang),{_sql_levels("g", "q", 3)}
SELECT q.doc_id, q.leaf, s.digest AS subroot, r.digest AS root, sha256(q.proof) AS proof_sha256, q.told AS folded_root, q.told = r.digest AS verified
FROM q3 q JOIN g0 s ON s.lang = q.lang CROSS JOIN g3 r"""
