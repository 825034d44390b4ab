import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quorumtab.llm import merkle
from quorumtab.llm.merkle import manifest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text=None):
    values = [str(x) if x is not None else None for x in row[:4]] + [row[4] if text is None else text]
    return h("".join("-" if x is None else f"{len(x.encode())}:{x}" for x in values))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def sides(levels, i):
    """Of each level up to the root: what is left and right of the node in its run."""
    for nodes in levels[:-1]:
        a = i - i % 8
        yield nodes[a:i], nodes[i + 1 : a + 8]
        i //= 8


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text). Plain loops over whole trees."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, out = {}, []
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]])
    top = tree([trees[g][-1][0] for g in names])
    for g in names:
        for i, r in enumerate(groups[g]):
            way = [*sides(trees[g], i), *sides(top, names.index(g))]
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            node = leaf(r, "".join(c.lower() if c.isascii() else c for c in r[4])) if touched else leaf(r)
            for a, b in way:
                node = h("".join([*a, node, *b]))
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h("".join("".join(a + b) for a, b in way)), node, node == top[-1][0]))
    return out


def mine(spark, rows, **options):
    table = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, TEXT string")
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    told = F.when(touched, merkle.leaf_hash(*[merkle.lower_ascii(F.col(f)) if f == "text" else F.col(f) for f in merkle.FIELDS]))
    out = manifest(table, told=told, **options).withColumn("verified", F.col("folded_root") == F.col("root"))
    return [tuple(r) for r in out.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def made(n, langs, seed=1):
    rng = random.Random(seed)
    return [(rng.randint(0, 3 * n), rng.choice(["s", None, "ü"]), rng.choice(langs), rng.choice([None, 5]), rng.choice([None, "", "Ab Ç", "x" * 50000, f"T{i}"])) for i in range(n)]


@pytest.mark.parametrize("rows", [
    made(1, ["a"]), made(8, ["a"]), made(9, ["a"]), made(65, ["a"]), made(700, ["a"]), made(300, [None, "", "a", "B", "é", "zz"]),
    made(40, [f"l{i}" for i in range(20)]), [(1, "s", "a", 1, "A")] * 30 + [(None, None, None, None, None)] * 10 + [(2, "s", "", 1, "b")],
])
def test_equals_plain_trees(spark, rows):
    assert sorted(mine(spark, rows), key=str) == sorted(brute(rows), key=str)


def test_blocks_of_few_leaves_equal_one_block(spark, monkeypatch):
    """Groups that lie in many blocks, with levels above them, and in many runs."""
    rows = made(1500, ["a", "a", "a", "b", None], seed=5)
    monkeypatch.setattr(merkle.proven, "__defaults__", (None, None, False, 1))
    assert sorted(mine(spark, rows), key=str) == sorted(brute(rows), key=str)


def test_empty_table(spark):
    assert mine(spark, []) == []


def test_paths_prove_by_themselves(spark):
    rows = made(200, ["a", "b"], seed=8)
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for r in manifest(table, paths=True).collect():
        node = r.leaf
        for step in r.path:
            assert step.children[step.slot] == node
            node = h("".join(step.children))
        assert node == r.root == r.folded_root
