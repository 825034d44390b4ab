import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumtab.llm import ordered, prefix_trie
from quorumtab.llm.common import kept
from quorumtab.llm.ordered import columns, looked_up, ones, running

SCHEMA = "conv_id long, turn long, role string, text string, TEXT string"


def brute(turns):
    """turns: (conv_id, turn, role, text). The nodes by plain loops over every prefix."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    for c in own:
        own[c] = [x[1:] for x in sorted(own[c])]
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    built = {c: tuple(own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :]) for c in own}
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for seq in members:
        if seq:
            kids[seq[:-1]].append(seq)

    def sums(seq):
        below = [sums(k) for k in kids[seq]]
        saved = (len(members[seq]) - 1) * len(seq[-1][1].encode()) if seq else 0
        return sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below)

    out = []
    for seq, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(built[c]) == len(seq))
        out.append((min(ids), len(seq), min(members[seq[:-1]]) if seq else None, len(ids), len(kids[seq]), *sums(seq), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def mine(spark, turns):
    out = prefix_trie.trie(*prefix_trie.rebuilt(spark.createDataFrame([(*t, "clash") for t in turns], SCHEMA)))
    return sorted((tuple(r) for r in out.collect()), key=str)


def made(n, most, words, seed):
    """Conversations of few different turns, so that many share their beginnings."""
    rng = random.Random(seed)
    return [(c, i, rng.choice(["user", "assistant"]) if words > 2 else "user", rng.choice([f"wörd{k}" for k in range(words)])) for c in rng.sample(range(3 * n), n) for i in range(rng.randint(1, most))]


@pytest.mark.parametrize("turns", [
    made(60, 6, 2, 1), made(150, 9, 3, 2), [(c, i, "u", "same") for c in range(40) for i in range(12)],
    [(0, i, "u", f"t{i}") for i in range(400)] + [(c, 0, None, None) for c in range(1, 30)] + [(c, None, "u", "x" * 30000) for c in range(3, 20)],
    [(None, 1, "u", "lost"), (7, 1, "b", "x"), (7, 1, "a", "y"), (7, 1, "a", "y"), (7, None, None, "first"), (-1, 0, "user", "é"), (1 << 40, 2, "u", "z")],
])
def test_equals_plain_loops(spark, turns):
    assert mine(spark, turns) == brute(turns)


def test_empty_table(spark):
    assert mine(spark, []) == []


def test_hot_keys_and_small_ranges_change_nothing(spark, monkeypatch):
    """All joins with broadcast keys, and conversations that lie in several ranges."""
    monkeypatch.setattr(ordered, "HOT_SHARE", 20)
    turns = made(80, 5, 2, 4) + [(1000, i, "user", f"wörd{i % 2}") for i in range(700)]
    assert mine(spark, turns) == brute(turns)


def test_conversations_as_they_are(spark):
    turns = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a"), (2, 1, "u", "c")]
    out = prefix_trie.trie(*prefix_trie.plain(spark.createDataFrame([(*t, "") for t in turns], SCHEMA))).collect()
    assert sorted((r.depth, r.conv_id, r.n_convs, r.n_leaves, r.saved_tokens) for r in out) == [(0, 1, 2, 2, 1), (1, 1, 2, 2, 1), (2, 1, 1, 1, 0), (2, 2, 1, 1, 0)]


def test_running_sums_over_ranges(spark):
    """A key with most of the rows lies in many partitions; sums wrap around."""
    rng = np.random.default_rng(7)
    rows = [(int(k), int(i), int(v)) for i, (k, v) in enumerate(zip(rng.choice([1, 1, 1, 1, 2, 3, 9], 20000), rng.integers(-(2**62), 2**62, 20000)))]
    table = kept(spark.createDataFrame(rows, "k long, i long, v long").repartition(7), "t")
    got = running(table, "k", [F.col("i").desc()], columns("v"), ["s"], "s").collect()
    sums = defaultdict(int)
    want = {}
    for k, i, v in sorted(rows, key=lambda r: -r[1]):
        before = sums[k]
        sums[k] = (before + v + 2**63) % 2**64 - 2**63
        want[i] = (sums[k], before)
    assert {r.i: (r.s, r.s_before) for r in got} == want


def test_running_numbers_equal_rows(spark):
    table = kept(spark.range(9000).selectExpr("'a' AS k"), "t")
    assert sorted(r.n for r in running(table, "k", [], ones, ["n"], "n").collect()) == list(range(1, 9001))


def test_looked_up_equals_a_join(spark):
    rows = spark.range(1000).selectExpr("IF(id < 900, 1, id) AS k", "id")
    table = rows.groupBy("k").count().selectExpr("k", "k * 2 AS twice", "count AS weight")
    assert sorted(looked_up(rows, table, ["k"], "weight", 1000).collect()) == sorted(rows.join(table.drop("weight"), "k").collect())
