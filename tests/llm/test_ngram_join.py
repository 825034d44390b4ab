import random
from fractions import Fraction

import numpy as np
import pytest

from quorumtab.llm import ngram_join
from quorumtab.llm.ngram_join import joined, matched_length, recall, survivors


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Classes and links by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return sorted((d, min(x for x in least[find(i)]), links[i]) for i, (d, _) in enumerate(rows))


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(4000)]
    out = []
    for g in range(40):
        base = rng.choices(vocab, k=rng.choice([6, 30, 120, 400]))
        for _ in range(rng.choice([1, 2, 6, 60])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 60)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
    out += ["", "  \n", "one two", "one two", "one  two", "a b c d e", "a b c d e", "a b c d e f", "é à ü ö", "x " * 30_000]
    rng.shuffle(out)
    return [(i + 10, t) for i, t in enumerate(out)] + [(5000, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_equals_all_pairs(spark, rows):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, key2 string").withColumnRenamed("key2", "key")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in joined(df).collect())
    assert got == brute(rows)


def test_tiles_equal_all_pairs(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_GROWTH", 1)
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 7)
    monkeypatch.setattr(ngram_join, "BROADCAST_KEYS", 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in joined(df).collect()) == brute(rows)


def test_empty_blocks_count_no_link_twice(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 60)
    monkeypatch.setattr(ngram_join, "INDEXED", 1)  # two blocks for each pair below, one of them often empty
    rng, rows = random.Random(6), []
    for g in range(24):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(60)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join([*base[:-1], "other"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in joined(df).collect())
    assert got == brute(rows) and {n for _, _, n in got} == {1}


def test_survivors(spark, rows):
    twice = rows + rows[:50] + [(None, "no id of its own at all"), (None, "no id of its own at all")]
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(twice)], "doc_id long, text string, class_id long")
    out = survivors(df)
    assert out.columns == ["doc_id", "text", "class_id"]
    left = [r.doc_id for r in out.collect() if shingles(r.text)]
    assert sorted(left, key=str) == sorted({c for d, c, _ in brute(rows) if shingles(dict(rows)[d])} | {None}, key=str)


@pytest.mark.parametrize("indexed", [2, 10**9])
def test_linked_counts_open_pairs_of_different_groups(monkeypatch, indexed):
    monkeypatch.setattr(ngram_join, "INDEXED", indexed)
    rng = np.random.default_rng(4)
    base = [rng.choice(5000, 60, replace=False) for _ in range(6)]
    sets = [np.unique(np.concatenate([base[i % 6][: 60 - i % 5], rng.integers(10_000, 20_000, i % 4)])).astype(np.uint64) for i in range(120)]
    before, open_, sides = rng.integers(0, 9, 120), rng.random(120) < 0.3, rng.integers(0, 2, 120)
    for two, some in ((False, open_), (True, open_), (False, np.ones(120, bool))):
        got = ngram_join.linked(sets, sides, np.full(120, 3), Fraction(4, 5), two, before, some, 8)
        want = np.zeros(120, np.int64)
        for i in range(120):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if (some[i] or some[j]) and before[i] != before[j] and (not two or sides[i] != sides[j]) and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                    want[[i, j]] += 1
        assert want.sum() > 100 and (got["pairs"] == want).all() and (got["links"] == 3 * want).all()


def test_prefixes_shorten_only_where_the_recall_is_short(spark, monkeypatch):
    rng, rows = random.Random(9), []
    for g, n in ((0, 60), (1, 2), (2, 2)):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(200)]
        for i in range(n):
            w = list(base)
            w[rng.randrange(200)] = f"x{g}-{i}"
            rows.append((len(rows), " ".join(w)))
    seen = []
    plain = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda texts, wanted, *a: seen.append((a[-1], wanted.filter("open").count())) or plain(texts, wanted, *a))
    monkeypatch.setattr(ngram_join, "trie_links", lambda units, *a: units.sparkSession.createDataFrame(links(units), "a bigint, b bigint, level int"))

    def links(units):  # the large group meets in two halves at 8 values, and those and the pairs at 7
        of = {}
        for r in units.orderBy("rep").collect():
            of.setdefault(0 if r.rep < 60 else 1 if r.rep < 62 else 2, []).append(r.unit)
        big = of[0]
        return [(big[0], u, 8) for u in big[1:40]] + [(big[40], u, 8) for u in big[41:]] + [(big[0], big[40], 7)] + [(x, y, 7) for x, y in (of[1], of[2])]

    got = joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert seen[0] == (8, 60) and seen[1] == (7, 24)  # of the large group only the 20 with fewer than 28 links go on
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute(rows)


def test_recall_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = [(d, shingles(t)) for d, t in rows]
    got = {r.doc_id: r.n_links for r in joined(docs).collect()}
    for d, s in sets:
        if d % 20 == 0:
            both = [(len(s & o), len(s | o)) for e, o in sets if e != d]
            assert got[d] == sum(5 * a >= 4 * b for a, b in both if a), d


def test_recall_bound():
    length = matched_length(0.8, 0.9999)
    assert length == 6 and recall(length, 0.8) >= 0.9999 > recall(length + 1, 0.8)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert joined(df).count() == 0 and survivors(df).count() == 0
