"""Sparse matching against the matrix solver and against every pair of keys."""

import random

import numpy as np
import pytest

from quorumtab.operators import evaluation
from quorumtab.operators.evaluation import assigned, matched, per_pair
from quorumtab.operators.matching import cheapest, components, like_pairs, sparse_matched
from test_brute_force import distance, likeness

SCHEMA = "k string, pos int, key string, value string"


def points(tables):
    return [(k, i, key, str(i)) for k, keys in tables.items() for i, key in enumerate(keys)]


def words(rng, n, letters="abcé "):
    return list(dict.fromkeys("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n)))


def typo(rng, w):
    i = rng.randrange(len(w))
    return rng.choice([w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "y" + w[i + 1 :], w]) or "q"


def total(t, p):
    cost = np.array([[1 - likeness(a, b) for b in p] for a in t])
    return sum(1 - cost[i, j] for i, j in assigned(cost))


def test_cheapest_equals_the_matrix_solver():
    rng = random.Random(1)
    for _ in range(800):
        a, b, full, same = rng.randint(1, 8), rng.randint(1, 8), rng.random(), rng.random()
        edges = {(i, j): rng.choice([rng.random() / 2, 0.1, 0.2, 0.4]) for i in range(a) for j in range(b) if rng.random() < full}
        edges |= {(i, i): 0.0 for i in range(min(a, b)) if rng.random() < same}
        cost = np.ones((a, b))
        for (i, j), d in edges.items():
            cost[i, j] = d
        got = cheapest([(i, j, d) for (i, j), d in edges.items()])
        assert len({g[0] for g in got}) == len(got) == len({g[1] for g in got})
        assert sum(1 - d for _, _, d in got) == pytest.approx(sum(1 - cost[i, j] for i, j in assigned(cost)))


def test_equal_keys_give_way_where_two_chains_are_better():
    """Matching the equal ends (0, 0) would leave two keys without a partner: 1 against 1.4."""
    assert [g[:2] for g in cheapest([(0, 0, 0.0), (0, 1, 0.3), (1, 0, 0.3)])] == [(0, 1), (1, 0)]


@pytest.mark.parametrize("theta", [0.3, 0.5, 0.8])
def test_like_pairs_are_all_pairs_below_theta(spark, theta):
    rng = random.Random(2)
    t, p = {k: [*words(rng, 60), "", "😀a", "é"] for k in "xy"}, {k: [*words(rng, 60), "", "😀b"] for k in "xy"}
    got = like_pairs(spark.createDataFrame(points(t), SCHEMA), spark.createDataFrame(points(p), SCHEMA), ["k"], theta).collect()
    want = {(k, i, j) for k in "xy" for i, a in enumerate(t[k]) for j, b in enumerate(p[k]) if a and b and distance(a, b) / max(len(a), len(b)) < theta}
    assert len(got) == len(want) and {(r.k, r.t_pos, r.p_pos) for r in got} == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, rng.randrange(60), rng.randrange(60), 0.1) for k in "xy" for _ in range(45)] + [("z", i, i, 0.1) for i in range(50)] + [("z", i + 1, i, 0.1) for i in range(50)]
    near = {}

    def root(x):
        while near.setdefault(x, x) != x:
            x = near[x]
        return x

    for k, t, p, _ in edges:
        near[root((k, "t", t))] = root((k, "p", p))
    got = components(spark.createDataFrame(edges, "k string, t_pos int, p_pos int, d double"), ["k"]).collect()
    assert len(got) == len(edges)
    pairs = {(root((r.k, "t", r.t_pos)), (r.k, r.part)) for r in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_sparse_totals_equal_the_matrix(spark):
    rng = random.Random(4)
    t = {str(k): words(rng, 25) for k in range(12)}
    p = {k: list(dict.fromkeys([typo(rng, w) for w in keys if rng.random() < 0.9] + words(rng, 5))) for k, keys in t.items()}
    got = sparse_matched(spark.createDataFrame(points(t), SCHEMA), spark.createDataFrame(points(p), SCHEMA), ["k"]).collect()
    for k in t:
        mine = [r for r in got if r.k == k]
        assert len({r.t_pos for r in mine}) == len(mine) == len({r.p_pos for r in mine})
        assert sum(r.key_score for r in mine) == pytest.approx(total(t[k], p[k]))
        assert all(r.key_score == pytest.approx(likeness(t[k][r.t_pos], p[k][r.p_pos])) for r in mine)


def test_large_tables_need_no_matrix(spark):
    """4,000 datapoints on each side: every tenth key with a wrong letter, every twentieth without a partner."""
    rng = random.Random(5)
    names = list({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(4_000)})
    told = ["#" + w[1:] if i % 10 == 0 else "".join(rng.choice("ABCDEFGH") for _ in range(14)) if i % 20 == 3 else w for i, w in enumerate(names)]
    one = matched(spark.createDataFrame(points({"a": names}), SCHEMA), spark.createDataFrame(points({"a": told}), SCHEMA), ["k"]).collect()
    assert all(r.t_value == r.p_value for r in one)
    assert len(one) == len(names) - len([i for i in range(len(names)) if i % 20 == 3])


def test_scores_are_the_same_without_a_matrix(spark):
    """Pairs of tables with label errors, nested ones, and empty ones."""
    rng = random.Random(6)
    pairs = []
    for i in range(30):
        rows, cols = words(rng, 5, "abcdefgh"), words(rng, 3, "xyzuvw")
        table = lambda rs, cs: "\n".join(["t\t" + "\t".join(cs), *["\t".join([r, *[str(rng.randint(1, 3)) for _ in cs]]) for r in rs]])
        pairs.append((i, table(rows, cols), table([typo(rng, r) for r in rows], cols) if i % 3 else table(rows[:2], cols)))
    pairs.append((99, "", "a\tb\nc\t1"))
    df = spark.createDataFrame(pairs, "pair_id int, gt_answer string, model_answer string")
    names = ["correct", "label_errors", "missing_datapoints", "extra_datapoints"]
    a, b = ({r.pair_id: r for r in per_pair(df, dense_cells=n).collect()} for n in (evaluation.DENSE_CELLS, 0))
    assert set(a) == set(b) and any(r.label_errors > 0 for r in a.values())
    for i in a:  # several matchings may be equally good, and then values differ
        assert b[i].missing_datapoints == pytest.approx(a[i].missing_datapoints) and b[i].label_errors + b[i].value_errors + b[i].correct == pytest.approx(a[i].label_errors + a[i].value_errors + a[i].correct), (i, names)


def test_matched_parts_equals_the_matrix(spark, monkeypatch):
    """The query's tables at the smallest size, with and without a matrix."""
    from quorumtab.plans import driver_queries as q

    mine = {r.pair_id: r for r in q.q_matched_parts(spark, "/root/testdata/sf0.001").collect()}
    scores = evaluation.scores
    monkeypatch.setattr(evaluation, "scores", lambda *args, dense_cells: scores(*args, dense_cells=1 << 40))
    want = {r.pair_id: r for r in q.q_matched_parts(spark, "/root/testdata/sf0.001").collect()}
    assert set(mine) == set(want)
    for i, w in want.items():
        assert mine[i].missing_datapoints == pytest.approx(w.missing_datapoints) and mine[i].extra_datapoints == pytest.approx(w.extra_datapoints)
        assert mine[i].label_errors == pytest.approx(w.label_errors)


def test_all_pairs_equal_pieces(spark):
    """Groups compared pair by pair, by pieces, and some by each."""
    rng = random.Random(7)
    t = {k: words(rng, n) for k, n in (("a", 40), ("b", 12))}
    p = {k: list(dict.fromkeys([typo(rng, w) for w in keys] + words(rng, 5))) for k, keys in t.items()}
    sides = [spark.createDataFrame(points(x), SCHEMA) for x in (t, p)]
    by = [sorted(map(tuple, like_pairs(*sides, ["k"], 0.5, n).collect())) for n in (0, 300, 1 << 40)]
    assert by[0] == by[1] == by[2] and len(by[0]) >= 52


def test_no_pieces_are_broadcast(spark):
    """Held keys look small to the optimiser, but all their parts together aren't (F1)."""
    sides = [spark.createDataFrame(points({"a": ["abcdef", "bcdefg"]}), SCHEMA) for _ in "tp"]
    for n in (0, 100):
        plan = like_pairs(*sides, ["k"], 0.5, n)._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=merge" in plan, n


@pytest.mark.parametrize("theta", [0.3, 0.5, 0.8, 1.0])
def test_distances_are_those_of_each_pair(theta):
    """Keys of up to four words of 64 letters, some of them alike, found for several keys at once."""
    from quorumtab.operators.matching import Distances, width

    rng = random.Random(8)
    for n in (5, 32, 33, 63, 64, 65, 200):
        for letters in ("ab", "abcé 😀"):
            base = "".join(rng.choice(letters) for _ in range(n))
            keys = ["".join(rng.choice(letters) for _ in range(rng.randint(1, n))) for _ in range(8)] + [base[:i] + "z" + base[i + 1 :] for i in range(0, n, max(1, n // 5))]
            found, asked = Distances(keys, theta), [base, base[1:] + "y", base[: n - n // 9]]
            for words in {width(k) for k in asked}:
                some = [k for k in asked if width(k) == words]
                for a, (places, d) in zip(some, found.near(some)):
                    want = {j: distance(a, b) / max(len(a), len(b)) for j, b in enumerate(keys)}
                    assert dict(zip(places.tolist(), d.tolist())) == {j: x for j, x in want.items() if x < theta}


@pytest.mark.parametrize("kept, batch", [(1 << 20, 8192), (300, 30), (0, 1)])
def test_cheapest_keys_equals_the_matrix_solver(monkeypatch, kept, batch):
    """Also where no distances are kept, and with keys that occur twice."""
    from quorumtab.operators import matching

    monkeypatch.setattr(matching, "KEPT", kept)
    monkeypatch.setattr(matching, "BATCH", batch)
    rng = random.Random(9)
    for i in range(80):
        t = words(rng, rng.randint(1, 15), rng.choice(["ab", "abc", "abcdé "]))
        p = [typo(rng, w) for w in t if rng.random() < 0.8] + words(rng, rng.randint(1, 6), "abc") + (t[:2] if i % 3 == 0 else [])
        got = matching.cheapest_keys(t, p, 0.5)
        assert len({g[0] for g in got}) == len(got) == len({g[1] for g in got})
        assert all(1 - d == pytest.approx(likeness(t[r], p[c])) for r, c, d in got)
        assert sum(1 - d for _, _, d in got) == pytest.approx(total(t, p))


def test_totals_in_a_task_equal_those_in_parts(spark):
    """Groups matched from their keys, over connected components, and some by each."""
    rng = random.Random(10)
    t = {k: words(rng, n) for k, n in (("a", 40), ("b", 12), ("only", 3))}
    p = {k: list(dict.fromkeys([typo(rng, w) for w in keys] + words(rng, 5))) for k, keys in t.items() if k != "only"}
    sides = [spark.createDataFrame(points(x), SCHEMA) for x in (t, p)]
    for n in (0, 300, 1 << 40):
        got = sparse_matched(*sides, ["k"], in_task=n).collect()
        assert {r.k for r in got} == {"a", "b"}
        for k in p:
            assert sum(r.key_score for r in got if r.k == k) == pytest.approx(total(t[k], p[k])), (n, k)


def test_many_like_keys_make_no_pairs(spark, monkeypatch):
    """4.8 million pairs of one group, more than a quarter of them alike: as rows they, and their pieces, were too many (F1)."""
    from quorumtab.operators import matching

    def refused(*args):
        raise AssertionError("pairs were made")

    monkeypatch.setattr(matching, "like_pairs", refused)
    rng = random.Random(11)
    names = [f"{a} {b} Brand#{n} {c}" for a in ("large", "hot", "blue", "old", "cold") for b in ("ring", "bolt", "plate", "gear") for n in range(1, 23) for c in ("LARGE", "ECONOMY", "SMALL", "STANDARD", "PROMO")]
    rng.shuffle(names)
    told = [w[:3] + "x" + w[4:] if i % 7 == 0 else w for i, w in enumerate(names)]
    assert len(names) == len(set(names)) == len(set(told)) and len(names) * len(told) > matching.ALL_PAIRS
    got = sparse_matched(spark.createDataFrame(points({"a": names}), SCHEMA), spark.createDataFrame(points({"a": told}), SCHEMA), ["k"]).collect()
    assert len(got) == len(names) == len({r.t_pos for r in got}) == len({r.p_pos for r in got})
    assert sum(r.key_score for r in got) >= sum(likeness(a, b) for a, b in zip(names, told)) - 1e-6
