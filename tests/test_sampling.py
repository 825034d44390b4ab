"""Greedy sampling of datasets against the walk as a plain loop."""

import hashlib

import pytest

from quorumtab.operators import series


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def walk(pairs, n, seed):
    """One pair after the other; the countries that a set takes are those not used, in the order of their draws."""
    used, sets, made = set(), [], {}
    for s, c in sorted(pairs, key=lambda p: md5(seed, "walk", *p)):
        if (s, c) in used or len(sets) == n:
            continue
        free = sorted((b for a, b in pairs if a == s and (a, b) not in used), key=lambda b: md5(seed, "draw", s, b))
        k = 2 + int(md5(seed, "size", s, made.get(s, 0))[0], 16) % 2
        made[s] = made.get(s, 0) + 1
        used |= {(s, b) for b in free[:k]}
        sets.append((s, len(sets) + 1, sorted(free[:k])))
    return sets


@pytest.mark.parametrize("n", [1000, 7])
def test_equals_the_walk(spark, n):
    pairs = {(f"s{i}", f"c{j}") for i, m in enumerate([1, 2, 3, 4, 9, 40, 77]) for j in range(m)}
    long = spark.createDataFrame([(s, c, y, 1.0) for s, c in pairs for y in (2000, 2001)], "series_name string, country_name string, year int, value double")
    got = sorted((r.series_name, r.set_no, r.countries) for r in series.sampled(long, n, 5).collect())
    assert got == sorted(walk(pairs, n, 5))
    taken = [(s, c) for s, _, cs in got for c in cs]
    assert len(taken) == len(set(taken))
    if n == 1000:
        assert any({len(cs) for s, _, cs in got if s == name} == {1, 2, 3} for name, _, _ in got)


def test_empty(spark):
    assert series.sampled(spark.createDataFrame([], "series_name string, country_name string, year int, value double")).collect() == []
