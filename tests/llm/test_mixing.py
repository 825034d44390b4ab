import pytest

from quorumtab.llm.mixing import emitted, mix


def filled(sizes, weights=(5, 2, 1), share=1.5, limit=2.0):
    """Targets by resharing the excess step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        each = left / sum(w[s] for s in open_)
        over = {s for s in open_ if each * w[s] > limit * sizes[s]}
        if not over:
            return target | {s: each * w[s] for s in open_}
        for s in over:
            target[s] = limit * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def docs(spark):
    rows = [(i, "w " * (1 + i % 40), "big") for i in range(3000)] + [(5000 + i, "a b c", s) for i, s in enumerate(["", "B", "a", "é", None] * 300)]
    rows += [(9000, None, "empty"), (9001, "  ", "empty"), (9002, "x " * 50_000, "long"), (9002, "x " * 50_000, "long"), (None, "q", "a")]
    return rows, spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, source string, rate double")


def test_targets_and_taken(spark):
    rows, df = docs(spark)
    out = mix(df).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = filled(sizes)
    source = {i: s for i, _, s in rows}
    taken = {}
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s in ("big", "B", "a", "é", None, ""):
        assert abs(taken[s] - want[s]) <= 0.1 * sizes[s]
    assert sorted(map(str, out)) == sorted(map(str, mix(df.repartition(7)).collect()))


def test_emitted_rows_match(spark):
    rows, df = docs(spark)
    out = emitted(df)
    assert out.columns == df.columns
    copies = {}
    for r in mix(df).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in copies.items() if v}


def test_empty_and_wordless(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(empty).count() == 0 and emitted(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [r.taken for r in mix(blank).collect()] == [0, 0]
