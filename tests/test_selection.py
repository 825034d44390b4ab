"""Values of cells by counting against the values from arrays."""

import random

import pytest

from quorumtab.functions import robust
from quorumtab.operators import consensus, selection

METHODS = list(robust.METHODS)


@pytest.fixture(scope="module")
def long(spark):
    rng = random.Random(3)
    kinds = {
        "few": [3.0], "two": [1.0, 2.0], "equal": [5.0] * 400, "none": [None, float("nan")], "close": [1e6, 1e6 + 1, 1e6 + 2] * 30,
        "ties": [rng.choice([1.0, 2.0, 3.0, 3.0]) for _ in range(700)], "normal": [rng.gauss(50, 9) for _ in range(900)], "even": [float(i) for i in range(600)],
        "wild": [rng.choice([-1, 1]) * 10 ** rng.uniform(-3, 4) for _ in range(500)], "huge": [1.7e308, 1.6e308, 0.0, 1.0, 2.0], "outliers": [1.0] * 300 + [1e9] * 299,
    }
    rows = [(k, "c", i // 2 if k == "ties" else i, i % 2, 1, v) for k, vs in kinds.items() for i, v in enumerate(vs)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "row_label string, col_label string, sample_idx int, row_pos int, col_pos int, value double").cache()


def test_equals_arrays(long, monkeypatch):
    """With arrays of 16 values at most, and 64 ranges a round, all goes through several rounds."""
    monkeypatch.setattr(selection, "SMALL", 16)
    monkeypatch.setattr(selection, "RANGES", 64)
    mine = {r.row_label: r for r in selection.aggregated_cells(long, ["row_label", "col_label"]).collect()}
    want = {r.row_label: r for r in consensus.aggregated(consensus.cell_values(long, []), METHODS).collect()}
    assert set(mine) == set(want) and "none" not in mine
    for k, w in want.items():
        for m in ["n", *METHODS]:
            if k != "huge" or m in ("n", "median", "medoid"):  # sums of those depend on their order
                assert mine[k][m] == pytest.approx(w[m], rel=1e-9, abs=2e-6), (k, m)


def test_all_ranks(spark):
    rng = random.Random(4)
    xs = sorted(rng.choice([rng.random(), 0.5, -3.0]) for _ in range(300))
    rows = spark.createDataFrame([("a", x) for x in xs], "k string, x double").cache()
    wanted = spark.createDataFrame([("a", f"{i}", i) for i in range(300)], "k string, which string, rank long")
    got = {int(r.which): r.value for r in selection.ranked(rows, ["k"], wanted).collect()}
    assert [got[i] for i in range(300)] == xs
