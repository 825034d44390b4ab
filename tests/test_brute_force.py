"""The queries on optimal matching against every possible matching, on a small fixture."""

import datetime
import itertools
from statistics import mean

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quorumtab.operators.evaluation import BUCKETS
from quorumtab.plans import driver_queries as q

#: Supplier, line number, year, flag, price: years that both have, that one has, that none shares; prices alike and not; a missing flag.
YEARS = {1: [(1992, 1993), (1993, 1994), (1992, 1993)], 2: [(1992, 1998), (1995, 1996)], 3: [(1994,), (1994, 1995)], 4: [(1996, 1997), (1997,), (1995, 1998)]}
MEASURES = ["precision", "recall", "f1", *BUCKETS]


def price(s, line, y, f):
    return 100.0 + 10 * f + (y - 1990) * (1 if line < 3 else 1.05) + (line - 1) * s * 3


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    rows = [
        (s, line, datetime.date(y, 5, 1), "ANR"[f], price(s, line, y, f))
        for s, lines in YEARS.items() for line, years in enumerate(lines, 1) for y in years for f in range(3) if (s, line, f) != (2, 2, 1)
    ]
    folder = tmp_path_factory.mktemp("small")
    names = ["l_suppkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_extendedprice"]
    pq.write_table(pa.table(dict(zip(names, map(list, zip(*rows))))), folder / "lineitem.parquet")
    return str(folder)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def likeness(a, b):
    if a == b:
        return 1.0
    d = distance(a, b) / max(len(a), len(b))
    return 1 - d if d < 0.5 else 0.0


def penalty(t, p):
    try:
        t, p = float(t), float(p)
    except ValueError:
        return 1 - likeness(t, p)
    if t == 0:
        return 0.0
    d = abs((t - p) / t)
    return d if d < 0.1 else 1.0


def points(grid):
    out = {"title": ""}
    for row in grid[1:]:
        for head, value in zip(grid[0][1:], row[1:]):
            out[f"{row[0]} {head}"] = value
    return list(out.items())


def outcomes(gt, told):
    """The measures of each matching whose keys are most alike in all."""
    g, p = points(gt), points(told)
    short, long = (g, p) if len(g) <= len(p) else (p, g)
    like = [[likeness(a[0], b[0]) for b in long] for a in short]
    picks = {m: sum(like[i][j] for i, j in enumerate(m)) for m in itertools.permutations(range(len(long)), len(short))}
    most, total, found = max(picks.values()), len(g) + len(p), set()
    for m, s in picks.items():
        if s < most - 1e-9:
            continue
        score = label = value = missed = 0.0
        for i, j in enumerate(m):
            k, (t, x) = like[i][j], (short[i][1], long[j][1]) if short is g else (long[j][1], short[i][1])
            pen = penalty(t, x) if k > 0 else 0.0
            score, value, missed, label = score + k * (1 - pen), value + 2 * k * pen, missed + (k == 0), label + (2 * (1 - k) if k > 0 else 0)
        rest = [value, label, len(g) - len(m) + missed, len(p) - len(m) + missed]
        found.add(tuple(round(v, 6) for v in (score / len(p), score / len(g), 2 * score / total, 200 * score / total, *[100 * v / total for v in rest])))
    return found


def grids(s, line):
    """A sample as the evaluation reads it: in lower case, the empty corner stripped."""
    body = [[str(y), *["nan" if (s, line, f) == (2, 2, 1) else f"{price(s, line, y, f):.2f}" for f in range(3)]] for y in YEARS[s][line - 1]]
    return [["a", "n", "r"], *body]


def turned(grid):
    return [list(r) for r in itertools.zip_longest(*grid, fillvalue="")]


def test_rms_f1_and_macro(spark, small):
    got = {r.pair_id: r for r in q.q_rms_f1(spark, small).collect()}
    pairs = {f"{s}-{line - 1}": (s, line) for s, lines in YEARS.items() for line in range(2, len(lines) + 1)}
    assert set(got) == set(pairs)
    for name, (s, line) in pairs.items():
        gt, told = grids(s, 1), grids(s, line)
        ways = {False: outcomes(gt, told), True: outcomes(gt, turned(told))}
        mine = got[name]
        assert tuple(round(mine[c], 6) for c in MEASURES) in ways[mine.transposed], name
        assert mine.f1 >= min(x[2] for x in ways[not mine.transposed]) - 1e-6, name
    assert len({round(r.f1, 3) for r in got.values()}) > 3 and any(r.label_errors > 0 for r in got.values()) and any(r.value_errors > 0 for r in got.values())

    (macro,) = q.q_eval_macro(spark, small).collect()
    for c in ("precision", "recall", "f1"):
        assert macro[c] == pytest.approx(100 * mean(r[c] for r in got.values()))
    kinds = {c: mean(r[c] for r in got.values()) for c in BUCKETS}
    largest = max(BUCKETS[1:], key=kinds.get)
    kinds[largest] += 100 - sum(kinds.values())
    assert {c: macro[c] for c in BUCKETS} == pytest.approx(kinds)
