"""Worked cases: values computed by hand or by independent snippets."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumtab.functions import robust
from quorumtab.functions import text as T
from quorumtab.operators import consensus, convergence, evaluation, series, tables

CELLS = [
    ([10, 12, 11, 50, 12], [12, 1, 19, 12, 11.666667, 11.666667, 11.25]),
    ([1, 2, 3, 10], [2.5, 1, 4, 2, 2.5, 2.5, 2]),
    ([5, 5, 5, 9], [5, 0, 6, 5, 5, 5, 5]),
    ([1.0, 1.00001, 0.99999], [1, 0.00001, 1, 1, 1, 1, 1]),
    ([-3, 4, 7, 7.5, 100, 8], [7.25, 2, 20.583333, 7, 6.625001, 7.5, 6.625]),
]


def test_consensus_values(spark):
    df = spark.createDataFrame([([float(x) for x in xs],) for xs, _ in CELLS], "xs array<double>")
    rows = consensus.aggregated(df).collect()
    for r, (xs, want) in zip(sorted(rows, key=lambda r: [list(map(float, x)) for x, _ in CELLS].index(r.xs)), CELLS):
        got = [r[m] for m in ("median", "mad", "mean", "medoid", "huber", "weighted_confidence", "ransac")]
        assert got == pytest.approx(want, abs=1.1e-6), xs
    with pytest.raises(ValueError):
        robust.method("mode")


def one(spark, col, *values):
    df = spark.createDataFrame([tuple(values)], " , ".join(f"c{i} {'double' if isinstance(v, float) else 'string'}" for i, v in enumerate(values)))
    return df.select(col(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("", 0), ("nan", 0), ("N/A", 0), ("1,310,000", 1310000), ("4.1e+01", 41), ("1E5", 1e5), ("45%", 45), ("$1.2M", 1.2), (".5", 5), ("10-20", 10), ("a-5", -5), ("(5)", 5), ("1, 31", 1)])
def test_cell_number(spark, raw, want):
    assert one(spark, T.cell_number, raw) == want


def test_distances(spark):
    for a, b, want in [("", "", 1), ("abcd", "abcd", 1), ("abcd", "abce", 0.75), ("ab", "ac", 0), ("", "a", 0)]:
        assert one(spark, T.anls, a, b) == want
    for a, b, want in [(100.0, 105.0, 0.05), (100.0, 120.0, 1), (0.0, 0.0, 0), (0.0, 7.0, 0), (5.0, 0.0, 1), (float("nan"), float("nan"), 1)]:
        assert one(spark, T.relative_distance, a, b) == pytest.approx(want)
    for a, want in [("50%", 0.5), ("5%%", 0.05), ("%", None), ("1_000", 1000), ("1d", None)]:
        assert one(spark, T.percent_or_number, a) == want


@pytest.mark.parametrize("x", [0.0, 12.0, 1e7, 123456789.25, 1e15, 1e16, 1.5e22, 0.001, 0.0001, 0.00012, 1e-5, 1.25e-6, -3.5, -1e7, 0.1 + 0.2, float("nan"), float("inf")])
def test_python_text(spark, x):
    assert one(spark, T.python_text, x) == str(x)


def test_structured_consensus(spark):
    texts = ["Year\tA\tB\n2000\t10\t1\n2001\t20\tnan", "Year\tA\tB\n2000\t12\t3\n2001\t22\t4\n2002\t1\t1", "Year\tA\tB\n2000\t50\t2\n2001\t\"21\"\t5"]
    samples = spark.createDataFrame([("i", k, t, 1, 2) for k, t in enumerate(texts)], "image_id string, sample_idx int, tsv_data string, input_tokens long, output_tokens long")
    skeleton = spark.createDataFrame([("i", "Year\tA\tB\n2000\t_\t_\n2001\t_\t_\n2009\t_\t_")], "image_id string, structure string")
    r = consensus.tables(samples, "median", skeleton).first()
    assert r.tsv_data == "Year\tA\tB\n2000\t12.0\t2.0\n2001\t21.0\t4.0\n2009\t\t"
    assert r.mad_tsv == "Year\tA\tB\n2000\t2.0\t1.0\n2001\t1.0\t1.0\n2009\t\t" and (r.num_samples, r.total_input_tokens, r.used_fallback) == (3, 3, False)
    free = consensus.tables(samples.withColumn("tsv_data", F.when(F.col("sample_idx") == 2, F.lower("tsv_data")).otherwise(F.col("tsv_data")))).first()
    assert free.tsv_data == "X\tA\tB\n2000\t12.0\t2.0\n2001\t21.0\t4.0"
    assert consensus.tables(samples.limit(1)).first().tsv_data in texts
    ok = samples.select(tables.conforms(F.col("tsv_data"), F.lit("Year\tA\tB\n2000\t_\t_\n2001\t_\t_")).alias("x")).collect()
    assert [r.x for r in ok] == [True, False, True]  # one row more in the second


def test_scores(spark):
    gt = "year\ta\n2000\t100\n2001\t200"
    pairs = [(1, gt, "year\ta\n2000\t105\n2001\t300"), (2, gt, "year\ta\n2000\t105"), (3, gt, "year\t2000\t2001\na\t100\t200"), (4, gt, None)]
    got = {r.pair_id: r for r in evaluation.per_pair(spark.createDataFrame(pairs, "pair_id long, gt_answer string, model_answer string")).collect()}
    assert (got[1].precision, got[1].recall, got[1].f1, got[1].correct, got[1].value_errors) == pytest.approx((0.65, 0.65, 0.65, 65, 35))
    assert (got[2].precision, got[2].recall, got[2].f1, got[2].value_errors, got[2].missing_datapoints) == pytest.approx((0.975, 0.65, 0.78, 2, 20))
    assert got[3].f1 == 1 and got[3].transposed and got[4].recall == pytest.approx(1 / 3)
    for r in got.values():
        assert sum(r[b] for b in evaluation.BUCKETS) == pytest.approx(100)


def test_assignment_is_cheapest():
    rng = np.random.default_rng(1)
    for n, m in itertools.product(range(1, 6), repeat=2):
        cost = rng.integers(0, 6, (n, m)) / 5
        small, large = min(n, m), max(n, m)
        c = cost if n <= m else cost.T
        best = min(sum(c[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert sum(cost[i, j] for i, j in evaluation.assigned(cost)) == pytest.approx(best) and len(evaluation.assigned(cost)) == small


@pytest.mark.parametrize("values,patience,want", [(["5", "6", "6"], 1, (True, 5, "6")), (["5", "6", "6", "6"], 2, (True, 6, "6")), (["5", "", "5", "7"], 1, (True, 5, "5")), (["5", "6", "7"], 1, (False, None, "7"))])
def test_incremental(spark, values, patience, want):
    rows = [("i", 3 + k, v, v != "", False) for k, v in enumerate(values)]
    r = convergence.incremental(spark.createDataFrame(rows, "image_id string, prefix_k int, value string, has_content boolean, used_fallback boolean"), patience=patience).first()
    assert (r.converged, r.convergence_iteration, r.value) == want


def test_pruning(spark):
    cases = {"a": [None, 1, 2, None], "b": [1, None, 2], "c": [1, 1e6], "d": [None] * 32, "e": [None] * 31 + [1], "f": [None, None]}
    rows = [("s", k, 2000 + i, None if v is None else float(v)) for k, vs in cases.items() for i, v in enumerate(vs)]
    left = series.pruned(spark.createDataFrame(rows, "series_name string, country_name string, year int, value double")).select("country_name").distinct().collect()
    assert sorted(r[0] for r in left) == ["a", "e", "f"]


def test_subsample_and_prompts(spark):
    df = spark.range(1).select(series.subsampled(F.expr("transform(sequence(0, 28), x -> x)")).alias("x"), T.clean_skeleton(F.lit("a_b\tc_d\n\n_x_\t_\t_")).alias("s"), T.axis_label(F.lit("gDP_per CAPITA")).alias("l"))
    assert df.first().x == list(range(0, 29, 2)) and df.first().s == "a b\tc d\nx\t_\t_" and df.first().l == "Gdp per capita"


def test_normalized_texts_are_quoted_as_by_a_csv_writer(spark):
    import csv
    import io

    from quorumtab.functions.text import cell_number_text
    from quorumtab.operators import tables

    texts = ['"x\ty"\tb\n"q""r"\t1,000\t"2\n3"\n', "a\tb\tc\nr\t5%", "h\n", '"a ""b"" c"\tz\nr\tnan\n']
    df = spark.createDataFrame(list(enumerate(texts)), "image_id long, tsv_data string")
    numbers = {r.raw: r.v for r in tables.cells(df, ["image_id"]).withColumn("v", cell_number_text(F.col("raw"))).collect()}
    for r in tables.normalized_tsv(df, ["image_id"]).collect():
        out = io.StringIO()
        writer = csv.writer(out, delimiter="\t", lineterminator="\n")
        for i, row in enumerate(csv.reader(io.StringIO(texts[r.image_id]), delimiter="\t")):
            writer.writerow([c if i == 0 or j == 0 else numbers[c] for j, c in enumerate(row)])
        assert r.tsv_data == out.getvalue()


def test_best_of_several_references(spark):
    from quorumtab.operators import evaluation

    rows = [(1, ["a\tb\nc\t1", "x\ty\nz\t2"], "x\ty\nz\t2"), (2, [], "x\ty\nz\t2"), (3, None, ""), (4, ["q\tw\ne\t0"], "q\tw\ne\t5")]
    df = spark.createDataFrame(rows, "pair_id long, gt_answer array<string>, model_answer string")
    got = {r.pair_id: r.f1 for r in evaluation.per_pair(df).collect()}
    assert got[1] == 1.0 and got[3] == 1.0 and got[2] < 1 and got[4] == 1.0
    strict = {r.pair_id: r.f1 for r in evaluation.per_pair(df, zero_target="strict").collect()}
    assert strict[4] == 0.5


def test_geometry_by_chart_type_and_unknown_library(spark):
    from quorumtab.operators import series

    points = spark.createDataFrame([("c", s, f"n{s}", y, 1.0 + s) for s in range(2) for y in (2000, 2002)], "chart_id string, series_pos int, country_name string, year int, value double")
    bars = {(r.series_pos, r.year): r for r in series.geometry(points, "stacked_bar").collect()}
    assert (bars[1, 2000].bottom, bars[1, 2000].top, bars[1, 2000].x) == (1.0, 3.0, 2000.0) and abs(bars[1, 2000].width - 1.3) < 1e-9
    for kind in series.CHART_TYPES:
        assert series.geometry(points, kind, "bokeh").count() == 4
    for bad in (("line", "excel"), ("pie", "bokeh")):
        with pytest.raises(ValueError):
            series.geometry(points, *bad)
    assert len(set(series.colors(30))) >= 30 and series.colors(3)[:3] == series.PALETTE[:3]


def test_pruning_drops_by_each_rule(spark):
    from quorumtab.operators import series

    rows = [("s", "few gaps", 2000, None), ("s", "few gaps", 2001, 1.0), ("s", "gaps", 2000, None), ("s", "gaps", 2001, None), ("s", "gaps", 2002, 1.0),
            ("s", "inside", 2000, 1.0), ("s", "inside", 2001, None), ("s", "inside", 2002, 1.0), ("s", "large", 2000, -1e12), ("s", "fine", 2000, 5.0)]
    df = spark.createDataFrame(rows, "series_name string, country_name string, year int, value double")
    assert {r.country_name for r in series.pruned(df, prune_at=2, large=1e11).collect()} == {"few gaps", "fine"}
