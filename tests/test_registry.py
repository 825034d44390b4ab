import random

import pytest
from pyspark.sql import functions as F

from quorumtab.functions import registry, robust
from quorumtab.operators import consensus, selection, strategies

SAMPLE = "image_id string, sample_idx int, tsv_data string, input_tokens bigint, output_tokens bigint"


def samples(spark, values):
    return spark.createDataFrame([("c", i, f"X\ta\nr\t{v}", 1, 1) for i, v in enumerate(values)], SAMPLE)


def test_sql_functions_equal_the_column_functions(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, -2.5, 1.0000005, 2.0000015, rng.uniform(-9, 9), rng.gauss(0, 1e12), 5e-07]) for _ in range(rng.randrange(0, 9))]) for i in range(400)]
    rows += [(1000, [3.0] * 5), (1001, [1.0, 1.0, 1.0, 9.0]), (1002, [1234.0000005])]
    df = spark.createDataFrame(rows, "id int, xs array<double>").withColumn("n", F.size("xs"))
    registry.register(spark)
    both = consensus.aggregated(df, list(robust.METHODS)).withColumns({f"sql_{m}": F.expr(f"robust_{m}(xs)") for m in registry.BUILT_IN})
    for r in both.collect():
        for m in registry.BUILT_IN:
            assert r[m] == r[f"sql_{m}"], (r.xs, m)


def test_an_added_method_is_used_by_tables_and_from_sql(spark):
    registry.add_method(spark, "spread_max", "array_max(filter(xs, x -> x <= med + 3 * mad))")
    try:
        out = consensus.tables(samples(spark, [1, 2, 3, 50]), "spread_max").first()
        assert out.tsv_data.split("\t")[-1] == "3.0"
        assert spark.sql("SELECT robust_spread_max(array(1D, 2D, 3D, 50D)) AS x").first().x == 3.0
        taken = strategies.fixed(samples(spark, [1, 2, 3, 50]), strategies.Sampling(method="spread_max", fixed_samples=4)).first()
        assert taken.tsv_data.split("\t")[-1] == "3.0"
        registry.add_method(spark, "spread_max", "med + 1")
        assert spark.sql("SELECT robust_spread_max(array(1D, 2D, 3D)) AS x").first().x == 3.0
        with pytest.raises(ValueError):
            selection.aggregated_cells(spark.createDataFrame([("r", "c", 0, 1, 1, 2.0)], "row_label string, col_label string, sample_idx int, row_pos int, col_pos int, value double"), ["row_label", "col_label"], ["spread_max"])
    finally:
        registry.remove_method(spark, "spread_max")
    for broken in (lambda: registry.add_method(spark, "median", "1"), lambda: registry.add_method(spark, "a b", "1"), lambda: robust.method("spread_max")):
        with pytest.raises(ValueError):
            broken()
    with pytest.raises(Exception):
        registry.add_method(spark, "wrong", "no_such(xs)")
    assert "wrong" not in robust.METHODS
    registry.register(spark)


def test_an_added_checker_ends_the_sampling(spark):
    registry.add_checker("three", lambda samples, steps: steps.select("image_id", "prefix_k", (F.col("prefix_k") >= 3).alias("done")))
    try:
        out = strategies.adaptive(samples(spark, [1, 2, 3, 50]), "three").first()
        assert (out.converged, out.convergence_iteration, out.num_samples) == (True, 3, 3)
    finally:
        del registry.CHECKERS["three"]
    assert strategies.adaptive(samples(spark, [1, 7, 7]), "exact").first().convergence_iteration == 3
    assert strategies.adaptive(samples(spark, [5, 5]), "variance").first().converged
    with pytest.raises(ValueError):
        strategies.adaptive(samples(spark, [1]), "three")
    with pytest.raises(ValueError):
        registry.add_checker("exact", None)
