"""The strategies on small charts whose course is worked out by hand."""

import pytest

from quorumtab.operators import consensus, strategies, tables

SCHEMA = "image_id string, sample_idx int, tsv_data string, input_tokens long, output_tokens long"


def sample(chart, values):
    return [(chart, i, None if v is None else f"\ta\n2000\t{v}", 1, 2) for i, v in enumerate(values)]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(sample("calm", [4, 5, 6, 7, 5, 5]) + sample("wild", [1, 50, 900, 20, 7000, 3]) + sample("none", [None] * 6), SCHEMA).cache()


def rows(df):
    return {r.image_id: r for r in df.collect()}


def test_fixed(samples):
    got = rows(strategies.fixed(samples, strategies.Sampling(fixed_samples=3)))
    assert got["calm"].tsv_data == "X\ta\n2000\t5.0" and got["calm"].num_samples == 3 and not got["calm"].converged
    assert got["none"].tsv_data == "" and got["none"].total_output_tokens == 6


def test_incremental(samples):
    got = rows(strategies.incremental(samples))  # medians: 5, 5.5, 5, 5
    assert (got["calm"].convergence_iteration, got["calm"].tsv_data, got["calm"].total_input_tokens) == (6, "X\ta\n2000\t5.0", 6)
    assert not got["wild"].converged and got["wild"].tsv_data == "X\ta\n2000\t35.0" and not got["none"].converged
    loose = rows(strategies.incremental(samples, strategies.Sampling(exact_match=False, tolerance=0.2)))
    assert (loose["calm"].convergence_iteration, loose["calm"].num_samples) == (4, 4)


def test_adaptive(samples):
    config = strategies.Sampling()
    got = rows(strategies.adaptive(samples, strategies.exact_done(samples), config))
    assert (got["calm"].convergence_iteration, got["wild"].convergence_iteration) == (6, None)
    steps = strategies.prefix_tables(samples, 2, 10, config)
    near = rows(strategies.adaptive(samples, strategies.variance_done(steps, threshold=0.6), config))
    assert near["calm"].convergence_iteration == 2 and near["calm"].tsv_data == "X\ta\n2000\t4.5" and not near["none"].converged


def test_structured(spark, samples):
    skeletons = spark.createDataFrame([("calm", "\ta\n2000\t_"), ("wild", "\ta\n2001\t_")], "image_id string, structure string")
    got = rows(strategies.structured(samples, skeletons))
    assert got["calm"].tsv_data == "\ta\n2000\t5.0" and got["calm"].convergence_iteration == 6 and got["calm"].error is None
    assert got["wild"].tsv_data is None and "sample 0" in got["wild"].error and set(got) == {"calm", "wild"}


def test_diversity(spark):
    many = [("i", m, "standard", k, f"\ta\n2000\t{v}", 1, 1) for m, k, v in (("x", 0, 1), ("x", 1, 2), ("y", 0, 9), ("y", 1, 9))]
    df = spark.createDataFrame(many, "image_id string, model string, prompt_variant string, sample_idx int, tsv_data string, input_tokens long, output_tokens long")
    assert strategies.diversity(df).first().tsv_data == "X\ta\n2000\t5.5"


def test_short_charts_keep_their_row(spark):
    """One and two samples where three, or two, are needed first: the consensus of what there is, not converged."""
    samples = spark.createDataFrame(sample("one", [4]) + sample("two", [4, 6]) + sample("none", [None]), SCHEMA)
    got = rows(strategies.incremental(samples))
    assert {k: (r.tsv_data, r.converged, r.convergence_iteration, r.num_samples) for k, r in got.items()} == {
        "one": ("\ta\n2000\t4", False, None, 1), "two": ("X\ta\n2000\t5.0", False, None, 2), "none": ("", False, None, 1),
    }
    got = rows(strategies.adaptive(samples, strategies.exact_done(samples)))
    assert (got["one"].tsv_data, got["two"].tsv_data, got["none"].tsv_data) == ("\ta\n2000\t4", "X\ta\n2000\t5.0", "")
    skeletons = spark.createDataFrame([("one", "\ta\n2000\t_"), ("two", "\ta\n2000\t_")], "image_id string, structure string")
    got = rows(strategies.structured(samples, skeletons))
    assert (got["one"].tsv_data, got["two"].tsv_data, got["two"].converged) == ("\ta\n2000\t4", "\ta\n2000\t5.0", False)


def test_prefixes_of_mixed_samples_equal_one_consensus_each(spark):
    """Quoted texts, labels that differ, over-wide rows, blank samples: each prefix as consensus.tables() of just its samples."""
    texts = ['\tA\tB\nx y\t1\t2\nz\t3\t4', '\ta\t"b"\n"x y"\t2\t9\t7\nz\t3\t4', None, "\tA\tB\nx  y\t1\tn/a\nq\t5\t5", '\tx y\tz\nA\t8\t8\nB\t6\t6']
    samples = spark.createDataFrame([(c, i, texts[(i * c) % 5], i, 1) for c in range(1, 6) for i in range(7)], "image_id int, sample_idx int, tsv_data string, input_tokens long, output_tokens long").cache()
    skeletons = spark.createDataFrame([(c, "corner\tA\tB\nx y\t_\t_\nz\t_\t_\nempty\t_\t_") for c in range(1, 6)], "image_id int, structure string")
    for shape in (None, skeletons):
        steps = {(r.image_id, r.prefix_k): r for r in strategies.prefix_tables(samples, 2, 6, skeletons=shape).collect()}
        assert len(steps) == 25
        for k in range(2, 7):
            for want in consensus.tables(samples.filter(f"sample_idx < {k}"), skeletons=shape).collect():
                mine = steps[want.image_id, k]
                assert (mine.mad_tsv, mine.num_samples, mine.total_input_tokens) == (want.mad_tsv, want.num_samples, want.total_input_tokens)
                assert want.used_fallback or mine.tsv_data == want.tsv_data


def test_stability_reads_stripped_texts(spark):
    """An empty corner is lost: labels move by one and the last column isn't compared; a named corner keeps all."""
    df = spark.createDataFrame([(1, "\tA\tN\tR\n1995\t1\t2\t3\n\n1996\t4\tx\t6"), (2, "X\tA\tN\n1995\t1\t2\n1995\t7\t8"), (3, "just a header"), (4, None)], "k int, tsv_data string")
    got = sorted(map(tuple, tables.stripped_cells(df, ["k"]).collect()))
    assert got == [(1, "1995", "N", 1.0), (1, "1995", "R", 2.0), (1, "1996", "N", 4.0), (1, "1996", "R", None), (2, "1995", "A", 7.0), (2, "1995", "N", 8.0)]
