"""The sampling strategies as replays over stored samples: what each would have returned, and after how many samples.

samples: image_id, sample_idx (from 0), tsv_data, input_tokens, output_tokens. Each strategy gives one row per chart:
image_id, tsv_data, converged, convergence_iteration (null if it didn't), num_samples, total_input_tokens,
total_output_tokens; the totals are those of the samples it took. All charts and all prefixes are one job. A chart with
fewer samples than the first check needs gives the consensus of what it has, not converged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumtab.functions import registry
from quorumtab.functions.text import bare
from quorumtab.operators import consensus, convergence, tables
from quorumtab.operators.matching import once

TOTALS = ["num_samples", "total_input_tokens", "total_output_tokens"]
STEP = ["image_id", "prefix_k"]


@dataclass(frozen=True)
class Sampling:
    """Parameters that the strategies share. The row and column thresholds and pruning are for charts without a skeleton."""

    method: str = "median"
    fixed_samples: int = 10
    adaptive_least: int = 2
    initial: int = 3
    most: int = 10
    patience: int = 1
    exact_match: bool = True
    coverage: float = 0.95
    tolerance: float = 0.01
    row_sim: float = 0.5
    col_sim: float = 0.5
    pruning: bool = True
    prune_below: float = 0.5

    def alignment(self) -> dict:
        return {k: getattr(self, k) for k in ("row_sim", "col_sim", "pruning", "prune_below")}


def prefix_tables(samples: DataFrame, least: int, most: int, config: Sampling = Sampling(), skeletons: DataFrame | None = None) -> DataFrame:
    """consensus.tables() of each prefix, with prefix_k. A chart with fewer samples than `least` has one prefix, of all of them.

    Samples are held and parsed once; a prefix takes the beginning of what its chart or cell has. There are at most `most`
    samples of a chart. Where a prefix falls back, the last consensus of a shorter one that didn't is taken, if it has more
    than a header.
    """
    held = once(samples.filter(F.col("sample_idx") < most).select("image_id", "sample_idx", "tsv_data", "input_tokens", "output_tokens"))
    text = F.col("tsv_data")
    ok = F.coalesce(bare(text) != "", F.lit(False))
    one = F.struct("sample_idx", ok.alias("ok"), "input_tokens", "output_tokens")
    charts = held.groupBy("image_id").agg(F.array_sort(F.collect_list(one)).alias("all"), F.min_by(F.when(ok, text), F.when(ok, F.col("sample_idx"))).alias("first"))
    last = F.get("all", F.size("all") - 1)["sample_idx"] + 1
    charts = once(charts.withColumns({"last_k": last, "first_k": F.least(F.lit(least), last)}))
    spans = charts.select("image_id", "first_k", "last_k")

    sums = charts.withColumn("prefix_k", F.explode(F.sequence("first_k", "last_k"))).withColumn("now", F.filter("all", lambda s: s["sample_idx"] < F.col("prefix_k")))
    total = lambda c: F.aggregate(F.filter(F.col("now")[c], lambda x: x.isNotNull()), F.lit(None).cast("long"), lambda acc, x: F.coalesce(acc, F.lit(0)) + x)
    sums = sums.select(*STEP, F.size("now").cast("long").alias("num_samples"), total("input_tokens").alias("total_input_tokens"), total("output_tokens").alias("total_output_tokens"), F.size(F.filter("now", lambda s: s["ok"])).alias("n_usable"), "first")

    long = tables.cells(held.filter(ok), ["image_id", "sample_idx"])
    if skeletons is None:
        cells, want = consensus.aligned_prefixes(long.join(spans, "image_id"), **config.alignment()), None
    else:
        want = once(tables.skeleton_cells(skeletons, ["image_id"]))
        cells = consensus.structured_prefixes(long, want, spans)
    steps = consensus.told(sums, consensus.aggregated(cells, [config.method]), STEP, config.method, want)
    before = Window.partitionBy("image_id").orderBy("prefix_k").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(~F.col("used_fallback") & (F.col("tsv_data") != ""), F.col("tsv_data"))
    steps = steps.withColumn("earlier", F.last(own, ignorenulls=True).over(before))
    text = F.when(F.col("used_fallback") & tables.has_content(F.col("earlier")), F.col("earlier")).otherwise(F.col("tsv_data"))
    return once(steps.withColumn("tsv_data", text).drop("earlier"))


def _taken(found: DataFrame, steps: DataFrame) -> DataFrame:
    """found (image_id, converged, convergence_iteration, value) with the totals of the prefix at which it stopped."""
    last = steps.groupBy("image_id").agg(F.max("prefix_k").alias("last_k"))
    out = found.withColumnRenamed("value", "tsv_data").join(last, "image_id").withColumn("prefix_k", F.coalesce("convergence_iteration", "last_k"))
    out = out.join(steps.select(*STEP, *TOTALS), STEP)
    return out.select("image_id", "tsv_data", "converged", "convergence_iteration", *TOTALS)


def fixed(samples: DataFrame, config: Sampling = Sampling()) -> DataFrame:
    """The consensus of the first fixed_samples samples, or of all where there are fewer; never converged."""
    some = samples.filter(F.col("sample_idx") < config.fixed_samples)
    out = consensus.tables(some, config.method, **config.alignment())
    return out.select("image_id", "tsv_data", F.lit(False).alias("converged"), F.lit(None).cast("int").alias("convergence_iteration"), *TOTALS)


def diversity(samples: DataFrame, config: Sampling = Sampling()) -> DataFrame:
    """The consensus of all samples of all models and prompts; sample_idx may repeat between these."""
    by = Window.partitionBy("image_id").orderBy("model", "prompt_variant", "sample_idx")
    numbered = samples.withColumn("sample_idx", F.row_number().over(by) - 1)
    out = consensus.tables(numbered, config.method, **config.alignment())
    return out.select("image_id", "tsv_data", F.lit(False).alias("converged"), F.lit(None).cast("int").alias("convergence_iteration"), *TOTALS)


def adaptive(samples: DataFrame, done: DataFrame | str, config: Sampling = Sampling()) -> DataFrame:
    """The first prefix that a checker says is done; done: a checker's name ("exact", "variance" or an added one), or image_id, prefix_k, done."""
    steps = prefix_tables(samples, config.adaptive_least, config.most, config)
    if isinstance(done, str):
        done = registry.checker(done)(samples, steps).select(*STEP, "done")
    judged = steps.withColumnRenamed("tsv_data", "value").join(done, STEP, "left").withColumn("done", F.coalesce("done", F.lit(False)))
    return _taken(convergence.adaptive(judged, "done", config.adaptive_least), steps)


def exact_done(samples: DataFrame, matches: int = 2) -> DataFrame:
    """Done where the last `matches` raw samples are equal."""
    return convergence.exact_match(samples, matches).select("image_id", (F.col("sample_idx") + 1).alias("prefix_k"), "done")


def variance_done(steps: DataFrame, **options) -> DataFrame:
    """Done where the MADs of prefix_tables() are within convergence.variance()'s threshold; a prefix without any isn't."""
    spread = tables.cells(steps, STEP, "mad_tsv").withColumnRenamed("value", "mad")
    return convergence.variance(spread, **options).select(*STEP, "done")


registry.CHECKERS.update(exact=lambda samples, steps: exact_done(samples), variance=lambda samples, steps: variance_done(steps))


def _settled(steps: DataFrame, config: Sampling, exact: bool) -> DataFrame:
    judged = steps.withColumnRenamed("tsv_data", "value").withColumn("has_content", tables.has_content(F.col("value")))
    if exact:
        return _taken(convergence.incremental(judged, patience=config.patience), steps)
    calm = convergence.stability(tables.stripped_cells(steps, STEP), value="value", tolerance=config.tolerance, coverage=config.coverage)
    judged = judged.join(calm.select(*STEP, F.col("stable").alias("calm")), STEP, "left").withColumn("calm", F.coalesce("calm", F.lit(False)))
    return _taken(convergence.incremental(judged, patience=config.patience, stable="calm"), steps)


def incremental(samples: DataFrame, config: Sampling = Sampling()) -> DataFrame:
    """Samples are added until the consensus stays, as text or within the tolerance, for `patience` prefixes."""
    return _settled(prefix_tables(samples, config.initial, config.most, config), config, config.exact_match)


def structured(samples: DataFrame, skeletons: DataFrame, config: Sampling = Sampling()) -> DataFrame:
    """incremental() against a skeleton, with error: a chart whose first samples don't all conform has that and no table.

    Comparison is within 1% for 95% of the cells unless exact_match. Later samples needn't conform.
    """
    first = samples.filter(F.col("sample_idx") < config.initial).join(skeletons, "image_id")
    odd = first.groupBy("image_id").agg(F.min(F.when(~tables.conforms(F.col("tsv_data"), F.col("structure")), F.col("sample_idx"))).alias("odd"))
    steps = prefix_tables(samples.join(skeletons, "image_id", "left_semi"), config.initial, config.most, config, skeletons)
    fixed_rule = Sampling(method=config.method, patience=config.patience)
    out = _settled(steps, fixed_rule, config.exact_match).join(odd, "image_id")
    error = F.when(F.col("odd").isNotNull(), F.concat(F.lit("sample "), F.col("odd"), F.lit(" does not conform to the skeleton")))
    good = F.col("odd").isNull()
    return out.select(
        "image_id", F.when(good, F.col("tsv_data")).alias("tsv_data"), (good & F.col("converged")).alias("converged"),
        F.when(good, F.col("convergence_iteration")).alias("convergence_iteration"), *TOTALS, error.alias("error"),
    )
