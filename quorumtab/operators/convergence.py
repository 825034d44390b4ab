"""Consensus by prefix of the samples, and when it has settled.

All prefixes of all charts are one job. A prefix's consensus is compared with the one before it; runs of stable
prefixes are gaps and islands over windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 0.1


def prefixes(samples: DataFrame, least: int, most: int, keys: list[str] = ("image_id",)) -> DataFrame:
    """Each sample once for every prefix length prefix_k that holds it; samples are numbered from 0.

    A chart with fewer samples than `least` has one prefix, of all of them.
    """
    last = F.least(F.max("sample_idx").over(Window.partitionBy(*keys)) + 1, F.lit(most))
    start = F.greatest(F.col("sample_idx") + 1, F.least(F.lit(least), F.col("last")))
    return samples.withColumn("last", last).filter(start <= F.col("last")).withColumn("prefix_k", F.explode(F.sequence(start, F.col("last")))).drop("last")


def stable_value(previous: Column, current: Column, tolerance: float = 0.01) -> Column:
    """Numbers that differ by at most the tolerance of the previous one, or by FLOOR; no number is never stable."""
    return F.coalesce(F.abs(previous - current) <= F.greatest(F.lit(FLOOR), tolerance * F.abs(previous)), F.lit(False))


def stability(consensus: DataFrame, keys: list[str] = ("image_id",), value: str = "median", tolerance: float = 0.01, coverage: float = 0.95) -> DataFrame:
    """For each prefix after a chart's first: same_cells, stable_share, exact, stable. consensus: keys, prefix_k, row_label, col_label, value."""
    keys = list(keys)
    now = consensus.select(*keys, "prefix_k", "row_label", "col_label", F.col(value).alias("current"), F.lit(True).alias("here"))
    was = consensus.select(*keys, (F.col("prefix_k") + 1).alias("prefix_k"), "row_label", "col_label", F.col(value).alias("previous"), F.lit(True).alias("there"))
    both = was.join(now, [*keys, "prefix_k", "row_label", "col_label"], "full_outer")
    out = both.groupBy(*keys, "prefix_k").agg(
        F.every(F.col("here").isNotNull() & F.col("there").isNotNull()).alias("same_cells"),
        F.avg(stable_value(F.col("previous"), F.col("current"), tolerance).cast("double")).alias("stable_share"),
        F.every(F.col("previous").eqNullSafe(F.col("current")) & F.col("here").isNotNull() & F.col("there").isNotNull()).alias("exact"),
        F.count("here").alias("n_here"), F.count("there").alias("n_there"),
    )
    out = out.filter("n_here > 0 AND n_there > 0").drop("n_here", "n_there")
    return out.withColumn("stable", F.col("same_cells") & (F.col("stable_share") >= coverage))


def run_lengths(steps: DataFrame, keys: list[str], flag: str, order: str = "prefix_k") -> DataFrame:
    """steps with run: how many rows up to this one have the flag without a break."""
    by = Window.partitionBy(*keys).orderBy(order)
    steps = steps.withColumn("island", F.sum((~F.col(flag)).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum(F.col(flag).cast("int")).over(Window.partitionBy(*keys, "island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("run", run).drop("island")


def incremental(steps: DataFrame, keys: list[str] = ("image_id",), patience: int = 1, stable: str | None = None) -> DataFrame:
    """One row per chart: converged, convergence_iteration, value.

    steps: keys, prefix_k, value, has_content, used_fallback (and the column named by stable, for tolerant comparison; else
    values must be equal). Blank values other than the first are skipped; the first with content is the baseline and can't
    be stable itself. The chart converges at the first prefix that ends a run of `patience` stable ones, with the value
    before it; a chart that doesn't has its last value.
    """
    keys = list(keys)
    by = Window.partitionBy(*keys).orderBy("prefix_k")
    steps = steps.withColumn("first_k", F.min("prefix_k").over(Window.partitionBy(*keys)))
    steps = steps.filter((F.coalesce("value", F.lit("")) != "") | (F.col("prefix_k") == F.col("first_k")))
    steps = steps.withColumn("base", F.min(F.when(F.col("has_content"), F.col("prefix_k"))).over(Window.partitionBy(*keys))).withColumn("before", F.lag("value").over(by))
    same = F.col(stable) if stable else F.col("value") == F.col("before")
    steps = steps.withColumn("ok", F.coalesce((F.col("prefix_k") > F.col("base")) & same & F.col("has_content") & ~F.col("used_fallback"), F.lit(False)))
    steps = run_lengths(steps, keys, "ok")
    end = F.when(F.col("run") >= patience, F.col("prefix_k"))
    out = steps.groupBy(*keys).agg(F.min(end).alias("convergence_iteration"), F.min_by("before", end).alias("settled"), F.max_by("value", "prefix_k").alias("latest"))
    converged = F.col("convergence_iteration").isNotNull()
    return out.select(*keys, converged.alias("converged"), "convergence_iteration", F.when(converged, F.col("settled")).otherwise(F.col("latest")).alias("value"))


def fixed(steps: DataFrame, n: int, keys: list[str] = ("image_id",)) -> DataFrame:
    """The consensus of the first n samples, or of all where there are fewer; never reported as converged."""
    return steps.filter(F.col("prefix_k") <= n).groupBy(*keys).agg(F.max_by("value", "prefix_k").alias("value")).withColumn("converged", F.lit(False))


def adaptive(steps: DataFrame, done: str, least: int, keys: list[str] = ("image_id",)) -> DataFrame:
    """The first prefix of `least` samples or more whose checker column says done, if it has a value; else the last."""
    at = F.when(F.col(done) & (F.col("prefix_k") >= least) & (F.coalesce("value", F.lit("")) != ""), F.col("prefix_k"))
    out = steps.groupBy(*keys).agg(F.min(at).alias("convergence_iteration"), F.min_by("value", at).alias("hit"), F.max_by("value", "prefix_k").alias("latest"))
    return out.select(*keys, F.col("convergence_iteration").isNotNull().alias("converged"), "convergence_iteration", F.when(F.col("convergence_iteration").isNotNull(), F.col("hit")).otherwise(F.col("latest")).alias("value"))


def exact_match(samples: DataFrame, matches: int = 2, keys: list[str] = ("image_id",), text_col: str = "tsv_data") -> DataFrame:
    """samples with done: the last `matches` texts up to this one are equal and none is blank."""
    by = Window.partitionBy(*keys).orderBy("sample_idx").rowsBetween(1 - matches, 0)
    text = F.trim(F.coalesce(F.col(text_col), F.lit("")))
    same = (F.count(F.lit(1)).over(by) == matches) & (F.min(text).over(by) == F.max(text).over(by)) & (F.min(text).over(by) != "")
    return samples.withColumn("done", same)


def marker(samples: DataFrame) -> DataFrame:
    """samples with done: never. The checker named with the incremental strategy, which compares consensus texts by itself."""
    return samples.withColumn("done", F.lit(False))


def variance(consensus: DataFrame, threshold: float = 0.01, every_cell: bool = True, least: int = 2, patience: int = 1, keys: list[str] = ("image_id",)) -> DataFrame:
    """For each prefix: mad (largest, or mean), run, done: MADs within the threshold for `patience` prefixes in a row."""
    keys = list(keys)
    value = F.max("mad") if every_cell else F.avg("mad")
    steps = consensus.groupBy(*keys, "prefix_k").agg(value.alias("mad")).filter(F.col("prefix_k") >= least)
    steps = run_lengths(steps.withColumn("within", F.coalesce(F.col("mad") <= threshold, F.lit(False))), keys, "within")
    return steps.select(*keys, "prefix_k", "mad", "run", (F.col("run") >= patience).alias("done"))


def diversity_plan(models: DataFrame, variants: DataFrame, samples_per_config: int = 2) -> DataFrame:
    """Model, prompt_variant and sample_idx for each combination; both tables are short lists of names."""
    return models.crossJoin(variants).withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(samples_per_config - 1))))


def first_conforming(attempts: DataFrame, flag: str, keys: list[str], most: int = 3) -> DataFrame:
    """Of up to `most` attempts the first that conforms, else the last; cached only if it conforms."""
    tried = attempts.filter(F.col("attempt") < most)
    best = F.struct((~F.col(flag)).alias("bad"), F.when(F.col(flag), F.col("attempt")).otherwise(-F.col("attempt")).alias("at"))
    return tried.groupBy(*keys).agg(F.min_by("tsv_data", best).alias("tsv_data"), F.max(F.col(flag)).alias("cached"))
