"""Consensus tables of many samples of one chart, with a declared skeleton or aligned by similar labels.

A cell's samples are an array in sample order; there are as many as a chart has samples, so it stays small.
"""

from __future__ import annotations

import re
from collections import defaultdict
from difflib import SequenceMatcher
from functools import lru_cache
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumtab.functions import robust
from quorumtab.functions.text import bare, python_text
from quorumtab.operators.matching import once
from quorumtab.operators.tables import cells, has_content, skeleton_cells, to_tsvs


def cell_values(long: DataFrame, keys: list[str]) -> DataFrame:
    """Values per cell label: keys, row_label, col_label, xs (in order of sample, row and column), n."""
    at = F.struct("sample_idx", "row_pos", "col_pos", "value")
    some = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    out = some.groupBy(*keys, "row_label", "col_label").agg(F.transform(F.array_sort(F.collect_list(at)), lambda c: c["value"]).alias("xs"))
    return out.withColumn("n", F.size("xs"))


def aggregated(values: DataFrame, methods: list[str] = tuple(robust.METHODS)) -> DataFrame:
    """cell_values() with a column for each method; median and mad are always there."""
    chosen = {m: robust.method(m) for m in methods}
    out = values.withColumn("median", robust.median(F.col("xs"))).withColumn("mad", robust.mad(F.col("xs"), F.col("median")))
    return out.withColumns({m: f(F.col("xs"), F.col("median"), F.col("mad")) for m, f in chosen.items() if m not in ("median", "mad")})


def structured(samples: DataFrame, skeletons: DataFrame, methods: list[str] = ("median",), keys: list[str] = ("image_id",), missing: str = "zero") -> DataFrame:
    """Long consensus over the skeleton's cells; a sample's columns count by position, its rows by label.

    Cells that no sample has stay, with null values. skeletons may be their skeleton_cells().
    """
    keys = list(keys)
    want = skeletons if "col_label" in skeletons.columns else skeleton_cells(skeletons, keys)
    names = want.select(*keys, "col_pos", "col_label").distinct()
    long = cells(samples, [*keys, "sample_idx"], missing=missing).drop("col_label").join(names, [*keys, "col_pos"])
    return want.join(aggregated(cell_values(long, keys), methods), [*keys, "row_label", "col_label"], "left").drop("xs", "corner")


def _grouped(cells: list[tuple[int, str, int]], least: float, n: int, pruning: bool, prune_below: float) -> dict:
    """Label to (canonical label, position), from cells of (sample, label, place), n samples in all."""
    of, places = defaultdict(set), defaultdict(list)
    for sample, label, place in cells:
        of[label].add(sample)
        places[label].append(place)
    pos = {label: median(p) for label, p in places.items()}
    leaders: list[list] = []
    for label in sorted(of, key=lambda x: (-len(of[x]), min(of[x]), pos[x], x)):
        fits = [(_alike(label, g[0]), -i) for i, g in enumerate(leaders) if not g[2] & of[label]]
        best = max(fits, default=(0, 0))
        if best[0] >= least:
            leaders[-best[1]][1].append(label)
            leaders[-best[1]][2] |= of[label]
        else:
            leaders.append([label, [label], set(of[label]), pos[label]])
    stay = [g for g in leaders if not pruning or len(g[2]) >= prune_below * n]
    stay.sort(key=lambda g: g[3])
    return {x: (g[0], i + 1) for i, g in enumerate(stay) for x in g[1]}


@lru_cache(maxsize=100_000)
def _alike(a: str, b: str) -> float:
    a, b = a.strip().lower(), b.strip().lower()
    if a == b:
        return 1.0
    if re.fullmatch(r"[-\d.,%]+", a) or re.fullmatch(r"[-\d.,%]+", b):
        return 0.0
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def aligned(samples: DataFrame, keys: list[str] = ("image_id",), row_sim: float = 0.5, col_sim: float = 0.5, pruning: bool = True, prune_below: float = 0.5, missing: str = "zero") -> DataFrame:
    """Long cells of samples without a skeleton, under canonical labels and positions; an algorithm of our own.

    Labels of a chart are grouped by leaders, those of most samples first: a label joins the leader most like it, from
    the threshold on, that holds none of its samples yet; labels that are numbers must be equal. A sample whose labels
    fit the first sample better when transposed is transposed. Groups in fewer samples than prune_below go.
    """
    keys = list(keys)
    long = cells(samples, [*keys, "sample_idx"], missing=missing)
    schema = long.select(*keys, "sample_idx", "row_label", "col_label", "row_pos", "col_pos", "value").schema

    def align(t: pa.Table) -> pa.Table:
        found = _canonical(t, None, row_sim, col_sim, pruning, prune_below)
        out = t.take(pa.array([x[0] for x in found], pa.int64()))
        for j, name in enumerate(("row_label", "row_pos", "col_label", "col_pos"), 1):
            at = out.schema.get_field_index(name)
            out = out.set_column(at, out.schema.field(at), pa.array([x[j] for x in found], out.schema.field(at).type))
        return out

    return dealt(long.select(*schema.names), keys).applyInArrow(align, schema)


def dealt(rows: DataFrame, keys: list[str]):  # noqa: ANN201
    """rows grouped by keys in a fixed number of tasks: few bytes and much work, which adaptive execution would join."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).groupBy(*keys)


def _canonical(t: pa.Table, before: int | None, row_sim: float, col_sim: float, pruning: bool, prune_below: float) -> list[tuple]:
    """Of a chart's cells, of samples numbered below `before`, those that stay: (row of t, row label, row place, column label, column place)."""
    of = t.column("sample_idx").to_pylist()
    kept = [i for i, s in enumerate(of) if before is None or s < before]
    if not kept:
        return []
    rows, cols = ([[x or "", p] for x, p in zip(t.column(f"{a}_label").to_pylist(), t.column(f"{a}_pos").to_pylist())] for a in ("row", "col"))
    own = {of[i]: (set(), set()) for i in kept}
    for i in kept:
        own[of[i]][0].add(rows[i][0].lower())
        own[of[i]][1].add(cols[i][0].lower())
    first = own[min(own)]
    turned = {s for s, (r, c) in own.items() if len(r & first[1]) + len(c & first[0]) > len(r & first[0]) + len(c & first[1])}
    for i in [i for i in kept if of[i] in turned]:
        rows[i], cols[i] = cols[i], rows[i]
    for side, least in ((rows, row_sim), (cols, col_sim)):
        to = _grouped([(of[i], *side[i]) for i in kept], least, len(own), pruning, prune_below)
        kept = [i for i in kept if side[i][0] in to]
        for i in kept:
            side[i] = to[side[i][0]]
    return [(i, *rows[i], *cols[i]) for i in kept]


def aligned_prefixes(long: DataFrame, row_sim: float = 0.5, col_sim: float = 0.5, pruning: bool = True, prune_below: float = 0.5) -> DataFrame:
    """Cells of each prefix of each chart's samples, aligned as by aligned(): image_id, prefix_k, row_pos, col_pos, labels, xs (in order of sample), n.

    long: cells() with image_id, sample_idx, and first_k and last_k, a chart's shortest and longest prefix.
    """
    kind = long.schema["image_id"].dataType.simpleString()

    def align(t: pa.Table) -> pa.Table:
        of, values, out = t.column("sample_idx").to_pylist(), t.column("value").to_pylist(), []
        for k in range(t.column("first_k")[0].as_py(), t.column("last_k")[0].as_py() + 1):
            by = defaultdict(list)
            for i, row, row_pos, col, col_pos in _canonical(t, k, row_sim, col_sim, pruning, prune_below):
                if values[i] is not None and values[i] == values[i]:
                    by[row_pos, col_pos, row, col].append((of[i], values[i]))
            out += [(k, *cell, [x for _, x in sorted(got)]) for cell, got in by.items()]
        names, types = ["prefix_k", "row_pos", "col_pos", "row_label", "col_label", "xs"], [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64())]
        cols = list(zip(*out)) if out else [[]] * 6
        same = pa.array([t.column("image_id")[0].as_py()] * len(out), t.schema.field("image_id").type)
        return pa.table([same, *[pa.array(c, x) for c, x in zip(cols, types)]], ["image_id", *names])

    rows = long.select("image_id", "sample_idx", "row_label", "col_label", "row_pos", "col_pos", "value", "first_k", "last_k")
    out = dealt(rows, ["image_id"]).applyInArrow(align, f"image_id {kind}, prefix_k int, row_pos int, col_pos int, row_label string, col_label string, xs array<double>")
    return out.withColumn("n", F.size("xs"))


def structured_prefixes(long: DataFrame, want: DataFrame, spans: DataFrame) -> DataFrame:
    """Cells of each prefix of each chart's samples, over a skeleton's cells: those, prefix_k, xs, n.

    A cell's samples are one ordered array, of which each prefix takes the beginning. long: cells() with image_id, sample_idx;
    want: skeleton_cells(); spans: image_id, first_k, last_k.
    """
    names = want.select("image_id", "col_pos", "col_label").distinct()
    at = F.struct("sample_idx", "row_pos", "col_pos", "value")
    some = long.drop("col_label").filter(F.col("value").isNotNull() & ~F.isnan("value")).join(names, ["image_id", "col_pos"])
    values = some.groupBy("image_id", "row_label", "col_label").agg(F.array_sort(F.collect_list(at)).alias("all"))
    cells_ = want.join(values, ["image_id", "row_label", "col_label"], "left").join(spans, "image_id")
    each = cells_.withColumn("prefix_k", F.explode(F.sequence("first_k", "last_k")))
    xs = F.transform(F.filter("all", lambda c: c["sample_idx"] < F.col("prefix_k")), lambda c: c["value"])
    return each.withColumn("xs", F.coalesce(xs, F.array().cast("array<double>"))).withColumn("n", F.size("xs")).drop("all", "first_k", "last_k")


def free_form(samples: DataFrame, methods: list[str] = ("median",), keys: list[str] = ("image_id",), **options) -> DataFrame:
    """Long consensus of samples without a skeleton, in the form of structured()."""
    keys = list(keys)
    long = aligned(samples, keys, **options)
    return aggregated(cell_values(long, [*keys, "row_pos", "col_pos"]), methods).drop("xs")


def usable(samples: DataFrame, text_col: str = "tsv_data") -> DataFrame:
    """Samples with a text that isn't blank."""
    return samples.filter(F.coalesce(bare(F.col(text_col)) != "", F.lit(False)))


def tables(samples: DataFrame, method: str = "median", skeletons: DataFrame | None = None, keys: list[str] = ("image_id",), **options) -> DataFrame:
    """The consensus of each chart as text: keys, tsv_data, mad_tsv, used_fallback, num_samples, token totals.

    No usable sample: empty texts. One: that sample, as it is. No cells in common: the first usable sample, marked as a
    fallback. With a skeleton the header is the skeleton's, and a chart falls back only if it has none. Samples and the
    skeletons' cells are held, as both are read more than once.
    """
    keys = list(keys)
    samples = once(samples.select(*keys, "sample_idx", "tsv_data", "input_tokens", "output_tokens"))
    has = bare(F.col("tsv_data")) != ""
    sums = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_samples"), F.sum("input_tokens").alias("total_input_tokens"), F.sum("output_tokens").alias("total_output_tokens"),
        F.count(F.when(has, 1)).alias("n_usable"), F.min_by(F.when(has, F.col("tsv_data")), F.when(has, F.col("sample_idx"))).alias("first"),
    )
    ok = usable(samples)
    if skeletons is None:
        return told(sums, free_form(ok, [method], keys, **options), keys, method)
    want = once(skeleton_cells(skeletons, keys))
    return told(sums, structured(ok, want, [method], keys, **options), keys, method, want)


def told(sums: DataFrame, long: DataFrame, keys: list[str], method: str, want: DataFrame | None = None) -> DataFrame:
    """tables() from a chart's sums (and n_usable and first, the first usable sample's text) and its consensus cells; want is the skeleton's cells, if any."""
    shown = long.select(*keys, "row_pos", "col_pos", "row_label", "col_label", python_text(F.col(method)).alias("value"), python_text(F.col("mad")).alias("spread"))
    both = sums.join(to_tsvs(shown, keys, {"value_tsv": "value", "spread_tsv": "spread"}, "X" if want is None else ""), keys, "left")
    if want is not None:
        corners = want.groupBy(*[k for k in keys if k in want.columns]).agg(F.first("corner").alias("corner"))
        both = both.join(corners, [k for k in keys if k in want.columns], "left").withColumns({c: F.concat(F.coalesce("corner", F.lit("")), c) for c in ("value_tsv", "spread_tsv")})
    many = F.col("n_usable") > 1
    made = has_content(F.col("value_tsv")) if want is not None else F.col("value_tsv").isNotNull()
    return both.select(
        *keys, F.when(F.col("n_usable") == 0, "").when(~many, F.col("first")).when(made, F.col("value_tsv")).otherwise(F.col("first")).alias("tsv_data"),
        F.when(many & made, F.col("spread_tsv")).otherwise("").alias("mad_tsv"), (many & ~made).alias("used_fallback"),
        "num_samples", "total_input_tokens", "total_output_tokens",
    )


def variance_map(long: DataFrame, keys: list[str] = ("image_id",)) -> DataFrame:
    """Each chart's cells to their MAD, and its mean and largest MAD."""
    at = F.concat_ws(",", "row_pos", "col_pos")
    return long.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(at, F.coalesce("mad", F.lit(0.0))))).alias("variance"), F.avg("mad").alias("mean_mad"), F.max("mad").alias("max_mad"))
