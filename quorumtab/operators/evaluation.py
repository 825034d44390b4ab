"""Scores of predicted tables: precision, recall and F1 of datapoints under an optimal matching, with kinds of errors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumtab.functions.text import anls, bare, let, value_penalty
from quorumtab.operators.matching import once, sparse_matched
from quorumtab.operators.tables import plain_table, transposed

#: A pair of tables with more pairs of datapoints than this is matched without a matrix.
DENSE_CELLS = 10_000
BUCKETS = ["correct", "value_errors", "label_errors", "missing_datapoints", "extra_datapoints"]


def datapoints(tables: DataFrame, keys: list[str], table_col: str = "table") -> DataFrame:
    """Long datapoints (keys, pos, key, value) of plain tables; the title is the first. Of equal keys the first place and the last value count."""
    t = F.col(table_col)
    body = F.transform(t["rows"], lambda r: F.transform(F.arrays_zip(F.slice(t["headers"], 2, 1 << 30).alias("h"), F.slice(r, 2, 1 << 30).alias("v")), lambda x, j: F.struct(F.concat(F.get(r, 0), F.lit(" "), x["h"]).alias("key"), x["v"].alias("value"), (j + 1 < F.least(F.size(t["headers"]), F.size(r))).alias("whole"))))
    title = F.array(F.struct(F.lit("title").alias("key"), F.coalesce(t["title"], F.lit("")).alias("value"), F.lit(True).alias("whole")))
    long = tables.select(*keys, F.posexplode(F.filter(F.concat(title, F.flatten(body)), lambda x: x["whole"])).alias("pos", "d"))
    return long.groupBy(*keys, F.col("d.key").alias("key")).agg(F.min("pos").alias("pos"), F.max_by("d.value", "pos").alias("value"))


def assigned(cost: np.ndarray) -> list[tuple[int, int]]:
    """A cheapest one-to-one assignment of rows to columns (shortest augmenting paths with potentials)."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assigned(cost.T))
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, n)
    for row in range(n):
        owner[m], at, best, back, used = row, m, np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[at] != n:
            used[at], i = True, owner[at]
            free = ~used[:m]
            less = free & (cost[i] - u[i] - v[:m] < best)
            best[less], back[less] = (cost[i] - u[i] - v[:m])[less], at
            to = int(np.argmin(np.where(free, best, np.inf)))
            step = best[to]
            u[owner[used]] += step
            v[used] -= step
            best[free] -= step
            at = to
        while at != m:
            owner[at], at = owner[back[at]], back[at]
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] != n)


def matched(targets: DataFrame, predictions: DataFrame, keys: list[str], text_theta: float = 0.5, dense_cells: int | None = None) -> DataFrame:
    """Optimally matched datapoints whose keys are alike: keys, key_score, t_value, p_value.

    Pairs of tables with at most dense_cells pairs of datapoints are a row each, with a matrix of that size; larger ones go
    through matching.sparse_matched(), which gets their keys. Where one side's keys are all among the other's, matching
    equal keys is the optimum, and the only one, so neither is needed. Both tables are read several times: hold them.
    """
    limit = DENSE_CELLS if dense_cells is None else dense_cells
    sizes = targets.groupBy(*keys).agg(F.count(F.lit(1)).alias("ng")).join(predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("np")), keys)
    large = once(sizes.filter(F.col("ng") * F.col("np") > limit))
    if not large.head(1):
        return _dense_matched(targets, predictions, keys, text_theta)
    few = large.select(*keys)
    t, p = targets.join(few, keys, "left_semi"), predictions.join(few, keys, "left_semi")
    equal = once(t.join(p.select(*keys, "key", F.col("pos").alias("p_pos")).hint("merge"), [*keys, "key"]).select(*keys, F.col("pos").alias("t_pos"), "p_pos", F.lit(1.0).alias("key_score")))
    nested = equal.groupBy(*keys).agg(F.count(F.lit(1)).alias("same")).join(large, keys).filter(F.col("same") == F.least("ng", "np")).select(*keys)
    found = sparse_matched(t.join(nested, keys, "left_anti"), p.join(nested, keys, "left_anti"), keys, text_theta).unionByName(equal.join(nested, keys, "left_semi"))
    value = lambda points, side: points.select(*keys, F.col("pos").alias(f"{side}_pos"), F.col("value").alias(f"{side}_value"))
    found = found.join(value(t, "t").hint("merge"), [*keys, "t_pos"]).join(value(p, "p").hint("merge"), [*keys, "p_pos"]).select(*keys, "key_score", "t_value", "p_value")
    return _dense_matched(targets.join(few, keys, "left_anti"), predictions.join(few, keys, "left_anti"), keys, text_theta).unionByName(found)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("s", T.DoubleType())])))
def _solved(edges: pa.Array) -> pa.Array:
    """Of each row's edges (i, j, s) those of an assignment with the largest sum of s; only rows and columns with an edge are looked at."""
    out = []
    for found in edges.to_pylist():
        if found is None:
            out.append(None)
            continue
        rows, cols = ({x: k for k, x in enumerate(sorted({e[c] for e in found}))} for c in "ij")
        cost, of = np.ones((len(rows), len(cols))), {}
        for e in found:
            cost[rows[e["i"]], cols[e["j"]]] = 1 - e["s"]
            of[rows[e["i"]], cols[e["j"]]] = e
        out.append([of[x] for x in assigned(cost) if x in of])
    return pa.array(out, pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("s", pa.float64())])))


def _picked(rows: DataFrame, text_theta: float) -> DataFrame:
    """rows with t and p, arrays of datapoints (pos, key, value), with picked: optimally matched ones whose keys are alike, as (i, j, s).

    That depends on the keys alone, which tables of like charts share, so it is found once for each different pair of key
    lists. Where one side's keys are all among the other's, these are the equal keys. Else pairs of keys with a score above 0
    are the edges: where no two share an end all are picked, and only other pairs of lists are solved.
    """
    rows = rows.withColumns({"t_keys": F.col("t")["key"], "p_keys": F.col("p")["key"]})
    nested = F.size(F.array_intersect("t_keys", "p_keys")) >= F.least(F.size("t_keys"), F.size("p_keys"))
    one = lambda i, j, s: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), s.alias("s"))
    equal = F.filter(F.transform("t_keys", lambda a, i: one(i, F.array_position(F.col("p_keys"), a) - 1, F.lit(1.0))), lambda x: x["j"] >= 0)
    alike = F.flatten(F.transform("t_keys", lambda a, i: F.filter(F.transform("p_keys", lambda b, j: one(i, j, anls(a, b, text_theta))), lambda x: x["s"] > 0)))
    lists = rows.select("t_keys", "p_keys").distinct().withColumn("edges", F.when(nested, equal).otherwise(alike))
    apart = lambda c: F.size(F.array_distinct(F.col("edges")[c])) == F.size("edges")
    lists = lists.withColumn("picked", F.coalesce(_solved.asNondeterministic()(F.when(~(apart("i") & apart("j")), F.col("edges"))), F.col("edges"))).drop("edges")
    return rows.join(lists, ["t_keys", "p_keys"]).drop("t_keys", "p_keys")


def _dense_matched(targets: DataFrame, predictions: DataFrame, keys: list[str], text_theta: float) -> DataFrame:
    """matched() for pairs of tables that are a row each."""
    side = lambda points, name: points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "key", "value"))).alias(name))
    long = _picked(side(targets, "t").join(side(predictions, "p"), keys), text_theta).withColumn("x", F.explode("picked"))
    at = lambda c, k: F.get(F.col(c), F.col(f"x.{k}"))
    return long.select(*keys, F.col("x.s").alias("key_score"), at("t", "i")["value"].alias("t_value"), at("p", "j")["value"].alias("p_value"))


def _points(table: Column) -> Column:
    """datapoints() of a plain table as one array of (pos, key, value), in order."""
    lone = lambda r, h: F.transform(F.slice(h, F.lit(2), F.greatest(F.least(F.size(h), F.size(r)) - 1, F.lit(0))), lambda x, j: F.struct(F.concat(F.get(r, F.lit(0)), F.lit(" "), x).alias("key"), F.get(r, j + 1).alias("value")))
    body = F.flatten(F.transform(table["rows"], lambda r: lone(r, table["headers"])))
    title = F.array(F.struct(F.lit("title").alias("key"), F.coalesce(table["title"], F.lit("")).alias("value")))
    placed = F.array_sort(F.transform(F.concat(title, body), lambda x, i: F.struct(x["key"].alias("key"), i.alias("pos"), x["value"].alias("value"))))

    def distinct(a: Column) -> Column:
        first = F.filter(a, lambda x, i: (i == 0) | ~F.get(a, i - 1)["key"].eqNullSafe(x["key"]))
        last = F.filter(a, lambda x, i: ~F.coalesce(F.get(a, i + 1)["key"].eqNullSafe(x["key"]), F.lit(False)))
        return F.array_sort(F.zip_with(first, last, lambda x, y: F.struct(x["pos"].alias("pos"), x["key"].alias("key"), y["value"].alias("value"))))

    return let(placed, distinct)


def scores(targets: DataFrame, predictions: DataFrame, keys: list[str], text_theta: float = 0.5, number_theta: float = 0.1, zero_target: str = "match", dense_cells: int | None = None) -> DataFrame:
    """Per key: precision, recall, f1, and shares of 100 for the kinds in BUCKETS."""
    targets, predictions = once(targets), once(predictions)
    key = F.col("key_score")
    pairs = matched(targets, predictions, keys, text_theta, dense_cells).withColumn("pen", value_penalty(F.col("t_value"), F.col("p_value"), text_theta, number_theta, zero_target))
    sums = pairs.groupBy(*keys).agg(
        F.sum(key * (1 - F.col("pen"))).alias("score"), F.sum(2 * (1 - key)).alias("label"), F.sum(2 * key * F.col("pen")).alias("value"), F.count(F.lit(1)).alias("hits"),
    )
    sizes = targets.groupBy(*keys).agg(F.count(F.lit(1)).alias("ng")).join(predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("np")), keys, "full_outer").fillna(0, ["ng", "np"])
    return _shares(sizes.join(sums, keys, "left").fillna(0, ["score", "label", "value", "hits"]), keys)


def _shares(all_: DataFrame, keys: list[str]) -> DataFrame:
    """scores() from the numbers of datapoints, ng and np, and the sums score, label, value and hits."""
    total = F.col("ng") + F.col("np")
    share = lambda x: F.when(total > 0, 100 * x / total).otherwise(F.lit(0.0))
    none = total == 0
    return all_.select(
        *keys, F.when(F.col("np") > 0, F.col("score") / F.col("np")).otherwise(1.0).alias("precision"), F.when(F.col("ng") > 0, F.col("score") / F.col("ng")).otherwise(F.when(none, 1.0).otherwise(0.0)).alias("recall"),
        F.when(none, 1.0).otherwise(2 * F.col("score") / F.nullif(total, F.lit(0))).alias("f1"), F.when(none, 100.0).otherwise(share(2 * F.col("score"))).alias("correct"),
        share(F.col("value")).alias("value_errors"), share(F.col("label")).alias("label_errors"),
        share(F.col("ng") - F.col("hits")).alias("missing_datapoints"), share(F.col("np") - F.col("hits")).alias("extra_datapoints"),
    )


def _row_scores(rows: DataFrame, keys: list[str], text_theta: float, number_theta: float, zero_target: str) -> DataFrame:
    """scores() of pairs of tables that are a row each, with datapoints as arrays t and p: none of them is shuffled."""
    penalty = lambda x: value_penalty(F.get("t", x["i"])["value"], F.get("p", x["j"])["value"], text_theta, number_theta, zero_target)
    hits = _picked(rows, text_theta).withColumn("hit", F.transform("picked", lambda x: F.struct(x["s"].alias("key"), penalty(x).alias("pen"))))
    total = lambda of: F.aggregate("hit", F.lit(0.0), lambda acc, x: acc + of(x["key"], x["pen"]))
    sums = hits.select(
        *keys, F.size("t").cast("long").alias("ng"), F.size("p").cast("long").alias("np"), total(lambda key, pen: key * (1 - pen)).alias("score"),
        total(lambda key, pen: 2 * (1 - key)).alias("label"), total(lambda key, pen: 2 * key * pen).alias("value"), F.size("hit").cast("long").alias("hits"),
    )
    return _shares(sums, keys)


def per_pair(pairs: DataFrame, add_title: bool = True, text_theta: float = 0.5, number_theta: float = 0.1, zero_target: str = "match", dense_cells: int | None = None) -> DataFrame:
    """Scores of each pair_id, the best of the prediction as it is and transposed, against each reference (transposed on ties, then the first).

    pairs: pair_id, gt_answer (a text, or an array of texts; an empty or null one counts as one empty text), model_answer. add_title puts an empty title first on both sides, a datapoint that matches.
    """
    head = "title\t\n" if add_title else ""
    text = lambda c: F.concat(F.lit(head), F.lower(bare(F.coalesce(F.col(c), F.lit("")))))
    many = isinstance(pairs.schema["gt_answer"].dataType, T.ArrayType)
    answers = F.when(F.size("gt_answer") > 0, F.col("gt_answer")).otherwise(F.array(F.lit(""))) if many else F.array("gt_answer")
    pairs = pairs.select("pair_id", "model_answer", F.posexplode(answers).alias("ref", "gt_answer"))
    flat = pairs.select("pair_id", "ref", plain_table(text("gt_answer")).alias("gt"), plain_table(text("model_answer")).alias("told"))
    way = lambda yes, table: F.struct(F.lit(yes).alias("transposed"), let(table, _points).alias("p"))
    held = once(flat.select("pair_id", "ref", _points(F.col("gt")).alias("t"), F.array(way(True, transposed(F.col("told"))), way(False, F.col("told"))).alias("ways")))
    limit, keys = DENSE_CELLS if dense_cells is None else dense_cells, ["pair_id", "ref", "transposed"]
    rows = held.select("pair_id", "ref", "t", F.explode("ways").alias("w")).select("pair_id", "ref", "w.transposed", "t", "w.p")
    large = F.size("t").cast("long") * F.size("p") > limit
    out = _row_scores(rows.filter(~large), keys, text_theta, number_theta, zero_target)
    if held.filter(F.exists("ways", lambda w: F.size("t").cast("long") * F.size(w["p"]) > limit)).head(1):
        side = lambda c: rows.filter(large).select(*keys, F.explode(c).alias("d")).select(*keys, "d.pos", "d.key", "d.value")
        out = out.unionByName(scores(side("t"), side("p"), keys, text_theta, number_theta, zero_target, dense_cells))
    best = out.groupBy("pair_id").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("pair_id", "ref")]), F.struct("f1", "transposed", -F.col("ref"))).alias("b"))
    return best.select("pair_id", "b.*")


def evaluate(pairs: DataFrame, **options) -> DataFrame:
    """One row: mean precision, recall and F1 in percent, and mean shares, their rest given to the largest kind of error."""
    mean = per_pair(pairs, **options).agg(*[(100 * F.avg(c)).alias(c) for c in ("precision", "recall", "f1")], *[F.avg(c).alias(c) for c in BUCKETS])
    rest = 100 - sum((F.col(c) for c in BUCKETS[1:]), F.col("correct"))
    largest = F.greatest(*[F.col(c) for c in BUCKETS[1:]])
    which = F.coalesce(*[F.when(F.col(c) == largest, F.lit(c)) for c in BUCKETS[1:]])
    return mean.withColumn("rest", rest).withColumn("which", which).withColumns({c: F.when((F.abs("rest") > 1e-6) & (F.col("which") == c), F.col(c) + F.col("rest")).otherwise(F.col(c)) for c in BUCKETS[1:]}).drop("rest", "which")
