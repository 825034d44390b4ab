"""Consensus values of a cell: functions of the array of its samples' numbers, in sample order.

Everything is rounded to 6 decimals, as Python does. Deviations are taken from the rounded median. An empty array gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorumtab.functions.text import let

DIGITS = 6
HUBER = 1.345
STEPS = 10
SETTLED = 1e-6
CLOSEST = 0.6
OUTSIDE = 2


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x) / F.nullif(F.size(xs), F.lit(0))


def _middle(xs: Column) -> Column:
    s, n = F.array_sort(xs), F.size(xs)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def rounded(x: Column) -> Column:
    """To DIGITS decimals by the exact value of the double, ties to the even digit.

    x * 10**DIGITS is a double and what it lacks: x is cut into halves of 26 bits, whose products are exact. From 2**33 on
    doubles lie further apart than what is rounded off.
    """
    scale = float(10**DIGITS)

    def parts(a: Column) -> Column:
        wide = a * float((1 << 27) + 1)
        high = wide - (wide - a)
        product = a * scale
        return F.struct(F.floor(product).alias("n"), product.alias("p"), ((high * scale - product) + (a - high) * scale).alias("lacks"))

    def nearest(c: Column) -> Column:
        over, odd = c["p"] - c["n"], c["n"] % 2 == 1
        up = (over > 0.5) | ((over == 0.5) & ((c["lacks"] > 0) | ((c["lacks"] == 0) & odd))) | ((over == 0) & (c["lacks"] == 0.5) & odd)
        down = (over == 0) & (c["lacks"] == -0.5) & odd
        return (c["n"] + up.cast("int") - down.cast("int")).cast("double") / scale

    def signed(x: Column) -> Column:
        size = let(let(F.abs(x), parts), nearest)
        return F.when(F.abs(x) < float(1 << 33), F.when(x < 0, -size).otherwise(size)).otherwise(x)

    return let(x.cast("double"), signed)


def median(xs: Column) -> Column:
    return rounded(_middle(xs))


def mad(xs: Column, med: Column) -> Column:
    return rounded(_middle(F.transform(xs, lambda x: F.abs(x - med))))


def all_close(xs: Column) -> Column:
    first = F.get(xs, 0)
    return F.forall(xs, lambda x: F.abs(x - first) <= 1e-8 + 1e-5 * F.abs(first))


def mean(xs: Column, med: Column, mad_: Column) -> Column:
    return rounded(_mean(xs))


def medoid(xs: Column, med: Column, mad_: Column) -> Column:
    """The lower of the two middle values."""
    return rounded(F.get(F.array_sort(xs), F.floor((F.size(xs) - 1) / 2).cast("int")))


def huber(xs: Column, med: Column, mad_: Column) -> Column:
    """Location by reweighting from the median, at most STEPS times; the step that settles is not taken."""
    delta = HUBER * mad_

    def step(acc: Column, _: Column) -> Column:
        mu = acc["mu"]
        weight = lambda x: F.when(F.abs(x - mu) <= delta, F.lit(1.0)).otherwise(delta / F.abs(x - mu))
        total = F.aggregate(xs, F.lit(0.0), lambda a, x: a + weight(x))
        new = F.aggregate(xs, F.lit(0.0), lambda a, x: a + weight(x) * x) / total
        done = acc["done"] | (F.abs(new - mu) < SETTLED)
        return F.struct(F.when(done, mu).otherwise(new).alias("mu"), done.alias("done"))

    start = F.struct(med.cast("double").alias("mu"), F.lit(False).alias("done"))
    fold = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda acc: acc["mu"])
    return F.when((mad_ == 0) | all_close(xs), med).otherwise(rounded(fold))


def weighted_confidence(xs: Column, med: Column, mad_: Column) -> Column:
    """Mean of the 60 % closest to the median, one at least; of equally close ones the earlier samples."""
    ranked = F.array_sort(F.transform(xs, lambda x, i: F.struct(F.abs(x - med).alias("d"), i.alias("i"), x.alias("x"))))
    k = F.greatest(F.floor(F.size(xs) * CLOSEST).cast("int"), F.lit(1))
    return rounded(_mean(F.transform(F.slice(ranked, F.lit(1), k), lambda r: r["x"])))


def ransac(xs: Column, med: Column, mad_: Column) -> Column:
    """Mean of the values within twice the MAD of the median."""
    near = F.filter(xs, lambda x: F.abs(x - med) <= OUTSIDE * mad_)
    return F.when((mad_ == 0) | all_close(xs) | (F.size(near) == 0), med).otherwise(rounded(_mean(near)))


METHODS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "median": lambda xs, med, mad_: med,
    "mad": lambda xs, med, mad_: mad_,
    "mean": mean,
    "medoid": medoid,
    "huber": huber,
    "weighted_confidence": weighted_confidence,
    "ransac": ransac,
}


def method(name: str) -> Callable[[Column, Column, Column], Column]:
    if name not in METHODS:
        raise ValueError(f"unknown method {name!r}; there are {sorted(METHODS)}")
    return METHODS[name]
