"""Consensus methods and convergence checkers by name, which users extend; methods are SQL functions as well.

    add_method(spark, "upper", "array_max(filter(xs, x -> x <= med + 3 * mad))")
    consensus.tables(samples, "upper");  spark.sql("SELECT robust_upper(array(1D, 2D, 50D))")
    add_checker("three", lambda samples, steps: steps.select("image_id", "prefix_k", (F.col("prefix_k") >= 3).alias("done")))
    strategies.adaptive(samples, "three")

A method's text is an expression over xs (a cell's numbers in the order of its samples, none null or NaN), med and mad (their
rounded median and MAD), in Spark SQL. It becomes temporary SQL functions of the session, so it is inlined into the plan and stays
in the JVM; its value is rounded as all values are. Names are identifiers; those of the library can't be taken.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumtab.functions import robust

PREFIX = "robust_"
SCALE = f"{10**robust.DIGITS}D"
HIGH = "(a * 134217729D - (a * 134217729D - a))"
UP = "c.p - c.n > 0.5 OR (c.p - c.n = 0.5 AND (c.lacks > 0 OR (c.lacks = 0 AND c.n % 2 = 1))) OR (c.p = c.n AND c.lacks = 0.5 AND c.n % 2 = 1)"
CLOSE = "forall(xs, x -> abs(x - xs[0]) <= 1e-8D + 1e-5D * abs(xs[0]))"
MEAN = "aggregate({0}, 0D, (a, x) -> a + x) / nullif(size({0}), 0)"
NEAR = f"filter(xs, x -> abs(x - med) <= {robust.OUTSIDE} * mad)"
WEIGHT = f"if(abs(x - acc.mu) <= {robust.HUBER}D * mad, 1D, {robust.HUBER}D * mad / abs(x - acc.mu))"
MOVED = f"aggregate(xs, 0D, (s, x) -> s + {WEIGHT} * x) / aggregate(xs, 0D, (s, x) -> s + {WEIGHT})"
STEP = f"named_struct('mu', if(acc.done OR abs({MOVED} - acc.mu) < {robust.SETTLED}D, acc.mu, {MOVED}), 'done', acc.done OR abs({MOVED} - acc.mu) < {robust.SETTLED}D)"
RANKED = "array_sort(transform(xs, (x, i) -> named_struct('d', abs(x - med), 'i', i, 'x', x)))"

#: Name, parameters, type and text of what the methods share.
SHARED = (
    ("round_parts", "a DOUBLE", "STRUCT<n: BIGINT, p: DOUBLE, lacks: DOUBLE>", f"named_struct('n', floor(a * {SCALE}), 'p', a * {SCALE}, 'lacks', ({HIGH} * {SCALE} - a * {SCALE}) + (a - {HIGH}) * {SCALE})"),
    ("round_nearest", "c STRUCT<n: BIGINT, p: DOUBLE, lacks: DOUBLE>", "DOUBLE", f"(c.n + int({UP}) - int(c.p = c.n AND c.lacks = -0.5 AND c.n % 2 = 1)) / {SCALE}"),
    ("round", "x DOUBLE", "DOUBLE", f"if(abs(x) < {float(1 << 33)}D, if(x < 0, -{PREFIX}round_nearest({PREFIX}round_parts(abs(x))), {PREFIX}round_nearest({PREFIX}round_parts(abs(x)))), x)"),
    ("middle", "s ARRAY<DOUBLE>", "DOUBLE", "(get(s, int(floor((size(s) - 1) / 2))) + get(s, int(floor(size(s) / 2)))) / 2"),
)
#: The library's methods in SQL, each by what is rounded; "{}" where the median stands as it is.
BUILT_IN = {
    "median": "med",
    "mad": "mad",
    "mean": MEAN.format("xs"),
    "medoid": "get(array_sort(xs), int(floor((size(xs) - 1) / 2)))",
    "huber": f"if(mad = 0 OR {CLOSE}, med, aggregate(sequence(1, {robust.STEPS}), named_struct('mu', med, 'done', false), (acc, i) -> {STEP}, acc -> acc.mu))",
    "weighted_confidence": MEAN.format(f"transform(slice({RANKED}, 1, greatest(int(floor(size(xs) * {robust.CLOSEST}D)), 1)), r -> r.x)"),
    "ransac": f"if(mad = 0 OR {CLOSE} OR size({NEAR}) = 0, med, {MEAN.format(NEAR)})",
}
CHECKERS: dict[str, Callable[..., DataFrame]] = {}
_texts = dict(BUILT_IN)


def _create(spark: SparkSession, name: str, takes: str, gives: str, text: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{name}({takes}) RETURNS {gives} RETURN {text}")


def _create_method(spark: SparkSession, name: str) -> None:
    _create(spark, f"{name}_of", "xs ARRAY<DOUBLE>, med DOUBLE, mad DOUBLE", "DOUBLE", f"{PREFIX}round({_texts[name]})")
    _create(spark, f"{name}_med", "xs ARRAY<DOUBLE>, med DOUBLE", "DOUBLE", f"{PREFIX}{name}_of(xs, med, {PREFIX}round({PREFIX}middle(array_sort(transform(xs, x -> abs(x - med))))))")
    _create(spark, name, "xs ARRAY<DOUBLE>", "DOUBLE", f"{PREFIX}{name}_med(xs, {PREFIX}round({PREFIX}middle(array_sort(xs))))")


def register(spark: SparkSession) -> None:
    """Makes robust_<method>(xs) known to SQL in this session, for all methods that have a text."""
    for one in SHARED:
        _create(spark, *one)
    for name in _texts:
        _create_method(spark, name)


def _free(name: str, taken: object) -> None:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"{name!r} is no identifier")
    if name in taken:
        raise ValueError(f"{name!r} is a name of the library")


def add_method(spark: SparkSession, name: str, text: str) -> None:
    """A method by its SQL text: usable by its name wherever a method is, and as robust_<name>(xs) in SQL. Adding it again replaces it."""
    _free(name, [*BUILT_IN, *(one[0] for one in SHARED)])
    before = _texts.get(name)
    _texts[name] = text
    try:
        register(spark)
    except Exception:
        del _texts[name]
        if before is not None:
            _texts[name] = before
        raise

    def method(xs: Column, med: Column, mad: Column) -> Column:
        return F.call_function(f"{PREFIX}{name}_of", xs, med, mad)

    robust.METHODS[name] = method


def remove_method(spark: SparkSession, name: str) -> None:
    """Forgets an added method."""
    _free(name, BUILT_IN)
    for end in ("", "_med", "_of"):
        spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {PREFIX}{name}{end}")
    robust.METHODS.pop(name, None)
    _texts.pop(name, None)


def add_checker(name: str, done: Callable[..., DataFrame]) -> None:
    """A checker: a function of samples and of strategies.prefix_tables() that gives image_id, prefix_k, done (a row at most for each)."""
    _free(name, ("exact", "variance"))
    CHECKERS[name] = done


def checker(name: str) -> Callable[..., DataFrame]:
    if name not in CHECKERS:
        raise ValueError(f"unknown checker {name!r}; there are {sorted(CHECKERS)}")
    return CHECKERS[name]
