"""Robust values of cells with any number of samples: no array longer than SMALL, whatever a cell holds.

Order statistics are found by counting. The rows that may hold a wanted rank are counted by ranges between their least and
largest value, the range with the rank is kept, and that again until few rows, or equal ones, are left. Counts are added
up where the rows lie, so a cell of many rows is never in one task. Means, Huber's steps and shares are sums of the same kind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumtab.functions import robust
from quorumtab.operators.matching import once

RANGES = 1024
SMALL = 4096
BROADCAST_CELLS = 50_000


def _beside(rows: DataFrame, state: DataFrame, cell: list[str]) -> DataFrame:
    """rows joined to a table of few rows a cell; broadcast where that is small by its count, else left to adaptive execution."""
    return rows.join(F.broadcast(state) if state.count() <= BROADCAST_CELLS else state, cell)


def ranked(rows: DataFrame, cell: list[str], wanted: DataFrame, x: str = "x") -> DataFrame:
    """Values by rank: wanted (cell, which, rank from 0) with value. rows (cell, x, no nulls) are read several times: hold them."""
    ends = rows.groupBy(*cell).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(F.lit(1)).alias("n"))
    open_, found = once(wanted.join(ends, cell)), []
    while True:
        found.append(open_.filter("lo = hi").select(*cell, "which", F.col("lo").alias("value")))
        open_ = open_.filter("lo != hi")
        large = open_.filter(F.col("n") > SMALL)
        if not large.head(1):
            break
        inside = _beside(rows, large, cell).filter(F.col(x).between(F.col("lo"), F.col("hi")))
        share = (F.col(x) / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves, as the difference may be no number
        counts = inside.groupBy(*cell, "which", "rank", F.floor(share * RANGES).cast("int").alias("range")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*cell, "which").orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
        hit = counts.withColumn("upto", upto).filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        hit = hit.select(*cell, "which", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "lo", "hi", "n")
        open_ = once(hit.unionByName(open_.filter(F.col("n") <= SMALL).select(*hit.columns)))
    few = _beside(rows, open_, cell).filter(F.col(x).between(F.col("lo"), F.col("hi")))
    last = few.groupBy(*cell, "which", "rank").agg(F.sort_array(F.collect_list(x)).alias("xs")).select(*cell, "which", F.get("xs", F.col("rank").cast("int")).alias("value"))
    return reduce(DataFrame.unionByName, found, last)


def _middle(rows: DataFrame, cell: list[str], sizes: DataFrame) -> DataFrame:
    """cell, low, middle: the lower of the two middle values, and their mean."""
    n = F.col("n") - 1
    ranks = sizes.select(*cell, F.explode(F.array(F.struct(F.lit("a").alias("which"), F.floor(n / 2).alias("rank")), F.struct(F.lit("b").alias("which"), F.ceil(n / 2).alias("rank")))).alias("w")).select(*cell, "w.*")
    return ranked(rows, cell, ranks).groupBy(*cell).agg(F.min("value").alias("low"), ((F.min("value") + F.max("value")) / 2).alias("middle"))


#: The methods that need no array.
OWN = tuple(robust.METHODS.values())


def aggregated_cells(long: DataFrame, cell: list[str], methods: list[str] = tuple(robust.METHODS)) -> DataFrame:
    """consensus.aggregated() of long cells (cell, sample_idx, row_pos, col_pos, value) without an array a cell: cell, n, methods.

    Of samples in equal places, the smaller value counts as the earlier one.
    """
    for m in methods:
        if robust.method(m) not in OWN:
            raise ValueError(f"{m!r} needs a cell's values as an array: consensus.aggregated() has it")
    at = F.struct("sample_idx", "row_pos", "col_pos", "value")
    rows = once(long.filter(F.col("value").isNotNull() & ~F.isnan("value")).select(*cell, F.col("value").cast("double").alias("x"), at.alias("at")))
    sizes = once(rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_"), F.min_by("x", "at").alias("first")))
    out = sizes.join(_middle(rows, cell, sizes), cell).withColumn("median", robust.rounded(F.col("middle"))).drop("middle")
    far = once(_beside(rows, once(out.select(*cell, "median", "first")), cell).withColumns({
        "x": F.abs(F.col("x") - F.col("median")), "v": F.col("x"), "near": F.abs(F.col("x") - F.col("first")) <= 1e-8 + 1e-5 * F.abs("first"),
    }).drop("median", "first"))
    out = out.join(_middle(far, cell, sizes).select(*cell, robust.rounded(F.col("middle")).alias("mad")), cell)
    out = once(out.join(far.groupBy(*cell).agg(F.every("near").alias("close")), cell))
    plain = (F.col("mad") == 0) | F.col("close")
    made: dict[str, Column] = {"median": F.col("median"), "mad": F.col("mad"), "mean": robust.rounded(F.col("mean_")), "medoid": robust.rounded(F.col("low"))}
    if "huber" in methods:
        out = out.join(_huber(far, out, cell), cell)
        made["huber"] = F.when(plain, F.col("median")).otherwise(robust.rounded(F.col("mu")))
    if "weighted_confidence" in methods:
        out = out.join(_closest(far, out, cell), cell)
        made["weighted_confidence"] = robust.rounded(F.col("closest"))
    if "ransac" in methods:
        near = _beside(far, out.select(*cell, "mad"), cell).filter(F.col("x") <= robust.OUTSIDE * F.col("mad")).groupBy(*cell).agg(F.avg("v").alias("inside"))
        out = out.join(near, cell, "left")
        made["ransac"] = F.when(plain | F.col("inside").isNull(), F.col("median")).otherwise(robust.rounded(F.col("inside")))
    return out.select(*cell, F.col("n").cast("int").alias("n"), *[made[m].alias(m) for m in dict.fromkeys([*methods, "median", "mad"])])


def _huber(far: DataFrame, cells: DataFrame, cell: list[str]) -> DataFrame:
    """cell, mu: each step sums weights over all rows; a cell whose step settles keeps the value before it."""
    state = once(cells.select(*cell, (robust.HUBER * F.col("mad")).alias("delta"), F.col("median").alias("mu"), ((F.col("mad") == 0) | F.col("close")).alias("done")))
    for _ in range(robust.STEPS):
        going = state.filter(~F.col("done"))
        if not going.head(1):
            break
        d = F.abs(F.col("v") - F.col("mu"))
        w = F.when(d <= F.col("delta"), F.lit(1.0)).otherwise(F.col("delta") / d)
        sums = _beside(far, going.select(*cell, "delta", "mu"), cell).groupBy(*cell).agg((F.sum(w * F.col("v")) / F.sum(w)).alias("new"))
        state = state.join(sums, cell, "left").withColumn("done", F.col("done") | F.coalesce(F.abs(F.col("new") - F.col("mu")) < robust.SETTLED, F.lit(False)))
        state = once(state.withColumn("mu", F.when(F.col("done"), F.col("mu")).otherwise(F.col("new"))).drop("new"))
    return state.select(*cell, "mu")


def _closest(far: DataFrame, cells: DataFrame, cell: list[str]) -> DataFrame:
    """cell, closest: the mean of the CLOSEST share nearest the median; where the last ones are equally near, of the earlier samples."""
    k = F.greatest(F.floor(F.col("n") * robust.CLOSEST), F.lit(1))
    wanted = cells.select(*cell, F.lit("k").alias("which"), (k - 1).alias("rank"))
    limits = ranked(far, cell, wanted).select(*cell, F.col("value").alias("limit"))
    within = once(_beside(far, limits, cell).filter("x <= limit"))
    sums = within.groupBy(*cell).agg(F.sum(F.when(F.col("x") < F.col("limit"), F.col("v"))).alias("sum"), F.count_if(F.col("x") < F.col("limit")).alias("have"))
    need = once(sums.join(cells.select(*cell, k.alias("k")), cell).withColumn("need", F.col("k") - F.col("have")))
    ties = once(within.filter("x = limit").select(*cell, "v", "at", F.col("at.sample_idx").cast("double").alias("i")))
    some = need.filter("need > 0")
    last = once(ranked(ties, cell, some.select(*cell, F.lit("i").alias("which"), (F.col("need") - 1).alias("rank")), "i").select(*cell, F.col("value").alias("last")))
    early = once(_beside(ties, last, cell).filter("i <= last"))
    sums = early.filter("i < last").groupBy(*cell).agg(F.sum("v").alias("more"), F.count(F.lit(1)).alias("had"))
    # of the last sample, which may have the cell more than once, as many as are left to take
    nth = F.row_number().over(Window.partitionBy(*cell, "i").orderBy("at"))
    left = some.join(sums, cell, "left").select(*cell, (F.col("need") - F.coalesce("had", F.lit(0))).alias("take"))
    final = early.filter("i = last").withColumn("nth", nth).join(left, cell).filter("nth <= take").groupBy(*cell).agg(F.sum("v").alias("rest"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = need.join(sums.drop("had"), cell, "left").join(final, cell, "left")
    return out.select(*cell, ((zero("sum") + zero("more") + zero("rest")) / F.col("k")).alias("closest"))
