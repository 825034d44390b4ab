"""Wide yearly series as chart-ready data: pruning, sampling of countries, fewer years, and what the charts draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRUNE_AT = 32
LARGE = 1e6
MOST_BARS = 15
SEED = 42
#: So many lines of ten have no marker whatever is drawn for them.
BARE_TENTHS = 2
CHART_TYPES = ("line", "area", "grouped_bar", "stacked_bar")
LIBRARIES = ("matplotlib", "seaborn", "plotly", "bokeh")
#: Colors, and the options of each library's style. A pair of floats is a range, rounded to two decimals;
#: a pair of ints under a size is a range of whole pixels; two ints and a list are so many different ones of the list.
PALETTE = [
    "#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b",
    "#e377c2", "#7f7f7f", "#bcbd22", "#17becf", "#393b79", "#637939",
]
TITLES = ["Timeseries", "Trend", "Chart", "Statistics", "Evolution", "Progression", "Data", "World Bank", ""]
SWITCH = ["true", "false"]
PIXELS = {"width": (800, 1000), "height": (550, 750)}
INCHES = {"inches_wide": (8.0, 10.0), "inches_high": (5.5, 7.5)}
STYLES = {
    "matplotlib": {
        "sheets": (1, 3, ["default", "bmh", "classic", "fast", "fivethirtyeight", "ggplot", "grayscale"]), "font": ["serif", "sans-serif", "monospace"],
        "title_size": ["14", "16", "18"], "label_size": ["12", "14"], "tick_size": ["10", "12"], "grid": SWITCH, "grid_line": ["-", "--", "-.", ":"],
        "grid_alpha": (0.3, 1.0), "title": TITLES, **INCHES,
    },
    "seaborn": {
        "theme": ["whitegrid", "darkgrid", "white", "dark", "ticks"], "context": ["paper", "notebook", "talk", "poster"],
        "palette": ["deep", "muted", "bright", "pastel", "dark", "colorblind", "Set1", "Set2", "husl", "tab10"],
        "font_scale": (0.8, 1.4), "title": TITLES, "grid": SWITCH, **INCHES,
    },
    "plotly": {
        "template": ["plotly", "plotly_white", "plotly_dark", "ggplot2", "seaborn", "simple_white"],
        "font": ["Arial", "Courier New", "Times New Roman", "Verdana", "Georgia"], "font_size": ["12", "14", "16"], "title": TITLES,
        "grid_x": SWITCH, "grid_y": SWITCH, **PIXELS,
    },
    "bokeh": {
        "theme": ["caliber", "dark_minimal", "light_minimal", "night_sky", "contrast"], "title": TITLES, "title_size": ["14px", "16px", "18px"],
        "label_size": ["12px", "14px"], "grid": SWITCH, **PIXELS,
    },
}
LINE_STYLE = {"marker": ["o", "s", "^", "v", "<", ">", "D", "P", "*", "X", "none"], "line": ["-", "--", "-.", ":", "5 10", "1 1"], "line_width": (1.0, 4.0), "alpha": (0.7, 1.0)}


def pruned(long: DataFrame, prune_at: int = PRUNE_AT, large: float = LARGE) -> DataFrame:
    """Series of a country (series_name, country_name, year, value) with few gaps, none between values, and no huge value."""
    keys = ["series_name", "country_name"]
    some = F.col("value").isNotNull()
    span = long.groupBy(*keys).agg(
        F.count_if(~some).alias("gaps"), F.min(F.when(some, F.col("year"))).alias("a"), F.max(F.when(some, F.col("year"))).alias("b"),
        F.count_if(some).alias("have"), F.coalesce(F.max(F.abs("value")) >= large, F.lit(False)).alias("huge"), F.sort_array(F.collect_set("year")).alias("years"),
    )
    inside = F.size(F.filter("years", lambda y: (y >= F.col("a")) & (y <= F.col("b"))))
    ok = span.filter((F.col("gaps") < prune_at) & ~F.col("huge") & (F.col("a").isNull() | (inside == F.col("have")))).select(*keys)
    return long.join(ok, keys, "left_semi")


def subsampled(years: Column, most: int = MOST_BARS) -> Column:
    """At most so many of an array of years, evenly spaced, the first and last among them."""
    n = F.size(years)
    picked = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(years, F.floor(i * (n - 1) / (most - 1)).cast("int")))
    return F.when(n <= most, years).otherwise(picked)


def order_key(*cols: Column) -> Column:
    """An order by hash that other engines can repeat."""
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def sampled(long: DataFrame, n: int = 1000, seed: int = SEED) -> DataFrame:
    """Datasets of countries of one series, each country at most once: series_name, set_no, countries.

    All pairs of a series and a country are walked in an order by hash. A pair that no set has makes the next set of its
    series: two or three, drawn for each set, of the countries that no set has, drawn by another hash; a last set has what
    is left, which may be one. A pair is walked once, so what only passed pairs have left stays out. The first n sets count.

    Sets drawn one after the other are cuts of one random order, so they are made at once; how many are made by when is a
    fold over a series' pairs, of which there are as many as countries.
    """
    key = lambda what, *cols: order_key(F.lit(seed), F.lit(what), F.col("series_name"), *cols)
    pairs = long.select("series_name", "country_name").distinct()
    drawn = Window.partitionBy("series_name").orderBy(key("draw", F.col("country_name")))
    pairs = pairs.withColumns({"pos": F.row_number().over(drawn) - 1, "walk": key("walk", F.col("country_name"))})
    sizes = pairs.groupBy("series_name").agg(F.count(F.lit(1)).alias("m")).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / 2).cast("int"))))
    sizes = sizes.withColumn("size", 2 + F.conv(F.substring(key("size", F.col("part")), 1, 1), 16, 10).cast("int") % 2)
    start = F.sum("size").over(Window.partitionBy("series_name").orderBy("part")) - F.col("size")
    cuts = sizes.withColumn("start", start).filter("start < m").select("series_name", "part", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos"))
    placed = pairs.join(cuts, ["series_name", "pos"])

    walked = placed.groupBy("series_name").agg(F.array_sort(F.collect_list(F.struct("walk", "part"))).alias("all"))
    made = F.aggregate("all", F.array().cast("array<string>"), lambda acc, x: F.when(x["part"] >= F.size(acc), F.concat(acc, F.array(x["walk"]))).otherwise(acc))
    made = walked.select("series_name", F.posexplode(made).alias("part", "walk"))
    few = made.orderBy("walk").limit(n)  # the feature: n datasets, taken by a top-n
    sets = few.withColumn("set_no", F.row_number().over(Window.orderBy("walk"))).join(placed.select("series_name", "part", "country_name"), ["series_name", "part"])
    return sets.groupBy("series_name", "set_no").agg(F.sort_array(F.collect_list("country_name")).alias("countries"))


def prepared(specs: DataFrame, long: DataFrame) -> DataFrame:
    """What a chart plots: chart_id, series_pos, country_name, year, value (null where there is none), for each of its years.

    specs: chart_id, series_name, countries, years.
    """
    want = specs.select("chart_id", "series_name", "years", F.posexplode("countries").alias("series_pos", "country_name"))
    want = want.select("chart_id", "series_name", "series_pos", "country_name", F.explode("years").alias("year"))
    return want.join(long, ["series_name", "country_name", "year"], "left").select("chart_id", "series_pos", "country_name", "year", "value")


def line_points(points: DataFrame, library: str = "matplotlib") -> DataFrame:
    """Values of a line chart: gaps are NaN, but null for plotly."""
    return points if known(library) == "plotly" else points.withColumn("value", F.coalesce("value", F.lit(float("nan"))))


def known(library: str) -> str:
    """The library's name; an unknown one is an error."""
    if library not in LIBRARIES:
        raise ValueError(f"unknown library {library!r}; there are {sorted(LIBRARIES)}")
    return library


def stacked(points: DataFrame, total: float = 0.65) -> DataFrame:
    """bottom and top of each bar or area, stacked by series_pos, and x and width of a bar; a missing value is 0."""
    by = Window.partitionBy("chart_id", "year").orderBy("series_pos")
    value = F.coalesce("value", F.lit(0.0))
    below = F.coalesce(F.sum(value).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = points.withColumn("bottom", below).withColumn("top", F.col("bottom") + value)
    return out.withColumns({"x": F.col("year").cast("double"), "width": F.lit(total) * spacing()})


def spacing() -> Column:
    """What lies between the first two years of a chart; 1 where there is one year."""
    years = F.array_sort(F.collect_set("year").over(Window.partitionBy("chart_id")))
    return F.when(F.size(years) > 1, F.get(years, 1) - F.get(years, 0)).otherwise(1)


def geometry(points: DataFrame, chart_type: str, library: str = "matplotlib", stack: bool = False) -> DataFrame:
    """The geometry of a chart of one of CHART_TYPES in that library; areas are stacked on demand."""
    known(library)
    of = {"line": lambda: line_points(points, library), "area": lambda: area_points(points, stack, library), "grouped_bar": lambda: grouped_bars(points), "stacked_bar": lambda: stacked(points)}
    if chart_type not in of:
        raise ValueError(f"no geometry for {chart_type!r}; there are {sorted(of)}")
    return of[chart_type]()


def area_points(points: DataFrame, stack: bool, library: str = "matplotlib") -> DataFrame:
    """Values of an area chart: stacked tops (plotly stacks by itself, so plain values), or plain ones with gaps as NaN (0 for plotly and bokeh)."""
    zero = F.coalesce("value", F.lit(0.0))
    if stack and known(library) != "plotly":
        return stacked(points).withColumn("value", F.col("top")).drop("bottom", "top", "x", "width")
    return points.withColumn("value", zero if stack or library in ("plotly", "bokeh") else F.coalesce("value", F.lit(float("nan"))))


def grouped_bars(points: DataFrame, total: float = 0.8) -> DataFrame:
    """x, width and height of each bar of a grouped bar chart; bars of a year share `total` of the years' spacing."""
    n = F.max("series_pos").over(Window.partitionBy("chart_id")) + 1
    out = points.withColumn("spacing", spacing()).withColumn("n", n)
    width = F.lit(total) * F.col("spacing") / F.col("n")
    x = F.col("year") - F.lit(total / 2) * F.col("spacing") + width * (F.col("series_pos") + 0.5)
    return out.select("chart_id", "series_pos", "country_name", "year", x.alias("x"), width.alias("width"), F.coalesce("value", F.lit(0.0)).alias("height"))


def draw(what: str, *ids: Column) -> Column:
    """A whole number below 2**28 that depends on the ids and on what it is for, and on nothing else."""
    return F.conv(F.substring(order_key(F.lit(what), *ids), 1, 7), 16, 10).cast("long")


def choice(what: str, options: list[str] | tuple, *ids: Column) -> Column:
    """One of a list of options, several of them joined by commas, or a number in the range of a pair, as text."""
    n = draw(what, *ids)
    if isinstance(options, tuple) and len(options) == 3:
        least, most, names = options
        ranked = F.array_sort(F.array(*[F.struct(order_key(F.lit(what), F.lit(o), *ids).alias("k"), F.lit(o).alias("o")) for o in names]))
        return F.array_join(F.transform(F.slice(ranked, F.lit(1), (n % (most - least + 1) + least).cast("int")), lambda x: x["o"]), ",")
    if isinstance(options, list):
        return F.get(F.array(*[F.lit(o) for o in options]), (n % len(options)).cast("int"))
    low, high = options
    if isinstance(low, int):
        return (n % (high - low + 1) + low).cast("string")
    return F.format_string("%.2f", F.lit(low) + F.lit(high - low) * n / (1 << 28))


def charts(datasets: DataFrame) -> DataFrame:
    """Datasets with chart_type, library and style (a map of that library's options), chosen by set_no."""
    at = F.col("set_no")
    out = datasets.withColumns({"chart_type": choice("type", list(CHART_TYPES), at), "library": choice("library", list(LIBRARIES), at)})
    options = {lib: F.create_map(*[c for k, o in style.items() for c in (F.lit(k), choice(k, o, at))]) for lib, style in STYLES.items()}
    return out.withColumn("style", F.coalesce(*[F.when(F.col("library") == lib, m) for lib, m in options.items()]))


def colors(n: int) -> list[str]:
    """At least n colors: the palette, then round after round of it, each paler than the one before."""
    out = list(PALETTE)
    while len(out) < n:
        kept = 1 / (1 + len(out) // len(PALETTE))  # of the distance to white
        out += ["#" + "".join(f"{255 - round(kept * (255 - int(c[i : i + 2], 16))):02x}" for i in (1, 3, 5)) for c in PALETTE]
    return out


def line_styles(points: DataFrame, n: int) -> DataFrame:
    """A color and line options for each of a chart's series (chart_id, series_pos), some without a marker; n is the most series of any chart.

    Colors of a chart differ: they are put in an order by hash for each chart.
    """
    own = points.select("chart_id", "series_pos").distinct()
    ranked = F.array_sort(F.transform(F.array(*[F.lit(c) for c in colors(n)]), lambda c: F.struct(order_key(F.col("chart_id"), c).alias("k"), c.alias("c"))))
    ids = (F.col("chart_id"), F.col("series_pos"))
    picks = {k: choice(k, o, *ids) for k, o in LINE_STYLE.items()}
    picks["marker"] = F.when(draw("bare", *ids) % 10 < BARE_TENTHS, F.lit("none")).otherwise(picks["marker"])
    return own.withColumns({"color": F.get(ranked, F.col("series_pos").cast("int"))["c"], **picks})
