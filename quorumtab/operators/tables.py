"""Delimited table texts as long cells, and back.

cells() reads quoted texts: the first row holds the headers, the first column the row labels, blank lines don't count.
plain_table() reads texts without quoting, in lower case, as the evaluation does. Null texts have no cells.
"""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumtab.functions.text import bare, cell_number, cell_number_text, let

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _quoted_grid(texts: pa.Array) -> pa.Array:
    rows = [None if t is None else [r for r in csv.reader(io.StringIO(t), delimiter="\t") if r] for t in texts.to_pylist()]
    return pa.array(rows, pa.list_(pa.list_(pa.string())))


def _grids(samples: DataFrame, text_col: str) -> DataFrame:
    """samples with grid, an array of rows of cells. Of texts without a quote, Python's csv reader gets a null instead."""
    text = F.col(text_col)
    quoted = F.coalesce(F.contains(text, F.lit('"')), F.lit(False))
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: x != "")
    read = _quoted_grid(F.when(quoted, text))
    return samples.withColumn("grid", F.when(quoted, read).otherwise(F.transform(lines, lambda x: F.split(x, "\t"))))


def cells(samples: DataFrame, keys: list[str], text_col: str = "tsv_data", missing: str = "zero") -> DataFrame:
    """Long cells: keys, row_pos and col_pos (from 1), row_label, col_label (null beyond the header), raw, value."""
    grids = _grids(samples.select(*keys, text_col), text_col).select(*keys, F.get("grid", 0).alias("header"), F.posexplode("grid").alias("row_pos", "row"))
    rows = grids.filter("row_pos > 0").select(*keys, "header", "row_pos", F.get("row", 0).alias("row_label"), F.posexplode("row").alias("col_pos", "raw"))
    out = rows.filter("col_pos > 0").withColumn("col_label", F.get("header", F.col("col_pos")))
    return out.select(*keys, "row_pos", "col_pos", "row_label", "col_label", "raw", cell_number(F.col("raw"), missing).alias("value"))


def skeleton_cells(skeletons: DataFrame, keys: list[str], text_col: str = "structure") -> DataFrame:
    """Cells that a skeleton declares: keys, row_pos, col_pos, row_label, col_label, corner (the header's first cell); a short row has all columns."""
    grids = _grids(skeletons.select(*keys, text_col), text_col).select(*keys, F.get("grid", 0).alias("header"), F.posexplode("grid").alias("row_pos", "row"))
    rows = grids.filter("row_pos > 0").select(*keys, "row_pos", F.get("row", 0).alias("row_label"), F.get("header", 0).alias("corner"), F.posexplode("header").alias("col_pos", "col_label"))
    return rows.filter("col_pos > 0").select(*keys, "row_pos", "col_pos", "row_label", "col_label", "corner")


def stripped_cells(tables: DataFrame, keys: list[str], text_col: str = "tsv_data") -> DataFrame:
    """Cells as the stability check reads them: keys, row_label, col_label, value (null where it isn't a number).

    The whole text is stripped first, so an empty corner is lost: labels of columns then move by one and the last column
    has none and isn't compared. Of cells with equal labels the last counts.
    """
    lines = F.filter(F.split(bare(F.col(text_col)), LINE_END), lambda x: bare(x) != "")
    head = F.transform(F.split(F.get(lines, 0), "\t"), lambda c: bare(c))
    rows = tables.select(*keys, F.slice(head, 2, 1 << 30).alias("heads"), F.posexplode(F.slice(lines, 2, 1 << 30)).alias("row", "line")).withColumn("line", F.split("line", "\t"))
    each = F.posexplode(F.arrays_zip(F.col("heads").alias("h"), F.slice("line", 2, F.size("heads")).alias("v"))).alias("at", "x")
    long = rows.filter("size(line) > 1").select(*keys, "row", bare(F.get("line", 0)).alias("row_label"), each).filter("x.v IS NOT NULL")
    value = F.max_by(bare(F.col("x.v")), F.struct("row", "at")).try_cast("double")
    return long.groupBy(*keys, "row_label", F.col("x.h").alias("col_label")).agg(value.alias("value"))


def to_tsv(long: DataFrame, keys: list[str], value: str, corner: str = "", name: str = "tsv_data") -> DataFrame:
    """One text per key: a header, then a row for each row_pos; null values are empty. No line end at the end."""
    return to_tsvs(long, keys, {name: value}, corner)


def to_tsvs(long: DataFrame, keys: list[str], values: dict[str, str], corner: str = "") -> DataFrame:
    """to_tsv() for several values of the same cells at once: name of the text to column of the value."""
    cell = F.struct("col_pos", "col_label", *[F.coalesce(F.col(v), F.lit("")).alias(name) for name, v in values.items()])
    rows = long.groupBy(*keys, "row_pos", "row_label").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    head = F.array_join(F.concat(F.array(F.lit(corner)), F.transform("cells", lambda c: c["col_label"])), "\t").alias("head")
    line = lambda name: F.array_join(F.concat(F.array("row_label"), F.transform("cells", lambda c: c[name])), "\t")
    lines = rows.select(*keys, head, F.struct("row_pos", *[line(name).alias(name) for name in values]).alias("line")).groupBy(*keys)
    lines = lines.agg(F.min_by("head", "line.row_pos").alias("head"), F.array_sort(F.collect_list("line")).alias("lines"))
    text = lambda name: F.array_join(F.concat(F.array("head"), F.transform("lines", lambda r: r[name])), "\n")
    return lines.select(*keys, *[text(name).alias(name) for name in values])


def quoted(cell: Column) -> Column:
    """A cell as a csv writer puts it: in quotes, with its own doubled, only where it holds a tab, a quote or a line end."""
    return F.when(cell.rlike(r'[\t"\r\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def normalized_tsv(samples: DataFrame, keys: list[str], text_col: str = "tsv_data") -> DataFrame:
    """Each table text with its cells replaced by their numbers as text, headers and row labels as they are, quoted where they must be.

    A line end after each row; rows may differ in length. A text without rows stays as it is.
    """
    grids = _grids(samples.select(*keys, text_col), text_col)
    row = lambda r, i: F.array_join(F.transform(r, lambda c, j: quoted(F.when((i == 0) | (j == 0), c).otherwise(cell_number_text(c)))), "\t")
    text = F.concat(F.array_join(F.transform("grid", row), "\n"), F.lit("\n"))
    return grids.select(*keys, F.when(F.size("grid") > 0, text).otherwise(F.col(text_col)).alias(text_col))


def has_content(text: Column) -> Column:
    """More than a header."""
    return F.coalesce(F.size(F.split(bare(text), "\n")) > 1, F.lit(False))


def conforms(text: Column, structure: Column) -> Column:
    """Whether a table has its skeleton's header, row labels and shape. Numbers aren't looked at; null: false."""
    lines = lambda t: F.filter(F.split(bare(t), "\n"), lambda x: bare(x) != "")
    right = lambda x: F.regexp_replace(x, r"\s+$", "")
    a, b = lines(text), lines(structure)
    same = F.forall(
        F.zip_with(F.slice(a, F.lit(2), F.greatest(F.size(a), F.lit(1))), F.slice(b, F.lit(2), F.greatest(F.size(b), F.lit(1))), lambda x, y: (F.size(F.split(x, "\t")) == F.size(F.split(y, "\t"))) & (bare(F.substring_index(x, "\t", 1)) == bare(F.substring_index(y, "\t", 1)))),
        lambda ok: F.coalesce(ok, F.lit(False)),
    )
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & (F.size(a) == F.size(b)) & (right(F.get(a, 0)) == right(F.get(b, 0))) & same, F.lit(False))


def plain_table(text: Column) -> Column:
    """Struct of title, headers, rows: lower case, cells stripped, a first line "title<tab>..." taken off."""
    nothing = F.array().cast("array<string>")

    def lines(low: Column) -> Column:
        return F.when(low == "", nothing).otherwise(F.split(F.regexp_replace(low, f"(?:{LINE_END})\\z", ""), LINE_END, -1))

    def parts(lines: Column) -> Column:
        titled = F.coalesce(F.get(lines, F.lit(0)).startswith("title\t"), F.lit(False))
        title = F.when(titled, bare(F.substring(F.get(lines, F.lit(0)), 7, 1 << 30)))
        body = F.when(titled, F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1)))).otherwise(lines)
        return F.struct(title.alias("title"), F.transform(body, lambda x: F.transform(F.split(x, "\t", -1), lambda c: bare(c))).alias("grid"))

    return let(let(let(F.lower(text), lines), parts), lambda p: _shaped(p["title"], p["grid"]))


def _shaped(title: Column, grid: Column) -> Column:
    """A grid's first row as headers and the others as rows."""
    rows = F.when(F.size(grid) > 1, F.slice(grid, F.lit(2), F.greatest(F.size(grid), F.lit(1)))).otherwise(F.array().cast("array<array<string>>"))
    return F.struct(title.alias("title"), F.coalesce(F.get(grid, F.lit(0)), F.array().cast("array<string>")).alias("headers"), rows.alias("rows"))


def transposed(table: Column) -> Column:
    """A plain_table() with rows and columns swapped; short rows are filled with empty cells."""
    def turned(grid: Column) -> Column:
        width = F.array_max(F.transform(grid, lambda r: F.size(r)))
        swapped = F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.transform(grid, lambda r: F.coalesce(F.get(r, j), F.lit(""))))
        return F.when(width > 0, swapped).otherwise(F.array().cast("array<array<string>>"))

    def swap(table: Column) -> Column:
        grid = F.concat(F.array(table["headers"]), table["rows"])
        return F.struct(table["title"].alias("title"), let(grid, turned).alias("grid"))

    return let(let(table, swap), lambda p: _shaped(p["title"], p["grid"]))
