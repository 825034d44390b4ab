"""table_cells(text, dialect): a table text's cells in SQL, by LATERAL.

Dialects: "quoted" (as a csv reader with tabs reads it), "plain" (as the evaluation does: lower case, no quotes, cells
stripped, a first line "title<tab>" taken off), and "stripped" (as the stability check does: the whole text stripped first,
blank lines left out, cells beyond the header left out).
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

DIALECTS = ("quoted", "plain", "stripped")
CELL = T.StructType([
    T.StructField("row_pos", T.IntegerType(), False), T.StructField("col_pos", T.IntegerType(), False),
    T.StructField("row_label", T.StringType()), T.StructField("col_label", T.StringType()), T.StructField("raw", T.StringType()),
])


def grid(text: str, dialect: str) -> list[list[str]]:
    """Rows of cells, the header first."""
    if dialect == "quoted":
        return [row for row in csv.reader(io.StringIO(text, newline=""), delimiter="\t") if row]
    if dialect == "stripped":
        return [line.split("\t") for line in text.strip().splitlines() if line.strip()]
    rows = [[cell.strip() for cell in line.split("\t")] for line in text.lower().splitlines()]
    return rows[1:] if rows and rows[0][:1] == ["title"] and len(rows[0]) > 1 else rows


class TableCells:
    @staticmethod
    def analyze(text: AnalyzeArgument, dialect: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(text.dataType, (T.StringType, T.NullType)):
            raise ValueError(f"table_cells() takes a text, not {text.dataType.simpleString()}")
        if not dialect.isConstantExpression or dialect.value not in DIALECTS:
            raise ValueError(f"table_cells() has the dialects {', '.join(DIALECTS)}")
        return AnalyzeResult(CELL)

    def eval(self, text: str | None, dialect: str) -> Iterator[tuple]:
        rows = grid(text, dialect) if text is not None else []
        for i, row in enumerate(rows[1:], 1):
            label = row[0].strip() if dialect == "stripped" else row[0]
            for j, raw in enumerate(row[1:], 1):
                head = rows[0][j] if j < len(rows[0]) else None
                if dialect == "quoted":
                    yield i, j, label, head, raw
                elif head is not None:
                    yield i, j, label, head.strip(), raw.strip()


table_cells = udtf(TableCells)


def register(spark: SparkSession) -> None:
    """Makes table_cells known to SQL in this session."""
    spark.udtf.register("table_cells", table_cells)
