"""Readers of stored samples, skeletons, images and wide yearly series, and the writer of samples."""

from __future__ import annotations

import csv
import io
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = "array<struct<csv_data:string,input_tokens:bigint,output_tokens:bigint>>"


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files with their key: that of the folder image_id=key which they are in, or their name without .json."""
    name = F.input_file_name()
    folder = F.regexp_extract(name, r"/image_id=([^/]+)/[^/]*$", 1)
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    key = F.when(folder != "", plain(plain(folder))).otherwise(F.regexp_extract(name, r"([^/]+)\.json$", 1))
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.{json,txt}").select(key.alias("image_id"), "value")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """A folder with a JSON list of samples per key: image_id, sample_idx, tsv_data, token counts. A broken file has none."""
    rows = _files(spark, path).select("image_id", F.posexplode(F.from_json("value", SAMPLE)).alias("sample_idx", "s"))
    return rows.select("image_id", "sample_idx", F.col("s.csv_data").alias("tsv_data"), "s.input_tokens", "s.output_tokens")


def sample_lists(samples: DataFrame) -> DataFrame:
    """The samples of each key as a JSON list in order of sample_idx: image_id, value."""
    one = F.struct("sample_idx", F.struct(F.col("tsv_data").alias("csv_data"), "input_tokens", "output_tokens").alias("s"))
    lists = samples.groupBy("image_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return lists.select("image_id", F.to_json(F.transform("all", lambda x: x["s"]), {"ignoreNullFields": "false"}).alias("value"))


def write_samples(samples: DataFrame, path: str) -> None:
    """Samples as a JSON list per key, each in a folder image_id=key; read_samples() reads them, ids as text."""
    sample_lists(samples).write.mode("overwrite").partitionBy("image_id").text(path)


def next_samples(samples: DataFrame, cursors: DataFrame, n: int = 1) -> DataFrame:
    """The next n stored samples of each key of cursors (image_id, next_idx), in their order, and what must be made.

    image_id, sample_idx, tsv_data, stored: false for places beyond the stored samples, whose text is null. A key without a
    cursor isn't asked for; afterwards its cursor is next_idx + n.
    """
    asked = cursors.select("image_id", F.explode(F.sequence(F.col("next_idx"), F.col("next_idx") + n - 1)).alias("sample_idx"))
    found = asked.join(samples.select("image_id", "sample_idx", "tsv_data", F.lit(True).alias("stored")), ["image_id", "sample_idx"], "left")
    return found.withColumn("stored", F.coalesce("stored", F.lit(False)))


def read_skeletons(spark: SparkSession, path: str) -> DataFrame:
    """A folder with a JSON object per key, or a list whose first element counts: image_id, structure."""
    one, many = F.from_json("value", "struct<structure:string>"), F.from_json("value", "array<struct<structure:string>>")
    listed = F.ltrim("value").startswith("[")
    return _files(spark, path).select("image_id", F.when(listed, F.get(many, 0)["structure"]).otherwise(one["structure"]).alias("structure")).filter("structure IS NOT NULL")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,webp,gif}").load(path).select("path", "content")


@F.arrow_udf(T.ArrayType(T.StringType()))
def _csv_fields(records: pa.Array) -> pa.Array:
    return pa.array([None if r is None else next(csv.reader(io.StringIO(r, newline="")), []) for r in records.to_pylist()], pa.list_(pa.string()))


#: What csv.reader takes: doubled quotes, and delimiters and line breaks within quotes.
DIALECT = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def _series_rows(spark: SparkSession, path: str) -> tuple[DataFrame, list[int]]:
    """The rows of wide files as file, at (their order), fields; and the years of the header, from the fifth column on.

    Rows of another number of fields than the header come through the reader's corrupt-record column and are read by
    Python's csv; all others stay in the JVM. A file is read as a stream by one task, as quoted line breaks don't let it be cut.
    """
    header = spark.read.csv(path, **DIALECT).columns
    years = [int(name.split()[0]) for name in header[4:]]
    names = [f"c{i}" for i in range(len(header))]
    rows = spark.read.schema(", ".join(f"{c} string" for c in (*names, "odd"))).csv(path, columnNameOfCorruptRecord="odd", **DIALECT)
    fields = F.when(F.col("odd").isNotNull(), _csv_fields("odd")).otherwise(F.array(*names))
    return rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), fields.alias("fields")), years


def _cells_of(rows: DataFrame, years: list[int]) -> DataFrame:
    """A row for each year that a record has a field for: file, at, series_name, country_name, year, raw, value, broken (what is wrong, else null)."""
    where = F.array(*[F.lit(y) for y in years])
    pairs = F.slice(F.arrays_zip(where.alias("year"), F.slice("fields", 5, len(years)).alias("raw")), 1, F.greatest(F.lit(0), F.least(F.size("fields") - 4, F.lit(len(years)))).cast("int"))
    own = rows.withColumns({"series_name": F.get("fields", 0), "country_name": F.get("fields", 2), "pairs": F.when(F.size("fields") < 3, F.array(F.struct(F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("raw")))).otherwise(pairs)})
    cells = own.select("file", "at", "series_name", "country_name", F.size("fields").alias("n"), F.explode("pairs").alias("x")).select("*", "x.*").drop("x")
    absent = F.coalesce("raw", F.lit("")).isin("", "..")
    number = F.when(~F.col("raw").rlike(r"[dDfF]\s*$") | F.lower("raw").rlike(r"inf\s*$"), F.col("raw").try_cast("double"))
    broken = F.when(F.col("n") < 3, F.lit("too few fields")).when(~absent & number.isNull(), F.concat(F.lit("not a number: "), "raw"))
    return cells.withColumns({"value": F.when(~absent, number), "broken": broken}).drop("n")


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """Wide CSV files (series first, country third, years from the fifth column on): series_name, country_name, year, value.

    Fields are read as csv.reader does. "" and ".." are null; a short row has no later years, and further fields of a long one
    don't count. Of a repeated series and country the last row counts, with its years alone. Another text that isn't a
    number, or a row without a country, is an error that names its file; series_errors() lists all of them by row.
    """
    rows, years = _series_rows(spark, path)
    key = F.struct(F.get("fields", 0).alias("a"), F.get("fields", 2).alias("b"))
    last = rows.groupBy(key.alias("key")).agg(F.max_by(F.struct("file", "at", "fields"), F.struct("file", "at")).alias("r")).select("r.*")
    bad = F.concat(F.lit("in "), "file", F.lit(": "), "broken")
    cells = _cells_of(last, years)
    return cells.select("series_name", "country_name", "year", F.when(F.col("broken").isNotNull(), F.raise_error(bad).cast("double")).otherwise(F.col("value")).alias("value"))


def series_errors(spark: SparkSession, path: str) -> DataFrame:
    """What read_series() can't read, in all rows: file, row (from 1, the header not counted, nor blank lines), year, broken."""
    rows, years = _series_rows(spark, path)
    first = rows.groupBy("file").agg(F.min("at").alias("first"))  # a file is one task's, in order
    bad = _cells_of(rows, years).filter("broken IS NOT NULL").join(first, "file")
    return bad.select("file", (F.col("at") - F.col("first") + 1).alias("row"), "year", "broken")


def unpivoted(wide: DataFrame) -> DataFrame:
    """A table of strings in the layout of read_series() as series_name, country_name, year, value; of repeated ones the last row counts."""
    names = wide.columns
    ids = wide.select(F.col(f"`{names[0]}`").alias("series_name"), F.col(f"`{names[2]}`").alias("country_name"), F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(c.split()[0]) for c in names[4:]])
    long = ids.unpivot(["series_name", "country_name", "row"], [c.split()[0] for c in names[4:]], "year", "raw")
    value = F.when(~F.coalesce("raw", F.lit("")).isin("", ".."), F.col("raw").cast("double"))
    return long.groupBy("series_name", "country_name", F.col("year").cast("int").alias("year")).agg(F.max_by(value, "row").alias("value"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name where all executors can write: under spark.checkpoint.dir, and a folder of our own only where that is unset, on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = found.get() if found.isDefined() else tempfile.mkdtemp(prefix="shared-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
