"""Small helpers that the operators share: columns by exact name, words, and tables in the shared folder."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six characters.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[ \t-\r]+"


def pick(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """Just the columns called exactly that (the first of each name), whatever else the table holds, clashes included."""
    cols = df.columns
    wanted = {n: n for n in names} | renamed
    missing = [n for n in wanted.values() if n not in cols]
    if missing:
        raise ValueError(f"no column {missing} among {cols}")
    plain = df.toDF(*[f"c{i}" for i in range(len(cols))])
    return plain.select(*[F.col(f"c{cols.index(n)}").alias(new) for new, n in wanted.items()])


def whole(text: Column) -> Column:
    """A null text counts as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Words of a text in order, unchanged; none for null, empty or blank texts."""
    bare = F.btrim(whole(text), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; all-ASCII texts take the faster built-in."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, and one of our own only where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(where)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return where


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, lineage cut, and safe when executors are lost.

    Results are lazy, so the tables stay until the checkpoint folder is cleared: by its owner when the application has
    ended, as with checkpoints.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_buckets(df: DataFrame, n: int, bucket: str, slot: str, name: str) -> DataFrame:
    """kept() for rows that already lie in n partitions, numbered by `bucket`: operators keyed by `slot` read it without a shuffle.

    slot is a number that Spark's hash deals to the bucket's place; there is one for each bucket, so buckets don't meet.
    Buckets are known by a catalog entry only, which is dropped once the table is resolved: its data stays in the shared folder.
    A larger spark.sql.sources.bucketing.maxBuckets, where it is needed, lasts as long as the entry.
    """
    spark = df.sparkSession
    number = F.col("id").cast("int")
    slots = spark.range(n * (20 + n.bit_length())).groupBy(F.pmod(F.hash(number), F.lit(n)).cast("long").alias(bucket)).agg(F.min(number).alias(slot))
    path, table = shared_path(spark, name), f"{name}_{uuid.uuid4().hex}"
    dealt = df.join(F.broadcast(slots), bucket, "left")
    dealt = dealt.withColumn(slot, F.coalesce(slot, F.raise_error(F.lit("more partitions than buckets")).cast("int")))
    setting = "spark.sql.sources.bucketing.maxBuckets"
    most = spark.conf.get(setting)
    try:
        if n > int(most):
            spark.conf.set(setting, str(n))
        dealt.write.bucketBy(n, slot).option("path", path).saveAsTable(table)
        return spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")  # an external one: the files stay
        spark.conf.set(setting, most)


def task_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sql_crc32(number: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a whole number's decimal digits, bit by bit: it has no such function."""
    step = "xor(c >> 8, list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda t, i: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END, xor(c, b) & 255))"
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))"
    return f"xor(list_reduce({digits}, lambda c, b: {step}, CAST(4294967295 AS UBIGINT)), 4294967295)"
