"""A store of samples that grows: a data source with many keys a file, appends that are committed whole, and stored cursors.

A store is a folder with three kinds of files: samples and cursors (Parquet, sorted by key) and commits (JSON), each of
which names the files of one write with their least and greatest keys, and the commits that it replaces. Only what a
commit names is read, so a task or job that fails leaves nothing that is read; a commit appears by a rename. The path is a local one
that all executors share, or a URI that pyarrow.fs knows.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from quorumtab.sources.caches import next_samples

PARTS = {
    "samples": "image_id string, sample_idx int, tsv_data string, input_tokens bigint, output_tokens bigint",
    "cursors": "image_id string, next_idx int",
}
ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
#: Rows after which a task begins another file, and the bytes of files that one reading task takes.
FILE_ROWS = 1_000_000
TASK_BYTES = 128 << 20


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _log(path: str, part: str, until: int | None = None) -> list[dict]:
    """The commits that count, up to one with the number `until`, in their order."""
    fs, root = _fs(path)
    found = fs.get_file_info(pafs.FileSelector(f"{root}/{part}/commits", allow_not_found=True))
    entries = []
    for info in found:
        if info.base_name.endswith(".json"):
            with fs.open_input_stream(info.path) as f:
                entries.append(json.loads(f.read()))
    entries = sorted((e for e in entries if until is None or e["number"] <= until), key=lambda e: (e["number"], e["id"]))
    gone = {x for e in entries for x in e["replaces"]}
    return [e for e in entries if e["id"] not in gone]


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


@dataclass
class Files(InputPartition):
    files: list[str]


class SampleSource(DataSource):
    """format("samples"): options path, part (samples or cursors), until (a commit's number), replaces (commits' ids, comma-joined)."""

    @classmethod
    def name(cls) -> str:
        return "samples"

    def _part(self) -> str:
        part = self.options.get("part", "samples")
        if part not in PARTS:
            raise ValueError(f"part is one of {sorted(PARTS)}")
        return part

    def schema(self) -> str:
        return PARTS[self._part()]

    def reader(self, schema) -> Reader:  # noqa: ANN001
        until = self.options.get("until")
        return Reader(self.options["path"], self._part(), None if until is None else int(until))

    def writer(self, schema, overwrite: bool) -> Writer:  # noqa: ANN001
        if overwrite:
            raise ValueError("a store is appended to; compact() rewrites it")
        return Writer(self.options["path"], self._part(), [x for x in self.options.get("replaces", "").split(",") if x])


class Reader(DataSourceReader):
    """Tasks of neighbouring key ranges. Filters on image_id choose files by their range and row groups by their statistics."""

    def __init__(self, path: str, part: str, until: int | None) -> None:
        self.path, self.part, self.until, self.keys = path, part, until, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)) and f.attribute == ("image_id",):
                self.keys.append((type(f).__name__, f.value))
            yield f  # Spark checks the rows again

    def _may_hold(self, least: str, most: str) -> bool:
        fits = {
            "EqualTo": lambda v: least <= v <= most, "In": lambda v: any(least <= x <= most for x in v if x is not None), "GreaterThan": lambda v: most > v,
            "GreaterThanOrEqual": lambda v: most >= v, "LessThan": lambda v: least < v, "LessThanOrEqual": lambda v: least <= v,
        }
        return all(fits[kind](v) for kind, v in self.keys)

    def partitions(self) -> list[InputPartition]:
        files = [f for e in _log(self.path, self.part, self.until) for f in e["files"] if self._may_hold(f["least"], f["most"])]
        out, size = [], 0
        for f in sorted(files, key=lambda f: (f["least"], f["most"], f["name"])):
            if not out or size + f["bytes"] > TASK_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].files.append(f["name"])
            size += f["bytes"]
        return out or [Files([])]

    def _wanted(self) -> ds.Expression | None:
        key = ds.field("image_id")
        of = {
            "EqualTo": lambda v: key == v, "In": lambda v: key.isin([x for x in v if x is not None]), "GreaterThan": lambda v: key > v,
            "GreaterThanOrEqual": lambda v: key >= v, "LessThan": lambda v: key < v, "LessThanOrEqual": lambda v: key <= v,
        }
        out = None
        for kind, v in self.keys:
            out = of[kind](v) if out is None else out & of[kind](v)
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(self.path)
        for name in partition.files:
            file = ds.dataset(f"{root}/{self.part}/{name}", filesystem=fs, format="parquet")
            yield from file.to_batches(filter=self._wanted(), batch_size=10_000)


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, part: str, replaces: list[str]) -> None:
        self.path, self.part, self.replaces = path, part, replaces

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _fs(self.path)
        fs.create_dir(f"{root}/{self.part}", recursive=True)
        kinds = pa.schema([(name, ARROW[kind]) for name, kind in (x.split() for x in PARTS[self.part].split(", "))])
        files, out, name, rows, least, most = [], None, "", 0, None, None

        def close() -> None:
            out.close()
            files.append({"name": name, "rows": rows, "least": least, "most": most, "bytes": fs.get_file_info(f"{root}/{self.part}/{name}").size})

        try:
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                if out is None:
                    name, rows, least, most = f"{uuid.uuid4().hex}.parquet", 0, None, None
                    out = pq.ParquetWriter(f"{root}/{self.part}/{name}", kinds, filesystem=fs, compression="zstd")
                ids = batch.column(kinds.get_field_index("image_id"))
                if ids.null_count:
                    raise ValueError("a sample without a key can't be stored")
                low, high = pc.min_max(ids).as_py().values()
                least, most = low if least is None else min(least, low), high if most is None else max(most, high)
                out.write_table(pa.Table.from_batches([batch]).cast(kinds))
                rows += batch.num_rows
                if rows >= FILE_ROWS:
                    close()
                    out = None
            if out is not None:
                close()
        except BaseException:
            if out is not None:
                out.close()
            for made in {name, *(f["name"] for f in files)} - {""}:
                if fs.get_file_info(f"{root}/{self.part}/{made}").type != pafs.FileType.NotFound:
                    fs.delete_file(f"{root}/{self.part}/{made}")
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _fs(self.path)
        number = max([time.time_ns(), *(e["number"] + 1 for e in _log(self.path, self.part))])
        entry = {"id": uuid.uuid4().hex, "number": number, "replaces": self.replaces, "files": [f for m in messages if m for f in m.files]}
        folder = f"{root}/{self.part}/commits"
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{entry['id']}.part") as f:
            f.write(json.dumps(entry).encode())
        fs.move(f"{folder}/{entry['id']}.part", f"{folder}/{entry['id']}.json")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _fs(self.path)
        for f in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{root}/{self.part}/{f['name']}")


class SampleStore:
    """A store at a path: append(), read(), take(), compact(). One application at a time appends to a key or moves its cursor.

    Registers the source and turns spark.sql.python.filterPushdown.enabled on in the session.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        spark.dataSource.register(SampleSource)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    def _now(self, part: str) -> int:
        return max((e["number"] for e in _log(self.path, part)), default=0)

    def _read(self, part: str) -> DataFrame:
        return self.spark.read.format("samples").options(path=self.path, part=part, until=str(self._now(part))).load()

    def _write(self, rows: DataFrame, part: str, replaces: str = "") -> None:
        """Ranges of keys; a key with a large share of the samples is cut too."""
        names = [x.split()[0] for x in PARTS[part].split(", ")]
        order = names[:2] if part == "samples" else names[:1]
        cast = rows.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in PARTS[part].split(", ")])
        cast.repartitionByRange(*order).sortWithinPartitions(*order).write.format("samples").mode("append").options(path=self.path, part=part, replaces=replaces).save()

    def read(self) -> DataFrame:
        """All samples as they are now; later appends don't change the DataFrame."""
        return self._read("samples")

    def append(self, new: DataFrame) -> None:
        """Samples after those that their keys have: image_id, sample_idx (from 0 in this append), tsv_data, input_tokens, output_tokens.

        A null key is an error, and nothing is stored. Ids are kept as text.
        """
        new = new.withColumn("image_id", F.col("image_id").cast("string"))
        if self._now("samples"):
            stored = self.read().groupBy("image_id").agg((F.max("sample_idx") + 1).alias("n"))
            new = new.join(stored, "image_id", "left").withColumn("sample_idx", F.col("sample_idx") + F.coalesce("n", F.lit(0)))
        self._write(new, "samples")

    def cursors(self) -> DataFrame:
        """image_id, next_idx of the keys that were ever taken from: the furthest one stored."""
        return self._read("cursors").groupBy("image_id").agg(F.max("next_idx").alias("next_idx"))

    def take(self, keys: DataFrame, n: int = 1) -> DataFrame:
        """The next n samples of each of keys (image_id, repeats count once), as next_samples() gives them; its cursors are moved on and stored."""
        asked = keys.select(F.col("image_id").cast("string").alias("image_id")).filter("image_id IS NOT NULL").distinct()
        at = asked.join(self.cursors(), "image_id", "left").withColumn("next_idx", F.coalesce("next_idx", F.lit(0)))
        out = next_samples(self.read(), at, n)
        self._write(at.withColumn("next_idx", F.col("next_idx") + n), "cursors")
        return out

    def compact(self) -> None:
        """Rewrites samples and cursors into few files. The old files stay, for readers that have begun; they aren't read again."""
        for part, rows in (("samples", self.read()), ("cursors", self.cursors())):
            old = [e["id"] for e in _log(self.path, part)]
            if len(old) > 1:
                self._write(rows, part, ",".join(old))

    def files(self, part: str = "samples") -> int:
        """How many files are read."""
        return sum(len(e["files"]) for e in _log(self.path, part))
