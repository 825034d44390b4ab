"""Packing token sequences of a fixed size by bounded-space online best-fit.

Documents become tokens with an end token; only those longer than a sequence are cut. Pieces are dealt to tasks, and each
task puts them, as they come, into the open bin with the least space that holds them. Open bins are found by a bitset
whose bits are amounts of free space. There are at most OPEN_BINS; when all are taken and none fits, the fullest closes.

What a task's last open bins hold goes on to a next round, of a FAN-th of the tasks, until one task is left; the pieces in
that one's last open bins are packed once more, longest first. So the space lost doesn't grow with the number of tasks,
no task holds more than its open bins, and the last one reads at most FAN * OPEN_BINS bins.

Null texts count as empty: a document of the end token alone. Repeated rows are packed each by itself, null ids are kept.
Very long texts give many pieces. An empty table gives an empty result; other columns are ignored by pieces().
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumtab.llm.bpe import codec, vocabulary
from quorumtab.llm.common import kept, pick

SIZE = 4096
END_ID = 1
OPEN_BINS = 256
PIECES_A_TASK = 20_000
FAN = 8
ROWS_OUT = 10_000


def pieces(docs: DataFrame, spec_path: str, size: int = SIZE, end_id: int = END_ID, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece (from 0), start, length, ids_crc32, and on demand ids, as bytes of little-endian 32-bit integers."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    with open(spec_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # 1.7 MB whatever the input
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, width = codec(spec.value).encoded, 4 * size
        for batch in batches:
            kind, out = batch.schema.field("doc_id").type, [[] for _ in names]

            def flushed() -> pa.RecordBatch:
                types = [kind, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
                for c in out:
                    c.clear()
                return made

            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                data = encoded(text.as_py() or "") + end
                for i, at in enumerate(range(0, len(data), width)):
                    part = data[at : at + width]
                    for c, x in zip(out, (doc, i, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        c.append(x)
                    if len(out[0]) >= ROWS_OUT:
                        yield flushed()
            yield flushed()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if ids else ""))


class OpenBins:
    """Open bins of one size: at most `most` (None: any number), found by their free space. A bin is a list of (item, offset)."""

    def __init__(self, size: int, most: int | None = None) -> None:
        self.size, self.most, self.count = size, most, 0
        self.bits = 0  # bit f is set while some bin has f free
        self.by_free: list[list[list]] = [[] for _ in range(size + 1)]

    def _taken(self, free: int) -> list:
        found = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        return found

    def put(self, item: object, length: int) -> Iterator[list]:
        """Places an item; yields the bins that close by it."""
        if length > self.size:
            raise ValueError(f"a piece of {length} does not fit {self.size}")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            own = self._taken(free)
        else:
            if self.count == self.most:
                yield self._taken((self.bits & -self.bits).bit_length() - 1)  # the fullest
                self.count -= 1
            own, free = [], self.size
            self.count += 1
        own.append((item, self.size - free))
        if free == length:
            self.count -= 1
            yield own
        else:
            self.by_free[free - length].append(own)
            self.bits |= 1 << (free - length)

    def rest(self) -> Iterator[list]:
        """The bins still open, the fullest first."""
        for bins in self.by_free:
            yield from bins


def packed(table: DataFrame, size: int = SIZE, open_bins: int = OPEN_BINS, pieces_a_task: int = PIECES_A_TASK) -> DataFrame:
    """Pieces (length, from 0 to size, and any other columns but these two) with sequence_id and offset.

    Intermediate rounds are tables in the shared folder, so what is placed stays placed when executors are lost.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema) + ", sequence_id bigint, offset bigint"
    names = table.columns
    at_length = names.index("length")

    def task(round_: int, last: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, open_, out, types = (round_ << 56) + (TaskContext.get().partitionId() << 32), OpenBins(size, open_bins), [], None

            def flushed() -> pa.RecordBatch:
                cols = list(zip(*out)) if out else [[]] * (len(names) + 2)
                out.clear()
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*types, pa.int64(), pa.int64()])], [*names, "sequence_id", "offset"])

            def close(bin_: list) -> None:
                nonlocal number
                out.extend((*item, number, offset) for item, offset in bin_)
                number += 1

            for batch in batches:
                types = [f.type for f in batch.schema]
                for item in zip(*[c.to_pylist() for c in batch.columns]):
                    for bin_ in open_.put(item, item[at_length]):
                        close(bin_)
                    if len(out) >= ROWS_OUT:
                        yield flushed()
            left = [item for bin_ in open_.rest() for item, _ in bin_]
            if last:
                again = OpenBins(size)
                for item in sorted(left, key=lambda x: -x[at_length]):
                    for bin_ in again.put(item, item[at_length]):
                        close(bin_)
                for bin_ in again.rest():
                    close(bin_)
            else:
                out.extend((*item, None, None) for item in left)
            if types:
                yield flushed()

        return run

    tasks, round_, done = max(1, -(-table.count() // pieces_a_task)), 0, []
    while True:
        placed = kept(table.repartition(tasks).mapInArrow(task(round_, tasks == 1), schema), f"packed-{round_}")
        done.append(placed.filter("sequence_id IS NOT NULL"))
        if tasks == 1:
            break
        table = placed.filter("sequence_id IS NULL").select(*names)
        tasks, round_ = -(-tasks // FAN), round_ + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def sequences(placed: DataFrame) -> DataFrame:
    """packed() pieces with ids as whole sequences: sequence_id, ids (array of int), docs (array of doc_id, piece, offset, length). At most a sequence's tokens meet."""
    own = F.struct("offset", "ids", "doc_id", "piece", "length")
    rows = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(own)).alias("all"))
    doc = lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length"))
    rows = rows.select("sequence_id", F.transform("all", lambda x: x["ids"]).alias("ids"), F.transform("all", doc).alias("docs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.frombuffer(b"".join(x.as_py()), "<i4") for x in batch.column("ids")]
            ends = np.cumsum([0, *map(len, data)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(data) if data else np.array([], "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), ids, batch.column("docs")], ["sequence_id", "ids", "docs"])

    kind = rows.schema["docs"].dataType.simpleString()
    return rows.mapInArrow(run, f"sequence_id bigint, ids array<int>, docs {kind}")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = kept(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary()), "pieces")
    return packed(made).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
