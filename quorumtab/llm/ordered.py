"""Running sums over sorted rows, and joins to tables of unique keys, for keys that may hold any share of the rows.

running() sorts by range, so that a key with many rows lies in several partitions. Each partition adds up its own rows,
and what a key brings from the partitions before is added afterwards: one small row a partition goes through the driver,
whatever the data. looked_up() broadcasts the keys with a large share of the rows, of which there are few by their share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumtab.llm.common import kept

#: Keys with at least one of so many rows are broadcast; there can't be more of them than this number.
HOT_SHARE = 5000


def ones(batch: pa.RecordBatch) -> np.ndarray:
    return np.ones((batch.num_rows, 1), np.int64)


def columns(*names: str) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Columns of whole numbers as the values to add up."""
    return lambda batch: np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names], axis=1)


def running(rows: DataFrame, key: str, order: list[Column], values: Callable[[pa.RecordBatch], np.ndarray], names: list[str], name: str) -> DataFrame:
    """rows with, for each of names, its sum over the rows of the same key up to this one, and (name_before) up to the one before.

    rows must be a table that gives the same rows each time it is read, as kept() ones do; key isn't null. values gives an
    array of as many columns as there are names. Sums wrap around at 64 bits. Rows that the order leaves tied are put in
    the order of their places, so many equal rows don't meet in one partition. An empty table gives an empty one.
    """
    both = [x for n in names for x in (n, f"{n}_before")]
    sort = [F.col(key).asc(), *order, F.col("_at").asc()]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{n}` bigint" for n in both] + ["_part int", "_at bigint"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, last, carry = TaskContext.get().partitionId(), 0, None, np.zeros(len(names), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            flat, own = batch.column(key).to_numpy(zero_copy_only=False), values(batch)
            new = np.concatenate([[last is None or flat[0] != last], flat[1:] != flat[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # of each row's key; -1 where an earlier batch has it
            with np.errstate(over="ignore"):
                sums = np.concatenate([np.zeros((1, len(names)), np.int64), np.cumsum(own, axis=0)])
                base = np.where((start < 0)[:, None], -carry, sums[start])
                sums = sums[1:] - base
                before = sums - own
            last, carry = flat[-1], sums[-1]
            cols = [c for i in range(len(names)) for c in (pa.array(sums[:, i]), pa.array(before[:, i]))]
            place = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n))]
            seen += n
            kept_ = [batch.column(c) for c in batch.schema.names if c != "_at"]
            yield pa.RecordBatch.from_arrays([*kept_, *cols, *place], [*[c for c in batch.schema.names if c != "_at"], *both, "_part", "_at"])

    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    done = kept(placed.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(local, schema), name)
    ends = done.groupBy("_part").agg(F.min(key).alias("a"), F.max(key).alias("b"), F.max_by(F.array(*names), "_at").alias("sums")).orderBy("_part").collect()
    carries, last, total = {}, None, np.zeros(len(names), np.int64)  # by partition: its first key, and that key's sums before it
    with np.errstate(over="ignore"):
        for e in ends:
            if e.a == last:
                carries[e["_part"]] = (e.a, total)
            total = (total if e.a == last and e.a == e.b else 0) + np.array(e.sums, np.int64)
            last = e.b
    if not carries:
        return done.drop("_part", "_at")

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, keys = batch.column("_part").to_numpy(), batch.column(key).to_numpy(zero_copy_only=False)
            cols = {n: np.array(batch.column(n).to_numpy()) for n in both}
            for p in np.unique(parts):
                if int(p) in carries:
                    first, more = carries[int(p)]
                    here = (parts == p) & (keys == first)
                    with np.errstate(over="ignore"):
                        for n, x in zip(names, more):
                            cols[n][here] += x
                            cols[f"{n}_before"][here] += x
            yield pa.RecordBatch.from_arrays([pa.array(cols[n]) if n in cols else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return done.mapInArrow(carried, done.schema).drop("_part", "_at")


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to a table of unique keys. weight, a column of the table, says how many rows a key has, at most `total` in all."""
    hot = F.col(weight) * HOT_SHARE >= F.lit(total)
    few, rest = table.filter(hot).drop(weight), table.filter(~hot).drop(weight)
    near = rows.join(F.broadcast(few), on)
    far = rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(rest, on, how)
    return near.unionByName(far)
