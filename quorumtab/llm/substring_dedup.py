"""Removal of repeated word windows, with a count-min prefilter.

A window is `size` consecutive words of a document. A word goes when a window over it also starts earlier, in a smaller
doc_id or further up in the same document; windows are judged on the input.

Documents are dealt once into buckets by sampled ranges of doc_id, in order, and written as a table that is bucketed by
them, so each further pass reads its bucket without a shuffle. A window's place in the order of all windows is its bucket
and its rank there, one long. Exact copies of a text are found first, by digest; all their windows start earlier in the
first one, and they take no further part. Then:

1. Prefilter: a count-min sketch of ROWS rows with CELLS counters a window each, which saturate at two. Each bucket counts
   its own windows and sends its sketch by shards, as the counters that aren't zero; a shard adds up the sketches of all
   buckets in one array of fixed width, and tells each bucket which of its counters reached two in all. A window's
   estimate is the least of its counters; collisions only raise it, so no repeated window is missed.
2. A bucket sends the windows estimated at two or more, each different one once, with two independent 64-bit hashes and
   the place; they are grouped exactly, and all but the earliest of a group go back to their bucket. A group has a row for
   each bucket at most, 24 bytes, however many documents share the passage.
3. A bucket marks those and the windows that started earlier within itself, and drops the covered words.

At large sizes buckets and shards both grow with the root of the input, so that what a bucket sends to a shard stays a
block of counters. Nothing is broadcast but a number for each bucket.

Null and empty texts have no words. Rows that share a doc_id are ordered by a hash of their text; a null id comes after
all others. Repeated rows are copies of the first. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumtab.llm.common import kept, kept_buckets, pick, task_count, whole
from quorumtab.llm.word_hashes import FACTORS, mixed, word_hashes

SIZE = 20
#: Rows of the sketch, and counters a window in each.
ROWS = 2
CELLS = 4
BUCKET_BYTES = 8 << 20
MOST_BUCKETS = 1 << 20
#: Counters of a shard, one byte each; more only where a bucket would send it fewer windows than LEAST_SENT.
SHARD_CELLS = 1 << 23
LEAST_SENT = 64
#: Kinds of side rows; HITS + i is for row i of the sketch.
COPY, LATER, HITS = 0, 1, 2
SIDE = "slot int, kind int, num bigint, tie bigint, cells binary"


def packed(values: np.ndarray) -> bytes:
    """Sorted numbers in little more than the bits they need: whole low bytes, and of the rest a bit a number and a step."""
    n = len(values)
    if not n:
        return b""
    top = int(values[-1])
    low = min(range(1, 8), key=lambda k: 8 * k * n + (top >> 8 * k))
    steps = np.zeros((top >> 8 * low) + n, np.uint8)
    steps[(values >> 8 * low) + np.arange(n)] = 1
    bytes_ = values.astype("<i8").view(np.uint8).reshape(n, 8)[:, :low]
    return bytes([low]) + n.to_bytes(4, "little") + bytes_.tobytes() + np.packbits(steps).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    low, n = raw[0], int.from_bytes(raw[1:5], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :low] = np.frombuffer(raw, np.uint8, n * low, 5).reshape(n, low)
    steps = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, offset=5 + n * low)))
    return out.view("<i8").ravel() + ((steps - np.arange(n)) << 8 * low)


class Bucket:
    """The texts and windows of a bucket's documents in order, copies apart; second asks for second hashes too."""

    def __init__(self, docs: pa.Table, copies: set[tuple[int | None, int]], size: int, second: bool = False) -> None:
        ids, ties = docs.column("doc_id").to_pylist(), docs.column("tie").to_pylist()
        texts = docs.column("text").cast(pa.binary()).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, ties[i]))
        self.ids, self.size = [ids[i] for i in order], size
        self.texts = [texts[i] for i in order]
        self.copy, last = [], None
        for i in order:
            self.copy.append((ids[i], ties[i]) in copies or (ids[i], ties[i]) == last)
            last = (ids[i], ties[i])
        counts, self.hashes = word_hashes([t for t, copy in zip(self.texts, self.copy) if not copy], second)
        self.ends = np.cumsum(counts)  # of those that take part, among all their words
        n = int(self.ends[-1]) if len(counts) else 0
        last = np.repeat(self.ends, counts) - np.arange(n)
        self.at = np.flatnonzero(last >= size)  # words that a window starts at
        self.a = mixed(rolled(self.hashes[0], size, FACTORS[0])[self.at]) if len(self.at) else np.zeros(0, np.uint64)

    def other(self, some: np.ndarray) -> np.ndarray:
        """A second 64-bit hash of the windows given by their places in at."""
        spots, out = self.at[some], np.zeros(len(some), np.uint64)
        for j in range(self.size):
            out += self.hashes[1][spots + j] * np.uint64(pow(FACTORS[1], j, 1 << 64))
        return mixed(out)

    def groups(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those windows by hash, equal ones in order, their second hashes, and which of them is the first of its kind."""
        a, b = self.a[some], self.other(some)
        order = np.argsort(a, kind="stable")
        same_a = a[order][1:] == a[order][:-1]
        if (same_a & (b[order][1:] != b[order][:-1])).any():
            order = np.lexsort((b, a))
            same_a = a[order][1:] == a[order][:-1]
        first = np.ones(len(order), bool)
        first[1:] = ~(same_a & (b[order][1:] == b[order][:-1]))
        return some[order], b[order], first


def among(values: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Which values are in full, which is sorted; a table of their low bits rules most others out."""
    if not len(full) or not len(values):
        return np.zeros(len(values), bool)
    mask = np.int64((1 << min(22, max(10, (8 * len(full)).bit_length()))) - 1)
    table = np.zeros(int(mask) + 1, bool)
    table[full & mask] = True
    out = table[values & mask]
    some = np.flatnonzero(out)
    spot = np.minimum(np.searchsorted(full, values[some]), len(full) - 1)
    out[some] = full[spot] == values[some]
    return out


def rolled(one: np.ndarray, size: int, factor: int) -> np.ndarray:
    """sum(one[i + j] * factor**j for j < size) for each i, modulo 2**64; what goes beyond the end is cut off."""
    power = lambda n: np.uint64(pow(factor, n, 1 << 64))
    total, done, block, width = None, 0, one, 1
    while width <= size:
        if size & width:
            shifted = block[done:]
            total = shifted.copy() if total is None else total[: len(shifted)] + shifted * power(done)
            done += width
        if width * 2 <= size:
            block = block[: max(len(block) - width, 0)] + block[width:] * power(width)
        width *= 2
    return total


def cells_of(h: np.ndarray, row: int, width: int) -> np.ndarray:
    """The counter of each window in a row of width counters (a power of two)."""
    h = mixed(h + np.uint64(row * FACTORS[1] % (1 << 64))) if row else h
    return (h >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64)


def counters(parts: list[np.ndarray], n: int) -> np.ndarray:
    """The sum of some sketches, each a sorted list with a counter's number once or twice; counts stop at two."""
    out, at = np.zeros(n, np.uint8), 0
    while at < len(parts):
        end, m = at + 1, len(parts[at])
        while end < len(parts) and m < 1 << 20:
            m += len(parts[end])
            end += 1
        cells, counts = np.unique(np.concatenate(parts[at:end]), return_counts=True)
        out[cells] = np.minimum(out[cells] + np.minimum(counts, 2), 2)
        at = end
    return out


def side_copies(side: pa.Table) -> set:
    kind = side.column("kind").to_numpy()
    mine = side.take(pa.array(np.flatnonzero(kind == COPY)))
    return set(zip(mine.column("num").to_pylist(), mine.column("tie").to_pylist()))


def deduped(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (the words that stay, joined by one space)."""
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select(F.col("doc_id").cast("long"), whole(F.col("text")).alias("text")).withColumn("tie", F.xxhash64("text"))
    total = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) + 1
    buckets = max(task_count(spark), min(-(-total // BUCKET_BYTES), MOST_BUCKETS))
    width = 1 << (max(CELLS * total // 6, 1 << 16) - 1).bit_length()
    shards = max(1, min(width // SHARD_CELLS, total // (6 * buckets * LEAST_SENT)))  # by the data alone: blocks are buckets times shards
    step = width // shards + 1

    ranged = rows.repartitionByRange(buckets, F.col("doc_id").asc_nulls_last(), "tie").withColumn("bucket", F.spark_partition_id().cast("long"))
    rows = kept_buckets(ranged, buckets, "bucket", "slot", "windows")

    digests = kept(rows.select("doc_id", "tie", "slot", F.sha2("text", 256).alias("sha")), "window-digests")
    firsts = digests.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = kept(firsts, "window-firsts")  # a plain table on this side, so that the join below can split a hot digest
    copies = digests.join(firsts, "sha").filter(~F.col("doc_id").eqNullSafe(F.col("first_id")))
    copies = copies.select("slot", F.lit(COPY).alias("kind"), F.col("doc_id").alias("num"), "tie", F.lit(None).cast("binary").alias("cells"))
    copies = kept(copies, "window-copies")

    def sketch(docs: pa.Table, side: pa.Table) -> pa.Table:
        b = Bucket(docs, side_copies(side), size) if docs.num_rows else None
        got = []
        if b is not None and len(b.at):
            a = np.sort(b.a)
            first, again = np.ones(len(a), bool), np.zeros(len(a), bool)
            first[1:] = a[1:] != a[:-1]
            again[1:] = ~first[1:] & first[:-1]  # the second of its kind; further ones add nothing
            some, slot = a[first | again], docs.column("slot")[0].as_py()
            for row in range(ROWS):
                cells = np.sort(cells_of(some, row, width))
                new = np.ones(len(cells), bool)
                new[2:] = cells[2:] != cells[:-2]  # a counter twice at most
                cells = cells[new]
                edges = np.searchsorted(cells, np.arange(shards + 1) * step)
                got += [(row * shards + s, slot, packed(cells[i:j] - s * step)) for s, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if j > i]
        shard, slot, cells = zip(*got) if got else ((), (), ())
        return pa.table({"shard": pa.array(shard, pa.int64()), "slot": pa.array(slot, pa.int32()), "cells": pa.array(cells, pa.binary())})

    def merge(blobs: pa.Table) -> pa.Table:
        row, s = divmod(blobs.column("shard")[0].as_py(), shards)
        slots, parts = blobs.column("slot").to_pylist(), [unpacked(c.as_py()) for c in blobs.column("cells")]
        counts = counters(parts, step)
        got = [(o, packed(np.unique(p[counts[p] >= 2]) + s * step)) for o, p in zip(slots, parts)]
        got = [(o, c) for o, c in got if c]
        n = len(got)
        return pa.table({"slot": pa.array([o for o, _ in got], pa.int32()), "kind": pa.array([HITS + row] * n, pa.int32()), "num": pa.nulls(n, pa.int64()), "tie": pa.nulls(n, pa.int64()), "cells": pa.array([c for _, c in got], pa.binary())})

    def suspected(b: Bucket, side: pa.Table) -> np.ndarray:
        """The windows of which the least counter is two."""
        kinds, cells = side.column("kind").to_numpy(), side.column("cells")
        left = np.arange(len(b.a))
        for row in range(ROWS):
            hits = [unpacked(cells[i].as_py()) for i in np.flatnonzero(kinds == HITS + row).tolist()]
            full = np.sort(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
            left = left[among(cells_of(b.a[left], row, width), full)]
        return left

    def suspects(docs: pa.Table, side: pa.Table) -> pa.Table:
        none = pa.array([], pa.int64())
        b = Bucket(docs, side_copies(side), size, second=True) if docs.num_rows else None
        if b is None or not len(b.at):
            return pa.table({"a": none, "b": none, "place": none, "slot": none.cast(pa.int32())})
        order, second, first = b.groups(suspected(b, side))
        order, second = order[first], second[first]
        bucket, slot = docs.column("bucket")[0].as_py(), docs.column("slot")[0].as_py()
        return pa.table({"a": b.a[order].view(np.int64), "b": second.view(np.int64), "place": (np.int64(bucket) << 32) + order, "slot": pa.array(np.full(len(order), slot), pa.int32())})

    def cut(docs: pa.Table, side: pa.Table) -> pa.Table:
        kind = pa.array([], pa.string())
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": kind})
        b = Bucket(docs, side_copies(side), size, second=True)
        order, _, first = b.groups(suspected(b, side))
        later = order[~first]
        sent = side.column("num").to_numpy(zero_copy_only=False)[side.column("kind").to_numpy() == LATER].astype(np.int64)
        starts = b.at[np.union1d(later, sent & 0xFFFFFFFF).astype(np.int64)]
        n = int(b.ends[-1]) if len(b.ends) else 0
        edges = np.zeros(n + size + 1, np.int32)
        edges[starts] += 1
        edges[starts + size] -= 1
        covered = np.cumsum(edges)[:n] > 0
        counts, removed, texts, ends = [], [], [], iter(b.ends.tolist())
        for text, copy in zip(b.texts, b.copy):
            words = text.split()  # of bytes: at exactly the six blanks
            end = None if copy else next(ends)
            gone = np.full(len(words), len(words) >= size) if copy else covered[end - len(words) : end]
            counts.append(len(words))
            removed.append(int(gone.sum()))
            texts.append(b" ".join([words[i] for i in np.flatnonzero(~gone)] if removed[-1] else words))
        return pa.table({
            "doc_id": pa.array(b.ids, pa.int64()), "n_words": pa.array(counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
        })

    def with_side(side: DataFrame):
        return rows.groupBy("slot").cogroup(side.groupBy("slot"))

    blobs = with_side(copies).applyInArrow(sketch, "shard bigint, slot int, cells binary")
    hits = kept(blobs.groupBy("shard").applyInArrow(merge, SIDE), "window-hits")
    found = with_side(copies.unionByName(hits)).applyInArrow(suspects, "a bigint, b bigint, place bigint, slot int")
    firsts = found.withColumn("first", F.min("place").over(Window.partitionBy("a", "b")))
    later = firsts.filter("place > first").select(
        "slot", F.lit(LATER).alias("kind"), F.col("place").alias("num"), F.lit(None).cast("bigint").alias("tie"), F.lit(None).cast("binary").alias("cells")
    )
    later = kept(later, "window-later")
    return with_side(copies.unionByName(hits).unionByName(later)).applyInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduped(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
