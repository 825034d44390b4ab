"""Optimal matching of like keys without a matrix.

A group of up to IN_TASK pairs of keys is one task's, which gets the keys alone and makes no pairs as rows: equal keys are matched
to begin with, and distances are only found from keys that a search reaches. Of larger groups, pairs of keys that are alike are made:
keys with a normalised edit distance below theta need fewer than theta edits a letter of the longer one. So of the longer
one's pieces, one more than the edits, some piece stands unchanged in the shorter one, near the same place: keys are joined
by these, compared by which letters they hold, then by edit distance. Spark takes the size of the pieces for that of the
held keys, so a merge join is asked for: a broadcast would bring them all to the driver. Connected components of the pairs are found by
passing least labels on, and each component is one assignment over its pairs. Either way equal keys are matched first, and
each other key is added along the cheapest chain of changes, or not at all where no chain gains anything.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumtab.sources.caches import scratch

SALT = 4
#: Groups with at most so many pairs of keys are compared pair by pair, which beats pieces where most keys are alike.
ALL_PAIRS = 4_000_000
#: Groups with at most so many pairs of keys are matched in a task each, from their keys.
IN_TASK = 400_000_000
#: Bytes of distances that such a task keeps; those of further keys are found again when a search reaches them again.
KEPT = 128 << 20
#: Distances that are found at once, where a key has fewer.
BATCH = 32_768


def once(df: DataFrame) -> DataFrame:
    """The rows computed once: a table in the checkpoint folder where one is set, else held on the executors' disks, and made again if lost."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        path = scratch(spark, "held")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    return df.persist(StorageLevel.DISK_ONLY)


def like_pairs(targets: DataFrame, predictions: DataFrame, keys: list[str], theta: float, all_pairs: int | None = None) -> DataFrame:
    """Pairs with a normalised edit distance below theta: keys, t_pos, p_pos, d. Both sides: keys, pos, key (not null).

    Groups with at most all_pairs pairs are compared pair by pair, larger ones where pieces meet; both give the same pairs.
    """
    def side(points: DataFrame, name: str) -> DataFrame:
        letters = F.filter(F.split("key", ""), lambda c: c != "")
        bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(c) % 64).cast("int"))
        mask = F.aggregate(letters, F.lit(0).cast("long"), lambda acc, c: acc.bitwiseOR(bit(c)))
        return points.filter("key != ''").select(*keys, F.col("pos").alias(f"{name}_pos"), F.col("key").alias(f"{name}_key"), F.char_length("key").alias(f"{name}_size"), mask.alias(f"{name}_mask"))

    def met(long: str, short: str, same: bool) -> DataFrame:
        """Pairs whose longer key is that side's: the pieces of the longer against all parts of the shorter of that size."""
        size, other = F.col(f"{long}_size"), F.col(f"{short}_size")
        n = F.ceil(theta * size).cast("int")  # one more than the most edits
        at = lambda j: F.floor(j * size / n).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(at(j).alias("at"), F.substring(F.col(f"{long}_key"), at(j) + 1, at(j + 1) - at(j)).alias("piece")))
        widths = F.sequence(F.lit(1), F.least(F.lit(math.ceil(1 / theta)), other))
        parts = F.flatten(F.transform(widths, lambda w: F.transform(F.sequence(F.lit(0), other - w), lambda i: F.struct(i.alias("i"), F.substring(F.col(f"{short}_key"), i + 1, w).alias("piece")))))
        a = sides[long].withColumn("x", F.explode(pieces)).select("*", "x.*").drop("x").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        b = sides[short].withColumn("x", F.explode(parts)).select("*", "x.*").drop("x").withColumn("salt", F.pmod(F.xxhash64(f"{short}_key"), F.lit(SALT)).cast("int"))
        alone = lambda x, y: F.bit_count(F.col(f"{x}_mask").bitwiseAND(F.bitwise_not(F.col(f"{y}_mask"))))
        near = (other <= size if same else other < size) & (other > (1 - theta) * size) & (F.abs(F.col("at") - F.col("i")) < n) & (F.greatest(alone(long, short), alone(short, long)) < theta * size)
        found = a.join(b.hint("merge"), [*keys, "piece", "salt"]).filter(near).withColumn("d", F.levenshtein("t_key", "p_key") / size)
        return found.filter(F.col("d") < theta).select(*keys, "t_pos", "p_pos", "d")

    def compared(t: DataFrame, p: DataFrame) -> DataFrame:
        """All pairs, those of a group dealt to SALT tasks."""
        longest = F.greatest("t_size", "p_size")
        a, b = t.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), p.withColumn("salt", F.pmod(F.xxhash64("p_key"), F.lit(SALT)).cast("int"))
        alone = lambda x, y: F.bit_count(F.col(f"{x}_mask").bitwiseAND(F.bitwise_not(F.col(f"{y}_mask"))))
        near = (F.least("t_size", "p_size") > (1 - theta) * longest) & (F.greatest(alone("t", "p"), alone("p", "t")) < theta * longest)
        found = a.join(b.hint("merge"), [*keys, "salt"]).filter(near).withColumn("d", F.levenshtein("t_key", "p_key") / longest)
        return found.filter(F.col("d") < theta).select(*keys, "t_pos", "p_pos", "d")

    both = {"t": side(targets, "t"), "p": side(predictions, "p")}
    count = lambda name: both[name].groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}_n"))
    limit = ALL_PAIRS if all_pairs is None else all_pairs
    sizes = once(count("t").join(count("p"), keys).select(*keys, (F.col("t_n") * F.col("p_n") <= limit).alias("few")))
    few, many = (sizes.filter(F.col("few") == yes).select(*keys) for yes in (True, False))
    out = compared(*(x.join(few, keys, "left_semi") for x in both.values()))
    if not many.head(1):
        return out
    sides = {name: x.join(many, keys, "left_semi") for name, x in both.items()}
    return out.unionByName(met("t", "p", True).unionByName(met("p", "t", False)).distinct())


def components(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs with part: the least node of their connected component, among the pairs of the same keys.

    Each round every node takes the least label next to it, and then the label of that label's node.
    """
    ends = once(pairs.select(*keys, (2 * F.col("t_pos")).alias("t"), (2 * F.col("p_pos") + 1).alias("p")))
    links = ends.select(*keys, F.col("t").alias("node"), F.col("p").alias("other")).unionByName(ends.select(*keys, F.col("p").alias("node"), F.col("t").alias("other")))
    labels = once(links.groupBy(*keys, "node").agg(F.least(F.min("other"), F.first("node")).alias("label")))
    while True:
        near = links.join(labels.withColumnRenamed("node", "other").hint("merge"), [*keys, "other"]).groupBy(*keys, "node").agg(F.min("label").alias("near"))
        now = labels.hint("merge").join(near, [*keys, "node"]).select(*keys, "node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(*keys, F.col("node").alias("label"), F.col("label").alias("far"))
        now = once(now.join(jump.hint("merge"), [*keys, "label"], "left").select(*keys, "node", "was", F.least("label", F.coalesce("far", "label")).alias("label")))
        labels = now.drop("was")
        if not now.filter("label != was").head(1):
            break
    part = labels.select(*keys, F.expr("node div 2").alias("t_pos"), F.col("label").alias("part"), "node").filter("node % 2 = 0").drop("node")
    return pairs.join(part.hint("merge"), [*keys, "t_pos"])


def cheapest(edges: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The matching of rows and columns with the largest sum of 1 - d over its edges (row, column, d); d is from 0 to 1.

    Not matching a row costs 1. Equal ends (d = 0) begin as pairs, which is a cheapest matching of them; each other row is
    added by a shortest path over reduced costs, which ends in a free column or in leaving some row alone.
    """
    near: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for r, c, d in edges:
        near[r].append((c, d))
    of_row, of_col = {}, {}
    for r, c, d in edges:
        if d == 0 and r not in of_row and c not in of_col:
            of_row[r], of_col[c] = (c, d), r
    u, v = defaultdict(float), defaultdict(float)
    for start in [r for r in near if r not in of_row]:
        heap = [(d - u[start] - v[c], c, start) for c, d in near[start]]
        heapq.heapify(heap)
        reached, back, done = {start: 0.0}, {}, {}
        stop, alone, free = 1 - u[start], start, None
        while heap:
            cost, c, r = heapq.heappop(heap)
            if cost >= stop:
                break
            if c in done:
                continue
            done[c], back[c] = cost, r
            if c not in of_col:
                stop, free = cost, c
                break
            r = of_col[c]
            reached[r] = cost
            if cost + 1 - u[r] < stop:
                stop, alone = cost + 1 - u[r], r
            for c2, d in near[r]:
                if c2 not in done:
                    heapq.heappush(heap, (cost + d - u[r] - v[c2], c2, r))
        for r, cost in reached.items():
            if cost < stop:
                u[r] += stop - cost
        for c, cost in done.items():
            if cost < stop:
                v[c] -= stop - cost
        if free is None:
            if alone == start:
                continue
            free = of_row.pop(alone)[0]
        while True:
            r = back[free]
            before = of_row.get(r)
            of_row[r], of_col[free] = (free, next(d for c, d in near[r] if c == free)), r
            if r == start:
                break
            free = before[0]
    return sorted((r, c, d) for r, (c, d) in of_row.items())


def width(key: str) -> tuple[int, int]:
    """The bits of a word, and how many words a key takes."""
    return (32, 1) if len(key) <= 32 else (64, -(-len(key) // 64))


class Distances:
    """The edit distances of one key to many at once, where they are below theta of the longer key's letters (bit-parallel, after Myers and Hyyrö)."""

    def __init__(self, keys: list[str], theta: float):
        self.theta, size = theta, np.array([len(k) for k in keys], np.int64)
        self.order = np.argsort(-size, kind="stable")  # the longest first: those with a letter j are the first over[j]
        self.size = size[self.order]
        text = "".join(keys[i] for i in self.order)
        letters, codes = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
        self.code = {chr(x): i for i, x in enumerate(letters)}
        first, codes = np.cumsum(self.size) - self.size, codes.astype(np.min_scalar_type(len(letters)))
        self.over = [int(np.searchsorted(-self.size, -j)) for j in range(max(size, default=0))]
        self.at = [codes[first[:n] + j] for j, n in enumerate(self.over)]

    def near(self, keys: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each key (all of one width()) the places of the keys that are like it, and their normalised distances."""
        bits, words = width(keys[0])
        word = np.uint32 if bits == 32 else np.uint64
        n, one, last = np.array([[len(k)] for k in keys]), word(1), word(bits - 1)
        longest = np.maximum(self.size, n)
        fit = np.flatnonzero((np.abs(self.size - n) / longest < self.theta).any(0))
        lo, hi = (int(fit[0]), int(fit[-1]) + 1) if len(fit) else (0, 0)
        masks = np.zeros((words, len(keys), len(self.code)), word)
        for k, key in enumerate(keys):
            for i, c in enumerate(key):
                if c in self.code:
                    masks[i // bits, k, self.code[c]] |= one << word(i % bits)
        # Bits: whether the distance grows, or falls, from one letter of the key to the next, up to the letter reached in each other key
        grows, falls = np.full((words, len(keys), hi - lo), ~word(0)), np.zeros((words, len(keys), hi - lo), word)
        for j in range(int(self.size[lo]) if hi else 0):
            m = min(self.over[j], hi) - lo
            codes, more, less = self.at[j][lo : lo + m], one, None
            for w in range(words):
                eq, p, q = masks[w].take(codes, 1), grows[w, :, :m], falls[w, :, :m]
                xv = eq | q
                if less is not None:
                    eq |= less
                mh = eq & p
                mh += p
                mh ^= p
                mh |= eq
                ph = mh | p
                np.invert(ph, out=ph)
                ph |= q
                mh &= p
                above = (ph >> last, mh >> last) if w + 1 < words else None
                ph <<= one
                ph |= more
                mh <<= one
                if less is not None:
                    mh |= less
                np.bitwise_and(ph, xv, out=q)
                ph |= xv
                np.invert(ph, out=ph)
                np.bitwise_or(mh, ph, out=p)
                more, less = above or (None, None)
        inside = np.array([[[(1 << min(max(len(k) - bits * w, 0), bits)) - 1] for k in keys] for w in range(words)], word)
        steps = np.bitwise_count(grows & inside).sum(0, np.int64) - np.bitwise_count(falls & inside).sum(0, np.int64)
        d = (self.size[lo:hi] + steps) / longest[:, lo:hi]
        like = [np.flatnonzero(x < self.theta) for x in d]
        return [(self.order[lo + i].astype(np.int32), x[i]) for i, x in zip(like, d)]


def cheapest_keys(rows: list[str], cols: list[str], theta: float) -> list[tuple[int, int, float]]:
    """cheapest() over all pairs of keys with a normalised edit distance below theta, without making them: a search finds the distances of the rows it reaches."""
    distances, kept, room, together = Distances(cols, theta), {}, KEPT, max(1, BATCH // max(len(cols), 1))

    def near(r: int, then: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The distances of a row; those of the rows that are likely next are found with it."""
        nonlocal room
        if r in kept:
            return kept[r]
        some = [r, *[x for x in then if x not in kept and x != r and width(rows[x]) == width(rows[r])][: together - 1]] if room > 0 else [r]
        found = distances.near([rows[x] for x in some])
        if room > 0:
            kept.update(zip(some, found))
            room -= sum(x.nbytes + y.nbytes for x, y in found)
        return found[0]

    of_row, of_col = np.full(len(rows), -1), np.full(len(cols), -1)
    u, v, d_of = np.zeros(len(rows)), np.zeros(len(cols)), np.zeros(len(rows))
    equal = defaultdict(list)
    for c in reversed(range(len(cols))):
        equal[cols[c]].append(c)
    for r, key in enumerate(rows):
        if equal.get(key):
            of_row[r] = c = equal[key].pop()
            of_col[c] = r
    low, queue = np.empty(len(cols)), np.empty(len(cols))
    back, d_back = np.zeros(len(cols), np.int64), np.zeros(len(cols))
    starts = np.flatnonzero(of_row < 0).tolist()
    for n, start in enumerate(starts):
        low.fill(np.inf)  # the least cost of a way to each column; -inf where it is settled
        queue.fill(np.inf)  # the same of columns that aren't settled
        stop, alone, free = 1 - u[start], start, None
        r, cost, reached, done = start, 0.0, [(start, 0.0)], []
        while True:
            then = []
            if r == start:
                then = starts[n + 1 : n + together]
            elif r not in kept and together > 1:
                then = [int(of_col[x]) for x in np.argsort(queue)[: 2 * together] if queue[x] < stop and of_col[x] >= 0]
            to, d = near(r, then)
            way = d - v[to] + (cost - u[r])
            better = np.flatnonzero(way < np.minimum(low[to], stop))
            to, way = to[better], way[better]
            low[to], queue[to], back[to], d_back[to] = way, way, r, d[better]
            c = int(queue.argmin())
            cost = float(queue[c])
            if cost >= stop:
                break
            queue[c], low[c] = np.inf, -np.inf
            done.append((c, cost))
            if of_col[c] < 0:
                stop, free = cost, c
                break
            r = int(of_col[c])
            reached.append((r, cost))
            if cost + 1 - u[r] < stop:
                stop, alone = cost + 1 - u[r], r
        for r, cost in reached:
            u[r] += max(stop - cost, 0.0)
        for c, cost in done:
            v[c] -= max(stop - cost, 0.0)
        if free is None:
            if alone == start:
                continue
            free, of_row[alone] = int(of_row[alone]), -1
        while True:
            r = int(back[free])
            before = int(of_row[r])
            of_row[r], of_col[free], d_of[r] = free, r, d_back[free]
            if r == start:
                break
            free = before
    return [(r, int(of_row[r]), float(d_of[r])) for r in np.flatnonzero(of_row >= 0).tolist()]


def matched_in_task(targets: DataFrame, predictions: DataFrame, keys: list[str], theta: float) -> DataFrame:
    """sparse_matched() of groups that are a task's each: only their keys are shuffled."""
    spark = targets.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)  # named, as few bytes are much work here
    side = lambda points: points.filter("key != ''").select(*keys, "pos", F.col("key").cast("binary").alias("key")).repartition(tasks, *keys).groupBy(*keys)
    texts = lambda t: [x.decode("utf-8", "surrogateescape") for x in t.column("key").to_pylist()]

    def solve(t: pa.Table, p: pa.Table) -> pa.Table:
        t, p = t.sort_by("pos"), p.sort_by("pos")
        found = cheapest_keys(texts(t), texts(p), theta) if len(t) and len(p) else []
        ends = [x.column("pos").combine_chunks().take(pa.array([f[i] for f in found], pa.int64())) for i, x in enumerate((t, p))]
        group = t if len(t) else p
        same = [pa.array([group.column(k)[0].as_py()] * len(found), group.schema.field(k).type) for k in keys]
        return pa.table([*same, *ends, pa.array([1 - f[2] for f in found], pa.float64())], [*keys, "t_pos", "p_pos", "key_score"])

    kind = lambda points, c: points.schema[c].dataType.simpleString()
    schema = ", ".join([f"`{k}` {kind(targets, k)}" for k in keys] + [f"t_pos {kind(targets, 'pos')}", f"p_pos {kind(predictions, 'pos')}", "key_score double"])
    return side(targets).cogroup(side(predictions)).applyInArrow(solve, schema)


def sparse_matched(targets: DataFrame, predictions: DataFrame, keys: list[str], theta: float = 0.5, in_task: int | None = None) -> DataFrame:
    """Optimally matched pairs of like keys: keys, t_pos, p_pos, key_score.

    Groups with at most in_task pairs of keys are a task's each; of larger ones no more than a component's pairs meet in a task.
    """
    limit, count = IN_TASK if in_task is None else in_task, lambda points, name: points.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    sizes = once(count(targets, "t_n").join(count(predictions, "p_n"), keys).select(*keys, (F.col("t_n") * F.col("p_n") <= limit).alias("few")))
    few, many = (sizes.filter(F.col("few") == yes).select(*keys) for yes in (True, False))
    of = lambda groups: [x.join(groups, keys, "left_semi") for x in (targets, predictions)]
    found = matched_in_task(*of(few), keys, theta)
    return found.unionByName(_matched_in_parts(*of(many), keys, theta)) if many.head(1) else found


def _matched_in_parts(targets: DataFrame, predictions: DataFrame, keys: list[str], theta: float) -> DataFrame:
    """sparse_matched() of large groups, over their connected components."""
    pairs = once(like_pairs(targets, predictions, keys, theta))
    parts = components(pairs, keys).withColumn("d", F.col("d").cast("double"))
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema}

    def solve(t: pa.Table) -> pa.Table:
        found = cheapest(list(zip(*(t.column(c).to_pylist() for c in ("t_pos", "p_pos", "d")))))
        same = [pa.array([t.column(k)[0].as_py()] * len(found), t.schema.field(k).type) for k in keys]
        ends = [pa.array([f[i] for f in found], t.schema.field(c).type) for i, c in enumerate(("t_pos", "p_pos"))]
        return pa.table([*same, *ends, pa.array([1 - f[2] for f in found], pa.float64())], [*keys, "t_pos", "p_pos", "key_score"])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (*keys, "t_pos", "p_pos")] + ["key_score double"])
    return parts.groupBy(*keys, "part").applyInArrow(solve, schema)
