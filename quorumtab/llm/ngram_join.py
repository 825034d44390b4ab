"""Join of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, by a MinHash LSH forest.

1. Each text gets a label of LABEL min-hashes in each of TREES trees. Equal texts are one unit from here on.
2. Forest: a tree is its labels in sorted order, a prefix trie laid flat; range partitioning sorts all trees at once and
   neighbours tell how long a prefix they share. Each unit is linked to the first one of the deepest node of the trie that
   it shares with those before it, so links grow with the rows and not with the square of a node, and those of k values or
   more join all nodes at depth k.
3. Matching starts at whole labels. What a depth joins is verified exactly (on 64-bit shingle hashes), which gives each
   unit its links with their similarities s. A pair of similarity s shares a prefix of k values in some tree with the
   probability p(k, s) = 1 - (1 - s**k)**TREES, so every link found stands for 1 / p(k, s) links there are, and one more at
   the threshold is assumed for each unit: its recall is (links + p(k, threshold)) / (sum of 1 / p(k, s) + 1). Units that
   have reached the target recall stop; the others' prefixes are shortened by a value, and only pairs with such a unit are
   compared, until all have reached it. With 32 trees and 0.9999 a unit with 28 close links or more stops at 8 values,
   with 5 or more at 7, and all at 6, where a single pair at the threshold reaches the target.
4. Links found give the final classes.

Verification is by groups of joined nodes: a task takes many small groups, or a tile of two blocks of a large one. Blocks
grow with the root of a group, so a text is copied as often as the root of its group's size, and units that have stopped
meet only the blocks of those that haven't. A task counts links and gives a spanning forest of them, never the pairs;
in groups of many texts only those that share one of their rarest shingles are compared (prefix filter).

Words are `[^\\x20\\x09-\\x0D]+`, unchanged; a text of one to four words is one shingle. A text without words (null,
empty, blank) links with nothing, copies of it neither. Repeated rows count as copies; ids may be null or repeat. An
empty table gives an empty result; other columns are ignored. An edge's recall is that of step 3, 0.9999 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumtab.llm.common import kept, pick, whole
from quorumtab.llm.substring_dedup import rolled
from quorumtab.llm.word_hashes import mixed

WORDS = 5
THRESHOLD = 0.8
TREES = 32
LABEL = 8
RECALL = 0.9999
#: A block holds about this many texts, more as the root of its group's size, and so many shingles at most but for a longest text.
BLOCK_TEXTS = 400
BLOCK_GROWTH = 10
BLOCK_SHINGLES = 2_000_000
#: A task of small groups has about so many texts or shingles.
TASK_TEXTS = 800
TASK_SHINGLES = 1_200_000
#: In groups of more texts than this the prefix filter is worth its index.
INDEXED = 64
#: Up to this many rows of keys (48 bytes each) are broadcast; more take a shuffled join.
BROADCAST_KEYS = 200_000
SIGNED_AT_ONCE = 1 << 15


def recall(length: int, similarity: float | np.ndarray, trees: int = TREES) -> float | np.ndarray:
    """How surely a pair of that similarity shares a prefix of that length in some tree."""
    return 1 - (1 - similarity**length) ** trees


def matched_length(threshold: float, target: float, trees: int = TREES, label: int = LABEL) -> int:
    """The length at which a single pair at the threshold reaches the target, so no prefix needs to be shorter."""
    for length in range(label, 1, -1):
        if recall(length, threshold, trees) >= target:
            return length
    return 1


class Shingler:
    """Texts to arrays of distinct 64-bit shingle hashes; the words met last are remembered."""

    def __init__(self, words: int) -> None:
        self.words, self.seen = words, {}

    def __call__(self, text: bytes) -> np.ndarray:
        import xxhash

        found = text.split()  # of bytes: at exactly the six blanks
        if not found:
            return np.zeros(0, np.uint64)
        if len(self.seen) > 500_000:
            self.seen = {}
        seen, one = self.seen, np.empty(len(found), np.uint64)
        hashes = []
        for w in found:
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh3_64_intdigest(w)
            hashes.append(h)
        one[:] = hashes
        n = min(self.words, len(found))
        return np.unique(mixed(rolled(one, n, 0x9E3779B97F4A7C15)[: len(found) - n + 1]))


def signer(trees: int, label: int):
    """A function from shingle arrays to their labels: two bytes a min-hash, trees one after another."""
    rng = np.random.default_rng(20)
    factors = rng.integers(0, 1 << 31, trees * label, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    offsets = rng.integers(0, 1 << 32, trees * label, dtype=np.uint32)

    def sign(sets: list[np.ndarray]) -> list[bytes]:
        low = np.full((len(sets), trees * label), 0xFFFFFFFF, np.uint32)
        at = 0
        while at < len(sets):  # runs of texts of about SIGNED_AT_ONCE shingles; long ones by themselves
            end, n = at + 1, len(sets[at])
            while end < len(sets) and n + len(sets[end]) <= SIGNED_AT_ONCE:
                n += len(sets[end])
                end += 1
            h = np.concatenate(sets[at:end]).astype(np.uint32) if n else np.zeros(0, np.uint32)
            some = [i for i in range(at, end) if len(sets[i])]
            starts = np.cumsum([0] + [len(sets[i]) for i in some])[:-1]
            for cut in range(0, len(h), SIGNED_AT_ONCE * 8):
                part, t = h[cut : cut + SIGNED_AT_ONCE * 8], None
                t = np.empty_like(part)
                for k in range(trees * label):
                    np.bitwise_xor(part, offsets[k], out=t)
                    np.multiply(t, factors[k], out=t)
                    low[some, k] = np.minimum(low[some, k], np.minimum.reduceat(t, starts) if len(some) > 1 else t.min())
            at = end
        short = ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2")
        return [row.tobytes() for row in short]

    return sign


def key_of(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def signed(rows: DataFrame, words: int, trees: int, label: int) -> DataFrame:
    """rows (doc_id, text) as (doc_id, key, n, label): n distinct shingles, and the labels (null without words)."""

    def run(batches: Iterator) -> Iterator:
        shingles, sign = Shingler(words), signer(trees, label)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t.as_py()) for t in part.column("text").cast(pa.binary())]
                n = np.array([len(s) for s in sets], np.int64)
                labels = [x if k else None for x, k in zip(sign(sets), n)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(n), pa.array(labels, pa.binary())], ["doc_id", "key", "n", "label"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.withColumn("key", key_of(F.col("text"))).select("doc_id", "key", "text").mapInArrow(run, f"doc_id {kind}, key binary, n bigint, label binary")


def trie_links(units: DataFrame, least: int, trees: int, label: int) -> DataFrame:
    """Links (a, b, level) of units (unit, label): b shares `level` values with a, the first unit of their node at that depth."""
    spark = units.sparkSession
    width = 2 * label
    tree = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring(F.col("label"), t * width + 1, F.lit(width)))).alias("tree", "leaf")
    leaves = units.select("unit", tree)
    sort = ["tree", "leaf", "unit"]
    levels = range(least, label + 1)

    def shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many leading values rows of leaf bytes share, -1 where their first byte, the tree, differs."""
        same = x[:, 1:].reshape(len(x), label, 2) == y[:, 1:].reshape(len(y), label, 2)
        deep = np.cumprod(same.all(axis=2), axis=1).sum(axis=1)
        return np.where(x[:, 0] == y[:, 0], deep, -1)

    def walk(batches: Iterator) -> Iterator:
        """Links within a sorted partition; its two ends also come out, for nodes that go on elsewhere."""
        from pyspark import TaskContext

        heads, last, first = {}, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column("tree").to_numpy(zero_copy_only=False).astype(np.uint8)
            leaf = np.frombuffer(b"".join(batch.column("leaf").to_pylist()), np.uint8).reshape(-1, width)
            node = np.concatenate([tree[:, None], leaf], axis=1)
            unit = batch.column("unit").to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.concatenate([node[:1] if last is None else last, node[:-1]])
            deep = shared(before, node)
            if last is None:
                deep[0], first = -1, (node[0].tobytes(), int(unit[0]))
            index, links = np.arange(len(unit)), []
            for k in levels:
                start = np.where(deep < k, index, -1)
                at = np.maximum.accumulate(start)
                head = np.where(at >= 0, unit[at], heads.get(k, -1))
                on = np.flatnonzero((deep == k) & (head != unit))
                links.append((head[on], unit[on], np.full(len(on), k)))
                heads[k] = int(head[-1])
            last = node[-1:]
            yield table(*(np.concatenate(x) for x in zip(*links)))
        if first:
            at = TaskContext.get().partitionId()
            ends = [(first[1], -1, 2 * at, first[0]), *((heads[k], k, 2 * at + 1, last.tobytes()) for k in levels)]
            a, k, end, nodes = zip(*ends)
            yield table(a, a, k, end, nodes)

    def table(a, b, level, end=None, node=None) -> pa.RecordBatch:
        n = len(a)
        end, node = pa.array(end, pa.int64()) if end else pa.nulls(n, pa.int64()), pa.array(node, pa.binary()) if node else pa.nulls(n, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(level, pa.int32()), end, node], ["a", "b", "level", "end", "node"])

    ranged = leaves.repartitionByRange(*sort).sortWithinPartitions(*sort)
    found = kept(ranged.mapInArrow(walk, "a bigint, b bigint, level int, end bigint, node binary"), "join-trie")
    over, heads, last = [], {}, None
    for r in found.filter("end IS NOT NULL").orderBy("end", "level").collect():  # a few rows a partition
        node = np.frombuffer(bytes(r.node), np.uint8)[None]
        if r.end % 2 == 0:
            deep = int(shared(last, node)[0]) if last is not None else -1
            if deep >= least and heads[deep] != r.a:
                over.append((heads[deep], r.a, deep))
        else:
            heads[r.level], last = r.a, node
    return found.filter("end IS NULL").select("a", "b", "level").unionByName(spark.createDataFrame(over, "a bigint, b bigint, level int"))


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): (unit, root), for each unit with a link, root the least unit.

    Large-star and small-star in turn: links move towards ever smaller units until each component is a star.
    """
    def sided(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi != lo").distinct()

    edges, before = kept(sided(links), "join-edges"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("hi").alias("unit"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("unit"), F.col("lo").alias("root")).distinct())
        before = state
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "join-least")  # a plain table, so that the join can split a hub
        large = sided(both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("lo").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("hi").alias("a"), F.col("m").alias("b")))
        edges = kept(sided(small), "join-edges")


class Sets:
    """The shingle sets of a group by size, and which later ones a set can be like."""

    def __init__(self, sets: list[np.ndarray], threshold: Fraction) -> None:
        self.num, self.den = threshold.numerator, threshold.denominator
        sizes = np.array([len(s) for s in sets], np.int64)
        self.order = np.argsort(sizes, kind="stable")
        self.sizes, self.ends = sizes[self.order], np.cumsum(sizes[self.order])
        self.starts = self.ends - self.sizes
        _, flat, counts = np.unique(np.concatenate([sets[i] for i in self.order]), return_inverse=True, return_counts=True)
        self.flat, self.mark = flat, np.zeros(len(counts), np.uint8)
        self.low = np.searchsorted(self.sizes, -(-self.sizes * self.num // self.den), side="left")
        self.reach = np.searchsorted(self.sizes, self.sizes * self.den // self.num, side="right")
        self.posted = None
        if len(sets) > INDEXED:
            self._index(counts)

    def _index(self, counts: np.ndarray) -> None:
        """Postings of each set's rarest shingles: two sets that are alike share one of them."""
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        ranks = rank[self.flat]
        by = np.lexsort((ranks, of))
        most = self.sizes - -(-self.sizes * self.num // self.den) + 1
        rare = np.arange(len(of)) - self.starts[of] < most[of]
        self.rarest, self.rare_ends = ranks[by][rare], np.cumsum(most)
        owners = of[rare]  # by keeps the sets' order, so of[by] is of
        turn = np.lexsort((owners, self.rarest))
        self.posted = owners[turn]
        self.post_ends = np.cumsum(np.bincount(self.rarest, minlength=len(counts)))

    def candidates(self, i: int, lo: int, hi: int) -> np.ndarray:
        """Sets from lo to hi that may be like set i: all of them, or where that is less work those with a rare shingle in common."""
        if self.posted is not None:
            end = self.rare_ends[i]
            mine = self.rarest[end - (self.sizes[i] - -(-self.sizes[i] * self.num // self.den) + 1) : end]
            ends = self.post_ends[mine]
            starts = np.where(mine > 0, self.post_ends[mine - 1], 0)
            if 4 * int((ends - starts).sum()) < int(self.ends[hi - 1] - self.starts[lo]):
                found = np.unique(np.concatenate([self.posted[a:b] for a, b in zip(starts, ends)]))
                return found[(found >= lo) & (found < hi) & (found != i)]
        every = np.arange(lo, hi)
        return every[every != i] if lo <= i < hi else every

    def shared(self, i: int, js: np.ndarray) -> np.ndarray:
        """How many shingles set i has in common with each of some sets, in order."""
        own = self.flat[self.starts[i] : self.ends[i]]
        self.mark[own] = 1
        if js[-1] - js[0] + 1 == len(js):
            hits = self.mark[self.flat[self.starts[js[0]] : self.ends[js[-1]]]]
        else:
            hits = self.mark[self.flat[np.concatenate([np.arange(self.starts[j], self.ends[j]) for j in js])]]
        self.mark[own] = 0
        return np.add.reduceat(hits, np.cumsum(self.sizes[js]) - self.sizes[js], dtype=np.int64)


def linked(sets: list[np.ndarray], sides: np.ndarray, copies: np.ndarray, threshold: Fraction, two: bool, before: np.ndarray, open_: np.ndarray, met: int) -> dict[str, np.ndarray]:
    """Links of each set within a task, weighed by copies; pairs and, at prefixes of `met` values, the sum of 1 / p - 1 over
    them; and the root of its tree in a spanning forest of links.

    Pairs count that lay in different groups before and have a set that is open. For a tile of two blocks only pairs across
    its sides count, also where one of them is empty. Sets go by size, so a set meets only those of a size that fits.
    """
    n = len(sets)
    out = {"links": np.zeros(n, np.int64), "pairs": np.zeros(n, np.int64), "missed": np.zeros(n), "root": np.arange(n)}
    root = list(range(n))
    if n < 2:
        return out
    s = Sets(sets, threshold)
    sides, before, open_ = sides[s.order], before[s.order], open_[s.order]
    every = bool(open_.all())

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in np.flatnonzero(open_).tolist():
        lo, hi = i + 1 if every else int(s.low[i]), int(s.reach[i])
        if hi <= lo:
            continue
        js = s.candidates(i, lo, hi)
        js = js[(before[js] != before[i]) & ((js > i) | ~open_[js])]
        if two:
            js = js[sides[js] != sides[i]]
        if not len(js):
            continue
        both = s.shared(i, js)
        union = s.sizes[i] + s.sizes[js] - both
        ok = both * s.den >= s.num * union
        if not ok.any():
            continue
        x, ys = int(s.order[i]), s.order[js[ok]]
        missed = 1 / recall(met, both[ok] / union[ok]) - 1
        out["links"][x] += copies[ys].sum()
        out["links"][ys] += copies[x]
        out["pairs"][x] += len(ys)
        out["pairs"][ys] += 1
        out["missed"][x] += missed.sum()
        out["missed"][ys] += missed
        for y in ys.tolist():
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
    out["root"] = np.array([find(i) for i in range(n)], np.int64)
    return out


FOUND = "unit bigint, links bigint, pairs bigint, missed double, root bigint"


def verified(texts: DataFrame, wanted: DataFrame, words: int, threshold: float, met: int) -> DataFrame:
    """Exact links in groups of candidates: FOUND, a row for each task that found the unit a link.

    wanted: (unit, copies, n, root, before, open); texts: (unit, text). Blocks of open units come first, and only they meet
    others.
    """
    is_open = F.col("open").cast("long")
    groups = wanted.groupBy("root").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("n").alias("shingles"), F.sum(is_open).alias("open_texts"), F.sum(is_open * F.col("n")).alias("open_shingles")
    )
    side = F.greatest(F.lit(float(BLOCK_TEXTS)), BLOCK_GROWTH * F.sqrt("texts"))
    blocks = lambda t, n: F.greatest(F.ceil(t / side), F.ceil(n / F.lit(BLOCK_SHINGLES))).cast("int")
    groups = groups.withColumn("whole", blocks(F.col("texts"), F.col("shingles")) <= 1)
    groups = groups.withColumn("first", F.when(F.col("whole"), 1).otherwise(blocks(F.col("open_texts"), F.col("open_shingles"))))
    groups = groups.withColumn("rest", F.when(F.col("whole"), 0).otherwise(blocks(F.col("texts") - F.col("open_texts"), F.col("shingles") - F.col("open_shingles"))))
    groups = kept(groups, "join-groups")
    total = groups.filter("whole").agg(F.sum("texts"), F.sum("shingles")).first()
    buckets = max(1, -(-(total[0] or 0) // TASK_TEXTS), -(-(total[1] or 0) // TASK_SHINGLES))
    dealt = wanted.join(groups.select("root", "first", "rest", "whole"), "root")
    place = F.xxhash64("unit")
    block = F.when(F.col("whole"), 0).when(F.col("open"), F.pmod(place, F.col("first"))).otherwise(F.col("first") + F.pmod(place, F.greatest(F.col("rest"), F.lit(1))))
    dealt = dealt.withColumn("block", block.cast("int"))
    dealt = dealt.withColumn("task", F.when(F.col("whole"), -1 - F.pmod(F.xxhash64("root"), F.lit(buckets))).otherwise(F.col("root")))
    last = F.when(F.col("block") < F.col("first"), F.col("first") + F.col("rest")).otherwise(F.col("first")) - 1
    dealt = kept(dealt.select("unit", "copies", "root", "before", "open", "block", "task", last.alias("last")), "join-dealt")

    few = dealt.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    tiles = texts.join(F.broadcast(dealt) if few else dealt, "unit").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    tiles = tiles.select("task", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "root", "before", "open", "block", "unit", "copies", "text")
    limit = Fraction(str(threshold))

    def compare(tile: tuple, t: pa.Table) -> pa.Table:
        two = tile[1].as_py() != tile[2].as_py()
        shingles, out = Shingler(words), {k: [] for k in ("unit", "links", "pairs", "missed", "root")}
        group, unit = t.column("root").to_numpy(), t.column("unit").to_numpy()
        order = np.lexsort((unit, group))
        new = np.ones(len(order), bool)
        new[1:] = unit[order][1:] != unit[order][:-1]
        order = order[new]  # a unit once, also where its row repeats
        group, unit, texts = group[order], unit[order], t.column("text").combine_chunks().take(pa.array(order)).cast(pa.binary())
        side, copies, before, open_ = (t.column(c).to_numpy()[order] for c in ("block", "copies", "before", "open"))
        cuts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
        for a, b in zip(cuts[:-1], cuts[1:]):
            sets = [shingles(texts[i].as_py()) for i in range(a, b)]
            got = linked(sets, side[a:b], copies[a:b], limit, two, before[a:b], open_[a:b], met)
            some = np.flatnonzero(got["pairs"])
            got["unit"], got["root"] = unit[a:b], unit[a:b][got["root"]]
            for k, values in out.items():
                values.append(got[k][some])
        kinds = {k: pa.float64() if k == "missed" else pa.int64() for k in out}
        return pa.table({k: pa.array(np.concatenate(v), kinds[k]) for k, v in out.items()})

    return tiles.groupBy("task", "lo", "hi").applyInArrow(compare, FOUND)


def grown(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Groups (unit, root) after further links (a, b) of units."""
    of = lambda name: groups.select(F.col("unit").alias(name), F.col("root").alias(name + "_root"))
    tops = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    tops = tops.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).filter("a != b").distinct()
    up = kept(components(tops), "join-up")
    every = groups.unionByName(up.select("unit", F.col("unit").alias("root")).join(groups, "unit", "left_anti"))
    return every.join(up.select(F.col("unit").alias("root"), F.col("root").alias("top")), "root", "left").select("unit", F.coalesce("top", "root").alias("root"))


def links_of(units: DataFrame, docs: DataFrame, words: int, threshold: float, target: float) -> DataFrame:
    """FOUND rows of all depths; units: (unit, key, rep, copies, n, label), docs: (doc_id, text)."""
    spark = units.sparkSession
    least = matched_length(threshold, target)
    trie = kept(trie_links(units, least, TREES, LABEL).distinct(), "join-links")
    deep = {r.level for r in trie.select("level").distinct().collect()}  # at most LABEL rows
    linked_units = trie.select(F.col("a").alias("unit")).unionByName(trie.select(F.col("b").alias("unit"))).distinct()
    named = kept(units.join(linked_units, "unit").select("unit", "copies", "n", F.col("key").alias("k"), "rep"), "join-named")
    few = named.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    rows = docs.withColumn("key", key_of(F.col("text")))
    texts = rows.join(F.broadcast(named) if few else named, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    texts = kept(texts.select("unit", "text"), "join-texts")  # the texts that have a candidate, once for all depths

    groups, found = spark.createDataFrame([], "unit bigint, root bigint"), spark.createDataFrame([], FOUND)
    for k in range(LABEL, least - 1, -1):
        if k not in deep:
            continue
        after = kept(grown(groups, trie.filter(F.col("level") == k).select("a", "b")), "join-grown")
        so_far = found.groupBy("unit").agg(F.sum("pairs").alias("pairs"), F.sum("missed").alias("missed"))
        pairs, missed = F.coalesce("pairs", F.lit(0)), F.coalesce("missed", F.lit(0.0))
        met = recall(k + 1, threshold) if k < LABEL else 0.0
        open_ = pairs + F.lit(met) < F.lit(target) * (pairs + missed + 1)
        all_ = after.join(groups.select("unit", F.col("root").alias("before")), "unit", "left").join(so_far, "unit", "left")
        all_ = all_.select("unit", "root", F.coalesce("before", "unit").alias("before"), open_.alias("open")).join(named.select("unit", "copies", "n"), "unit")
        todo = all_.groupBy("root").agg(F.min("before").alias("x"), F.max("before").alias("y"), F.max("open").alias("some")).filter("some AND x < y")
        wanted = kept(all_.join(todo.select("root"), "root", "left_semi"), "join-wanted")
        found = found.unionByName(kept(verified(texts, wanted, words, threshold, k), "join-found"))
        groups = after
    return found


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, target: float = RECALL) -> DataFrame:
    """One row per document: doc_id, key (of its text), class_id, n_links, first (its text stands for the class).

    class_id is the least id of the class; n_links counts the other documents with a similarity of the threshold or more.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("text", whole(F.col("text")))
    sig = kept(signed(docs, words, TREES, LABEL), "join-signed")
    units = sig.filter("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("label").alias("label")
    )
    units = kept(units.withColumn("unit", F.monotonically_increasing_id()), "join-units")
    found = kept(links_of(units, docs, words, threshold, target), "join-found")
    links = found.groupBy("unit").agg(F.sum("links").alias("links"))
    roots = kept(components(found.select(F.col("unit").alias("a"), F.col("root").alias("b"))), "join-roots")
    parts = units.select("unit", "key", "rep", "copies").join(links, "unit", "left").join(roots, "unit", "left")
    parts = kept(parts.withColumn("root", F.coalesce("root", "unit")).withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1), "join-parts")
    first = kept(parts.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "unit")).alias("f")).select("root", F.col("f.rep").alias("class_id"), F.col("f.unit").alias("first")), "join-first")
    parts = parts.join(first, "root").select("key", "class_id", F.col("links").cast("long").alias("n_links"), (F.col("first") == F.col("unit")).alias("first"), "rep")
    parts = kept(parts, "join-classes")
    out = sig.select("doc_id", "key", "n").join(parts, "key", "left")
    bare = F.col("n") == 0
    return out.select(
        "doc_id", "key", F.when(bare, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(bare, F.lit(True)).otherwise(F.col("first") & F.col("doc_id").eqNullSafe(F.col("rep"))).alias("first"),
    )


def survivors(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that stay, with all their columns: one row of each class (all rows without words stay)."""
    cols, own = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    out = kept(joined(docs, words=words, threshold=threshold), "join-rows")
    gone = out.filter("NOT first").select(F.col("doc_id").alias("i"), F.col("key").alias("k")).distinct()
    few = gone.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    rows = docs.toDF(*own)
    doc_id, text = F.col(own[cols.index("doc_id")]), whole(F.col(own[cols.index("text")]))
    rows = rows.withColumns({"doc_id": doc_id, "key": key_of(text), "blank": F.btrim(text, F.lit(" \t\n\x0b\f\r")) == ""})
    rows = rows.join(F.broadcast(gone) if few else gone, doc_id.eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left_anti")
    if not out.filter("first").groupBy("doc_id", "key").count().filter("count > 1").isEmpty():  # rows that repeat
        rows = rows.filter("blank").unionByName(rows.filter("NOT blank").dropDuplicates(["doc_id", "key"]))
    return rows.select(*own).toDF(*cols)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links")
