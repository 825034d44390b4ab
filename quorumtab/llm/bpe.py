"""BPE encoding and decoding with a published vocabulary of word-end pieces.

A text is cut at the special tokens' strings, put in NFC and lower case, split into words, and each word is merged:
its parts' ids and the ranks of adjacent pairs stand in contiguous arrays, the arrays are scanned for the minimum, that
boundary is deleted and the two neighbouring ranks are refreshed. A word of more than SHORT parts, where scans would
take quadratic time, keeps its ranks in a heap instead; both give the leftmost pair of the lowest rank each time.
Words, and what stands between white space, are looked up in a cache of bounded size, which a worker keeps from task to
task. Letters that Unicode added after version 15 may be cut otherwise than by the tokenizers library, whose tables are
older than the regex module's.

Spark partitions the documents; nothing is shuffled. Null counts as empty: no tokens, decoded as empty. Repeated rows
give repeated results, an empty table an empty one; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumtab.llm.common import pick

SHORT = 200
CACHED_WORDS = 1_500_000
ROWS_A_BATCH = 500
END = "</w>"
#: White space as the vocabulary's split pattern has it, and that pattern, for any text and for ASCII.
SPACE = r"\t-\r \x85\xa0" + "\u1680\u2028\u2029\u202f\u205f\u3000\u2000-\u200a"
NOT_SPACE = "\x1c\x1d\x1e\x1f"  # white space to Python, not to the pattern
ANY_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
ASCII_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(printable))
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Cache(dict):
    """Texts to their ids as bytes of 32-bit integers, made when first asked for. Very long texts aren't kept.

    There are two generations: a full one becomes the old one, from which what is asked for again comes back.
    """

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.old.pop(text, None) or self.make(text)
        if len(text) <= 64:
            if len(self) >= CACHED_WORDS // 2:
                self.old = dict(self)
                self.clear()
            self[text] = ids
        return ids


class Codec:
    """Encodes and decodes with the vocabulary of a tokenizers file, given as its text."""

    def __init__(self, spec: str) -> None:
        import regex

        spec = json.loads(spec)
        vocab = spec["model"]["vocab"]
        self.ids = vocab
        merges = spec["model"]["merges"]
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(merges)}  # of adjacent ids
        self.merged = [vocab[a + b] for a, b in merges]  # id by rank
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = [x for _, x in sorted(byte_letters().items())]
        self.inside, self.last = [vocab.get(x) for x in letters], [vocab.get(x + END) for x in letters]  # ids by byte, in a word and at its end
        self.any_words, self.ascii_words = regex.compile(ANY_SPLIT).findall, re.compile(ASCII_SPLIT).findall
        self.known = Cache(self._made)

    def encode(self, text: str) -> list[int]:
        return array("i", self.encoded(text)).tolist()

    def encoded(self, text: str) -> bytes:
        """The ids of a text, as bytes of 32-bit integers."""
        return b"".join([array("i", [self.special[piece]]).tobytes() if piece in self.special else self._plain(piece) for piece in (self.cut.split(text) if self.cut else [text])])

    def _plain(self, text: str) -> bytes:
        # lower() writes the last sigma of a word otherwise; letter by letter there is one sigma
        text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if any(c in text for c in NOT_SPACE):
            return self._made(text)
        return b"".join(map(self.known.__getitem__, text.split()))  # no word has white space in it

    def _made(self, text: str) -> bytes:
        """The ids of words without white space between them, or of one word."""
        found = self.ascii_words(text) if text.isascii() else self.any_words(text)
        if len(found) == 1 and found[0] == text:
            return array("i", self._merge(text)).tobytes()
        return b"".join(map(self.known.__getitem__, found))

    def _merge(self, word: str) -> list[int]:
        data = word.encode()
        parts = [p for p in (*(self.inside[b] for b in data[:-1]), self.last[data[-1]]) if p is not None]
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        rank, merged, never = self.ranks.get, self.merged, 1 << 60
        ranks = [rank(p, never) for p in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == never:
                break
            i = ranks.index(low)
            parts[i] = merged[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), never)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), never)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        ranks, merged, n = self.ranks, self.merged, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # a neighbour was merged meanwhile
            parts[i], parts[j] = merged[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (p := (parts[left], parts[after[left]])) in ranks:
                    heapq.heappush(heap, (ranks[p], left, *p))
        return [p for p in parts if p >= 0]

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings with a blank between, as for a vocabulary without a decoder."""
        return " ".join([self.tokens[i] for i in ids])


@lru_cache(maxsize=2)
def codec(spec: str) -> Codec:
    """One codec a worker process and vocabulary, with the words that it has met."""
    return Codec(spec)


def encode(docs: DataFrame, spec_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """One row per document: doc_id, ids (array of int), and unless decoded is off, decoded (the text that the ids give).

    The vocabulary file is read on the driver and sent to each worker once, 1.7 MB whatever the input.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    with open(spec_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own = codec(spec.value)
        names = ["doc_id", "ids", *(["decoded"] if decoded else [])]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_A_BATCH):
                part = batch.slice(at, ROWS_A_BATCH)
                flat, ends, back = [], [0], []
                for text in part.column("text"):
                    ids = np.frombuffer(own.encoded(text.as_py() or ""), dtype=np.int32)
                    flat.append(ids)
                    ends.append(ends[-1] + len(ids))
                    if decoded:
                        back.append(own.decode(ids.tolist()))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, *([pa.array(back, pa.string())] if decoded else [])], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>" + (", decoded string" if decoded else ""))


def ids_text(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), " ")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids_text(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
