"""Quality scores by nearest-neighbour voting among labelled documents in a latent-semantic space.

A document's terms are its words (lower-cased, hashed into WORD_TERMS columns) and style terms: shares of symbols,
capitals, digits, line ends, repeated words, repeated lines and repeated word pairs, word lengths and text length, each
in bins. Terms are weighed by log frequency and inverse document frequency, rows have length 1, and a truncated singular
value decomposition of the labelled sample maps them to RANK dimensions. The labelled vectors are broadcast, every
document takes exact cosine products with all of them, block by block, and its K nearest vote, each with its similarity
to the power POWER.

Labels are learnt from rows of `labels` whose crc32(doc_id as text) mod 5 is not 0, at most MAX_LABELLED of them (those
with the least hash of their id); so what the driver fits and what is broadcast are bounded (about 4 MB), whatever the
input. Labels, languages, sources and ids are never inputs of a score.

Null counts as empty; empty texts have style terms, so they get a score like others. Without labelled rows every score
is 0.5. Repeated rows get equal scores; of several labels of one id the largest counts. An id is learnt from once: of its
rows, however many, Spark picks the one whose term counts have the least hash. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumtab.llm.common import pick, whole

FOLDS = 5
MAX_LABELLED = 8_000
WORD_TERMS = 512
RANK = 64
K = 25
POWER = 4
THRESHOLD = 0.3
BLOCK = 256
#: Bin edges of the style terms.
STYLES = {
    "symbols": (0.002, 0.01, 0.03, 0.08, 0.15, 0.3),
    "marks": (0.005, 0.02, 0.05, 0.1, 0.2),
    "capitals": (0.005, 0.02, 0.06, 0.15, 0.4, 0.7),
    "digits": (0.001, 0.01, 0.04, 0.1, 0.3),
    "line_ends": (0.0005, 0.002, 0.008, 0.03, 0.1),
    "word_length": (2.5, 3.5, 4.5, 5.5, 6.5, 8, 12),
    "repeated_words": (0.1, 0.25, 0.4, 0.55, 0.7, 0.85, 0.95),
    "repeated_pairs": (0.01, 0.03, 0.08, 0.2, 0.4, 0.7, 0.9),
    "repeated_lines": (0.01, 0.05, 0.2, 0.5, 0.8),
    "words": (1, 5, 10, 20, 50, 150, 400, 1500),
}
OFFSETS = dict(zip(STYLES, np.cumsum([WORD_TERMS] + [len(e) + 1 for e in STYLES.values()])[:-1].tolist()))
TERMS = WORD_TERMS + sum(len(e) + 1 for e in STYLES.values())
#: A style term counts as a word that stands so often (before the logarithm).
STYLE_COUNT = 12
BYTES = {
    "symbols": np.isin(np.arange(256), list(b"#*$%&|<>{}[]\\^~_=+@")),
    "marks": np.isin(np.arange(256), list(b"!?.,;:-'\"()/")),
    "capitals": np.isin(np.arange(256), list(range(65, 91))),
    "digits": np.isin(np.arange(256), list(range(48, 58))),
    "line_ends": np.isin(np.arange(256), [10]),
}


class Terms:
    """Texts to rows of term counts; the words met last are remembered."""

    def __init__(self) -> None:
        self.seen: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        import zlib

        row = np.zeros(TERMS, np.float32)
        words, seen = text.split(), self.seen
        if len(seen) > 500_000:
            self.seen = seen = {}
        at = []
        for w in words:
            k = seen.get(w)
            if k is None:
                k = seen[w] = zlib.crc32(w.lower()) % WORD_TERMS
            at.append(k)
        if at:
            row[:WORD_TERMS] = np.bincount(at, minlength=WORD_TERMS)
        found = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        n, size = len(words), max(1, len(text))
        lines = [x for x in text.split(b"\n") if x.strip()]
        style = {k: found[on].sum() / size for k, on in BYTES.items()}
        style["word_length"] = sum(map(len, words)) / max(1, n)
        style["repeated_words"] = 1 - len(set(words)) / max(1, n)
        style["repeated_pairs"] = 1 - len(set(zip(words, words[1:]))) / max(1, n - 1) if n > 1 else 0.0
        style["repeated_lines"] = 1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0
        style["words"] = n
        for k, v in style.items():
            row[OFFSETS[k] + int(np.searchsorted(STYLES[k], v, side="right"))] = STYLE_COUNT
        return row


def weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = np.log1p(counts) * idf
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.maximum(length, 1e-9)).astype(np.float32)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def fold_of(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def counted(rows: DataFrame, kind: str) -> DataFrame:
    """rows (doc_id, text, label) as (doc_id, label, counts): term counts as bytes of 32-bit floats."""

    def run(batches: Iterator) -> Iterator:
        terms = Terms()
        for batch in batches:
            got = [terms(t.as_py()).tobytes() for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(got, pa.binary())], ["doc_id", "label", "counts"])

    return rows.select("doc_id", "label", "text").mapInArrow(run, f"doc_id {kind}, label int, counts binary")


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> dict | None:
    """The model of docs (doc_id, text) and labels (doc_id, label): idf, projection, and the labelled vectors with votes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    usable = labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 0))
    usable = usable.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    usable = usable.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = counted(docs.join(F.broadcast(sample), "doc_id"), kind)
    one = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("counts").alias("at"), "counts")).alias("one"))
    got = sorted((r.doc_id, r.label, bytes(r.counts)) for r in one.select("doc_id", "label", "one.counts").collect())  # at most MAX_LABELLED rows of 2 kB
    if not got:
        return None
    counts = np.frombuffer(b"".join(c for _, _, c in got), np.float32).reshape(len(got), TERMS)
    idf = (np.log((1 + len(got)) / (1 + (counts > 0).sum(axis=0))) + 0.2).astype(np.float32)
    rows = weighed(counts, idf)
    values, vectors = np.linalg.eigh(rows.T.astype(np.float64) @ rows)
    projection = vectors[:, np.argsort(-values)[:RANK]].astype(np.float32)
    votes = np.array([label for _, label, _ in got], np.float32)
    return {"idf": idf, "projection": projection, "vectors": unit_rows(rows @ projection), "votes": votes}


def voted(model: dict, counts: np.ndarray) -> np.ndarray:
    """The share of similarity that the nearest labelled vectors give to label 1, for a block of documents."""
    near = unit_rows(weighed(counts, model["idf"]) @ model["projection"]) @ model["vectors"].T
    k = min(K, near.shape[1])
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(near, best, axis=1), 1e-3).astype(np.float64) ** POWER
    return np.clip((weight * model["votes"][best]).sum(axis=1) / weight.sum(axis=1), 0, 1)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_LABELLED) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("text", whole(F.col("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    model = fit(docs, pick(labels, doc_id=id_col, label=label_col), most)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        terms, model = Terms(), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if model is None:
                    score = np.full(part.num_rows, 0.5)
                else:
                    score = voted(model, np.stack([terms(t.as_py()) for t in part.column("text").cast(pa.binary())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    out = docs.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
