"""Quality rules per document and per host.

Every document gets its counts and the rules that it fails. Failures are summed per host and rule; a rule's rates over
all hosts give an empirical beta prior by moments, each host's rate is shrunk towards it, and a host with a shrunk rate
above `host_limit` for any rule is rejected, with all its documents. Host verdicts are joined back to the documents.

A null text counts as empty and fails the rule on words; a null host is a host of its own. An empty table gives an
empty result. Only counts travel: one host may hold most rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumtab.llm.common import BLANKS, kept, pick, whole, words

MIN_WORDS = 10
REPEAT_PERCENT = 20
SYMBOL_PERCENT = 30
DUP_LINE_PERCENT = 50
WINDOW = 5
HOST_LIMIT = 0.6
#: Up to this many rejected hosts are broadcast; more take a shuffled join.
BROADCAST_HOSTS = 100_000
RULES = ("few_words", "repeats", "symbols", "dup_lines")


def measured(rows: DataFrame) -> DataFrame:
    """rows (text, ...) with the counts of each document; the steps are columns of their own, so each runs once.

    A 5-word window that repeats must share its 64-bit hash with another, so a document whose hashes are all distinct has
    none; a window's hash is made of its words' hashes, so a word is hashed once and not five times. Only other documents sort their windows, as strings with their places: equal neighbours give the places that
    repeat, and each place adds the words up to the next one, five at most. Time is that of a sort, texts of any length.
    """
    text = F.col("text")
    n, w = F.col("n_words"), F.col("w")
    at = F.sequence(F.lit(1), n - WINDOW + 1)
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("text", whole(text)).withColumn("w", words(text)).withColumn("n_words", F.size("w").cast("long"))
    rows = rows.withColumn("h1", F.when(n >= WINDOW, F.transform(w, lambda x: F.xxhash64(x))).otherwise(none))
    for wide, left, right in ((2, 1, 1), (4, 2, 2), (WINDOW, 4, 1)):  # windows of 2 words, of 4 and of 5, each of two narrower ones
        size = F.greatest(F.size("h1") - (wide - 1), F.lit(0))
        halves = F.slice(f"h{left}", F.lit(1), size), F.slice(f"h{right}", F.lit(left + 1), size)
        rows = rows.withColumn(f"h{wide}", F.zip_with(*halves, lambda a, b: F.xxhash64(a, b)))
    rows = rows.withColumnRenamed(f"h{WINDOW}", "hashes").drop("h1", "h2", "h4")
    windows = F.transform(at, lambda i: F.struct(F.array_join(F.slice(w, i.cast("int"), WINDOW), " ").alias("g"), i.alias("i")))
    rows = rows.withColumn("sorted", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(windows)))
    o = F.col("sorted")
    pairs = F.zip_with(
        F.slice(o, 1, F.size(o) - 1), F.slice(o, 2, F.size(o) - 1),
        lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])).otherwise(none),
    )
    rows = rows.withColumn("places", F.sort_array(F.array_distinct(F.flatten(pairs))))
    p = F.col("places")
    steps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(WINDOW).cast("long")))
    covered = F.when(F.size(p) > 0, F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda acc, x: acc + x))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    rows = rows.withColumn("lines", lines)
    symbols = F.when(text.rlike(r"[#*$%&|<>]"), F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).otherwise(0)
    return rows.withColumns({
        "word_chars": F.char_length(F.array_join("w", "")).cast("long"),
        "n_symbols": symbols.cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }).drop("w", "hashes", "sorted", "places", "lines")


def ruled(rows: DataFrame) -> DataFrame:
    """measured() rows with a flag for each rule that a document fails, and base_failed."""
    return rows.withColumns({
        "few_words": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars"),
        "dup_lines": 100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_lines"),
    }).withColumn("base_failed", F.col("few_words") | F.col("repeats"))


def rejected_hosts(flagged: DataFrame, host: str, limit: float = HOST_LIMIT) -> DataFrame:
    """Hosts of which a shrunk rate of failures is above the limit: host, worst.

    The prior of a rule: m is the mean of the hosts' rates and v their variance less what binomial noise explains; its
    strength is m(1-m)/v - 1, between 1 and 1000 documents.
    """
    sums = [F.sum(F.col(r).cast("long")).alias(r) for r in RULES]
    hosts = kept(flagged.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), *sums), "rule-hosts")
    rates = {r: F.col(r) / F.col("n") for r in RULES}
    moments = hosts.agg(
        F.avg(1 / F.col("n")).alias("noise"),
        *[F.avg(rate).alias(f"{r}_m") for r, rate in rates.items()],
        *[F.var_pop(rate).alias(f"{r}_v") for r, rate in rates.items()],
    ).first()  # one row
    shrunk = []
    for r in RULES:
        m, noise = moments[f"{r}_m"] or 0.0, moments["noise"] or 0.0
        v = (moments[f"{r}_v"] or 0.0) - m * (1 - m) * noise
        strength = min(max(m * (1 - m) / v - 1, 1.0), 1000.0) if v > 0 else 1000.0
        shrunk.append((F.col(r) + F.lit(m * strength)) / (F.col("n") + F.lit(strength)))
    return hosts.withColumn("worst", F.greatest(*shrunk)).filter(F.col("worst") > limit).select("host", "worst")


def with_verdicts(flagged: DataFrame, host: str, limit: float = HOST_LIMIT) -> DataFrame:
    """flagged rows with kept: neither base_failed nor of a rejected host."""
    bad = rejected_hosts(flagged, host, limit).select(F.col("host").alias("bad_host"), F.lit(True).alias("of_bad_host"))
    if bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    both = flagged.join(bad, F.col(host).eqNullSafe(F.col("bad_host")), "left").drop("bad_host")
    return both.withColumn("kept", ~F.col("base_failed") & F.col("of_bad_host").isNull()).drop("of_bad_host")


def judge(docs: DataFrame, host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    rows = ruled(measured(pick(docs, "doc_id", "text", host=host_col))).drop("text")
    rows = kept(rows, "rule-counts")  # counts alone, so the texts are read once
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return with_verdicts(rows, "host", limit).select(*counts)


def accepted(docs: DataFrame, host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The documents that are kept, with all their columns."""
    cols, own = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    text = own[cols.index("text")]
    rows = docs.toDF(*own)
    flagged = ruled(measured(rows.withColumn("text", F.col(text)))).select(*own, *RULES, "base_failed")
    flagged = kept(flagged, "rule-flags")
    return with_verdicts(flagged, own[cols.index(host_col)], limit).filter("kept").select(*own).toDF(*cols)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (  -- 5-word windows
  SELECT doc_id, u.i, array_to_string(w[u.i:u.i + 4], ' ') AS gram FROM d, unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 5),
p AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (
  SELECT doc_id, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM p) GROUP BY doc_id),
l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (
  SELECT *, n_words < 10 AS few_words, 100 * n_repeat_words > 20 * n_words AS repeats,
         100 * n_symbols > 30 * word_chars AS symbols, 100 * n_dup_lines > 50 * n_lines AS dup_lines FROM c),
h AS (
  SELECT source, rule, count(*) AS n, sum(CAST(hit AS INT)) AS k
  FROM (SELECT source, unnest(['few_words', 'repeats', 'symbols', 'dup_lines']) AS rule, unnest([few_words, repeats, symbols, dup_lines]) AS hit FROM f)
  GROUP BY source, rule),
m AS (SELECT rule, avg(k / n) AS m, var_pop(k / n) - avg(k / n) * (1 - avg(k / n)) * avg(1 / n) AS v FROM h GROUP BY rule),
s AS (SELECT rule, m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 1000.0) ELSE 1000.0 END AS strength FROM m),
b AS (SELECT source, max((k + m * strength) / (n + strength)) > 0.6 AS bad FROM h JOIN s USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repeats AS base_failed,
       NOT (few_words OR repeats) AND NOT bad AS kept
FROM f JOIN b ON f.source IS NOT DISTINCT FROM b.source
"""
