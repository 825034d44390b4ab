"""URL lists and rules behind a blocked Bloom filter.

Listed are whole canonical URLs, host and path ("spam.example.com/a": host in lower case, no scheme, query, fragment or
slash at the end), which block, and rules, host then path prefix ("example.org/es/"), with a verdict. A rule fits its host
and all subdomains when the URL's path starts with the rule's path; the longest fitting rule wins, then the longer host,
then block. So a URL is judged by its candidate keys: its canonical form, and each suffix of its host at a label, joined
with each prefix of its path that is as long as some rule's path.

Candidates first meet a blocked Bloom filter of all listed keys: a hash names one 64-bit block, a second hash sets four
bits in it, and all four must be there. The filter is one array of blocks, 10.7 bits a key, which a scalar subquery builds
once and hands to every task; a candidate is tested in the expression, without a join or shuffle, and only possible hits
go on to the exact hash join, which removes the false positives. Above MOST_BLOCKS blocks (12.5 million keys, 16 MB) the
blocks stay a table that is joined by block instead.

Where no rule fits, the list decides: block if the canonical URL is listed, else allow. Null URLs and those without "://"
have host and path empty and are allowed, an empty path fits no rule, repeated rows are judged alike, and an empty table
gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumtab.llm.common import kept, pick

#: Fixed values of the job: the rules.
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
#: The query's list holds the pages whose title shows a run of one of these marks.
JUNK_TITLE = r"<title>[^<]*(?:\*\*\*|###|\$\$\$|%%%)"

BROADCAST_KEYS = 200_000
KEYS_PER_BLOCK = 6
MOST_BLOCKS = 1 << 21


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without it."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(rest, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*(/[^?#]*)?", 1)


def canonical(host: Column, path: Column) -> Column:
    return F.concat(host, F.rtrim(path, F.lit("/")))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block")


def _mask(key: Column) -> Column:
    """Four of 64 bits."""
    h = F.xxhash64(key, F.lit("bits"))
    bits = [F.shiftright(h, 6 * i).bitwiseAND(63).cast("int") for i in range(4)]
    mask = F.lit(0).cast("long")
    for b in bits:
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))
    return mask


def bloom_of(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """keys (key) as blocks: (block, bits), and how many blocks there are."""
    blocks = max(1, -(-n_keys // KEYS_PER_BLOCK))
    return keys.groupBy(_block(F.col("key"), blocks)).agg(F.bit_or(_mask(F.col("key"))).alias("bits")), blocks


def possible_hits(candidates: DataFrame, listed: DataFrame, n_listed: int) -> DataFrame:
    """The candidates (key, ...) whose bits are all set in their block of the filter of the listed keys."""
    bloom, blocks = bloom_of(listed, n_listed)
    mask = _mask(F.col("key"))
    if blocks > MOST_BLOCKS:
        probed = candidates.withColumn("block", _block(F.col("key"), blocks)).join(bloom, "block")
        return probed.filter(F.col("bits").bitwiseAND(mask) == mask).drop("block", "bits")
    every = candidates.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block")).join(bloom, "block", "left")
    in_order = F.array_sort(F.collect_list(F.struct("block", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    words = every.agg(F.transform(in_order, lambda x: x["bits"]).alias("words")).scalar()  # MOST_BLOCKS elements at most
    return candidates.filter(F.get(words, _block(F.col("key"), blocks)).bitwiseAND(mask) == mask)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits), verdict.

    rules: (key, verdict), keys with their host in lower case; a few, as their path lengths come to the driver. listed:
    (url), canonical ones, of any number. Pages are told apart by host and path, so only distinct pairs are judged.
    """
    rules = rules.select("key", "verdict").groupBy("key").agg(F.max("verdict").alias("verdict"))  # "block" after "allow"
    named = listed.select(F.concat(F.lit("//"), "url").alias("key"), F.lit("listed").alias("verdict")).distinct()
    keys = kept(rules.unionByName(named), "url-keys")
    n_keys = keys.count()
    path_len = F.char_length("key") - F.instr("key", "/") + 1
    lengths = sorted(r[0] for r in rules.select(path_len).distinct().collect())  # at most as many as paths have characters
    most = rules.agg(F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\.")))).first()[0] or 1

    rows = pick(pages, page_id=id_col, url=url_col).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = rows.filter("host != ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    labels = F.slice(labels, F.greatest(F.size(labels) - most + 1, F.lit(1)), most)  # no rule's host has more labels
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.char_length("path"))
    of_rules = F.transform(F.array_distinct(suffixes), lambda h: F.transform(prefixes, lambda n: F.concat(h, F.substring("path", F.lit(1), n))))
    own = F.array(F.concat(F.lit("//"), canonical(F.col("host"), F.col("path"))))
    candidates = seen.select("host", "path", F.explode(F.concat(F.flatten(of_rules), own)).alias("key"))

    exact = possible_hits(candidates, keys, n_keys).join(F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys, "key")
    rule = F.struct(F.char_length("key").alias("n"), F.instr("key", "/").alias("h"), "verdict", "key")
    is_listed = F.col("verdict") == "listed"
    best = exact.groupBy("host", "path").agg(
        F.max(F.when(~is_listed, rule)).alias("best"), F.max(F.when(is_listed, F.lit(True))).alias("listed")
    )
    best = best.select(F.col("host").alias("h"), F.col("path").alias("p"), "best", "listed")
    out = rows.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    other = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", other).alias("verdict"))


def junk_urls(pages: DataFrame) -> DataFrame:
    """The canonical URLs (url) of the pages with a littered title; all captures of such a URL count as junk."""
    junk = pick(pages, "url", "html").filter(F.col("html").rlike(JUNK_TITLE))
    return junk.select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("url")).filter("url != ''").distinct()


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, spark.createDataFrame(RULES, "key string, verdict string"), junk_urls(pages))


ORACLE = r"""
WITH p AS (
  SELECT page_id, html, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*(/[^?#]*)?', 1) AS path FROM pages),
r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
j AS (SELECT DISTINCT host || rtrim(path, '/') AS url FROM p WHERE host || path <> '' AND regexp_matches(html, '<title>[^<]*(?:\*\*\*|###|\$\$\$|%%%)')),
u AS (SELECT DISTINCT host, path FROM p),
b AS (
  SELECT u.host, u.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM u JOIN r ON (u.host = r.host OR suffix(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.host, u.path)
SELECT page_id, p.host, p.path, b.rule,
       coalesce(b.verdict, CASE WHEN p.host <> '' AND p.host || rtrim(p.path, '/') IN (SELECT url FROM j) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN b ON p.host = b.host AND p.path = b.path
"""
