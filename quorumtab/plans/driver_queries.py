"""Queries over the driver's tables and the DuckDB statements that give the same rows.

Candidate tables come from lineitem: a supplier is a chart, a line number a sample, a ship year a row, a return flag a
column, and the summed price the cell. Sums are of decimals, so their order doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumtab.functions import registry, table_function
from quorumtab.functions import text as T
from quorumtab.operators import consensus, convergence, evaluation, selection, series, strategies, tables
from quorumtab.sources import caches
from quorumtab.sources.store import SampleStore

CANDIDATES = """
SELECT l_suppkey AS image_id, l_linenumber - 1 AS sample_idx, CAST(year(l_shipdate) AS VARCHAR) AS row_label, l_returnflag AS col_label,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM lineitem GROUP BY ALL"""
FILLED = f"WITH cand AS ({CANDIDATES}),"
METHODS = ["median", "mad", "mean", "medoid", "huber", "weighted_confidence", "ransac"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate cells: image_id, sample_idx, row_pos, col_pos, row_label, col_label, value."""
    rows = _table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("image_id"), (F.col("l_linenumber") - 1).alias("sample_idx"),
        F.year("l_shipdate").cast("string").alias("row_label"), F.col("l_returnflag").alias("col_label"),
    ).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("value"))
    return rows.withColumn("row_pos", F.col("row_label").cast("int")).withColumn("col_pos", F.ascii("col_label"))


def candidate_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates as samples: image_id, sample_idx, tsv_data with all three columns, prices to two decimals.

    Cells are dealt by chart once, which all that groups or joins by chart afterwards keeps to.
    """
    long = candidates(spark, sf_dir).repartition("image_id")
    flags = F.array(F.lit("A"), F.lit("N"), F.lit("R"))
    full = long.groupBy("image_id", "sample_idx", "row_label", "row_pos").agg(F.map_from_entries(F.collect_list(F.struct("col_label", F.col("value").cast("decimal(18,2)").cast("string")))).alias("m"))
    cells = full.select("image_id", "sample_idx", "row_label", "row_pos", "m", F.posexplode(flags).alias("col_pos", "col_label"))
    return tables.to_tsv(cells.withColumn("v", F.coalesce(F.try_element_at("m", F.col("col_label")), F.lit("nan"))), ["image_id", "sample_idx"], "v")


def skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A skeleton for each supplier: all years of the table and one more, whose cells stay empty."""
    items = _table(spark, sf_dir, "lineitem")
    years = items.agg(F.sequence(F.min(F.year("l_shipdate")), F.max(F.year("l_shipdate")) + 1).alias("years"))
    lines = F.transform("years", lambda y: F.concat(y.cast("string"), F.lit("\t_\t_\t_")))
    own = items.select(F.col("l_suppkey").alias("image_id")).distinct().join(F.broadcast(years))  # one row
    return own.select("image_id", F.array_join(F.concat(F.array(F.lit("\tA\tN\tR")), lines), "\n").alias("structure"))


def q_cell_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = consensus.aggregated(consensus.cell_values(candidates(spark, sf_dir), ["image_id"]), METHODS)
    return out.select("image_id", "row_label", "col_label", F.col("n").cast("long").alias("n"), *METHODS)


HUBER_STEPS = ",\n".join(
    f"""h{i} AS (
  SELECT image_id, row_label, col_label, any_value(med) AS med, any_value(mad) AS mad, any_value(close) AS close, any_value(done) OR abs(sum(w * value) / sum(w) - any_value(mu)) < 1e-6 AS done,
         CASE WHEN any_value(done) OR abs(sum(w * value) / sum(w) - any_value(mu)) < 1e-6 THEN any_value(mu) ELSE sum(w * value) / sum(w) END AS mu
  FROM (SELECT s.*, mu, done, CASE WHEN abs(value - mu) <= 1.345 * s.mad THEN 1.0 ELSE 1.345 * s.mad / abs(value - mu) END AS w
        FROM s JOIN h{i - 1} USING (image_id, row_label, col_label)) GROUP BY ALL)"""
    for i in range(1, 11)
)
CELL_ALL = f"""
{FILLED}
c AS (SELECT * FROM cand),
g AS (SELECT *, row_number() OVER (PARTITION BY image_id, row_label, col_label ORDER BY sample_idx) AS nth, count(*) OVER (PARTITION BY image_id, row_label, col_label) AS n,
             first_value(value) OVER (PARTITION BY image_id, row_label, col_label ORDER BY sample_idx) AS v0,
             round(median(value) OVER (PARTITION BY image_id, row_label, col_label), 6) AS med FROM c),
d AS (SELECT *, round(median(abs(value - med)) OVER (PARTITION BY image_id, row_label, col_label), 6) AS mad,
             bool_and(abs(value - v0) <= 1e-8 + 1e-5 * abs(v0)) OVER (PARTITION BY image_id, row_label, col_label) AS close FROM g),
s AS (SELECT *, row_number() OVER (PARTITION BY image_id, row_label, col_label ORDER BY abs(value - med), nth) AS near FROM d),
h0 AS (SELECT DISTINCT image_id, row_label, col_label, med, mad, close, false AS done, med AS mu FROM s),
{HUBER_STEPS}
SELECT s.image_id, s.row_label, s.col_label, count(*) AS n, any_value(s.med) AS median, any_value(s.mad) AS mad, round(avg(value), 6) AS mean,
       round(quantile_disc(value, 0.5), 6) AS medoid,
       any_value(CASE WHEN s.mad = 0 OR s.close THEN s.med ELSE round(h10.mu, 6) END) AS huber,
       round(avg(value) FILTER (WHERE near <= greatest(1, CAST(floor(n * 0.6) AS INT))), 6) AS weighted_confidence,
       CASE WHEN any_value(s.mad) = 0 OR any_value(s.close) THEN any_value(s.med) ELSE coalesce(round(avg(value) FILTER (WHERE abs(value - s.med) <= 2 * s.mad), 6), any_value(s.med)) END AS ransac
FROM s JOIN h10 USING (image_id, row_label, col_label) GROUP BY s.image_id, s.row_label, s.col_label"""


TRIMMED = "if(size(xs) < 3, med, aggregate(slice(array_sort(xs), 2, size(xs) - 2), 0D, (a, x) -> a + x) / (size(xs) - 2))"


def q_added_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A method added by its text, the mean without the least and the greatest value, of all cells by its name and from SQL."""
    registry.add_method(spark, "trimmed", TRIMMED)
    cells = consensus.cell_values(candidates(spark, sf_dir), ["image_id"])
    out = consensus.aggregated(cells, ["trimmed"]).withColumns({"by_sql": F.expr("robust_trimmed(xs)"), "huber_by_sql": F.expr("robust_huber(xs)")})
    return out.select("image_id", "row_label", "col_label", "trimmed", "by_sql", "huber_by_sql")


ADDED_METHOD = f"""
WITH all_cells AS ({CELL_ALL}),
t AS (
  SELECT image_id, row_label, col_label, CASE WHEN any_value(n) < 3 THEN round(median(value), 6) ELSE round(avg(value) FILTER (WHERE i > 1 AND i < n), 6) END AS trimmed
  FROM (SELECT *, row_number() OVER (PARTITION BY image_id, row_label, col_label ORDER BY value) AS i, count(*) OVER (PARTITION BY image_id, row_label, col_label) AS n FROM ({CANDIDATES}))
  GROUP BY image_id, row_label, col_label)
SELECT image_id, row_label, col_label, trimmed, trimmed AS by_sql, huber AS huber_by_sql FROM t JOIN all_cells USING (image_id, row_label, col_label)"""


def q_hot_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of cells with a large share of the line items each (return flag and line status), by counting instead of arrays."""
    items = _table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("row_label"), F.col("l_linestatus").alias("col_label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample_idx"),
        F.lit(1).alias("row_pos"), F.lit(1).alias("col_pos"), F.col("l_extendedprice").cast("double").alias("value"),
    )
    out = selection.aggregated_cells(items, ["row_label", "col_label"], METHODS)
    return out.select("row_label", "col_label", F.col("n").cast("long").alias("n"), *[F.round(m, 2).alias(m) for m in METHODS])


HOT_CELLS = CELL_ALL.replace(CANDIDATES, "SELECT 0 AS image_id, l_orderkey * 10 + l_linenumber AS sample_idx, l_returnflag AS row_label, l_linestatus AS col_label, CAST(l_extendedprice AS DOUBLE) AS value FROM lineitem")
HOT_CELLS = f"SELECT row_label, col_label, n, {', '.join(f'round({m}, 2) AS {m}' for m in METHODS)} FROM ({HOT_CELLS})"


def q_structured_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = consensus.structured(candidate_tables(spark, sf_dir), skeletons(spark, sf_dir), ["median", "mean"])
    return out.select("image_id", "row_label", "col_label", F.col("n").cast("long").alias("n"), "median", "mad", "mean")


STRUCTURED = f"""
{FILLED}
r AS (SELECT DISTINCT image_id, sample_idx, row_label FROM cand),
f AS (SELECT r.*, c.col_label, coalesce(cand.value, 0.0) AS value FROM r CROSS JOIN (VALUES ('A'), ('N'), ('R')) c(col_label)
      LEFT JOIN cand USING (image_id, sample_idx, row_label, col_label)),
w AS (SELECT image_id, CAST(y AS VARCHAR) AS row_label, col_label FROM (SELECT DISTINCT l_suppkey AS image_id FROM lineitem) CROSS JOIN (SELECT unnest(range(min(CAST(row_label AS INT)), max(CAST(row_label AS INT)) + 2)) AS y FROM cand) CROSS JOIN (VALUES ('A'), ('N'), ('R')) c(col_label)),
m AS (SELECT *, round(median(value) OVER (PARTITION BY image_id, row_label, col_label), 6) AS med FROM f),
a AS (SELECT image_id, row_label, col_label, count(*) AS n, any_value(med) AS median, round(median(abs(value - med)), 6) AS mad, round(avg(value), 6) AS mean FROM m GROUP BY ALL)
SELECT image_id, row_label, col_label, n, median, mad, mean FROM w LEFT JOIN a USING (image_id, row_label, col_label)"""


def q_consensus_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = candidate_tables(spark, sf_dir).withColumns({"input_tokens": F.lit(100).cast("long"), "output_tokens": F.char_length("tsv_data").cast("long")})
    return consensus.tables(samples, "median", skeletons(spark, sf_dir))


SAMPLES = f"""
{FILLED}
r AS (SELECT DISTINCT image_id, sample_idx, row_label FROM cand),
f AS (SELECT r.*, c.col_label, cand.value FROM r CROSS JOIN (VALUES ('A'), ('N'), ('R')) c(col_label) LEFT JOIN cand USING (image_id, sample_idx, row_label, col_label)),
smp AS (
  SELECT image_id, sample_idx, chr(9) || 'A' || chr(9) || 'N' || chr(9) || 'R' || chr(10) || string_agg(line, chr(10) ORDER BY row_label) AS tsv
  FROM (SELECT image_id, sample_idx, row_label, row_label || chr(9) || string_agg(coalesce(CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), 'nan'), chr(9) ORDER BY col_label) AS line FROM f GROUP BY image_id, sample_idx, row_label)
  GROUP BY image_id, sample_idx)"""
TABLES = f"""{SAMPLES},
w AS (SELECT image_id, CAST(y AS VARCHAR) AS row_label, col_label FROM (SELECT DISTINCT image_id FROM cand) CROSS JOIN (SELECT unnest(range(min(CAST(row_label AS INT)), max(CAST(row_label AS INT)) + 2)) AS y FROM cand) CROSS JOIN (VALUES ('A'), ('N'), ('R')) c(col_label)),
m AS (SELECT image_id, row_label, col_label, coalesce(value, 0.0) AS value, round(median(coalesce(value, 0.0)) OVER (PARTITION BY image_id, row_label, col_label), 6) AS med FROM f),
a AS (SELECT image_id, row_label, col_label, any_value(med) AS med, round(median(abs(value - med)), 6) AS mad FROM m GROUP BY image_id, row_label, col_label),
l AS (
  SELECT image_id, row_label, row_label || chr(9) || string_agg(coalesce(CAST(med AS VARCHAR), ''), chr(9) ORDER BY col_label) AS told,
         row_label || chr(9) || string_agg(coalesce(CAST(mad AS VARCHAR), ''), chr(9) ORDER BY col_label) AS spread
  FROM w LEFT JOIN a USING (image_id, row_label, col_label) GROUP BY image_id, row_label),
t AS (
  SELECT image_id, chr(9) || 'A' || chr(9) || 'N' || chr(9) || 'R' || chr(10) || string_agg(told, chr(10) ORDER BY row_label) AS told,
         chr(9) || 'A' || chr(9) || 'N' || chr(9) || 'R' || chr(10) || string_agg(spread, chr(10) ORDER BY row_label) AS spread FROM l GROUP BY image_id)
SELECT image_id, CASE WHEN count(*) > 1 THEN any_value(told) ELSE any_value(tsv) END AS tsv_data, CASE WHEN count(*) > 1 THEN any_value(spread) ELSE '' END AS mad_tsv, false AS used_fallback,
       count(*) AS num_samples, CAST(100 * count(*) AS BIGINT) AS total_input_tokens, CAST(sum(length(tsv)) AS BIGINT) AS total_output_tokens FROM smp JOIN t USING (image_id) GROUP BY image_id"""


def q_variance_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MADs of each supplier's consensus by place, and their mean and largest."""
    cells = consensus.aggregated(consensus.cell_values(candidates(spark, sf_dir), ["image_id"]), ["median"])
    placed = cells.withColumns({"row_pos": F.col("row_label").cast("int"), "col_pos": F.ascii("col_label")})
    out = consensus.variance_map(placed)
    shown = F.transform(F.array_sort(F.map_entries("variance")), lambda e: F.concat_ws("=", e["key"], T.python_text(e["value"])))
    return out.select("image_id", F.array_join(shown, ";").alias("variance"), F.round("mean_mad", 4).alias("mean_mad"), F.round("max_mad", 4).alias("max_mad"))


VARIANCE_MAP = f"""
{FILLED}
m AS (SELECT *, round(median(value) OVER (PARTITION BY image_id, row_label, col_label), 6) AS med FROM cand),
a AS (SELECT image_id, row_label || ',' || ascii(col_label) AS place, round(median(abs(value - med)), 6) AS mad FROM m GROUP BY image_id, row_label, col_label)
SELECT image_id, string_agg(place || '=' || CAST(mad AS VARCHAR), ';' ORDER BY place) AS variance, round(avg(mad), 4) AS mean_mad, round(max(mad), 4) AS max_mad FROM a GROUP BY image_id"""


def q_normalized_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small tables with a quoted tab in the header and a quote in the row label; cells with thousands' commas and words."""
    p = _table(spark, sf_dir, "part")
    text = F.concat(F.lit('"a\tb"\tc\n"'), F.col("p_brand"), F.lit(' ""x"" y"\t'), F.format_string("1,%03d pieces", F.col("p_size")), F.lit("\n"), F.col("p_name"), F.lit("\tnone\t-"), F.col("p_size").cast("string"), F.lit("%\n"))
    return tables.normalized_tsv(p.select("p_partkey", text.alias("tsv_data")), ["p_partkey"])


NORMALIZED_TSV = """
SELECT p_partkey, '"a' || chr(9) || 'b"' || chr(9) || 'c' || chr(10) || '"' || p_brand || ' ""x"" y"' || chr(9) || '1' || format('{:03d}', p_size) || chr(10)
       || p_name || chr(9) || '0' || chr(9) || '-' || p_size || chr(10) AS tsv_data FROM part"""


def q_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's table with an empty corner, read by SQL in three dialects: quotes stay or go, and an empty corner moves the labels."""
    table_function.register(spark)
    p = _table(spark, sf_dir, "part")
    text = F.concat(F.lit('\t"A"\tB\n'), F.col("p_brand"), F.lit("\t"), F.col("p_size").cast("string"), F.lit("\t x\n\n"), F.col("p_name"), F.lit('\t"y"'))
    parts = p.select("p_partkey", text.alias("tsv"))
    told = None
    for dialect in table_function.DIALECTS:
        one = spark.sql("SELECT p_partkey, :dialect AS dialect, c.* FROM {parts}, LATERAL table_cells(tsv, '" + dialect + "') c", args={"dialect": dialect}, parts=parts)
        told = one if told is None else told.unionByName(one)
    return told


TABLE_FUNCTION = """
SELECT p_partkey, 'quoted' AS dialect, r AS row_pos, c AS col_pos, CASE r WHEN 1 THEN p_brand ELSE p_name END AS row_label, CASE c WHEN 1 THEN 'A' ELSE 'B' END AS col_label,
       CASE WHEN r = 2 THEN 'y' WHEN c = 1 THEN CAST(p_size AS VARCHAR) ELSE ' x' END AS raw FROM part, (VALUES (1, 1), (1, 2), (2, 1)) t(r, c)
UNION ALL
SELECT p_partkey, 'plain', r, c, lower(CASE r WHEN 1 THEN p_brand ELSE p_name END), CASE c WHEN 1 THEN '"a"' ELSE 'b' END,
       CASE WHEN r = 3 THEN '"y"' WHEN c = 1 THEN CAST(p_size AS VARCHAR) ELSE 'x' END FROM part, (VALUES (1, 1), (1, 2), (3, 1)) t(r, c)
UNION ALL
SELECT p_partkey, 'stripped', r, 1, CASE r WHEN 1 THEN p_brand ELSE p_name END, 'B', CASE r WHEN 1 THEN CAST(p_size AS VARCHAR) ELSE '"y"' END FROM part, (VALUES (1), (2)) t(r)"""


def q_sample_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as samples, stored as the list of each key."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image_id"), F.col("o_orderkey").alias("sample_idx"), F.when(F.col("o_orderstatus") != "P", F.concat(F.col("o_orderpriority"), F.lit('\t"q"'))).alias("tsv_data"), F.lit(7).cast("long").alias("input_tokens"), F.col("o_orderkey").alias("output_tokens"))
    return caches.sample_lists(o)


SAMPLE_LISTS = """
SELECT o_custkey AS image_id, '[' || string_agg('{"csv_data":' || CASE WHEN o_orderstatus <> 'P' THEN '"' || o_orderpriority || '\\t\\"q\\""' ELSE 'null' END || ',"input_tokens":7,"output_tokens":' || o_orderkey || '}', ',' ORDER BY o_orderkey) || ']' AS value
FROM orders GROUP BY o_custkey"""


def q_next_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next three samples of each customer, after as many as its number's last digit; orders are the stored ones."""
    o = _table(spark, sf_dir, "orders")
    stored = o.select(F.col("o_custkey").alias("image_id"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("sample_idx"), F.col("o_orderpriority").alias("tsv_data"))
    cursors = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id"), (F.col("c_custkey") % 10).cast("int").alias("next_idx"))
    return caches.next_samples(stored, cursors, 3).withColumn("sample_idx", F.col("sample_idx").cast("long"))


NEXT_SAMPLES = """
WITH s AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_orderpriority FROM orders)
SELECT c_custkey AS image_id, CAST(c_custkey % 10 + t.j AS BIGINT) AS sample_idx, o_orderpriority AS tsv_data, s.i IS NOT NULL AS stored
FROM customer CROSS JOIN range(0, 3) t(j) LEFT JOIN s ON o_custkey = c_custkey AND i = c_custkey % 10 + t.j"""


def q_sample_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of a customer's orders as samples: the finished ones appended, two taken of each customer, the others appended, three more taken."""
    o = _table(spark, sf_dir, "orders").withColumn("later", F.col("o_orderstatus") != "F")
    nth = F.row_number().over(Window.partitionBy("o_custkey", "later").orderBy("o_orderkey")) - 1
    samples = o.select("later", F.col("o_custkey").alias("image_id"), nth.alias("sample_idx"), F.col("o_orderpriority").alias("tsv_data"), F.lit(7).alias("input_tokens"), F.col("o_orderkey").alias("output_tokens"))
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id"))
    store = SampleStore(spark, caches.scratch(spark, "samples"))
    store.append(samples.filter("NOT later").drop("later"))
    first = store.take(customers, 2)
    store.append(samples.filter("later").drop("later"))
    both = first.withColumn("taken", F.lit(1)).unionByName(store.take(customers, 3).withColumn("taken", F.lit(2)))
    return both.withColumn("sample_idx", F.col("sample_idx").cast("long"))


SAMPLE_STORE = """
WITH o AS (SELECT o_custkey, o_orderpriority, o_orderstatus <> 'F' AS later, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderkey) - 1 AS i FROM orders)
SELECT CAST(c_custkey AS VARCHAR) AS image_id, CAST(j AS BIGINT) AS sample_idx, o_orderpriority AS tsv_data, i IS NOT NULL AS stored, CASE WHEN j < 2 THEN 1 ELSE 2 END AS taken
FROM customer CROSS JOIN range(0, 5) t(j) LEFT JOIN o ON o_custkey = c_custkey AND i = j AND (j >= 2 OR NOT later)"""


def q_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a request for each customer's chart holds: data URL, prompt, provider and keys, of six models in turn."""
    c = _table(spark, sf_dir, "customer")
    model = F.get(F.array(*[F.lit(m) for m in MODELS]), (F.col("c_custkey") % len(MODELS)).cast("int"))
    skeleton = F.concat(F.lit(" \tA \n"), F.col("c_name"), F.lit("\t_"))
    path = F.concat(F.lit("x/"), F.col("c_name"), F.lit(".JPG"))
    return c.select(
        "c_custkey", T.data_url(path, F.col("c_name").cast("binary")).alias("url"), T.structured_prompt(skeleton).alias("prompt"), T.provider(model).alias("provider"),
        T.sample_key(path, model, F.lit(None).cast("double"), F.lit("p"), F.when(F.col("c_custkey") % 2 == 0, skeleton)).alias("key"),
    )


MODELS = ["qwen/a", "bytedance-seed/b", "meta-llama/c", "gpt-d", "gemini-e", "claude-f"]
REQUESTS = f"""
WITH m AS (SELECT *, {MODELS}[1 + c_custkey % {len(MODELS)}] AS model, ' ' || chr(9) || 'A ' || chr(10) || c_name || chr(9) || '_' AS skeleton FROM customer)
SELECT c_custkey, 'data:image/jpeg;base64,' || base64(encode(c_name)) AS url, '{T.PROMPT} Use exactly these headers: A' || chr(10) || 'Fill in this table:' || chr(10) || skeleton AS prompt,
       {[dict(T.PROVIDERS)[next(p for p, _ in T.PROVIDERS if m.startswith(p))] for m in MODELS]}[1 + c_custkey % {len(MODELS)}] AS provider,
       sha256('x/' || c_name || '.JPG|' || model || '|None|p' || CASE WHEN c_custkey % 2 = 0 THEN '|' || skeleton ELSE '' END) AS key FROM m"""


def q_fuzzy_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus without a skeleton, over tables whose column labels differ in case from sample to sample."""
    samples = candidate_tables(spark, sf_dir)
    odd = F.when(F.col("sample_idx") % 2 == 1, F.regexp_replace("tsv_data", r"\A[^\n]*", "\ta\tn\tr")).otherwise(F.col("tsv_data"))
    out = consensus.free_form(samples.withColumn("tsv_data", odd), ["median"])
    return out.select("image_id", *[F.col(c).cast("long").alias(c) for c in ("row_pos", "col_pos", "n")], "row_label", "col_label", "median", "mad")


#: Years are numbers, so they only meet their equals; those in half of the samples stay, in the order of their middle places. Column labels take the case that most samples have.
FUZZY = f"""{SAMPLES},
s AS (SELECT image_id, count(DISTINCT sample_idx) AS total FROM r GROUP BY image_id),
p AS (SELECT *, row_number() OVER (PARTITION BY image_id, sample_idx ORDER BY row_label) AS pos FROM r),
y AS (SELECT image_id, row_label, count(*) AS seen, min(sample_idx) AS early, median(pos) AS pos FROM p GROUP BY image_id, row_label),
k AS (SELECT image_id, row_label, row_number() OVER (PARTITION BY image_id ORDER BY pos, seen DESC, early, row_label) AS row_pos FROM y JOIN s USING (image_id) WHERE seen >= 0.5 * total),
c AS (
  SELECT image_id, count(*) FILTER (WHERE sample_idx % 2 = 0) AS upper_, count(*) FILTER (WHERE sample_idx % 2 = 1) AS lower_, min(sample_idx) % 2 = 0 AS upper_first
  FROM (SELECT DISTINCT image_id, sample_idx FROM r JOIN k USING (image_id, row_label)) GROUP BY image_id),
m AS (
  SELECT image_id, row_pos, row_label, CASE WHEN upper_ > lower_ OR upper_ = lower_ AND upper_first THEN col_label ELSE lower(col_label) END AS col_label, strpos('ANR', col_label) AS col_pos, coalesce(value, 0.0) AS value
  FROM f JOIN k USING (image_id, row_label) JOIN c USING (image_id)),
d AS (SELECT *, round(median(value) OVER (PARTITION BY image_id, row_label, col_label), 6) AS med FROM m)
SELECT image_id, row_pos, col_pos, row_label, col_label, count(*) AS n, any_value(med) AS median, round(median(abs(value - med)), 6) AS mad FROM d GROUP BY image_id, row_pos, col_pos, row_label, col_label"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median cells of each prefix of three samples or more."""
    long = convergence.prefixes(candidates(spark, sf_dir), 3, 10)
    return consensus.aggregated(consensus.cell_values(long, ["image_id", "prefix_k"]), ["median"])


def q_prefix_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).select("image_id", F.col("prefix_k").cast("long").alias("prefix_k"), "row_label", "col_label", "median", "mad")


PREFIX = f"""
{FILLED}
last AS (SELECT image_id, least(max(sample_idx) + 1, 10) AS last FROM cand GROUP BY image_id),
p AS (SELECT cand.*, k AS prefix_k FROM cand JOIN last USING (image_id) JOIN range(1, 11) t(k) ON k > sample_idx AND k <= last AND k >= least(3, last)),
m AS (SELECT *, round(median(value) OVER (PARTITION BY image_id, prefix_k, row_label, col_label), 6) AS med FROM p),
steps AS (SELECT image_id, CAST(prefix_k AS BIGINT) AS prefix_k, row_label, col_label, any_value(med) AS median, round(median(abs(value - med)), 6) AS mad FROM m GROUP BY ALL)"""
PREFIX = PREFIX.replace("GROUP BY ALL)", "GROUP BY image_id, prefix_k, row_label, col_label)").replace("FROM lineitem GROUP BY image_id, prefix_k, row_label, col_label)", "FROM lineitem GROUP BY ALL)")


def q_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = convergence.stability(_steps(spark, sf_dir), tolerance=0.05, coverage=0.5)
    return out.select("image_id", F.col("prefix_k").cast("long").alias("prefix_k"), "same_cells", F.round("stable_share", 9).alias("stable_share"), "exact", "stable")


STABILITY = (
    PREFIX
    + """,
b AS (SELECT coalesce(x.image_id, y.image_id) AS image_id, coalesce(x.prefix_k + 1, y.prefix_k) AS prefix_k, x.median AS was, y.median AS now
      FROM steps x FULL JOIN steps y ON x.image_id = y.image_id AND x.prefix_k + 1 = y.prefix_k AND x.row_label = y.row_label AND x.col_label = y.col_label),
s AS (SELECT image_id, prefix_k, bool_and(was IS NOT NULL AND now IS NOT NULL) AS same_cells, avg(CASE WHEN abs(was - now) <= greatest(0.1, 0.05 * abs(was)) THEN 1.0 ELSE 0.0 END) AS share,
             bool_and(was IS NOT DISTINCT FROM now) AS exact FROM b GROUP BY image_id, prefix_k HAVING count(was) > 0 AND count(now) > 0)
SELECT image_id, prefix_k, same_cells, round(share, 9) AS stable_share, exact, same_cells AND share >= 0.5 AS stable FROM s"""
)


def _told(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cells of the prefixes, and each prefix's consensus as text: image_id, prefix_k, value."""
    cells = _steps(spark, sf_dir)
    shown = cells.withColumns({"row_pos": F.col("row_label").cast("int"), "col_pos": F.ascii("col_label"), "v": T.python_text(F.col("median"))})
    return cells, tables.to_tsv(shown, ["image_id", "prefix_k"], "v", name="value")


TOLD = """lines AS (
  SELECT image_id, prefix_k, row_label, string_agg(col_label, chr(9) ORDER BY col_label) AS head,
         row_label || chr(9) || string_agg(CAST(median AS VARCHAR), chr(9) ORDER BY col_label) AS line FROM steps GROUP BY image_id, prefix_k, row_label),
v AS (SELECT image_id, prefix_k, chr(9) || arg_min(head, row_label) || chr(10) || string_agg(line, chr(10) ORDER BY row_label) AS value FROM lines GROUP BY image_id, prefix_k)"""


def q_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tolerant convergence with patience 2; a prefix's value is its consensus as text."""
    cells, value = _told(spark, sf_dir)
    steps = value.join(convergence.stability(cells, tolerance=0.3, coverage=0.5).select("image_id", "prefix_k", "stable_share"), ["image_id", "prefix_k"], "left")
    steps = steps.withColumns({"calm": F.coalesce(F.col("stable_share") >= 0.5, F.lit(False)), "has_content": F.lit(True), "used_fallback": F.lit(False)})
    out = convergence.incremental(steps, patience=2, stable="calm")
    return out.select("image_id", "converged", F.col("convergence_iteration").cast("long").alias("convergence_iteration"), "value")


INCREMENTAL = (
    PREFIX
    + f""",
b AS (SELECT coalesce(x.image_id, y.image_id) AS image_id, coalesce(x.prefix_k + 1, y.prefix_k) AS prefix_k, x.median AS was, y.median AS now
      FROM steps x FULL JOIN steps y ON x.image_id = y.image_id AND x.prefix_k + 1 = y.prefix_k AND x.row_label = y.row_label AND x.col_label = y.col_label),
s AS (SELECT image_id, prefix_k, avg(CASE WHEN abs(was - now) <= greatest(0.1, 0.3 * abs(was)) THEN 1.0 ELSE 0.0 END) >= 0.5 AS calm FROM b GROUP BY image_id, prefix_k HAVING count(was) > 0 AND count(now) > 0),
{TOLD},
o AS (SELECT v.*, coalesce(calm, false) AND v.prefix_k > min(v.prefix_k) OVER (PARTITION BY image_id) AS ok, lag(value) OVER (PARTITION BY image_id ORDER BY prefix_k) AS before FROM v LEFT JOIN s USING (image_id, prefix_k)),
i AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY image_id ORDER BY prefix_k) AS island FROM o),
r AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, island ORDER BY prefix_k) AS run FROM i),
e AS (SELECT image_id, min(prefix_k) FILTER (WHERE run >= 2) AS k, arg_min(before, prefix_k) FILTER (WHERE run >= 2) AS settled, arg_max(value, prefix_k) AS latest FROM r GROUP BY image_id)
SELECT image_id, k IS NOT NULL AS converged, k AS convergence_iteration, CASE WHEN k IS NOT NULL THEN settled ELSE latest END AS value FROM e"""
)


def q_variance_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = convergence.variance(_steps(spark, sf_dir), threshold=20_000.0, every_cell=False, patience=2)
    return out.select("image_id", F.col("prefix_k").cast("long").alias("prefix_k"), F.round("mad", 4).alias("mad"), F.col("run").cast("long").alias("run"), "done")


VARIANCE = (
    PREFIX
    + """,
a AS (SELECT image_id, prefix_k, avg(mad) AS mad, avg(mad) <= 20000 AS ok FROM steps GROUP BY image_id, prefix_k),
i AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY image_id ORDER BY prefix_k) AS island FROM a),
r AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, island ORDER BY prefix_k) AS run FROM i)
SELECT image_id, prefix_k, round(mad, 4) AS mad, CAST(run AS BIGINT) AS run, run >= 2 AS done FROM r"""
)


def q_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as samples: the status repeats."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image_id"), F.col("o_orderkey").alias("sample_idx"), F.col("o_orderstatus").alias("tsv_data"))
    return convergence.exact_match(o, 2).select("image_id", "sample_idx", "done")


EXACT = "SELECT o_custkey AS image_id, o_orderkey AS sample_idx, coalesce(lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = o_orderstatus, false) AS done FROM orders"


def q_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("num_samples"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).cast("long").alias("total_tokens"))


TOKENS = "SELECT conv_id, count(*) AS num_samples, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS total_tokens FROM conversations GROUP BY conv_id"


def q_diversity_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("model"))
    variants = _table(spark, sf_dir, "region").select(F.col("r_name").alias("prompt_variant"))
    return convergence.diversity_plan(models, variants, 2).select("model", "prompt_variant", F.col("sample_idx").cast("long").alias("sample_idx"))


DIVERSITY = "SELECT n_name AS model, r_name AS prompt_variant, CAST(i AS BIGINT) AS sample_idx FROM nation CROSS JOIN region CROSS JOIN range(0, 2) t(i)"


def q_normalize_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    raw = F.element_at(F.array(F.format_string(" $%d,%03dM ", F.floor(F.col("o_totalprice") / 1000), F.floor(F.col("o_totalprice") % 1000)), F.format_string("%d%%", F.col("o_custkey")), F.lit("n/a"), F.format_string("-%dE+02x", F.col("o_orderkey")), F.format_string(".%d", F.col("o_custkey"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select("o_orderkey", raw.alias("raw"), T.cell_number(raw).alias("value"), T.cell_number(raw, "null").alias("value_or_null"))


NORMALIZE = r"""
WITH r AS (SELECT o_orderkey, CASE o_orderkey % 5
    WHEN 0 THEN format(' ${},{:03d}M ', CAST(floor(o_totalprice / 1000) AS BIGINT), CAST(floor(o_totalprice % 1000) AS BIGINT)) WHEN 1 THEN o_custkey || '%' WHEN 2 THEN 'n/a'
    WHEN 3 THEN '-' || o_orderkey || 'E+02x' ELSE '.' || o_custkey END AS raw FROM orders),
t AS (SELECT *, regexp_replace(regexp_replace(lower(trim(raw)), '(\d),(\d)', '\1\2', 'g'), '(\d),(\d)', '\1\2', 'g') AS t FROM r),
v AS (SELECT o_orderkey, raw, CAST(coalesce(nullif(regexp_extract(t, '-?\d+(?:\.\d+)?e[+-]?\d+'), ''), nullif(regexp_extract(t, '-?\d+(?:\.\d+)?'), '')) AS DOUBLE) AS x FROM t)
SELECT o_orderkey, raw, coalesce(x, 0.0) AS value, x AS value_or_null FROM v"""


def q_fenced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in a tagged fence, in one with another tag, or in none."""
    c, head = _table(spark, sf_dir, "conversations"), F.col("text")
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Here:\n```tsv\n"), head, F.lit("\n```\nand ```more```"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("```csv\n"), head, F.lit("\n```"))).otherwise(head)
    return c.select("conv_id", "turn", T.fenced_table(said).alias("tsv_data"))


FENCED = r"""
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN regexp_replace(text, '^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$', '', 'g')
  WHEN 1 THEN regexp_replace('csv' || chr(10) || text, '^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$', '', 'g') END AS tsv_data FROM conversations"""


def q_conforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as row labels against a skeleton of the brand's first part; cells by size."""
    p = _table(spark, sf_dir, "part")
    text = F.concat(F.lit(" \tA  \n\n"), F.col("p_brand"), F.lit(" \t"), F.col("p_size"), F.when(F.col("p_size") % 2 == 0, F.lit("\t9")).otherwise(F.lit("")))
    structure = F.concat(F.lit("\tA\n"), F.lit("Brand#11\t_\n"))
    return p.select("p_partkey", tables.conforms(F.concat(F.lit("x"), text), F.concat(F.lit("x "), structure)).alias("conforms"))


CONFORMS = "SELECT p_partkey, p_brand = 'Brand#11' AND p_size % 2 = 1 AS conforms FROM part"


def q_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    path = F.concat(F.lit("/home/x/data/png/"), F.col("c_name"), F.lit(".PNG"))
    temperature = F.when(F.col("c_custkey") % 2 == 0, F.lit(0.0))
    return c.select("c_custkey", T.sample_key(path, F.lit("gpt-x"), temperature, F.lit("read")).alias("key"), T.structure_key(path, F.lit("gpt-x")).alias("structure_key"), T.image_type(path).alias("kind"), T.provider(F.lit("gpt-x")).alias("provider"))


CACHE_KEY = """
SELECT c_custkey, sha256('data/png/' || c_name || '.PNG|gpt-x|' || CASE WHEN c_custkey % 2 = 0 THEN '0.0' ELSE 'None' END || '|read') AS key,
       sha256('/home/x/data/png/' || c_name || '.PNG|gpt-x') AS structure_key, 'png' AS kind, 'openai' AS provider FROM customer"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_name").distinct()


def q_anls_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different part names (a fixed vocabulary, 64 of them) against each other."""
    n = _names(spark, sf_dir)
    both = n.select(F.col("p_name").alias("target")).crossJoin(F.broadcast(n.select(F.col("p_name").alias("prediction"))))
    return both.withColumn("anls", F.round(T.anls(F.col("target"), F.col("prediction")), 9))


ANLS = """
WITH n AS (SELECT DISTINCT p_name FROM part), d AS (SELECT a.p_name AS target, b.p_name AS prediction, levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) AS d FROM n a CROSS JOIN n b)
SELECT target, prediction, round(CASE WHEN target = prediction THEN 1.0 WHEN d < 0.5 THEN 1 - d ELSE 0.0 END, 9) AS anls FROM d"""


def q_value_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line by line: a truth of 0, percentages, what is no number, a date for a number, two dates, and numbers."""
    li = _table(spark, sf_dir, "lineitem")
    t = F.when(F.col("l_linenumber") == 5, F.date_add(F.col("l_shipdate").cast("date"), (F.col("l_orderkey") % 40).cast("int")).cast("string")).when(F.col("l_linenumber") == 1, F.lit("0")).when(F.col("l_linenumber") == 2, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("%"))).when(F.col("l_linenumber") == 3, F.lit("nan")).otherwise(F.col("l_quantity").cast("int").cast("string"))
    p = F.when(F.col("l_linenumber") == 3, F.lit("nan")).when(F.col("l_linenumber").isin(4, 5), F.col("l_shipdate").cast("date").cast("string")).otherwise((F.col("l_quantity") + F.col("l_partkey") % 3).cast("int").cast("string"))
    return li.select("l_orderkey", "l_linenumber", F.round(T.value_penalty(t, p), 9).alias("penalty"))


PENALTY = """
WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN floor(l_quantity) / 100 ELSE floor(l_quantity) END AS t, floor(l_quantity + l_partkey % 3) AS p,
              CASE WHEN l_linenumber = 5 THEN strftime(CAST(l_shipdate AS DATE) + CAST(l_orderkey % 40 AS INT), '%Y-%m-%d') ELSE CAST(CAST(floor(l_quantity) AS INT) AS VARCHAR) END AS a, strftime(l_shipdate, '%Y-%m-%d') AS b FROM lineitem),
y AS (SELECT *, least(abs((t - p) / t), 1.0) AS d, levenshtein(a, b) / greatest(length(a), length(b)) AS e FROM x)
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber IN (4, 5) THEN CASE WHEN e < 0.5 THEN e ELSE 1.0 END WHEN l_linenumber = 1 THEN 0.0 WHEN l_linenumber = 3 THEN 1.0 WHEN d < 0.1 THEN d ELSE 1.0 END, 9) AS penalty FROM y"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's first sample as the truth, and each further one as a prediction: pair_id is supplier and sample."""
    t = candidate_tables(spark, sf_dir)
    first = t.groupBy("image_id").agg(F.min("sample_idx").alias("first"), F.min_by("tsv_data", "sample_idx").alias("gt_answer"))
    both = t.join(first, "image_id").filter("sample_idx > first")
    return both.select(F.concat_ws("-", "image_id", "sample_idx").alias("pair_id"), "gt_answer", F.col("tsv_data").alias("model_answer"))


def q_rms_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.per_pair(_pairs(spark, sf_dir))


def q_eval_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.evaluate(_pairs(spark, sf_dir))


def q_eval_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample against a list of references: another table, a null where the supplier is even, and its own text."""
    t = candidate_tables(spark, sf_dir).withColumnRenamed("tsv_data", "model_answer")
    even = F.array(F.lit("a\tb\nc\t1"), F.lit(None).cast("string"), F.col("model_answer"))
    pairs = t.select(F.concat_ws("-", "image_id", "sample_idx").alias("pair_id"), "model_answer", F.when(F.col("image_id") % 2 == 0, even).otherwise(F.array(F.lit("q\tb\nc\t1"), F.col("model_answer"))).alias("gt_answer"))
    return evaluation.per_pair(pairs).select("pair_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", *evaluation.BUCKETS)])


def q_clean_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skeletons of parts with underscores in the header and in all columns, and blank lines; some have blank lines only."""
    text = F.concat(F.lit("\n_year_\ta_b\n \t\n"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("\t_\n\n"), F.col("p_brand"), F.lit("_x\t_y_"))
    return _table(spark, sf_dir, "part").select("p_partkey", T.clean_skeleton(F.when(F.col("p_size") > 1, text).otherwise(F.lit(" \n"))).alias("structure"))


CLEAN_SKELETON = """
SELECT p_partkey, CASE WHEN p_size > 1 THEN ' year ' || chr(9) || 'a b' || chr(10) || replace(p_name, ' ', '') || chr(9) || '_' || chr(10) || p_brand || 'x' || chr(9) || '_y_' ELSE '' END AS structure FROM part"""


def _wide(spark: SparkSession, sf_dir: str, keep_number: bool = False) -> DataFrame:
    """Yearly totals of orders by priority and nation, with some made null by their number."""
    o, c, n = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    long = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    out = long.groupBy(F.col("o_orderpriority").alias("series_name"), F.col("n_name").alias("country_name"), F.year("o_orderdate").alias("year")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"), F.min("n_nationkey").alias("k"))
    out = out.withColumn("value", F.when((F.col("k") * 7 + F.col("year")) % 23 != 0, F.col("value")))
    return out if keep_number else out.drop("k")


def q_prune_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by their number modulo 5: the first two years null (too many gaps), the first one null (stays), values of a million times (too large), and others as they are, some with a gap inside."""
    at, year = F.col("k") % 5, F.col("year")
    early = ((at == 0) & (year <= 1996)) | ((at == 1) & (year <= 1995))
    value = F.when(~early, F.when(at == 2, F.col("value") * 1e6).otherwise(F.col("value")))
    return series.pruned(_wide(spark, sf_dir, True).withColumn("value", value).drop("k"), prune_at=2, large=1e10)


WIDE = """
WITH w AS (SELECT o_orderpriority AS series_name, n_name AS country_name, CAST(year(o_orderdate) AS INT) AS year,
                  CASE WHEN (min(n_nationkey) * 7 + year(o_orderdate)) % 23 <> 0 THEN CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) END AS value
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY o_orderpriority, n_name, year(o_orderdate))"""
def q_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts of three nations of a priority each, with a year and a nation that it has no values of."""
    w = _wide(spark, sf_dir)
    specs = w.select("series_name").distinct().select(F.col("series_name").alias("chart_id"), "series_name", F.array(F.lit("NATION_3"), F.lit("ATLANTIS"), F.lit("NATION_7")).alias("countries"), F.array(*[F.lit(y) for y in range(1994, 2003)]).alias("years"))
    return series.prepared(specs, w).withColumn("series_pos", F.col("series_pos").cast("long"))


PREPARED = (
    WIDE
    + """
SELECT s.series_name AS chart_id, c.pos AS series_pos, c.name AS country_name, CAST(y AS INT) AS year, w.value
FROM (SELECT DISTINCT series_name FROM w) s CROSS JOIN (VALUES (0::BIGINT, 'NATION_3'), (1, 'ATLANTIS'), (2, 'NATION_7')) c(pos, name) CROSS JOIN range(1994, 2003) t(y)
LEFT JOIN w ON w.series_name = s.series_name AND w.country_name = c.name AND w.year = y"""
)


PRUNE = (
    WIDE.replace("WITH w AS (SELECT", "WITH w0 AS (SELECT min(n_nationkey) AS k,")
    + """,
w AS (SELECT series_name, country_name, year, CASE WHEN (k % 5 = 0 AND year <= 1996) OR (k % 5 = 1 AND year <= 1995) THEN NULL WHEN k % 5 = 2 THEN value * 1e6 ELSE value END AS value FROM w0),
s AS (SELECT series_name, country_name, min(year) FILTER (WHERE value IS NOT NULL) AS a, max(year) FILTER (WHERE value IS NOT NULL) AS b, count(*) FILTER (WHERE value IS NULL) AS gaps, coalesce(max(abs(value)) >= 1e10, false) AS huge FROM w GROUP BY ALL),
ok AS (SELECT * FROM s WHERE gaps < 2 AND NOT huge AND NOT EXISTS (SELECT 1 FROM w WHERE w.series_name = s.series_name AND w.country_name = s.country_name AND w.value IS NULL AND w.year BETWEEN s.a AND s.b))
SELECT w.* FROM w SEMI JOIN ok USING (series_name, country_name)"""
)


def q_sample_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.sampled(_wide(spark, sf_dir), n=1000)
    return out.select("series_name", F.col("set_no").cast("long").alias("set_no"), F.array_join("countries", "|").alias("countries"))


SAMPLE = (
    WIDE
    + """,
p AS (
  SELECT *, row_number() OVER (PARTITION BY series_name ORDER BY md5('42|draw|' || series_name || '|' || country_name)) - 1 AS pos, count(*) OVER (PARTITION BY series_name) AS m,
         md5('42|walk|' || series_name || '|' || country_name) AS walk FROM (SELECT DISTINCT series_name, country_name FROM w)),
z AS (SELECT series_name, m, part, 2 + CAST('0x' || left(md5('42|size|' || series_name || '|' || part), 1) AS BIGINT) % 2 AS size FROM (SELECT DISTINCT series_name, m FROM p), range(0, (m + 1) // 2) t(part)),
c AS (SELECT *, sum(size) OVER (PARTITION BY series_name ORDER BY part) - size AS start FROM z),
a AS (SELECT p.*, part FROM p JOIN c ON p.series_name = c.series_name AND pos >= start AND pos < start + size),
l AS (SELECT series_name, list(part ORDER BY walk) AS parts, list(walk ORDER BY walk) AS walks FROM a GROUP BY series_name),
f AS (SELECT series_name, walks[i] AS walk, parts[i] AS part, list_reduce(list_prepend(0, parts[1:i - 1]), lambda j, x: CASE WHEN x >= j THEN j + 1 ELSE j END) AS made
      FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM l)),
s AS (SELECT series_name, made AS part, row_number() OVER (ORDER BY walk) AS set_no FROM f WHERE part >= made QUALIFY set_no <= 1000)
SELECT series_name, set_no, string_agg(country_name, '|' ORDER BY country_name) AS countries FROM s JOIN a USING (series_name, part) GROUP BY series_name, set_no"""
)


def q_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of each type of event, 15 at most, evenly spaced."""
    e = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.sort_array(F.collect_set(F.dayofyear("ts"))).alias("days"))
    return e.select("event_type", F.posexplode(series.subsampled(F.col("days"))).alias("i", "day")).select("event_type", F.col("i").cast("long").alias("i"), F.col("day").cast("long").alias("day"))


SUBSAMPLE = """
WITH d AS (SELECT event_type, list_sort(list(DISTINCT dayofyear(ts))) AS days FROM events GROUP BY event_type),
x AS (SELECT event_type, days, unnest(range(0, least(len(days), 15))) AS i FROM d)
SELECT event_type, CAST(i AS BIGINT) AS i, CAST(CASE WHEN len(days) <= 15 THEN days[i + 1] ELSE days[(i * (len(days) - 1)) // 14 + 1] END AS BIGINT) AS day FROM x"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _wide(spark, sf_dir)
    by = Window.partitionBy("series_name").orderBy("country_name")
    names = w.select("series_name", "country_name").distinct().withColumn("series_pos", F.row_number().over(by) - 1)
    return w.join(names, ["series_name", "country_name"]).select(F.col("series_name").alias("chart_id"), "series_pos", "country_name", "year", "value")


def q_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry of grouped and of stacked bars."""
    p = _points(spark, sf_dir)
    both = series.grouped_bars(p).join(series.stacked(p).select("chart_id", "country_name", "year", "bottom", "top", F.col("x").alias("stack_x"), F.col("width").alias("stack_width")), ["chart_id", "country_name", "year"])
    return both.select(T.axis_label(F.col("chart_id")).alias("label"), "country_name", "year", *[F.round(c, 4).alias(c) for c in ("x", "width", "height", "bottom", "top", "stack_x", "stack_width")])


BARS = (
    WIDE
    + """,
n AS (SELECT *, row_number() OVER (PARTITION BY series_name ORDER BY country_name) - 1 AS pos, count(*) OVER (PARTITION BY series_name) AS n FROM (SELECT DISTINCT series_name, country_name FROM w)),
y AS (SELECT series_name, list_sort(list(DISTINCT year)) AS years FROM w GROUP BY series_name),
p AS (SELECT w.*, pos, CASE WHEN len(years) > 1 THEN years[2] - years[1] ELSE 1 END AS spacing, n FROM w JOIN n USING (series_name, country_name) JOIN y USING (series_name))
SELECT upper(left(replace(series_name, '_', ' '), 1)) || lower(substr(replace(series_name, '_', ' '), 2)) AS label, country_name, year,
       round(year - 0.4 * spacing + 0.8 * spacing / n * (pos + 0.5), 4) AS x, round(0.8 * spacing / n, 4) AS width, round(coalesce(value, 0.0), 4) AS height,
       round(coalesce(sum(coalesce(value, 0.0)) OVER (PARTITION BY series_name, year ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 4) AS bottom,
       round(sum(coalesce(value, 0.0)) OVER (PARTITION BY series_name, year ORDER BY pos), 4) AS top,
       CAST(year AS DOUBLE) AS stack_x, round(CAST(0.65 * spacing AS DOUBLE), 4) AS stack_width FROM p"""
)


def q_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each candidate table with rows and columns swapped."""
    t = candidate_tables(spark, sf_dir).select("image_id", "sample_idx", tables.transposed(tables.plain_table(F.col("tsv_data"))).alias("t"))
    rows = t.select("image_id", "sample_idx", F.col("t.headers").alias("h"), F.explode("t.rows").alias("r"))
    out = rows.select("image_id", "sample_idx", F.get("r", 0).alias("row_label"), F.posexplode(F.arrays_zip("h", "r")).alias("i", "x"))
    return out.filter("i > 0").select("image_id", "sample_idx", "row_label", F.col("x.h").alias("col_label"), F.col("x.r").alias("value"))


GRID = f"""
{FILLED}
r AS (SELECT DISTINCT image_id, sample_idx, row_label FROM cand),
f AS (SELECT r.*, lower(col_label) AS col_label, col_pos, coalesce(CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), 'nan') AS value FROM r CROSS JOIN (VALUES ('A', 1), ('N', 2), ('R', 3)) c(col_label, col_pos)
      LEFT JOIN cand USING (image_id, sample_idx, row_label, col_label))"""
TRANSPOSE = GRID + " SELECT image_id, sample_idx, col_label AS row_label, row_label AS col_label, value FROM f"


REFERENCES = (
    GRID
    + """,
x AS (SELECT image_id || '-' || sample_idx AS image_id, count(*) + 1 AS n, count(*) FILTER (WHERE value = 'nan') AS bad FROM f WHERE col_pos < 3 GROUP BY f.image_id, sample_idx)  -- the corner is empty, so headers move by one
SELECT image_id AS pair_id, round((n - bad) / n, 6) AS "precision", round((n - bad) / n, 6) AS recall, round((n - bad) / n, 6) AS f1, round(100 * (n - bad) / n, 6) AS correct,
       round(100 * bad / n, 6) AS value_errors, 0.0::DOUBLE AS label_errors, 0.0::DOUBLE AS missing_datapoints, 0.0::DOUBLE AS extra_datapoints FROM x"""
)


def q_datapoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datapoints of candidate tables whose row labels are decades, so that keys repeat: the first place, the last value."""
    long = candidates(spark, sf_dir).groupBy("image_id", "sample_idx", "row_pos", F.substring("row_label", 1, 3).alias("row_label"))
    full = long.agg(F.map_from_entries(F.collect_list(F.struct("col_label", F.col("value").cast("decimal(18,2)").cast("string")))).alias("m"))
    cells = full.select("image_id", "sample_idx", "row_pos", "row_label", "m", F.posexplode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("col_pos", "col_label"))
    text = tables.to_tsv(cells.withColumn("v", F.coalesce(F.try_element_at("m", F.col("col_label")), F.lit("nan"))), ["image_id", "sample_idx"], "v")
    return evaluation.datapoints(text.withColumn("table", tables.plain_table(F.col("tsv_data"))), ["image_id", "sample_idx"])


DATAPOINTS = (
    GRID
    + """,
d AS (SELECT image_id, sample_idx, left(row_label, 3) || ' ' || col_label AS key, 3 * (dense_rank() OVER (PARTITION BY image_id, sample_idx ORDER BY row_label) - 1) + col_pos AS pos, value FROM f
      UNION ALL SELECT DISTINCT image_id, sample_idx, 'title', 0, '' FROM cand)
SELECT image_id, sample_idx, key, CAST(min(pos) AS INT) AS pos, arg_max(value, pos) AS value FROM d GROUP BY image_id, sample_idx, key"""
)


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample as the prediction, and the largest value of each of its supplier's cells as the truth, which has all its keys."""
    long = candidates(spark, sf_dir).repartition("image_id").groupBy("image_id", "row_pos", "row_label", "col_label").agg(F.max("value").alias("value"))
    full = long.groupBy("image_id", "row_pos", "row_label").agg(F.map_from_entries(F.collect_list(F.struct("col_label", F.col("value").cast("decimal(18,2)").cast("string")))).alias("m"))
    cells = full.select("image_id", "row_pos", "row_label", "m", F.posexplode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("col_pos", "col_label"))
    truth = tables.to_tsv(cells.withColumn("v", F.coalesce(F.try_element_at("m", F.col("col_label")), F.lit("nan"))), ["image_id"], "v", "year", "gt_answer")
    told = candidate_tables(spark, sf_dir).withColumn("model_answer", F.concat(F.lit("year"), "tsv_data"))
    return told.join(truth, "image_id").withColumn("pair_id", F.concat_ws("-", "image_id", "sample_idx"))


def q_rms_f1_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.per_pair(_nested(spark, sf_dir))
    return out.select("pair_id", "transposed", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", *evaluation.BUCKETS)])


NESTED = (
    GRID
    + """,
g AS (SELECT image_id, row_label, col_label, max(TRY_CAST(nullif(value, 'nan') AS DOUBLE)) AS t FROM f GROUP BY image_id, row_label, col_label),
ng AS (SELECT image_id, count(*) + 1 AS ng FROM g GROUP BY image_id),
x AS (SELECT image_id, sample_idx, CASE WHEN abs(t - p) / t < 0.1 THEN abs(t - p) / t ELSE 1.0 END AS pen
      FROM (SELECT *, TRY_CAST(nullif(value, 'nan') AS DOUBLE) AS p FROM f) JOIN g USING (image_id, row_label, col_label)),
s AS (SELECT image_id, sample_idx, 1 + sum(1 - pen) AS score, sum(pen) AS pen, count(*) + 1 AS np FROM x GROUP BY image_id, sample_idx),
e AS (SELECT *, score <= 1 AS turned, ng + np AS total FROM s JOIN ng USING (image_id)),
n AS (SELECT image_id || '-' || sample_idx AS pair_id, turned AS transposed, round(score / np, 6) AS "precision", round(score / ng, 6) AS recall, round(2 * score / total, 6) AS f1, round(200 * score / total, 6) AS correct,
             round(CASE WHEN turned THEN 0.0 ELSE 200 * pen / total END, 6) AS value_errors, CAST(0 AS DOUBLE) AS label_errors,
             round(100.0 * CASE WHEN turned THEN ng - 1 ELSE ng - np END / total, 6) AS missing_datapoints, round(100.0 * CASE WHEN turned THEN np - 1 ELSE 0 END / total, 6) AS extra_datapoints FROM e)"""
)


def q_eval_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.evaluate(_nested(spark, sf_dir))
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


EVAL_NESTED = NESTED + ' SELECT round(100 * avg("precision"), 4) AS "precision", round(100 * avg(recall), 4) AS recall, round(100 * avg(f1), 4) AS f1, ' + ", ".join(f"round(avg({b}), 4) AS {b}" for b in evaluation.BUCKETS) + " FROM n"


def q_matched_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a table of parts for each size, without a matrix: some names with a wrong letter, some values off, some parts missing or other ones."""
    p = _table(spark, sf_dir, "part").withColumn("key", F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    k = F.col("p_partkey")
    truth = p.select(F.col("p_size").alias("pair_id"), k.alias("pos"), "key", F.col("p_retailprice").cast("string").alias("value"))
    typo = F.when(k % 7 == 0, F.concat(F.substring("key", 1, 3), F.lit("x"), F.substring("key", 5, 1000))).when(k % 11 == 0, F.reverse("key")).otherwise(F.col("key"))
    value = F.when(k % 5 == 0, F.col("p_retailprice") * 1.05).when(k % 13 == 0, F.col("p_retailprice") * 2).otherwise(F.col("p_retailprice"))
    told = p.filter(k % 17 != 0).select(F.col("p_size").alias("pair_id"), k.alias("pos"), typo.alias("key"), value.cast("string").alias("value"))
    told = told.groupBy("pair_id", "key").agg(F.min("pos").alias("pos"), F.max_by("value", "pos").alias("value"))
    truth = truth.groupBy("pair_id", "key").agg(F.min("pos").alias("pos"), F.max_by("value", "pos").alias("value"))
    out = evaluation.scores(truth, told, ["pair_id"], dense_cells=0)
    return out.select("pair_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", *evaluation.BUCKETS)])


def q_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convergence.fixed(_told(spark, sf_dir)[1], 5)


FIXED = f"{PREFIX}, {TOLD} SELECT image_id, value, false AS converged FROM v WHERE prefix_k = 5"


def q_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first prefix of four samples or more whose mean MAD is small; its value is its consensus as text."""
    cells, told = _told(spark, sf_dir)
    done = convergence.variance(cells, threshold=20_000.0, every_cell=False).select("image_id", "prefix_k", "done")
    out = convergence.adaptive(told.join(done, ["image_id", "prefix_k"]), "done", 4)
    return out.withColumn("convergence_iteration", F.col("convergence_iteration").cast("long"))


ADAPTIVE = (
    PREFIX
    + f""",
{TOLD},
j AS (SELECT image_id, prefix_k, avg(mad) <= 20000 AND prefix_k >= 4 AS ok FROM steps GROUP BY image_id, prefix_k),
o AS (SELECT image_id, min(prefix_k) FILTER (WHERE ok) AS k, arg_min(value, prefix_k) FILTER (WHERE ok) AS hit, arg_max(value, prefix_k) AS latest FROM v JOIN j USING (image_id, prefix_k) GROUP BY image_id)
SELECT image_id, k IS NOT NULL AS converged, k AS convergence_iteration, CASE WHEN k IS NULL THEN latest ELSE hit END AS value FROM o"""
)


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_tables(spark, sf_dir).withColumns({"input_tokens": F.lit(100).cast("long"), "output_tokens": F.char_length("tsv_data").cast("long")})


def q_incremental_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strategies.incremental(_samples(spark, sf_dir), strategies.Sampling(exact_match=False, tolerance=0.15, coverage=0.7))
    return out.withColumn("convergence_iteration", F.col("convergence_iteration").cast("long"))


PREFIXES = f"""{SAMPLES},
n AS (SELECT *, max(sample_idx) OVER (PARTITION BY image_id) AS top FROM smp),
pre AS (SELECT image_id, k, sample_idx, tsv FROM n CROSS JOIN range(1, 11) t(k) WHERE sample_idx < k AND k <= least(top + 1, 10) AND k >= least(top + 1, 3)),
sums AS (SELECT image_id, k, count(*) AS num_samples, CAST(100 * count(*) AS BIGINT) AS total_input_tokens, CAST(sum(length(tsv)) AS BIGINT) AS total_output_tokens, arg_min(tsv, sample_idx) AS one FROM pre GROUP BY image_id, k)"""
#: A table's cells are read back from its text, as prefixes that fall back show an earlier text. With an empty corner the last column is not compared.
SETTLED = """
line AS (SELECT image_id, k, row_pos, row_label || chr(9) || string_agg(CAST(med AS VARCHAR), chr(9) ORDER BY col_label) AS line FROM con GROUP BY image_id, k, row_pos, row_label),
told AS (SELECT image_id, k, '{corner}' || chr(9) || 'A' || chr(9) || 'N' || chr(9) || 'R' || chr(10) || string_agg(line, chr(10) ORDER BY row_pos) AS told FROM line GROUP BY image_id, k),
own AS (SELECT sums.*, CASE WHEN num_samples > 1 THEN coalesce(told, one) ELSE one END AS text, num_samples > 1 AND told IS NULL AS fell FROM sums LEFT JOIN told USING (image_id, k)),
v AS (
  SELECT *, CASE WHEN fell THEN coalesce(last_value(CASE WHEN NOT fell THEN text END IGNORE NULLS) OVER (PARTITION BY image_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), text) ELSE text END AS value FROM own),
parts AS (SELECT image_id, k, string_split(unnest(string_split(value, chr(10))[2:]), chr(9)) AS p FROM v),
cell AS (SELECT image_id, k, p[1] AS row_label, j, TRY_CAST(nullif(p[j], 'nan') AS DOUBLE) AS x FROM parts CROSS JOIN range(2, {last}) t(j)),
calm AS (
  SELECT coalesce(b.image_id, a.image_id) AS image_id, coalesce(b.k, a.k + 1) AS k, bool_and(a.j IS NOT NULL AND b.j IS NOT NULL) AS same,
         avg(CASE WHEN abs(a.x - b.x) <= greatest(0.1, {tolerance} * abs(a.x)) THEN 1 ELSE 0 END) AS share
  FROM cell a FULL JOIN cell b ON a.image_id = b.image_id AND a.k + 1 = b.k AND a.row_label = b.row_label AND a.j = b.j GROUP BY 1, 2),
g AS (
  SELECT v.*, coalesce(same AND share >= {coverage}, false) AND NOT fell AND k > min(k) OVER (PARTITION BY image_id) AS ok, lag(value) OVER (PARTITION BY image_id ORDER BY k) AS before
  FROM v LEFT JOIN calm USING (image_id, k)),
o AS (SELECT image_id, min(k) FILTER (WHERE ok) AS hit, max(k) AS latest FROM g GROUP BY image_id),
done AS (
  SELECT image_id, CASE WHEN hit IS NULL THEN value ELSE before END AS tsv_data, hit IS NOT NULL AS converged, hit AS convergence_iteration, num_samples, total_input_tokens, total_output_tokens
  FROM o JOIN g USING (image_id) WHERE k = coalesce(hit, latest))"""
INCREMENTAL_SAMPLING = f"""{PREFIXES},
p AS (SELECT image_id, k, sample_idx, row_label, row_number() OVER (PARTITION BY image_id, k, sample_idx ORDER BY row_label) AS pos FROM pre JOIN r USING (image_id, sample_idx)),
y AS (SELECT image_id, k, row_label, count(*) AS seen, min(sample_idx) AS early, median(pos) AS pos FROM p GROUP BY image_id, k, row_label),
stay AS (SELECT image_id, k, row_label, row_number() OVER (PARTITION BY image_id, k ORDER BY pos, seen DESC, early, row_label) AS row_pos FROM y JOIN sums USING (image_id, k) WHERE seen >= 0.5 * num_samples),
con AS (
  SELECT image_id, k, row_pos, row_label, col_label, round(median(coalesce(value, 0.0)), 6) AS med
  FROM pre JOIN f USING (image_id, sample_idx) JOIN stay USING (image_id, k, row_label) GROUP BY image_id, k, row_pos, row_label, col_label),
{SETTLED.format(corner="X", last=5, tolerance=0.15, coverage=0.7)}
SELECT * FROM done"""


def q_structured_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the shape of each supplier's first sample; suppliers whose next two samples differ in shape have an error.

    Suppliers divisible by 3 repeat their first sample, so that they settle; those by 10 have a row too many in their second, so that they have an error.
    """
    first = F.first("tsv_data").over(Window.partitionBy("image_id").orderBy("sample_idx"))
    t = _samples(spark, sf_dir).withColumn("tsv_data", F.when(F.col("image_id") % 3 == 0, first).otherwise(F.col("tsv_data")))
    longer = (F.col("image_id") % 10 == 0) & (F.col("sample_idx") == 1)
    t = t.withColumn("tsv_data", F.when(longer, F.concat("tsv_data", F.lit("\nmore\t1\t2\t3"))).otherwise(F.col("tsv_data")))
    shape = t.filter("sample_idx = 0").select("image_id", F.regexp_replace("tsv_data", r"\t(?:[0-9.]+|nan)", "\t_").alias("structure"))
    out = strategies.structured(t, shape, strategies.Sampling(exact_match=False))
    return out.withColumn("convergence_iteration", F.col("convergence_iteration").cast("long"))


STRUCTURED_SAMPLING = f"""{PREFIXES},
shape AS (SELECT image_id, row_label, row_number() OVER (PARTITION BY image_id ORDER BY row_label) AS row_pos FROM r WHERE sample_idx = 0),
con AS (
  SELECT image_id, k, row_pos, row_label, col_label, round(median(coalesce(value, 0.0)), 6) AS med
  FROM (SELECT image_id, k, CASE WHEN image_id % 3 = 0 THEN 0 ELSE sample_idx END AS sample_idx FROM pre) JOIN f USING (image_id, sample_idx) JOIN shape USING (image_id, row_label)
  GROUP BY image_id, k, row_pos, row_label, col_label),
{SETTLED.format(corner="", last=4, tolerance=0.01, coverage=0.95)},
years AS (SELECT image_id, sample_idx, string_agg(row_label, ',' ORDER BY row_label) AS years FROM r GROUP BY image_id, sample_idx),
odd AS (
  SELECT a.image_id, min(a.sample_idx) FILTER (WHERE a.image_id % 3 <> 0 AND a.years <> b.years OR a.image_id % 10 = 0 AND a.sample_idx = 1) AS odd
  FROM years a JOIN years b ON a.image_id = b.image_id AND b.sample_idx = 0 WHERE a.sample_idx < 3 GROUP BY a.image_id)
SELECT image_id, CASE WHEN odd IS NULL THEN tsv_data END AS tsv_data, odd IS NULL AND converged AS converged, CASE WHEN odd IS NULL THEN convergence_iteration END AS convergence_iteration,
       num_samples, total_input_tokens, total_output_tokens, 'sample ' || odd || ' does not conform to the skeleton' AS error FROM done JOIN odd USING (image_id)"""


def q_diversity_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples of a supplier as of two models and two prompts; samples with line number 4 are blank, and one of the others has a row that is too wide."""
    t = _samples(spark, sf_dir).withColumns({"model": F.when(F.col("sample_idx") % 2 == 0, "a").otherwise("b"), "prompt_variant": F.when(F.col("sample_idx") < 3, "x").otherwise("y")})
    wide = F.when(F.col("sample_idx") == 3, F.lit(" ")).when(F.col("sample_idx") == 1, F.regexp_replace("tsv_data", r"\z", "\t7")).otherwise(F.col("tsv_data"))
    out = strategies.diversity(t.withColumn("tsv_data", wide))
    return out.select("image_id", "converged", "num_samples", "total_input_tokens", "total_output_tokens", (F.col("tsv_data") != "").alias("has_table"))


DIVERSITY_SAMPLING = f"""{SAMPLES}
SELECT image_id, false AS converged, count(*) AS num_samples, CAST(100 * count(*) AS BIGINT) AS total_input_tokens, CAST(sum(length(tsv)) AS BIGINT) AS total_output_tokens, bool_or(sample_idx <> 3) AS has_table FROM smp GROUP BY image_id"""


def q_first_conforming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as attempts, of which those with status O conform."""
    o = _table(spark, sf_dir, "orders").withColumn("attempt", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    tries = o.select("o_custkey", "attempt", F.concat_ws("/", "o_orderkey", "o_orderpriority").alias("tsv_data"), (F.col("o_orderstatus") == "O").alias("ok"))
    return convergence.first_conforming(tries, "ok", ["o_custkey"], 3)


CONFORMING = """
WITH a AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS attempt, o_orderkey || '/' || o_orderpriority AS tsv_data, o_orderstatus = 'O' AS ok FROM orders QUALIFY attempt < 3)
SELECT o_custkey, coalesce(arg_min(tsv_data, attempt) FILTER (WHERE ok), arg_max(tsv_data, attempt)) AS tsv_data, bool_or(ok) AS cached FROM a GROUP BY o_custkey"""


def q_unpivot_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yearly totals laid out wide, as the CSV files are, and read back."""
    wide = _wide(spark, sf_dir).groupBy("series_name", "country_name").pivot("year", list(range(1995, 2002))).agg(F.first("value"))
    text = wide.select("series_name", F.lit("-").alias("code"), "country_name", F.lit("-").alias("country_code"), *[F.coalesce(F.col(str(y)).cast("string"), F.lit("..")).alias(f"{y} [YR{y}]") for y in range(1995, 2002)])
    return caches.unpivoted(text)


UNPIVOT = (
    WIDE
    + """,
g AS (SELECT DISTINCT series_name, country_name, y AS year FROM w CROSS JOIN range(1995, 2002) t(y))
SELECT g.series_name, g.country_name, CAST(g.year AS INT) AS year, w.value FROM g LEFT JOIN w ON g.series_name = w.series_name AND g.country_name = w.country_name AND g.year = w.year"""
)


def q_csv_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yearly totals written as a wide CSV file, with quotes, commas and line breaks in the names, and read back."""
    wide = _wide(spark, sf_dir).groupBy("series_name", "country_name").pivot("year", list(range(1995, 2002))).agg(F.first("value"))
    name = F.concat(F.lit('"Sum", of\nall "'), F.col("series_name"))
    text = wide.select(name.alias("Series Name"), F.lit("S,1").alias("Series Code"), F.concat("country_name", F.lit(' "x"')).alias("Country Name"), F.lit("").alias("Country Code"), *[F.coalesce(F.col(str(y)).cast("string"), F.lit("..")).alias(f"{y} [YR{y}]") for y in range(1995, 2002)])
    path = caches.scratch(spark, "series")
    text.write.csv(path, header=True, quote='"', escape='"')
    return caches.read_series(spark, path)


CSV_SERIES = (
    WIDE
    + """,
g AS (SELECT DISTINCT series_name, country_name, y AS year FROM w CROSS JOIN range(1995, 2002) t(y))
SELECT '"Sum", of' || chr(10) || 'all "' || g.series_name AS series_name, g.country_name || ' "x"' AS country_name, CAST(g.year AS INT) AS year, w.value
FROM g LEFT JOIN w ON g.series_name = w.series_name AND g.country_name = w.country_name AND g.year = w.year"""
)


def q_area_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of stacked areas, of plain areas and of lines, where gaps are null."""
    p = _points(spark, sf_dir)
    keys = ["chart_id", "series_pos", "country_name", "year"]
    kinds = {"stacked": series.area_points(p, True), "plain": series.area_points(p, False, "bokeh"), "line": series.line_points(p, "plotly")}
    out = None
    for name, df in kinds.items():
        one = df.select(*keys, F.round("value", 4).alias(name))
        out = one if out is None else out.join(one, keys)
    return out.withColumn("series_pos", F.col("series_pos").cast("long"))


AREA = (
    WIDE
    + """,
n AS (SELECT *, row_number() OVER (PARTITION BY series_name ORDER BY country_name) - 1 AS pos FROM (SELECT DISTINCT series_name, country_name FROM w))
SELECT series_name AS chart_id, pos AS series_pos, country_name, year, round(sum(coalesce(value, 0.0)) OVER (PARTITION BY series_name, year ORDER BY pos), 4) AS stacked,
       round(coalesce(value, 0.0), 4) AS plain, round(value, 4) AS line FROM w JOIN n USING (series_name, country_name)"""
)


def q_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chart type in every library, areas also stacked: what is drawn, added up for each chart."""
    p, told = _points(spark, sf_dir), None
    for kind in series.CHART_TYPES:
        for library in series.LIBRARIES:
            for stack in (False, True) if kind == "area" else (False,):
                g = series.geometry(p, kind, library, stack)
                shown = F.col("height" if kind == "grouped_bar" else "top" if kind == "stacked_bar" else "value")
                one = g.groupBy("chart_id").agg(F.round(F.sum(F.when(~F.isnan(shown), shown)), 2).alias("drawn"), F.count_if(F.isnan(shown)).alias("gaps"), F.count(shown).alias("n"))
                one = one.select("chart_id", F.lit(kind).alias("kind"), F.lit(library).alias("library"), F.lit(stack).alias("stacked"), "drawn", "gaps", "n")
                told = one if told is None else told.unionByName(one)
    return told


GEOMETRY = (
    WIDE
    + """,
n AS (SELECT *, row_number() OVER (PARTITION BY series_name ORDER BY country_name) AS pos FROM (SELECT DISTINCT series_name, country_name FROM w)),
p AS (SELECT series_name AS chart_id, value, sum(coalesce(value, 0.0)) OVER (PARTITION BY series_name, year ORDER BY pos) AS top FROM w JOIN n USING (series_name, country_name)),
k AS (SELECT kind, library, stacked FROM (VALUES ('line', false), ('area', false), ('area', true), ('grouped_bar', false), ('stacked_bar', false)) k(kind, stacked), (VALUES ('matplotlib'), ('seaborn'), ('plotly'), ('bokeh')) l(library)),
d AS (
  SELECT chart_id, kind, library, stacked, value,
         CASE WHEN kind = 'stacked_bar' OR stacked AND library <> 'plotly' THEN top WHEN kind = 'line' OR kind = 'area' AND NOT stacked AND library IN ('matplotlib', 'seaborn') THEN value ELSE coalesce(value, 0.0) END AS x,
         value IS NULL AND (kind = 'line' AND library <> 'plotly' OR kind = 'area' AND NOT stacked AND library IN ('matplotlib', 'seaborn')) AS gap FROM p CROSS JOIN k)
SELECT chart_id, kind, library, stacked, round(sum(x), 2) AS drawn, count(*) FILTER (WHERE gap) AS gaps, count(*) FILTER (WHERE x IS NOT NULL OR gap) AS n FROM d GROUP BY chart_id, kind, library, stacked"""
)


def q_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a dataset: chart type, library and all options of its style."""
    out = series.charts(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("set_no")))
    shown = F.transform(F.array_sort(F.map_entries("style")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("set_no", "chart_type", "library", F.array_join(shown, ";").alias("style"))


def _drawn(what: str, options: list[str] | tuple, ids: str = "c_custkey") -> str:
    """series.choice() in SQL."""
    n = f"CAST('0x' || left(md5('{what}|' || {ids}), 7) AS BIGINT)"
    if isinstance(options, list):
        return f"[{', '.join(repr(o) for o in options)}][1 + {n} % {len(options)}]"
    if len(options) == 3:
        least, most, names = options
        ranked = f"list_sort([{', '.join(f"""md5('{what}|{o}|' || {ids}) || '{o}'""" for o in names)}])"
        return f"array_to_string(list_transform({ranked}[1:{n} % {most - least + 1} + {least}], lambda x: substr(x, 33)), ',')"
    low, high = options
    if isinstance(low, int):
        return f"CAST({n} % {high - low + 1} + {low} AS VARCHAR)"
    return f"format('{{:.2f}}', {low}::DOUBLE + {high - low}::DOUBLE * {n} / {1 << 28})"


CHARTS = f"""
WITH c AS (SELECT c_custkey, {_drawn("type", list(series.CHART_TYPES))} AS chart_type, {_drawn("library", list(series.LIBRARIES))} AS library FROM customer)
SELECT c_custkey AS set_no, chart_type, library, CASE library {" ".join(f"WHEN '{lib}' THEN " + " || ';' || ".join(f"'{k}=' || {_drawn(k, style[k])}" for k in sorted(style)) for lib, style in series.STYLES.items())} END AS style FROM c"""


def _line_option(name: str, options: list[str] | tuple) -> str:
    ids = "chart_id || '|' || series_pos"
    bare = f"CAST('0x' || left(md5('bare|' || {ids}), 7) AS BIGINT) % 10 < {series.BARE_TENTHS}"
    return f"CASE WHEN {bare} THEN 'none' ELSE {_drawn(name, options, ids)} END" if name == "marker" else _drawn(name, options, ids)


def q_line_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A color and line options for each nation in each priority's chart."""
    return series.line_styles(_points(spark, sf_dir), 25).withColumn("series_pos", F.col("series_pos").cast("long"))


LINE_STYLES = (
    WIDE
    + f""",
n AS (SELECT series_name AS chart_id, row_number() OVER (PARTITION BY series_name ORDER BY country_name) - 1 AS series_pos FROM (SELECT DISTINCT series_name, country_name FROM w)),
c AS (SELECT chart_id, color, row_number() OVER (PARTITION BY chart_id ORDER BY md5(chart_id || '|' || color), color) - 1 AS series_pos FROM (SELECT DISTINCT chart_id FROM n) CROSS JOIN (SELECT unnest({series.colors(25)}) AS color))
SELECT chart_id, series_pos, color, {", ".join(f"{_line_option(k, o)} AS {k}" for k, o in series.LINE_STYLE.items())} FROM n JOIN c USING (chart_id, series_pos)"""
)


QUERIES: dict = {f.__name__: f for f in (
    q_cell_all, q_hot_cells, q_added_method, q_structured_consensus, q_consensus_tables, q_fuzzy_align, q_prefix_median, q_stability, q_incremental, q_variance_convergence, q_exact_match, q_token_totals,
    q_diversity_plan, q_normalize_value, q_fenced_table, q_conforms, q_cache_key, q_anls_pairs, q_value_penalty, q_rms_f1, q_eval_macro, q_prune_series, q_sample_datasets, q_subsample, q_bars,
    q_transpose, q_datapoints, q_rms_f1_nested, q_eval_nested, q_matched_parts, q_fixed, q_adaptive, q_incremental_sampling, q_structured_sampling, q_first_conforming, q_unpivot_series, q_csv_series, q_area_line, q_charts, q_line_styles,
    q_variance_map, q_normalized_tsv, q_table_function, q_sample_lists, q_next_samples, q_sample_store, q_prepared, q_requests, q_eval_references, q_clean_skeleton, q_diversity_sampling, q_geometry,
)}
ORACLES: dict = {
    "q_cell_all": CELL_ALL, "q_hot_cells": HOT_CELLS, "q_added_method": ADDED_METHOD, "q_structured_consensus": STRUCTURED, "q_prefix_median": PREFIX + " SELECT * FROM steps", "q_stability": STABILITY, "q_incremental": INCREMENTAL,
    "q_variance_convergence": VARIANCE, "q_exact_match": EXACT, "q_token_totals": TOKENS, "q_diversity_plan": DIVERSITY, "q_normalize_value": NORMALIZE, "q_fenced_table": FENCED,
    "q_conforms": CONFORMS, "q_cache_key": CACHE_KEY, "q_anls_pairs": ANLS, "q_value_penalty": PENALTY, "q_prune_series": PRUNE, "q_sample_datasets": SAMPLE, "q_subsample": SUBSAMPLE, "q_bars": BARS,
    "q_transpose": TRANSPOSE, "q_datapoints": DATAPOINTS, "q_rms_f1_nested": NESTED + " SELECT * FROM n", "q_eval_nested": EVAL_NESTED, "q_fixed": FIXED, "q_adaptive": ADAPTIVE,
    "q_first_conforming": CONFORMING, "q_unpivot_series": UNPIVOT, "q_csv_series": CSV_SERIES, "q_area_line": AREA, "q_charts": CHARTS,
    "q_consensus_tables": TABLES, "q_variance_map": VARIANCE_MAP, "q_normalized_tsv": NORMALIZED_TSV, "q_table_function": TABLE_FUNCTION, "q_sample_lists": SAMPLE_LISTS, "q_next_samples": NEXT_SAMPLES, "q_sample_store": SAMPLE_STORE, "q_prepared": PREPARED, "q_requests": REQUESTS,
    "q_eval_references": REFERENCES, "q_clean_skeleton": CLEAN_SKELETON, "q_diversity_sampling": DIVERSITY_SAMPLING, "q_geometry": GEOMETRY, "q_fuzzy_align": FUZZY, "q_incremental_sampling": INCREMENTAL_SAMPLING, "q_structured_sampling": STRUCTURED_SAMPLING, "q_line_styles": LINE_STYLES,
}
