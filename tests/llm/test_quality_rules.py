import re
from collections import Counter

from quorumtab.llm import quality_rules
from quorumtab.llm.quality_rules import accepted, judge

ROWS = [
    (1, None, "a"), (2, "", "a"), (3, "   \n\t ", None), (4, "one two three", "b"),
    (5, "a b c d e f g h i j k l", "b"), (6, "a b c d e a b c d e", "b"), (7, "x " * 30_000, "b"),
    (8, "p q r s t u v w a b c d e z a b c d e f", None), (9, "l1 é\nl1 é\n\n \nl2 ##| x\nl1 é", "c"), (9, "l1 é\nl1 é\n\n \nl2 ##| x\nl1 é", "c"),
    (10, " ".join(f"w{i % 97}" for i in range(20_000)), "c"), (11, "x y z w v x y z w v u t", "c"),
]


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_by_brute_force(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, source string, n_words int")
    out = judge(df).collect()
    assert len(out) == len(ROWS)
    want = {i: brute(t) for i, t, _ in ROWS}
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id], r.doc_id
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def test_bad_host_is_rejected_and_clean_hosts_stay(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    rows = [(i, clean + str(i), "good") for i in range(50)] + [(100 + i, "spam", "bad") for i in range(45)]
    rows += [(200 + i, clean + str(i), "bad") for i in range(5)] + [(300 + i, clean, f"h{i}") for i in range(5)] + [(400, clean, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = accepted(df)
    assert out.columns == df.columns
    assert {r.source for r in out.collect()} == {"good", None, *(f"h{i}" for i in range(5))}
    assert out.count() == 56


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert judge(df).count() == 0 and accepted(df).count() == 0


def test_planted_bad_hosts_over_the_whole_table(spark, sf_dir, duck, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    good = " ".join(f"word{i}" for i in range(40))
    bad = [(10**7 + i, "short" if i % 10 else f"{good} {i}", "en", "bad.example", 5) for i in range(200)]
    fair = [(2 * 10**7 + i, "short" if i % 10 == 0 else f"{good} x{i}", "en", "fair.example", 5) for i in range(200)]
    docs.unionByName(spark.createDataFrame(bad + fair, docs.schema)).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.kept for r in quality_rules.op9_quality_rules(spark, str(tmp_path)).collect()}
    duck.execute("CREATE SCHEMA IF NOT EXISTS planted")
    duck.execute(f"CREATE OR REPLACE VIEW planted.documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    duck.execute("SET schema = 'planted'")
    cur = duck.execute(quality_rules.ORACLE)
    names = [d[0] for d in cur.description]
    want = {r[names.index("doc_id")]: r[names.index("kept")] for r in cur.fetchall()}
    duck.execute("SET schema = 'main'")
    assert got == want
    assert not any(got[d] for d, *_ in bad) and sum(got[d] for d, *_ in fair) == 180
