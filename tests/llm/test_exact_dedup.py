import hashlib

from quorumtab.llm import exact_dedup
from quorumtab.llm.exact_dedup import content_sort, survivors

ROWS = (
    [(i, "Same Copy", "x") for i in range(400)]
    + [(1000, None, "a"), (1001, "", "b"), (1002, "É", "c"), (1003, "é", "d"), (1004, "ABC", "e"), (1005, "abc", "f"), (1005, "abc", "f")]
    + [(1006, "w " * 40_000, "g"), (1007, "W " * 40_000, "h"), (None, "no id", None)]
)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_groups_by_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, Text2 string").withColumnRenamed("Text2", "fold")
    got = {}
    for keep, best in (("largest", max), ("smallest", min)):
        out = content_sort(df, keep=keep).collect()
        assert len(out) == len(ROWS)
        groups = {}
        for i, t, _ in ROWS:
            groups.setdefault(lower(t), []).append(i)
        for r in out:
            got[r.doc_id] = r
        for i, t, _ in ROWS:
            ids = groups[lower(t)]
            r = got[i]
            assert r.group_size == len(ids) and r.keep_id == best((x for x in ids if x is not None), default=None)
            assert r.text_sha256 == hashlib.sha256(lower(t).encode()).hexdigest()
        for text, ids in groups.items():
            mine = [r for r in out if r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
            assert [r.doc_id for r in mine if r.kept] == [best((x for x in ids if x is not None), default=None)]


def test_hot_heads_and_texts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_SHARE", 4)
    head = "The same Head of very many texts, longer than the characters that splitters see: "
    rows = [(i, head + str(i % 120)) for i in range(300)] + [(1000 + i, (head + "HOT").upper() if i % 2 else head + "hot") for i in range(300)]
    rows += [(5000, head + "hot"), (5000, head + "hot")] + [(None, head + "hot")] * 3 + [(2000 + i, f"own {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = content_sort(df, keep="largest").collect()
    assert len(out) == len(rows) and sum(r.kept for r in out) == len(groups)
    want = {hashlib.sha256(t.encode()).hexdigest(): (max(x for x in ids if x is not None), len(ids)) for t, ids in groups.items()}
    assert {r.text_sha256: (r.keep_id, r.group_size) for r in out} == want
    left = survivors(df).collect()
    assert sorted(r.doc_id for r in left) == sorted(k for k, _ in want.values())


def test_survivors_keep_columns_and_one_row(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    out = survivors(df)
    assert out.columns == ["doc_id", "text", "lang"]
    rows = out.collect()
    assert len(rows) == len({lower(t) for _, t, _ in ROWS})
    assert {(r.doc_id, r.lang) for r in rows} >= {(399, "x"), (1001, "b"), (1005, "f"), (1007, "h"), (None, None)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert content_sort(df).count() == 0 and survivors(df).count() == 0
