import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quorumtab.llm.chat import CONTROLS, END, LAYOUTS, START, conversations_of, fingerprint, formatted, gathered, mixed_records, read_back, turns_of

NASTY = st.lists(st.sampled_from([*CONTROLS, "\\", "\n", "n", "<", "|", "im_end", "|>", "s", ">", "[", "é", "😀", " ", "<\\", "\\n"]), max_size=12).map("".join)


def test_escaping_is_reversible(spark):
    made = []

    @settings(max_examples=400, deadline=None)
    @given(NASTY, NASTY)
    def gather(role, text):
        made.append((role, text))

    gather()
    rows = [(i // 3, i % 3, r, t) for i, (r, t) in enumerate(made)]
    strings = formatted(gathered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    for r in read_back(strings).collect():
        want = [(a, b) for c, _, a, b in rows if c == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.formatted.count(START) == r.formatted.count(END) == len(want)
        assert all(r.formatted.count(c) == 0 for c in CONTROLS[2:])
        assert r.loss_text == "".join(t for a, t in want if a == "assistant")


def test_table_rows_with_nulls_ties_and_clashing_columns(spark):
    rows = [(1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (1, 1, "gpt", "hi", "y"), (2, None, None, "t" * 100_000, "z"), (None, 0, "assistant", "", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss string")
    through = lambda df: read_back(formatted(conversations_of(mixed_records(gathered(df)))))
    out = {r.conv_id: r for r in through(df).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("user", ""), ("user", ""), ("assistant", "hi")] and out[1].loss_text == "hi"
    assert [(t.role, len(t.text)) for t in out[2].turns] == [("", 100_000)]
    s = out[1].loss[0]
    assert out[1].formatted[s.s : s.e] == "hi"
    assert out[None].loss_text == "" and through(df.limit(0)).count() == 0


def test_fingerprints_choose_mappings(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "id": 5},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"instruction": "a", "output": "b"}, {"instruction": "a", "input": "c", "output": "b", "system": "s"}, {"prompt": "a", "response": "b", "input": None},
        {"question": "a", "answer": "b", "meta": {"x": 1}}, {"nothing": 1}, {"dialog": [{"speaker": "bot", "text": "b"}]},
    ]
    raw = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, "not json"), (91, None), (92, "[1]")]
    got = {}
    for r in turns_of(conversations_of(spark.createDataFrame(raw, "conv_id long, record string"))).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    pair = [("user", "a"), ("assistant", "b")]
    assert got[0] == got[1] == got[2] == got[4] == got[5] == pair
    assert got[3] == [("system", "s"), ("user", "a\n\nc"), ("assistant", "b")] and got[7] == [("assistant", "b")]
    assert got[6] == got[90] == got[91] == got[92] == [(None, None)]


def test_mixed_records_use_all_layouts_and_come_back(spark):
    plain, turns = ["x", "", 'q"\\', "é\n\t\x01", "</s>", "[INST]"], []
    shapes = [["user", "assistant"], ["system", "user", "assistant"], ["user"], ["user", "assistant", "user", "assistant"], ["tool", "assistant"]]
    for c in range(200):
        turns += [(c, i, role, plain[(c + i) % len(plain)]) for i, role in enumerate(shapes[c % len(shapes)])]
    records = mixed_records(gathered(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))
    got = conversations_of(records).collect()
    assert {r.layout for r in got} == set(LAYOUTS)
    for r in got:
        assert [(t.role, t.text) for t in r.turns] == [(a, b) for c, _, a, b in turns if c == r.conv_id]
        assert r.fingerprint == fingerprint(set(r.paths))
        parts = "messages[].content[].text" in r.paths
        wanted = {p + "[].text" if parts and p.endswith("content") else p for p in LAYOUTS[r.layout]["needs"]}
        assert wanted <= set(r.paths) and set(r.paths) - wanted <= {"system", "id", "source", "prompt"}
    assert any("messages[].content[].text" in r.paths for r in got) and any({"prompt", "messages[].role"} <= set(r.paths) for r in got)


def test_paths_are_the_records_own(spark):
    """Typed parts, unknown fields, fields of two layouts, fields that are null, texts that look like lists."""
    part = [{"type": "text", "text": "hi"}, {"type": "image", "url": "u"}, {"type": "text", "text": "you"}]
    records = [
        {"messages": [{"role": "user", "content": part}, {"role": "assistant", "content": "ok", "name": "n"}], "id": 5},
        {"messages": [{"role": "user", "content": json.dumps(part)}]},
        {"messages": [{"role": "user", "content": "a"}], "prompt": "p", "response": "r"},
        {"instruction": "a", "output": "b", "input": None}, {"instruction": "a", "output": "b"},
        {"messages": "none", "prompt": "p", "response": "[1]"}, {"deep": {"x": [1]}, "odd": 1}, {"messages": [None, {"role": "user", "content": None}]},
    ]
    got = {r.conv_id: r for r in conversations_of(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, record string")).collect()}
    told = {i: r.turns and [(t.role, t.text) for t in r.turns] for i, r in got.items()}
    assert told[0] == [("user", "hi\nyou"), ("assistant", "ok")] and told[1] == [("user", json.dumps(part))]
    assert got[0].paths == ["id", "messages[].content", "messages[].content[].text", "messages[].name", "messages[].role"]
    assert got[2].layout == "messages" and told[2] == [("user", "a")]
    assert got[3].fingerprint == got[4].fingerprint and told[3] == [("user", "a"), ("assistant", "b")]
    assert told[5] == [("user", "p"), ("assistant", "[1]")] and got[5].paths == ["messages", "prompt", "response"]
    assert told[6] is None and got[6].paths == ["deep", "odd"] and told[7] is None


def test_texts_longer_than_the_parsers_limit(spark):
    """21 million characters, in a list, in parts and as a field; nothing is lost."""
    long = "long text \u00e9" * 1_910_000
    turns = spark.createDataFrame([(c, i, r, None) for c in range(12) for i, r in enumerate(["user", "assistant"] * (1 + c % 2))], "conv_id long, turn long, role string, text string")
    turns = turns.withColumn("text", F.when(F.col("conv_id").isin(0, 1, 2, 3, 5, 7) & (F.col("turn") == 1), F.repeat(F.lit("long text \u00e9"), 1_910_000)).otherwise(F.lit("x")))
    out = read_back(formatted(conversations_of(mixed_records(gathered(turns)))))
    for r in out.select("conv_id", F.size("turns").alias("n"), F.length("loss_text").alias("loss"), F.sha2("loss_text", 256).alias("sha")).collect():
        last = "x" * (r.conv_id % 2)
        want = (long if r.conv_id in (0, 1, 2, 3, 5, 7) else "x") + last
        assert (r.n, r.loss, r.sha) == (2 * (1 + r.conv_id % 2), len(want), hashlib.sha256(want.encode()).hexdigest())
