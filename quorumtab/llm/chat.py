"""Chat formatting by schema fingerprints.

Records are JSON texts of several layouts. A record's own nested field paths, of its fields that aren't null, are sorted and
hashed. Fingerprints of layouts as they are declared pick their mapping at once; for others, with further fields or with
those of two layouts, the first layout whose needs are all there is taken, lists of turns before single fields. A mapping says
where the turns are, so prompts with responses, instructions, and lists of messages all become canonical turns (role,
text). Texts may be lists of typed parts, which are another path; their texts are joined by newlines. All of it is built-in
expressions: records are parsed as maps, so every field is seen, and texts may have any length. Records that no mapping
fits come back with null turns, fingerprint and paths, none is dropped.

formatted() writes a conversation as one string: START role newline text END newline for each turn. Control strings
inside roles and texts are escaped: backslashes are doubled, then each control string gets a backslash after its first
letter, and a newline in a role becomes backslash and n; read_back() undoes it. The loss mask is the spans of the
assistants' texts, in code points of the formatted string.

Null roles and texts count as empty. Rows of a turn that occurs twice are ordered by role and text and all kept; a null
turn comes first, and null ids are one conversation. An empty table gives an empty result. A conversation is one row of
the output, so it must fit a row. Other columns are ignored, also those that share a name but for its case.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumtab.llm.common import pick

START, END = "<|im_start|>", "<|im_end|>"
#: What must not stand in a text unescaped: our own marks, and those of other common templates.
CONTROLS = (START, END, "<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}
ASSISTANT = "assistant"

#: Layouts, those of lists first: the paths that must be there, those that may be, and where the turns are. "[]" is any element of a list.
LAYOUTS = {
    "messages": {"needs": ["messages[].role", "messages[].content"], "may": [], "list": ("messages", "role", "content")},
    "shared": {"needs": ["conversations[].from", "conversations[].value"], "may": [], "list": ("conversations", "from", "value")},
    "dialog": {"needs": ["dialog[].speaker", "dialog[].text"], "may": [], "list": ("dialog", "speaker", "text")},
    "instruction": {"needs": ["instruction", "output"], "may": ["input", "system"], "fields": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "prompt": {"needs": ["prompt", "response"], "may": ["system"], "fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    "completion": {"needs": ["prompt", "completion"], "may": ["system"], "fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"])]},
    "question": {"needs": ["question", "answer"], "may": ["context"], "fields": [("user", ["context", "question"]), ("assistant", ["answer"])]},
}
LISTS = {layout["list"][0]: layout["list"] for layout in LAYOUTS.values() if "list" in layout}
TURNS = "array<struct<role:string,text:string>>"
PARTS = "[].text"  # of a text that is a list of typed parts
ANY_LENGTH = {"maxStringLen": str((1 << 31) - 1)}  # else a text of more than 20 million characters makes its record null


def fingerprint(paths: set[str]) -> str:
    """Hash of the sorted paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def registry() -> dict[str, str]:
    """Fingerprint to layout, with each choice of the optional paths, and of texts in parts or not."""
    out = {}
    for name, layout in LAYOUTS.items():
        for k in range(len(layout["may"]) + 1):
            for extra in combinations(layout["may"], k):
                out[fingerprint({*layout["needs"], *extra})] = name
        if "list" in layout:
            field, role, said = layout["list"]
            out[fingerprint({f"{field}[].{role}", f"{field}[].{said}{PARTS}"})] = name
    return out


def canonical(role: Column) -> Column:
    return F.coalesce(*[F.when(role == a, F.lit(b)) for a, b in ROLES.items()], role, F.lit(""))


def mapped(layout: dict) -> Column:
    """The turns that a layout's mapping finds in a record: top (its fields) and lists (by field: entries, parts)."""
    turn = lambda role, text: F.struct(canonical(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if "list" in layout:
        name, role, said = layout["list"]
        listed = F.col(f"lists.{name}")
        joined = lambda i: F.array_join(F.transform(F.filter(F.get(listed["parts"], i)[said], lambda x: x["text"].isNotNull()), lambda x: x["text"]), "\n")
        text = lambda m, i: F.coalesce(joined(i), F.try_element_at(m, F.lit(said)))
        turns = F.transform(listed["entries"], lambda m, i: F.when(m.isNotNull(), turn(F.try_element_at(m, F.lit(role)), text(m, i))))
        return F.filter(turns, lambda t: t.isNotNull())
    turns = []
    for role, names in layout["fields"]:
        texts = [F.try_element_at("top", F.lit(f)) for f in names]
        said = F.concat_ws("\n\n", *[F.nullif(t, F.lit("")) for t in texts])
        turns.append(F.when(F.coalesce(*texts).isNotNull(), turn(F.lit(role), said)))
    return F.filter(F.array(*turns), lambda t: t.isNotNull())


def _parsed(records: DataFrame) -> DataFrame:
    """conv_id, top (fields as text), and for each list of turns its entries as maps, and their texts where these are parts."""
    rows = records.select("conv_id", F.from_json("record", "map<string,string>", ANY_LENGTH).alias("top"))
    rows = rows.withColumn("top", F.map_filter("top", lambda _, v: v.isNotNull()))
    of = lambda name: F.try_element_at("top", F.lit(name))
    entries = {name: F.from_json(of(name), "array<map<string,string>>", ANY_LENGTH).alias(name) for name in LISTS}
    rows = rows.withColumn("entries", F.struct(*entries.values()))
    lists = []
    for name, (_, _, said) in LISTS.items():
        some = F.exists(F.col("entries")[name], lambda m: F.coalesce(F.try_element_at(m, F.lit(said)).startswith("["), F.lit(False)))
        parts = F.from_json(F.when(some, of(name)), f"array<struct<`{said}`:array<struct<type:string,text:string>>>>", ANY_LENGTH)
        lists.append(F.struct(F.col("entries")[name].alias("entries"), parts.alias("parts")).alias(name))
    return rows.select("conv_id", "top", F.struct(*lists).alias("lists"))


def _list_paths(name: str, said: str) -> Column:
    """The paths within one list of turns."""
    listed, nothing = F.col(f"lists.{name}"), F.array().cast("array<string>")

    def of_entry(m: Column, i: Column) -> Column:
        in_parts = F.coalesce(F.get(listed["parts"], i)[said].isNotNull(), F.lit(False))
        called = lambda k: F.concat(F.lit(f"{name}[]."), k, F.when((k == said) & in_parts, F.lit(PARTS)).otherwise(F.lit("")))
        return F.coalesce(F.transform(F.map_keys(F.map_filter(m, lambda _, v: v.isNotNull())), called), nothing)

    return F.coalesce(F.flatten(F.transform(listed["entries"], of_entry)), nothing)


def _paths() -> Column:
    """A parsed record's own paths; a field called like a list of turns that isn't one is a plain field."""
    plain = F.map_keys("top")
    for name in LISTS:
        plain = F.when(F.col(f"lists.{name}.entries").isNotNull(), F.array_remove(plain, name)).otherwise(plain)
    found = F.concat(F.coalesce(plain, F.array().cast("array<string>")), *[_list_paths(name, said) for name, (_, _, said) in LISTS.items()])
    return F.array_sort(F.array_distinct(found))


def conversations_of(records: DataFrame, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """JSON records as conversations: conv_id, turns (array of role, text; null where no mapping fits), layout, fingerprint, paths."""
    rows = _parsed(pick(records, conv_id=id_col, record=record_col)).withColumn("paths", _paths())
    rows = rows.withColumn("fingerprint", F.sha2(F.array_join("paths", "\n"), 256))
    known = F.create_map(*[F.lit(x) for pair in registry().items() for x in pair])
    has = lambda p: F.array_contains("paths", p) | F.array_contains("paths", p + PARTS)
    covered = [F.when(reduce(Column.__and__, [has(p) for p in layout["needs"]]), F.lit(name)) for name, layout in LAYOUTS.items()]
    rows = rows.withColumn("layout", F.coalesce(F.try_element_at(known, F.col("fingerprint")), *covered))
    turns = F.lit(None).cast(TURNS)
    for name, layout in LAYOUTS.items():
        turns = F.when(F.col("layout") == name, mapped(layout).cast(TURNS)).otherwise(turns)
    return rows.select("conv_id", turns.alias("turns"), "layout", "fingerprint", "paths")


def turns_of(conversations: DataFrame) -> DataFrame:
    """conversations_of() with a row for each turn: conv_id, turn, role, text, layout, fingerprint; one with nulls where there is none."""
    got = conversations.select("conv_id", "layout", "fingerprint", F.posexplode_outer("turns").alias("turn", "said"))
    return got.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), "said.role", "said.text", "layout", "fingerprint")


def gathered(table: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as conversations: conv_id, turns in order."""
    rows = pick(table, "conv_id", "turn", "role", "text")
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    each = rows.select("conv_id", row.alias("row")).groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return each.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    """Pairs of backslashes, from the left, are one each; of the rest, one before n is a newline and others go."""
    plain = lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\"), F.lit(""))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def formatted(conversations: DataFrame) -> DataFrame:
    """One row per conversation (conv_id, turns): conv_id, formatted, loss (array of spans s, e)."""
    def parts(t: Column) -> Column:
        head = F.concat(F.lit(START), F.replace(escaped(t["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
        return F.struct(t["role"].alias("role"), head.alias("head"), escaped(t["text"]).alias("body"))

    each = conversations.select("conv_id", F.transform(F.coalesce("turns", F.array().cast(TURNS)), parts).alias("rows"))
    joined = F.array_join(F.transform("rows", lambda r: F.concat(r["head"], r["body"], F.lit(END + "\n"))), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("loss"))

    def step(acc: Column, r: Column) -> Column:
        s = acc["at"] + F.char_length(r["head"])
        e = s + F.char_length(r["body"])
        loss = F.when(r["role"] == ASSISTANT, F.concat(acc["loss"], F.array(F.struct(s.alias("s"), e.alias("e"))))).otherwise(acc["loss"])
        return F.struct((e + len(END) + 1).alias("at"), loss.alias("loss"))

    return each.select("conv_id", joined.alias("formatted"), F.aggregate("rows", start, step, lambda acc: acc["loss"]).alias("loss"))


def read_back(strings: DataFrame) -> DataFrame:
    """formatted() rows with what their strings say: turns (array of role, text) and loss_text, unescaped."""
    pieces = F.filter(F.split("formatted", F.lit(r"<\|im_end\|>\n"), -1), lambda p: p != "")
    body = lambda p: F.substring(p, len(START) + 1, F.char_length(p))
    turn = lambda p: F.struct(
        unescaped(F.substring_index(p, "\n", 1)).alias("role"), unescaped(F.substring(p, F.char_length(F.substring_index(p, "\n", 1)) + 2, F.char_length(p))).alias("text")
    )
    turns = F.transform(F.transform(pieces, body), turn)
    loss = F.transform("loss", lambda x: unescaped(F.substring(F.col("formatted"), (x["s"] + 1).cast("int"), (x["e"] - x["s"]).cast("int"))))
    return strings.withColumns({"turns": turns, "loss_text": F.array_join(loss, "")})


def mixed_records(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turns) written as JSON records of all layouts: conv_id, record. What a mixed crawl looks like.

    A question with its answer takes one of the four layouts that say no more than that, with a system text before it one
    of three, and all others a list of messages in one of three layouts, the first of these with texts in parts or with a
    prompt beside it; a hash of conv_id chooses.
    """
    turns, pick_of = F.col("turns"), lambda n: F.pmod(F.xxhash64("conv_id"), F.lit(n))
    roles = F.transform(turns, lambda t: t["role"])
    is_ = lambda *want: roles == F.array(*[F.lit(w) for w in want])
    text = lambda i: F.get(turns, i)["text"]
    record = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))

    def messages(name: str, role: str, said: str, odd: dict[str, str], **more: Column) -> Column:
        called = lambda r: F.coalesce(*[F.when(r == a, F.lit(b)) for a, b in odd.items()], r)
        return record(**{name: F.transform(turns, lambda t: F.struct(called(t["role"]).alias(role), t["text"].alias(said)))}, **more)

    two, three = is_("user", "assistant"), is_("system", "user", "assistant")
    out = F.when(two & (pick_of(4) == 0), record(prompt=text(0), response=text(1), id=F.lit(7)))
    out = out.when(two & (pick_of(4) == 1), record(prompt=text(0), completion=text(1)))
    out = out.when(two & (pick_of(4) == 2), record(instruction=text(0), output=text(1)))
    out = out.when(two, record(question=text(0), answer=text(1)))
    out = out.when(three & (pick_of(3) == 0), record(system=text(0), prompt=text(1), response=text(2)))
    out = out.when(three & (pick_of(3) == 1), record(system=text(0), prompt=text(1), completion=text(2)))
    out = out.when(three, record(system=text(0), instruction=text(1), output=text(2)))
    parts = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), t["text"].alias("text"))).alias("content")))
    out = out.when(pick_of(6) == 0, record(messages=parts, source=F.lit("crawl")))
    out = out.when(pick_of(6) == 3, messages("messages", "role", "content", {"": ""}, prompt=F.lit("of the page")))
    out = out.when(pick_of(3) == 1, messages("conversations", "from", "value", {"user": "human", "assistant": "gpt"}))
    return conversations.select("conv_id", out.otherwise(messages("dialog", "speaker", "text", {"assistant": "bot"})).alias("record"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's conversations as records of mixed layouts, recognised, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    stored = pick(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    records = mixed_records(gathered(stored.unionByName(extra)))
    out = read_back(formatted(conversations_of(records)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(col: str) -> str:
    out = f"replace({col}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(CASE role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'model' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE role END, '') AS role,
         coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(START) + len(END) + 2} + length(replace({_sql_escaped('role')}, chr(10), '\\n')) + length({_sql_escaped('text')})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
