"""Column functions on cell texts: numbers, distances between labels and values, keys, prompts and fenced blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PYTHON_FLOAT = r"(?i)^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?$"
#: Name prefixes of models and who serves them; the first that fits counts.
PROVIDERS = [("qwen/", "openrouter"), ("bytedance-seed/", "openrouter"), ("meta-llama/", "openrouter"), ("gpt", "openai"), ("gemini", "google"), ("claude", "anthropic")]
PROMPT = "Read the chart in the image and write its data as tab-separated values in a fenced tsv block: headers in the first row, row labels in the first column, nan for a value that cannot be read."
SKELETON_PROMPT = "Read the chart in the image and write the headers and row labels of its data as tab-separated values in a fenced tsv block, with _ in each cell."


def let(value: Column, then) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def bare(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def float_or_null(text: Column) -> Column:
    """What Python's float() reads; null where it would fail."""
    t = bare(text)
    plain = F.when(t.rlike(PYTHON_FLOAT), F.regexp_replace(t, "_", "").try_cast("double"))
    special = F.when(t.rlike(r"(?i)^[+-]?nan$"), F.lit(float("nan"))).when(t.rlike(r"(?i)^\+?inf(inity)?$"), F.lit(float("inf")))
    return F.coalesce(special.when(t.rlike(r"(?i)^-inf(inity)?$"), F.lit(float("-inf"))), plain)


def percent_or_number(text: Column) -> Column:
    """A number, or a percentage as its hundredth; null for other texts."""
    cut = F.regexp_replace(text, "%+$", "")
    return F.when(F.endswith(text, F.lit("%")), float_or_null(cut) / 100).otherwise(float_or_null(text))


def cell_number_text(text: Column) -> Column:
    """The first number in a cell as text: scientific notation first, thousands' commas removed; "0" where there is none."""
    t = F.regexp_replace(F.lower(bare(F.coalesce(text, F.lit("")))), r"(?<=\d),(?=\d)", "")
    science = F.regexp_extract(t, r"-?\d+(?:\.\d+)?e[+-]?\d+", 0)
    plain = F.regexp_extract(t, r"-?\d+(?:\.\d+)?", 0)
    return F.when(science != "", python_text(science.try_cast("double"))).when(plain != "", plain).otherwise("0")


def cell_number(text: Column, missing: str = "zero") -> Column:
    """The first number in a cell; where there is none 0, or null with missing="null"."""
    t = F.regexp_replace(F.lower(bare(F.coalesce(text, F.lit("")))), r"(?<=\d),(?=\d)", "")
    found = F.coalesce(F.nullif(F.regexp_extract(t, r"-?\d+(?:\.\d+)?e[+-]?\d+", 0), F.lit("")), F.nullif(F.regexp_extract(t, r"-?\d+(?:\.\d+)?", 0), F.lit("")))
    number = found.try_cast("double")
    return number if missing == "null" else F.coalesce(number, F.lit(0.0))


def python_text(x: Column) -> Column:
    """A double as Python prints it: an exponent only below 1e-4 and from 1e16 on."""
    s = F.abs(x).cast("string")
    sign = F.when((x < 0) | s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    n = F.substring_index(s, "E", -1).try_cast("int")
    head = F.regexp_replace(F.substring_index(s, "E", 1), r"\.0$", "")
    digits = F.replace(head, F.lit("."), F.lit(""))
    size = F.char_length(digits)
    large = F.when(size <= n + 1, F.concat(digits, F.repeat(F.lit("0"), n + 1 - size), F.lit(".0"))).otherwise(
        F.concat(F.substring(digits, F.lit(1), n + 1), F.lit("."), F.substring(digits, n + 2, size))
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -n - 1), digits)
    power = F.concat(head, F.when(n < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(n).cast("string"), 2, "0"))
    moved = F.when((n >= 16) | (n < -4), power).when(n >= 0, large).otherwise(small)
    special = F.when(F.isnan(x), F.lit("nan")).when(s == "Infinity", F.concat(sign, F.lit("inf")))
    return special.otherwise(F.concat(sign, F.when(F.contains(s, F.lit("E")), moved).otherwise(s)))


def anls(target: Column, prediction: Column, theta: float = 0.5) -> Column:
    """1 less the normalised edit distance where that is below theta, else 0."""
    longest = F.greatest(F.char_length(target), F.char_length(prediction))
    distance = F.levenshtein(target, prediction) / F.when(longest > 0, longest)
    return F.when(target == prediction, F.lit(1.0)).otherwise(F.when(distance < theta, 1 - distance).otherwise(F.lit(0.0)))


def relative_distance(target: Column, prediction: Column, theta: float = 0.1, zero_target: str = "match") -> Column:
    """Relative distance below theta, else 1. A target of 0 is met by any number, or with "strict" by 0 alone."""
    d = F.least(F.abs((target - prediction) / F.when(target != 0, target)), F.lit(1.0))
    zero = F.lit(0.0) if zero_target == "match" else F.when(prediction == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return F.when(target == 0, zero).when(d < theta, d).otherwise(F.lit(1.0))


def value_penalty(target: Column, prediction: Column, text_theta: float = 0.5, number_theta: float = 0.1, zero_target: str = "match") -> Column:
    """Distance of numbers where both are numbers; else 0 for equal texts and 1 - anls for others."""
    texts = F.when(target == prediction, F.lit(0.0)).otherwise(1 - anls(target, prediction, text_theta))
    numbers = lambda x: F.when(x["t"].isNotNull() & x["p"].isNotNull(), relative_distance(x["t"], x["p"], number_theta, zero_target))
    return F.coalesce(let(F.struct(percent_or_number(target).alias("t"), percent_or_number(prediction).alias("p")), numbers), texts)


def axis_label(series: Column) -> Column:
    t = F.replace(series, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, F.lit(2), F.char_length(t))))


def image_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(suffix == "jpg", F.lit("jpeg")).otherwise(suffix)


def data_url(path: Column, content: Column) -> Column:
    return F.concat(F.lit("data:image/"), image_type(path), F.lit(";base64,"), F.base64(content))


def provider(model: Column) -> Column:
    """Who serves a model; an unknown name raises an error."""
    known = reduce(lambda acc, p: acc.when(model.startswith(p[0]), F.lit(p[1])), PROVIDERS[1:], F.when(model.startswith(PROVIDERS[0][0]), F.lit(PROVIDERS[0][1])))
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown model: "), F.coalesce(model, F.lit("null")))))


def sample_key(path: Column, model: Column, temperature: Column, prompt: Column, structure: Column | None = None) -> Column:
    """SHA-256 of path|model|temperature|prompt, and |structure where there is one; paths start at the first /data/."""
    at = F.instr(path, "/data/")
    path = F.when(at > 0, F.substring(path, at + 1, F.char_length(path))).otherwise(path)
    parts = [path, model, F.coalesce(python_text(temperature), F.lit("None")), prompt]
    return F.sha2(F.concat(F.concat_ws("|", *parts), *([F.coalesce(F.concat(F.lit("|"), structure), F.lit(""))] if structure is not None else [])), 256)


def structure_key(path: Column, model: Column) -> Column:
    return F.sha2(F.concat_ws("|", path, model), 256)


def fenced_table(response: Column) -> Column:
    """The first fenced tsv block, or else the first block of any kind (its tag stays); null without a fence."""
    tagged = F.try_element_at(F.split(response, "```tsv", -1), F.lit(2))
    block = F.when(F.contains(response, F.lit("```tsv")), F.try_element_at(F.split(tagged, "```", -1), F.lit(1)))
    return bare(F.coalesce(block, F.try_element_at(F.split(response, "```", -1), F.lit(2))))


def structured_prompt(structure: Column) -> Column:
    header = bare(F.substring_index(structure, "\n", 1))
    return F.concat(F.lit(PROMPT + " Use exactly these headers: "), header, F.lit("\nFill in this table:\n"), structure)


def clean_skeleton(structure: Column) -> Column:
    """Blank lines go; underscores become blanks in the header and vanish from row labels."""
    lines = F.filter(F.split(structure, "\n"), lambda x: bare(x) != "")
    first = F.replace(F.get(lines, 0), F.lit("_"), F.lit(" "))
    label = lambda x: F.replace(F.substring_index(x, "\t", 1), F.lit("_"), F.lit(""))
    rest = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.concat(label(x), F.substring(x, F.char_length(F.substring_index(x, "\t", 1)) + 1, F.char_length(x))))
    return F.when(F.size(lines) > 0, F.array_join(F.concat(F.array(first), rest), "\n")).otherwise("")
