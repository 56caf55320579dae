"""Functions on arrays and JSON columns: tests, test cases, usage maps, messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltworks.functions.text import col, strip, truthy_strip, with_contract

CASE = "array<struct<input:string,output:string,testtype:string>>"
STDIN_NAMES = ("stdin", "stdio", "standard_input")
FUNCTIONAL_NAMES = ("functional", "function", "call-based")


def asserts_at_start(json_list: Column | str) -> Column:
    """Items of a JSON list of strings that begin with `assert`, stripped; anything malformed gives an empty list."""
    items = F.transform(F.from_json(col(json_list), "array<string>"), strip)
    return F.coalesce(F.filter(items, lambda t: t.startswith("assert")), F.array().cast("array<string>"))


def asserts_anywhere(json_list: Column | str) -> Column:
    """Items that contain `assert` anywhere, stripped."""
    items = F.from_json(col(json_list), "array<string>")
    return F.coalesce(F.transform(F.filter(items, lambda t: t.contains("assert")), strip), F.array().cast("array<string>"))


def visible_tests(tests: Column | str) -> Column:
    """Tests that are not blank; null gives an empty list."""
    return F.coalesce(F.filter(col(tests), lambda t: truthy_strip(t) != ""), F.array().cast("array<string>"))


def cases(json_text: Column | str) -> Column:
    """Test cases from a JSON list of objects, or of [input, output] pairs; anything else gives an empty list."""
    c = col(json_text)
    objects = F.filter(F.from_json(c, CASE), lambda x: x["input"].isNotNull() | x["output"].isNotNull())
    pairs = F.filter(F.from_json(c, "array<array<string>>"), lambda p: F.size(p) == 2)
    from_pairs = F.transform(pairs, lambda p: F.struct(p[0].alias("input"), p[1].alias("output"), F.lit(None).cast("string").alias("testtype")))
    empty = F.array().cast(CASE)
    return F.when(F.size(objects) > 0, objects).when(F.size(from_pairs) > 0, from_pairs).otherwise(empty)


def case_kind(case: Column) -> Column:
    return F.lower(strip(F.coalesce(F.nullif(case["testtype"], F.lit("")), F.lit("stdin"))))


def stdin_cases(c: Column) -> Column:
    return F.filter(c, lambda x: case_kind(x).isin(*STDIN_NAMES))


def functional_cases(c: Column) -> Column:
    return F.filter(c, lambda x: case_kind(x).isin(*FUNCTIONAL_NAMES))


def chosen_cases(public: Column, private: Column, feedback: str) -> Column:
    """Public cases, all cases or private ones (public ones where there is no private one)."""
    if feedback == "public":
        return public
    if feedback == "all":
        return F.concat(public, private)
    return F.when(F.size(private) > 0, private).otherwise(public)


def usage_total(usage: Column | str) -> Column:
    """Sum of a usage map's values; nulls count as 0, a null map gives null."""
    return F.aggregate(F.map_values(col(usage)), F.lit(0).cast("long"), lambda s, v: s + F.coalesce(v, F.lit(0)))


def first_content(messages: Column | str, role: str) -> Column:
    """The first non-empty content of a role."""
    own = F.filter(col(messages), lambda m: (m["role"] == role) & (truthy_strip(m["content"]) != ""))
    return F.try_element_at(own, F.lit(1))["content"]


def chat(*turns: tuple[str, Column]) -> Column:
    return F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in turns))


def with_system(messages: Column | str, system: str) -> Column:
    """The first system message replaced, or one put in front."""
    m = col(messages)
    at = F.array_position(F.transform(m, lambda x: F.coalesce(x["role"], F.lit(""))), "system")
    replaced = F.transform(m, lambda x, i: F.struct(x["role"].alias("role"), F.when(i + 1 == at, F.lit(system)).otherwise(x["content"]).alias("content")))
    return F.when(at > 0, replaced).otherwise(F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), m))


def flattened_content(json_text: Column | str) -> Column:
    """Text of a content that is a string, a list of strings or parts, or an object with a text."""
    v = F.try_parse_json(col(json_text))
    parts = F.try_variant_get(v, "$", "array<variant>")
    texts = F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.try_variant_get(p, "$.content", "string"), F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string"))))
    listed = F.array_join(F.filter(texts, lambda t: F.coalesce(t, F.lit("")) != ""), "\n")
    one = F.coalesce(F.try_variant_get(v, "$.text", "string"), F.try_variant_get(v, "$.content", "string"))
    return truthy_strip(F.when(parts.isNotNull(), listed).otherwise(F.coalesce(one, F.try_variant_get(v, "$", "string"), col(json_text))))


#: Fixed candidate names of columns, the best first.
QUESTION_NAMES = ("question", "prompt", "problem", "instruction", "input", "query")
ANSWER_NAMES = ("response", "answer", "solution", "output", "completion", "r1_solution")


def detect_layout(columns: list[str]) -> tuple[str, str | None, str | None]:
    """('conversations' | 'messages' | 'columns', question column, answer column) of a table of questions and answers."""
    for name in ("conversations", "messages"):
        if name in columns:
            return name, None, None
    question = next((c for c in QUESTION_NAMES if c in columns), None)
    answer = next((c for c in ANSWER_NAMES if c in columns), None)
    if not question or not answer:
        raise ValueError(f"no question and answer among {columns}")
    return "columns", question, answer


def text_pair(layout: tuple[str, str | None, str | None]) -> tuple[Column, Column]:
    """Question and answer columns of a layout, stripped; conversations have `from` and `value` in place of role and content."""
    kind, question, answer = layout
    if kind == "columns":
        return truthy_strip(question), truthy_strip(answer)
    if kind == "messages":
        return truthy_strip(first_content("messages", "user")), truthy_strip(first_content("messages", "assistant"))

    def said(*names: str) -> Column:
        own = F.filter("conversations", lambda m: F.lower(m["from"]).isin(*names) & (truthy_strip(m["value"]) != ""))
        return truthy_strip(F.try_element_at(own, F.lit(1))["value"])

    return said("user", "human"), said("assistant", "gpt")


def stringified(value: Column, is_text: bool) -> Column:
    """Text stripped, null empty, anything else as JSON with its keys in order (those of a variant are)."""
    return truthy_strip(value) if is_text else F.coalesce(F.to_json(F.parse_json(F.to_json(value))), F.lit(""))


def with_contract_message(messages: Column | str, names: Column | str) -> Column:
    """The messages with the contract in the first user message only."""
    m = col(messages)
    at = F.array_position(F.transform(m, lambda x: F.coalesce(x["role"], F.lit(""))), "user")
    return F.transform(m, lambda x, i: F.struct(x["role"].alias("role"), F.when(i + 1 == at, with_contract(x["content"], names)).otherwise(x["content"]).alias("content")))


def first_filled(*lists: Column) -> Column:
    """The first list that has any element; an empty one if none has."""
    empty = F.array().cast("array<string>")
    return F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists), empty)


def case_rows(df, public: str = "public_test_cases", functional: bool = False):
    """Rows that keep a public case: of stdin kind, or of any known kind if functional ones are allowed."""
    listed = cases(public)
    kept = F.concat(stdin_cases(listed), functional_cases(listed)) if functional else stdin_cases(listed)
    return df.withColumn("cases", kept).where(F.size("cases") > 0)


def prompt_messages(system: str, question: Column, names: Column) -> Column:
    """System and user message of a training prompt; the user message names what a solution must define."""
    return chat(("system", F.lit(system)), ("user", with_contract(question, names)))


def normalised_tests(tests: Column, is_text: bool) -> Column:
    """Tests as a list without blank ones, from a list or from one text; null gives an empty list."""
    return visible_tests(F.when(tests.isNotNull(), F.array(tests)) if is_text else tests)
