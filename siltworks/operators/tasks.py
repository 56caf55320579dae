"""Rows of other shapes to tasks and questions: adapters and conversions, as projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions import arrays as A
from siltworks.functions.text import strip, truthy_strip

END_SPACE = r"[\t-\r \x1c-\x1f\x85\p{Z}]+$"


def first_there(df: DataFrame, *names: str) -> Column:
    """The first of the columns that exist and hold a text that is not empty, as text; else an empty text."""
    there = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there, F.lit(""))


def _kept(df: DataFrame, **fields: str) -> Column:
    """A JSON object of those fields whose columns exist and are not null."""
    return F.to_json(F.struct(*(F.col(c).alias(f) for f, c in fields.items() if c in df.columns)))


def _task(df: DataFrame, scenario: str | None, benchmark: str, dataset: str, task_id: Column, prompt: Column, tests: Column) -> DataFrame:
    named = [F.lit(v).cast("string").alias(n) for n, v in (("benchmark", benchmark), ("dataset", dataset), ("scenario", scenario), ("language", "python"))]
    return df.select(*named, task_id.alias("task_id"), prompt.alias("prompt"), tests.alias("tests_metadata"))


def function_tasks(df: DataFrame, benchmark: str, dataset: str) -> DataFrame:
    """Rows with a prompt and assertions, a test module or inputs for a differential run."""
    fields = ("entry_point", "test", "tests", "test_list", "base_input", "plus_input", "canonical_solution", "prompt")
    prompt = first_there(df, "prompt", "question", "instruction")
    return _task(df, None, benchmark, dataset, first_there(df, "task_id", "id", "name"), prompt, _kept(df, **{f: f for f in fields}))


def public_examples(cases: Column, most: int = 3) -> Column:
    """The first cases as numbered examples; null without a case."""
    edges = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\n+|\n+$", "")
    shown = F.transform(F.slice(cases, 1, most), lambda x, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit("\nInput:\n"), edges(x["input"]), F.lit("\nOutput:\n"), edges(x["output"])))
    return F.when(F.size(cases) > 0, F.array_join(shown, "\n\n"))


def case_tasks(df: DataFrame, benchmark: str, dataset: str, scenario: str = "cases") -> DataFrame:
    """Rows with a question and test cases; the first public ones are shown in the prompt."""
    public, private = A.cases(first_there(df, "public_test_cases", "sample_tests")), A.cases(first_there(df, "private_test_cases", "hidden_tests"))
    examples = public_examples(public)
    question = first_there(df, "prompt", "question_content", "question")
    prompt = F.when(examples.isNull(), question).otherwise(F.concat(F.regexp_replace(question, END_SPACE, ""), F.lit("\n\nPublic examples:\n"), examples))
    tests = F.to_json(F.struct(public.alias("public_test_cases"), private.alias("private_test_cases"), first_there(df, "metadata").alias("metadata")))
    return _task(df, scenario, benchmark, dataset, first_there(df, "task_id", "question_id", "id"), prompt, tests)


def module_tasks(df: DataFrame, benchmark: str, dataset: str) -> DataFrame:
    """Rows with a question and a module of tests."""
    fields = {"test": "test", "test_info": "test_info", "reference_solution": "solution", "subset": "subset", "difficulty": "gpt_difficulty", "metadata": "metadata"}
    return _task(df, "module_tests", benchmark, dataset, first_there(df, "task_id", "question_id", "id"), strip(first_there(df, "prompt", "question")), _kept(df, **fields))


#: Adapters by the kind of test.
ADAPTERS: dict[str, Callable[..., DataFrame]] = {"functions": function_tasks, "cases": case_tasks, "module": module_tasks}


def question_rows(df: DataFrame, stdin_only: bool = True, include_private: bool = False) -> DataFrame:
    """Questions with their starter code in the prompt and their cases as lists; those without a public case are left out."""
    kept = A.stdin_cases if stdin_only else lambda c: c
    starter = truthy_strip("starter_code")
    content = F.coalesce("question_content", F.lit(""))
    prompt = F.when(starter == "", content).otherwise(F.concat(F.regexp_replace(content, END_SPACE, ""), F.lit("\n\nStarter code:\n"), starter))
    out = df.withColumns({"question_content": prompt, "public_test_cases": kept(A.cases("public_test_cases")), "private_test_cases": kept(A.cases("private_test_cases"))}).where(F.size("public_test_cases") > 0)
    return out if include_private else out.drop("private_test_cases")


def module_rows(df: DataFrame, subset: str | None = None, difficulty: str | None = None, least_pass: float | None = None) -> DataFrame:
    """Rows with a question and a test module, by up to three filters; a missing pass percentage fails its filter."""
    kept = df.where((truthy_strip("question") != "") & (truthy_strip("test") != ""))
    if subset:
        kept = kept.where(F.col("subset") == subset)
    if difficulty:
        kept = kept.where(F.col("gpt_difficulty") == difficulty)
    return kept if least_pass is None else kept.where(F.col("gpt_pass_percentage") >= least_pass)
