"""Source files that do not parse (problem 3).

The languages are ranked by the tokens of the text, and every text is parsed by all grammars in that order. The grammars that take it
tell what it is: none, then the text is corrupt; only foreign ones, then it has the wrong extension and the best ranked of them names
its true language; its own among them, then it is valid, unless a foreign one that takes it too outranks its own by far, whose tokens
the text lacks.

Defined cases: null and blank texts, and texts of invisible characters only, are no cases; a byte order mark is taken off; one fence that wraps the whole text is taken off; an unknown or null language
is the best ranked one; repeated rows of a key give one row; very long texts are parsed whole; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.vectext import hash_strings, rebatch
from siltworks.llm.grammars import ALIASES, GRAMMARS, parses, rank_languages

_WRAPPED = re.compile(r"\s*(`{3,}|~{3,})[^\n]*\n(.*?)(?:^[ \t]*)?\1[ \t]*\s*\Z", re.S | re.M)
_HIDDEN = re.compile("[\\s" + "".join(map(chr, [0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF])) + "]+")
_FENCE_LINE = re.compile(r"^[ \t]*(?:```|~~~)", re.M)


def unwrap(text: str) -> str:
    """The inside of the one fence that wraps the whole text, else the text."""
    m = _WRAPPED.match(text) if text.lstrip()[:3] in ("```", "~~~") else None
    return m[2] if m and not _FENCE_LINE.search(m[2]) else text


def diagnose(text: str, lang: str | None, clear: float = 1.0, little: float = 1.0) -> tuple[bool, str | None, int]:
    """(valid, language whose grammar takes the text or None, number of grammars that take it)."""
    text = unwrap(text).removeprefix("\ufeff")
    if not _HIDDEN.sub("", text):
        return True, None, 0
    ranked = rank_languages(text)
    score = dict(ranked)
    own = (lang or "").strip().lower()
    own = ALIASES.get(own, own)
    if own not in GRAMMARS:
        own = ranked[0][0]
    takers = [x for x, _ in ranked if parses(text, x, x == own)]
    if own not in takers:
        return False, takers[0] if takers else None, len(takers)
    if takers[0] != own and score[own] <= little and score[takers[0]] >= score[own] + clear:
        return False, takers[0], len(takers)
    return True, own, len(takers)


def check_syntax(files: DataFrame, remember: int = 200_000) -> DataFrame:
    """files: (src, id, lang, text); returns (src, id, valid boolean, parsed_as string, grammars int) of all rows with a visible text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str | None, int], tuple[bool, str | None, int]] = {}
        for batch in rebatch(batches):
            langs, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            kept = [i for i, t in enumerate(texts) if t and not t.isspace()]
            found = []
            for i, h in zip(kept, hash_strings(texts[i] for i in kept).tolist()):
                key = (langs[i], h)
                if key not in known:
                    if len(known) > remember:
                        known.clear()
                    known[key] = diagnose(texts[i], langs[i])
                found.append(known[key])
            take = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array([f[0] for f in found], pa.bool_()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int32())],
                names=["src", "id", "valid", "parsed_as", "grammars"],
            )

    return files.select("src", "id", "lang", "text").mapInArrow(run, "src string, id string, valid boolean, parsed_as string, grammars int")


def stored_files(turns: DataFrame, code_instruct: DataFrame) -> DataFrame:
    a = turns.select(F.lit("turns").alias("src"), F.concat_ws(":", "run_id", F.col("turn_index").cast("string")).alias("id"), F.lit("python").alias("lang"), F.col("parsed_submit").alias("text"))
    b = code_instruct.select(F.lit("code_instruct").alias("src"), F.col("row_id").cast("string").alias("id"), F.col("lang"), F.col("solution").alias("text"))
    return a.unionByName(b).where("id is not null")


def invalid_rates(turns: DataFrame, traces: DataFrame, code_instruct: DataFrame) -> DataFrame:
    """(src, repo, lang, files, invalid, wrong_language, rate) per repository and language; a null repository is a group."""
    verdicts = check_syntax(stored_files(turns, code_instruct)).dropDuplicates(["src", "id"])
    runs = traces.groupBy("run_id").agg(F.max("task.dataset").alias("repo"))
    a = verdicts.where("src = 'turns'").withColumn("run_id", F.regexp_replace("id", r":[^:]*$", "")).join(runs, "run_id", "left").select("src", "repo", F.lit("python").alias("lang"), "valid", "parsed_as")
    own = code_instruct.groupBy(F.col("row_id").cast("string").alias("id")).agg(F.max("repo").alias("repo"), F.max(F.lower(F.trim("lang"))).alias("lang"))
    b = verdicts.where("src = 'code_instruct'").join(own, "id", "left").select("src", "repo", "lang", "valid", "parsed_as")
    grouped = a.unionByName(b).groupBy("src", "repo", "lang").agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if(~F.col("valid") & F.col("parsed_as").isNotNull()).alias("wrong_language"))
    return grouped.withColumn("rate", F.col("invalid") / F.col("files"))
