"""Sources and sinks: JSON lines, JSON documents, subset lists, configuration, manifests."""

from __future__ import annotations

import json
import os
import tempfile
import tomllib
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPLEX = T.StructType([T.StructField("real", T.DoubleType()), T.StructField("imag", T.DoubleType())])
COMPLEX_TAG = "complex"


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = False) -> DataFrame:
    """JSON lines with a schema; malformed lines are dropped, or fail the read if strict. Blank lines never count."""
    return spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED").schema(schema).json(path)


def read_json_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON list of objects; anything else is an error."""
    head = spark.read.text(path, wholetext=True).select(F.regexp_like(F.col("value"), F.lit(r"^\s*\["))).first()
    if not head or not head[0]:
        raise ValueError(f"{path} holds no JSON list")
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)


def read_splits(spark: SparkSession, paths: list[str], reader=None) -> DataFrame:
    """Union by name of the splits that exist; missing columns are null. No split at all is an error."""
    reader = reader or spark.read.parquet
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(p: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(p)
        return path.getFileSystem(conf).exists(path)

    frames = [reader(p) for p in paths if there(p)]
    if not frames:
        raise FileNotFoundError(f"none of {paths}")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def resolve_version(spark: SparkSession, base: str, name: str | None, tag: str, suffix: str = ".parquet") -> str:
    """The path of a named configuration below `base`, else that of the version tag; neither is an error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    tried = [f"{base}/{n}{suffix}" for n in (name, tag) if n]
    for candidate in tried:
        path = jvm.org.apache.hadoop.fs.Path(candidate)
        if path.getFileSystem(conf).exists(path):
            return candidate
    raise FileNotFoundError(f"none of {tried}")


def read_version(spark: SparkSession, base: str, name: str | None, tag: str, limit: int | None = None) -> DataFrame:
    """The table that resolve_version finds, with at most `limit` rows if that is given."""
    df = spark.read.parquet(resolve_version(spark, base, name, tag))
    return df if limit is None else df.limit(limit)


def decode_complex(c: Column) -> Column:
    """A tagged JSON object {"type": "complex", "real": x, "imag": y} as a struct; other values give null."""
    parsed = F.from_json(c, "type string, real double, imag double")
    return F.when(parsed["type"] == COMPLEX_TAG, F.struct(parsed["real"].alias("real"), parsed["imag"].alias("imag")))


def encode_complex(c: Column) -> Column:
    return F.when(c.isNotNull(), F.to_json(F.struct(F.lit(COMPLEX_TAG).alias("type"), c["real"].alias("real"), c["imag"].alias("imag"))))


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_fan_out(df: DataFrame, outputs: dict[str, list[Column | str]]) -> None:
    """Several projections of one pass, each to its path."""
    kept = df.persist()
    try:
        for path, columns in outputs.items():
            write_json_lines(kept.select(*columns), path)
    finally:
        kept.unpersist()


def write_routed(df: DataFrame, path: str, route: Column, name: str = "route") -> None:
    """One folder a route below the path."""
    df.withColumn(name, route).write.mode("overwrite").partitionBy(name).json(path)


def write_json_atomically(path: str, value: Any) -> None:
    """A small report on the driver's disk: a temporary file beside it, then a rename."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, indent=2)
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


def write_evaluation(graded: DataFrame, prefix: str, key: str, codes: str, verdicts: str, facets: list[str]) -> dict[str, Any]:
    """The four parts of an evaluation: outputs, pass rates per item, all of it, and a summary of pass@1 by facet; returns the summary.

    graded: one row an item with its list of codes and its list of verdicts. The three tables are folders of JSON lines, the summary a file.
    """
    passed = F.avg(F.aggregate(verdicts, F.lit(0.0), lambda n, v: n + v.cast("double")) / F.greatest(F.size(verdicts), F.lit(1)))
    rate = F.aggregate(verdicts, F.lit(0.0), lambda n, v: n + v.cast("double")) / F.greatest(F.size(verdicts), F.lit(1))
    write_json_lines(graded.select(key, codes), f"{prefix}_output")
    write_json_lines(graded.select(key, rate.alias("pass_rate")), f"{prefix}_eval")
    write_json_lines(graded, f"{prefix}_eval_all")
    summary: dict[str, Any] = {"items": graded.count(), "pass_at_1": graded.agg(passed.alias("m")).first()["m"]}
    for f in facets:  # a facet has few values
        summary[f"by_{f}"] = {str(r[f]): r["m"] for r in graded.groupBy(f).agg(passed.alias("m")).orderBy(f).collect()}
    write_json_atomically(f"{prefix}_score_summary.json", summary)
    return summary


def subset_ids(value: Any, unique: bool = True) -> list[str]:
    """Ids of a subset file: {"question_ids": [...]}, {"questions": [{"question_id": ...}]} or a list of either."""
    if isinstance(value, dict):
        value = value.get("question_ids") or value.get("questions") or []
    ids = [str(v["question_id"] if isinstance(v, dict) else v) for v in value]
    if unique and len(set(ids)) != len(ids):
        raise ValueError("repeated ids in the subset")
    return ids


def subset_frame(spark: SparkSession, ids: list[str], key: str = "question_id") -> DataFrame:
    return spark.createDataFrame([(v, i) for i, v in enumerate(ids)], f"{key} string, place int")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of all files below a folder."""
    root = path.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"))
    return files.select(F.regexp_replace("path", r"^.*?" + root.lstrip("/").replace("\\", "/") + "/", "").alias("path"), "bytes")


def histogram(df: DataFrame, value: Column, bins: int = 20) -> DataFrame:
    """(bin, low, high, n) over equal bins between the least and the greatest value; nulls are left out."""
    span = df.agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high")).first()
    if span["low"] is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    width = (span["high"] - span["low"]) / bins or 1.0
    b = F.least(F.floor((value.cast("double") - span["low"]) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(value.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("bin", (F.lit(span["low"]) + F.col("bin") * width).alias("low"), (F.lit(span["low"]) + (F.col("bin") + 1) * width).alias("high"), "n")


def _scalar(text: str) -> Any:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    low = text.lower()
    if low in ("", "null", "none", "~"):
        return None
    if low in ("true", "false"):
        return low == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


@dataclass
class RunConfig:
    """Settings of trace rendering and judging; unknown keys of a file are an error."""

    feedback: str = "public"
    max_turns: int = 3
    prompt_budget: int = 3000
    long_prompt_budget: int = 6000
    compact: bool = True
    timeout_seconds: float = 10.0
    output_limit: int = 4000
    min_fail_turns: int = 2
    max_fail_turns: int = 3

    def budget(self, prompt_tokens: int) -> int:
        return self.long_prompt_budget if prompt_tokens * 2 > self.prompt_budget else self.prompt_budget


def read_config(path: str) -> RunConfig:
    """From .json, .toml or a flat `key: value` file with comments."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        values = json.loads(text)
    elif path.endswith(".toml"):
        values = tomllib.loads(text)
    else:
        lines = (s.split(" #")[0].rstrip() for s in text.splitlines() if s.strip() and not s.lstrip().startswith("#"))
        values = {k.strip(): _scalar(v) for k, _, v in (s.partition(":") for s in lines)}
    unknown = set(values) - {f.name for f in fields(RunConfig)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return RunConfig(**values)
