"""Samples of exact sizes with a reproducible order: rows are ordered by the MD5 of seed and key.

Quotas are worked out from grouped counts; rows are picked by ranks within their group, so the picks are distributed. A global
exact sample is a top-n, which Spark merges from per-task heaps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.session import materialise


def draw(seed: int, key: Column | str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string")))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly n rows (all of a smaller table)."""
    marked = df.withColumn("draw__", draw(seed, key))
    lead = -F.conv(F.substring("draw__", 1, 8), 16, 10).cast("double")
    return top_rows(marked, n, lead, [F.col("draw__"), F.col(key)]).drop("draw__")


def top_rows(df: DataFrame, n: int, lead: Column, order: list[Column], few: int = 10_000, steps: int = 65_536) -> DataFrame:
    """The first n rows in an order that begins with the greatest `lead`, a number.

    Few rows are merged from the tasks' own tops. For many, rows are counted by steps of the lead, whole steps are kept, and only the step
    at the border is sorted, so the n rows never meet in one task.
    """
    if n <= few:
        return df.orderBy(*order).limit(n)
    marked = df.withColumn("lead__", lead.cast("double"))
    ends = marked.agg(F.max("lead__").alias("high"), F.min("lead__").alias("low")).first()
    if ends["high"] is None:
        return df.limit(0)
    width = (ends["high"] - ends["low"]) / steps or 1.0
    marked = marked.withColumn("step__", F.coalesce(F.floor((F.lit(ends["high"]) - F.col("lead__")) / width), F.lit(steps + 1)))
    counts = {r["step__"]: r["n"] for r in marked.groupBy("step__").agg(F.count("*").alias("n")).collect()}  # at most `steps` rows and two
    border, before = -1, 0
    for border in sorted(counts):
        if before + counts[border] >= n:
            break
        before += counts[border]
    whole = marked.where(F.col("step__") < border)
    return whole.unionByName(marked.where(F.col("step__") == border).orderBy(*order).limit(n - before)).drop("lead__", "step__")


def shuffle_positions(df: DataFrame, key: str, seed: int = 42, position: str = "shuffle_pos") -> DataFrame:
    """A position of each row in a full seeded shuffle, from 0: ranks within hash ranges plus the ranges' offsets.

    Ranges are the first three hex digits of the hash, so no task sorts more than about a 4096th of the rows.
    """
    marked = df.withColumn("draw__", draw(seed, key)).withColumn("range__", F.substring("draw__", 1, 3))
    counts = marked.groupBy("range__").agg(F.count("*").alias("n__"))
    offsets = counts.withColumn("offset__", F.sum("n__").over(Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["offset__"]).drop("n__")
    ranked = marked.withColumn("rank__", F.row_number().over(Window.partitionBy("range__").orderBy("draw__", key)))
    joined = ranked.join(offsets, "range__")  # at most 4096 rows
    return joined.withColumn(position, (F.col("offset__") + F.col("rank__") - 1).cast("long")).drop("draw__", "range__", "rank__", "offset__")


def capped(df: DataFrame, group: list[str], cap: int, key: str, seed: int = 42) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(draw(seed, key), key)
    return df.withColumn("rank__", F.row_number().over(w)).where(F.col("rank__") <= cap).drop("rank__")


def strata(df: DataFrame, fields: list[str], missing: str = "__missing__") -> tuple[DataFrame, list[str]]:
    """Adds a stratum from those fields that have any value at all; blanks and nulls count as missing."""
    has = df.agg(*(F.max(F.length(F.trim(F.col(f).cast("string"))) > 0).alias(f) for f in fields)).first()
    used = [f for f in fields if has[f]]
    parts = [F.coalesce(F.nullif(F.trim(F.col(f).cast("string")), F.lit("")), F.lit(missing)) for f in used]
    return df.withColumn("stratum", F.concat_ws("|", *parts) if parts else F.lit(missing)), used


def greedy_stratified(df: DataFrame, stratum: str, target: int, key: str, seed: int = 42) -> DataFrame:
    """Proportional sample: one row a stratum first if they all fit, then always the stratum that lacks most.

    The want of a stratum falls by one with each row it gets, so the greedy choice is one top-n over all rows with their rank k in
    their stratum, ordered by (first rows first, ideal - k, size - k, stratum), all descending.
    """
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size__"))
    sums = sizes.agg(F.sum("size__").alias("total"), F.count("*").alias("groups")).first()
    ranked = df.withColumn("k__", F.row_number().over(Window.partitionBy(stratum).orderBy(draw(seed, key), key)))
    # no stratum gives more than the target, so the tasks may drop the rest before the shuffle
    ranked = ranked.where(F.col("k__") <= target).withColumn("k__", F.col("k__") - 1)
    joined = ranked.join(sizes, stratum)
    want = F.col("size__") / F.lit(sums["total"] or 1) * target - F.col("k__")
    order = [F.desc(want), F.desc(F.col("size__") - F.col("k__")), F.desc(stratum)]
    if sums["groups"] > target:
        return top_rows(joined, target, want, order).drop("k__", "size__")
    rest = top_rows(joined.where("k__ > 0"), target - sums["groups"], want, order)
    return joined.where("k__ = 0").unionByName(rest).drop("k__", "size__")


def largest_remainder(sizes: dict, total: int) -> dict:
    """Whole quotas in proportion to the sizes: at least one a group, no more than its size, remainders to the largest first."""
    if total < len(sizes):
        raise ValueError("fewer places than groups")
    everything = sum(sizes.values())
    total = min(total, everything)
    ideal = {g: n / everything * total for g, n in sizes.items()}
    quota = {g: max(1, min(n, math.floor(ideal[g]))) for g, n in sizes.items()}
    by_rest = sorted(sizes, key=lambda g: (ideal[g] - math.floor(ideal[g]), sizes[g], str(g)), reverse=True)
    while (gap := total - sum(quota.values())) != 0:
        moved = False
        for g in by_rest if gap > 0 else sorted(sizes, key=lambda g: (quota[g] - ideal[g], quota[g], str(g)), reverse=True):
            if gap > 0 and quota[g] < sizes[g]:
                quota[g], gap, moved = quota[g] + 1, gap - 1, True
            elif gap < 0 and quota[g] > 1:
                quota[g], gap, moved = quota[g] - 1, gap + 1, True
            if gap == 0:
                break
        if not moved:
            break
    return quota


def group_quotas(df: DataFrame, group: list[str], total: int, max_groups: int = 100_000) -> DataFrame:
    """(group, size, quota): quotas by largest remainders; the groups' counts are few and worked out on the driver."""
    counts = df.groupBy(*group).agg(F.count("*").alias("size")).orderBy(*group).limit(max_groups + 1).collect()
    if len(counts) > max_groups:
        raise ValueError(f"more than {max_groups} groups")
    quota = largest_remainder({tuple(r[g] for g in group): r["size"] for r in counts}, total) if counts else {}
    kinds = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)
    return df.sparkSession.createDataFrame([(*g, n["size"], quota[g]) for n in counts for g in [tuple(n[x] for x in group)]], f"{kinds}, size long, quota int")


def round_robin(df: DataFrame, group: list[str], bucket: str, quotas: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Within each group one row of each bucket in turn until the quota is full."""
    turn = F.row_number().over(Window.partitionBy(*group, bucket).orderBy(draw(seed, key), key))
    marked = df.withColumn("turn__", turn)
    place = F.row_number().over(Window.partitionBy(*group).orderBy("turn__", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(bucket).cast("string"), F.lit("")))), bucket))
    return marked.withColumn("place__", place).join(quotas.select(*group, "quota"), group).where(F.col("place__") <= F.col("quota")).drop("turn__", "place__", "quota")


def equal_buckets(df: DataFrame, bucket: str, buckets: list, target: int, key: str, seed: int = 42) -> DataFrame:
    """target // k rows a bucket (one more for the first ones); what a bucket lacks is filled from the others' rest, in bucket order."""
    k = len(buckets)
    own = df.where(F.col(bucket).isin(*buckets))
    there = {r[bucket]: r["n"] for r in own.groupBy(bucket).agg(F.count("*").alias("n")).collect()}  # one row a bucket
    quota = {b: min(there.get(b, 0), target // k + (i < target % k)) for i, b in enumerate(buckets)}
    short = target - sum(quota.values())
    for b in buckets:  # what others lack, in bucket order
        more = min(short, there.get(b, 0) - quota[b])
        quota[b], short = quota[b] + more, short - more
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(draw(seed, key), key))
    most = F.create_map(*(x for b, n in quota.items() for x in (F.lit(b), F.lit(n))))
    return own.withColumn("rank__", rank).where(F.col("rank__") <= most[F.col(bucket)]).drop("rank__")


def block_interleave(df: DataFrame, label: str, per_block: dict, key: str, seed: int = 42, blocks: int | None = None) -> DataFrame:
    """Blocks of so many rows of each label in turn; adds the block number and drops rows beyond the wanted blocks."""
    size = F.create_map(*(x for kv in per_block.items() for x in map(F.lit, kv)))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(draw(seed, key), key))
    out = df.where(F.col(label).isin(*per_block)).withColumn("rank__", rank)
    if blocks is not None:
        out = out.where(F.col("rank__") <= blocks * max(per_block.values()))
    out = out.withColumn("block", F.floor((F.col("rank__") - 1) / size[F.col(label)]).cast("int"))
    return (out if blocks is None else out.where(F.col("block") < blocks)).withColumnRenamed("rank__", "place_in_label")


def numbered(df: DataFrame, *order: Column | str, place: str = "place", ranges: int = 64) -> DataFrame:
    """The place of each row in an order, from 0, by a range partitioning: no task sorts more than about its share of the rows."""
    parted = materialise(df.repartitionByRange(ranges, *order).withColumn("part__", F.spark_partition_id()), "ranges")
    sizes = parted.groupBy("part__").agg(F.count("*").alias("n__"))
    offsets = sizes.withColumn("offset__", F.coalesce(F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n__")  # one row a range
    rank = F.row_number().over(Window.partitionBy("part__").orderBy(*order))
    return parted.withColumn("rank__", rank).join(offsets, "part__").withColumn(place, F.col("offset__") + F.col("rank__") - 1).drop("part__", "rank__", "offset__")


def stop_after(df: DataFrame, batch: str, eligible: Column, wanted: int) -> DataFrame:
    """Whole batches up to the one in which the wanted number of eligible rows is reached."""
    per = df.groupBy(batch).agg(F.count_if(eligible).alias("eligible__"))
    before = F.sum("eligible__").over(Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1))
    keep = per.withColumn("before__", F.coalesce(before, F.lit(0))).where(F.col("before__") < wanted).select(batch)
    return df.join(keep, batch)
