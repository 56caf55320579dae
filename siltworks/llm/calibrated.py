"""A sample whose categories have given shares (problem 4).

The pool is reduced to one moment per category (its row count) by a grouped count. The sample is the tilting of the pool that
comes nearest to it in relative entropy and meets the target moments: a row of category c is in with probability
exp(lambda_c + mu), where the multipliers solve the dual by Newton steps. Categories whose probability would pass 1 are fixed at all
their rows, those below their floor at the floor, and the rest is solved again. Rows are drawn with the tilted probabilities by the
pivotal method: each category gets its expected number of rows, rounded up or down, and the whole sample its size.

Defined cases: categories with null parts are matched like any value; rows of categories without a target are not drawn; targets
for empty categories are reported with no rows; rows with a null key are left out and rows repeated with a key count once; an empty
pool gives an empty sample and a full report; repeated targets of a category are summed; extra columns pass through, but one named
`probability` is replaced. The targets are a stated list: the dual is solved on the driver with a few numbers for each target; rows and
their counts stay distributed.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.pivotal import pivotal_sample
from siltworks.operators.dedup import keep_first


def tilt(base: np.ndarray, target: np.ndarray, steps: int = 50, tolerance: float = 1e-10) -> np.ndarray:
    """Counts base * exp(lambda) that meet the target counts, by Newton steps on the dual; categories with base 0 stay 0.

    The dual is sum_c base_c exp(lambda_c) - target_c lambda_c; its gradient is the miss of each moment, its Hessian the counts.
    """
    some = (base > 0) & (target > 0)
    lam = np.zeros(len(base))
    count = np.where(some, base, 0.0).astype(float)
    for _ in range(steps):
        miss = np.where(some, count - target, 0.0)
        if np.abs(miss).sum() <= tolerance * max(1.0, target.sum()):
            break
        step = np.divide(miss, count, out=np.zeros_like(count), where=some)
        lam -= np.clip(step, -2.0, 2.0)  # damped, as far steps overshoot the exponential
        count = np.where(some, base * np.exp(lam), 0.0)
    return count


def plan(available: np.ndarray, share: np.ndarray, floor: np.ndarray, size: int) -> np.ndarray:
    """Expected counts per category: shares of `size`, floors and ceilings kept, what is lost given to the others."""
    floor = np.minimum(floor, available)
    fixed = np.full(len(share), np.nan)
    fixed[available == 0] = 0.0
    size = int(min(size, available.sum()))
    while True:
        free = np.isnan(fixed)
        rest = size - np.nansum(fixed)
        weight = share[free].sum()
        wanted = np.zeros(len(share))
        if weight > 0 and rest > 0:
            wanted[free] = share[free] / weight * rest
        expected = np.where(free, tilt(available.astype(float), wanted), np.nan_to_num(fixed))
        over, under = free & (expected > available), free & (expected < floor)
        # the side that moves more rows is fixed first, so that the loop ends
        if over.any() and (expected - available)[over].sum() >= (floor - expected)[under].sum():
            fixed[over] = available[over]
        elif under.any():
            fixed[under] = floor[under]
        else:
            break
    return expected


class CalibratedSample:
    """rows: any columns with `key` and the category columns; targets: the category columns, target_share, min_rows."""

    def __init__(self, rows: DataFrame, targets: DataFrame, categories: list[str], key: str, fraction: float = 0.2, size: int | None = None, seed: int = 42):
        rows = keep_first(rows.where(F.col(key).isNotNull()), [key], categories)
        self.rows, self.categories, self.key, self.seed = rows, categories, key, seed
        wanted = targets.groupBy(*categories).agg(F.sum("target_share").alias("target_share"), F.max("min_rows").alias("min_rows"))
        counts = rows.groupBy(*categories).agg(F.count("*").alias("available"))
        match = [wanted[c].eqNullSafe(counts[c]) for c in categories]
        condition = match[0]
        for m in match[1:]:
            condition = condition & m
        joined = wanted.join(counts, condition, "left").select(*(wanted[c] for c in categories), "target_share", "min_rows", F.coalesce("available", F.lit(0)).alias("available"))
        self.table = joined.orderBy(*categories).toPandas()  # as many rows as there are targets
        t = self.table
        available = t["available"].to_numpy(np.int64)
        share = t["target_share"].fillna(0).to_numpy(float).clip(min=0)
        share = share / share.sum() if share.sum() > 0 else share
        self.size = int(size if size is not None else math.floor(fraction * available.sum()))
        t["target_rows"] = share * self.size
        t["expected"] = plan(available, share, t["min_rows"].fillna(0).to_numpy(np.int64), self.size)
        t["probability"] = np.minimum(1.0, np.divide(t["expected"], available, out=np.zeros(len(t)), where=available > 0))
        self.drawn: DataFrame | None = None

    def sample(self) -> DataFrame:
        """The drawn rows, all columns, with their inclusion probability."""
        spark, t = self.rows.sparkSession, self.table
        kinds = {c: self.rows.schema[c].dataType.simpleString() for c in self.categories}
        cells = []
        for number, row in enumerate(t[[*self.categories, "probability"]].itertuples(index=False)):
            values = [None if v is None or v != v else int(v) if "int" in k else v for v, k in zip(row, kinds.values())]
            cells.append((*values, float(row[-1]), number))
        schema = ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), "p__ double", "c__ int"])
        table = spark.createDataFrame(cells, schema)  # one row a target
        condition = None
        for c in self.categories:
            m = self.rows[c].eqNullSafe(table[c])
            condition = m if condition is None else condition & m
        joined = self.rows.join(table, condition).select(*(self.rows[c] for c in self.rows.columns if c != "probability"), "p__", "c__").where("p__ > 0")
        if self.drawn is None:
            order = F.xxhash64(self.key, F.lit(self.seed)).cast("double")
            units = joined.select(F.col("c__").alias("category"), F.col(self.key).alias("key"), F.col("p__").alias("prob"), order.alias("place"))
            self.drawn = pivotal_sample(units, self.seed)
        return joined.join(self.drawn.select(F.col("key").alias(self.key)), self.key, "left_semi").drop("c__").withColumnRenamed("p__", "probability")

    def report(self) -> DataFrame:
        """Per target: its share and floor, what is there, what was wanted and drawn, the shares drawn and missed, and why."""
        self.sample()
        t = self.table.copy()
        counts = {r["category"]: r["n"] for r in self.drawn.groupBy("category").agg(F.count("*").alias("n")).collect()}  # one row a target
        t["drawn"] = [counts.get(i, 0) for i in range(len(t))]
        total = max(1, int(t["drawn"].sum()))
        t["drawn_share"] = t["drawn"] / total
        t["gap_rows"] = t["target_rows"] - t["drawn"]
        t["reason"] = np.select(
            [t["available"] == 0, (t["drawn"] == t["available"]) & (t["gap_rows"] >= 1), (t["drawn"] <= t["min_rows"]) & (t["gap_rows"] <= -1), t["gap_rows"] <= -1],
            ["no rows", "too few rows", "raised to its floor", "takes what others lack"],
            "met",
        )
        kinds = {c: self.rows.schema[c].dataType.simpleString() for c in self.categories}
        columns = {"target_share": ("double", float), "min_rows": ("long", int), "available": ("long", int), "target_rows": ("double", float), "drawn": ("long", int), "drawn_share": ("double", float), "gap_rows": ("double", float), "reason": ("string", str)}
        t["min_rows"] = t["min_rows"].fillna(0)
        out = []
        for row in t[[*self.categories, *columns]].itertuples(index=False):
            own = [None if v is None or v != v else int(v) if "int" in k else v for v, k in zip(row, kinds.values())]
            out.append((*own, *(f(v) for v, (_, f) in zip(row[len(own) :], columns.values()))))
        schema = ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), *(f"{c} {k}" for c, (k, _) in columns.items())])
        return self.rows.sparkSession.createDataFrame(out, schema)
