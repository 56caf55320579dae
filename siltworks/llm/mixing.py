"""Mixing sources to target shares of the total size (problem 6).

Sizes are summed per cell of source and further marginals (language, topic). Iterative proportional fitting rakes the cells to the shares
that each value of a marginal has in the pool and to the sources' target weights, the sources last, so that their shares are exact; a
cell's weight never passes the repeats that its source allows. A row is then used floor(weight) times and once more with the rest as
probability, drawn by the pivotal method along the sizes, so that rows that duel are of like size; the cells of a source duel with each other.

The total is the largest at which every source that has rows meets its weight within its repeats, unless `total` is given; then a
source that cannot meet its weight gives all it may and the others share the rest by their weights.

Defined cases: rows of sources without a weight are not used; sources without rows are reported with a gap; null or negative sizes
count as 0 and such rows are not used; a null value of a marginal is a value; rows with a null key are left out and rows repeated with a
key count once; an empty pool gives an empty mix and a full report; extra columns pass through, but one named `repeats` is replaced. The
weights are a stated list and the values of a marginal are few: the cells are fitted on the driver with a few numbers for each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.pivotal import pivotal_sample
from siltworks.operators.dedup import keep_first
from siltworks.session import materialise


def source_totals(size: np.ndarray, weight: np.ndarray, repeats: np.ndarray, total: float | None) -> np.ndarray:
    """The size that each source is to give: its weight of the total, no more than size * repeats; what is lost goes to the others."""
    most = size * repeats
    weight = np.where(most > 0, weight, 0.0)
    if weight.sum() <= 0:
        return np.zeros(len(size))
    weight = weight / weight.sum()
    if total is None:
        used = weight > 0
        return weight * np.min(most[used] / weight[used])
    fixed = np.full(len(size), np.nan)
    fixed[weight == 0] = 0.0
    while True:
        free = np.isnan(fixed)
        give = np.where(free, 0.0, fixed)
        if free.any():
            give[free] = weight[free] / weight[free].sum() * max(0.0, total - np.nansum(fixed))
        over = free & (give > most)
        if not over.any():
            return give
        fixed[over] = most[over]


def rake(cells: np.ndarray, marginals: list[tuple[np.ndarray, np.ndarray]], cap: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Weights of the cells: sums of weight * size meet the targets of the marginals as near as the caps allow, and those of the last one exactly.

    A marginal is the number of each cell's value and the target of each value.
    """
    weight = np.ones(len(cells))

    def fit(of: np.ndarray, target: np.ndarray) -> None:
        """Scale to the target; cells at their cap stay there and the others make up for them."""
        for _ in range(len(cells) + 1):
            held = weight >= cap * (1 - 1e-12)
            fixed = np.bincount(of, np.where(held, weight * cells, 0.0), len(target))
            loose = np.bincount(of, np.where(held, 0.0, weight * cells), len(target))
            factor = np.divide(np.maximum(target - fixed, 0.0), loose, out=np.ones(len(target)), where=loose > 0)
            over_held = fixed > target * (1 + 1e-12)
            weight[:] = np.where(held & ~over_held[of], weight, weight * np.where(over_held, np.divide(target, fixed + loose, out=np.zeros(len(target)), where=fixed + loose > 0), factor)[of])
            if not (weight > cap * (1 + 1e-12)).any():
                return
            np.minimum(weight, cap, out=weight)

    for _ in range(rounds):
        before = weight.copy()
        for of, target in marginals:
            fit(of, target)
        if np.abs(weight - before).max(initial=0.0) <= tolerance:
            break
    return weight


class SourceMix:
    """rows: any columns with key, source, size and the marginals; weights: source, target_weight, max_repeats."""

    def __init__(self, rows: DataFrame, weights: DataFrame, key: str, source: str, size: str, marginals: list[str], total: float | None = None, seed: int = 42):
        self.key, self.seed = key, seed
        rows = rows.where(F.col(key).isNotNull()).withColumns({"mix_source": F.col(source), "mix_size": F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("double")} | {f"mix_{k}": F.coalesce(F.col(m).cast("string"), F.lit("")) for k, m in enumerate(marginals)})
        self.parts = [f"mix_{k}" for k in range(len(marginals))]
        self.rows = keep_first(rows, [key], ["mix_source", "mix_size", *self.parts])
        cells = self.rows.where(F.col("mix_source").isNotNull() & (F.col("mix_size") > 0)).groupBy("mix_source", *self.parts).agg(F.count("*").alias("rows"), F.sum("mix_size").alias("chars"))
        wanted = weights.groupBy(F.col("source").alias("mix_source")).agg(F.sum("target_weight").alias("target_weight"), F.min("max_repeats").alias("max_repeats"))
        cells = cells.join(wanted.select("mix_source"), "mix_source").toPandas()  # sources with a weight, by the values of the marginals
        self.cells = cells = cells.sort_values(["mix_source", *self.parts], ignore_index=True)
        self.sources = s = wanted.orderBy("mix_source").toPandas()
        at = np.searchsorted(s["mix_source"].to_numpy(str), cells["mix_source"].to_numpy(str)) if len(cells) else np.zeros(0, np.int64)
        s["rows"] = np.bincount(at, cells["rows"], len(s)).astype(np.int64)
        s["chars"] = np.bincount(at, cells["chars"], len(s))
        repeats = s["max_repeats"].fillna(1).to_numpy(float)
        s["wanted"] = source_totals(s["chars"].to_numpy(float), s["target_weight"].fillna(0).to_numpy(float), repeats, total)
        chars = cells["chars"].to_numpy(float)
        fitted = []
        for part in self.parts if len(cells) else []:
            _, of = np.unique(cells[part].to_numpy(str), return_inverse=True)
            pool = np.bincount(of, chars)
            fitted.append((of, pool / pool.sum() * s["wanted"].sum()))
        cells["weight"] = rake(chars, [*fitted, (at, s["wanted"].to_numpy(float))], repeats[at]) if len(cells) else []
        self.used: DataFrame | None = None

    def mix(self) -> DataFrame:
        """The used rows, all columns, with `repeats`, how often each is used."""
        if self.used is None:
            spark, cells = self.rows.sparkSession, self.cells
            whole = np.floor(cells["weight"].to_numpy(float) + 1e-9)
            part = np.clip(cells["weight"].to_numpy(float) - whole, 0, 1)
            # the cells of a source are drawn together, so a source is out by no more than part of a row
            number = {x: i for i, x in enumerate(self.sources["mix_source"])}
            listed = [(*map(str, c), int(w), float(p), number[c[0]]) for c, w, p in zip(cells[["mix_source", *self.parts]].itertuples(index=False, name=None), whole, part)]
            table = spark.createDataFrame(listed, ", ".join(f"{c} string" for c in ("mix_source", *self.parts)) + ", mix_whole int, mix_part double, mix_cell int")  # one row a cell
            joined = self.rows.where("mix_size > 0").join(table, ["mix_source", *self.parts])
            units = joined.where("mix_part > 0").select(F.col("mix_cell").alias("category"), F.col(self.key).alias("key"), F.col("mix_part").alias("prob"), F.col("mix_size").alias("place"))
            extra = pivotal_sample(units, self.seed).select(F.col("key").alias(self.key)).withColumn("mix_extra", F.lit(1))
            used = joined.join(extra, self.key, "left").withColumn("repeats", (F.col("mix_whole") + F.coalesce("mix_extra", F.lit(0))).cast("int"))
            self.used = materialise(used.where("repeats > 0").drop("mix_whole", "mix_part", "mix_cell", "mix_extra", *self.parts), "mix")
        return self.used

    def report(self) -> DataFrame:
        """Per source: target and actual share of all characters, what is there and used, the gap, and why."""
        mixed = self.mix().groupBy("mix_source").agg(F.sum(F.col("mix_size") * F.col("repeats")).alias("used"), F.max("repeats").alias("most"))
        used = {r.mix_source: (r.used, r.most) for r in mixed.collect()}  # one row a source
        all_used, all_wanted = sum(u for u, _ in used.values()) or 1.0, self.sources["wanted"].sum() or 1.0
        out = []
        for r in self.sources.itertuples(index=False):
            u, most = used.get(r.mix_source, (0.0, 0))
            share, planned = u / all_used, r.wanted / all_wanted
            reason = "no rows" if r.rows == 0 else "repeats used up" if planned < r.target_weight - 0.005 else "takes what others lack" if planned > r.target_weight + 0.005 else "met"
            out.append((r.mix_source, float(r.target_weight), int(r.max_repeats), int(r.rows), float(r.chars), float(u), float(share), float(r.target_weight - share), int(most), reason))
        return self.rows.sparkSession.createDataFrame(out, "source string, target_weight double, max_repeats int, rows long, chars double, used_chars double, share double, gap double, most_repeats int, reason string")
