"""Sampling with given inclusion probabilities by the pivotal method (Deville and Tillé, 1998), in blocks.

Two units duel: one takes as much of the other's probability as it can, until each unit is in or out. Within a block the duels go
along the order of the units, so neighbours share their fate and the sample is spread over that order. Each block leaves at most
one undecided unit; these duel in the next round, so no task ever holds more than about one block, however hot a category is or however many
categories there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.vectext import mix64
from siltworks.session import materialise

_EPS = 1e-9


def duel_along(prob: np.ndarray, dice: np.ndarray) -> np.ndarray:
    """Probabilities after all duels along the array: 0, 1 and at most one value between; dice are uniform in (0, 1)."""
    out = prob.copy()
    holder = -1
    for j, (p, u) in enumerate(zip(prob.tolist(), dice.tolist())):
        if p <= _EPS or p >= 1 - _EPS:
            out[j] = round(p)
            continue
        if holder < 0:
            holder = j
            continue
        h = out[holder]
        total = h + p
        if total < 1:
            loser, keeper = (holder, j) if u * total < p else (j, holder)
            out[loser], out[keeper] = 0.0, total
        else:
            winner, keeper = (holder, j) if u * (2 - total) < 1 - p else (j, holder)
            out[winner], out[keeper] = 1.0, total - 1
        holder = keeper if _EPS < out[keeper] < 1 - _EPS else -1
        if holder < 0:
            out[keeper] = round(out[keeper])
    return out


def pivotal_sample(units: DataFrame, seed: int = 42, block: int = 50_000) -> DataFrame:
    """units: (category int, key long, prob double, place double) -> (category, key) of the units that are in.

    Units duel within their category first, so that each category gets its expected number of units, up or down; the at most one that is
    left of each category then duels with those of the others, so that the whole sample has its expected size. `place` orders the units of
    a category (for example a size), ties are broken by a hash of the key, equal rows fall side by side. Null keys are dropped.
    """
    kinds = "category int, key long, prob double, place double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))  # one block
        if not table.num_rows:
            return
        category, key, prob, place = (table.column(k).to_numpy() for k in range(4))
        hashed = mix64(key.astype(np.int64).view(np.uint64) ^ np.uint64(seed))
        order = np.lexsort((hashed, place))
        dice = ((mix64(hashed ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        after = duel_along(prob[order], dice[order])
        kept = after > 0
        yield pa.RecordBatch.from_arrays([pa.array(category[order][kept]), pa.array(key[order][kept]), pa.array(after[kept]), pa.array(place[order][kept])], names=["category", "key", "prob", "place"])

    now = units.select(F.col("category").cast("int"), F.col("key").cast("long"), F.col("prob").cast("double"), F.col("place").cast("double")).where("key is not null and prob > 0")
    now = materialise(now, "units")
    chosen = now.where("prob >= 1").select("category", "key")
    now = now.where("prob < 1")
    for pool in (F.col("category"), F.lit(0)):
        while True:
            pooled = now.withColumn("pool", pool)
            blocks = pooled.groupBy("pool").agg(F.ceil(F.count("*") / block).alias("blocks"))
            most = blocks.agg(F.max("blocks")).first()[0] or 0
            salted = pooled.join(blocks, "pool").withColumn("salt", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("blocks")))
            done = materialise(salted.groupBy("pool", "salt").applyInArrow(lambda t: _block(t, run), kinds), "duels")
            chosen = chosen.unionByName(done.where("prob >= 1").select("category", "key"))
            now = done.where("prob < 1")
            if most <= 1:
                break
    # what is left of a whole number of expected units is rounding
    return chosen.unionByName(now.where("prob >= 0.5").select("category", "key"))


def _block(table: pa.Table, run) -> pa.Table:
    picked = table.select(["category", "key", "prob", "place"]).combine_chunks()
    out = list(run(iter(picked.to_batches())))
    schema = pa.schema([("category", pa.int32()), ("key", pa.int64()), ("prob", pa.float64()), ("place", pa.float64())])
    return pa.Table.from_batches([b.cast(schema) if b.schema != schema else b for b in out], schema)
