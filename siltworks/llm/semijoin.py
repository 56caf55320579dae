"""Semi joins that drop most rows before the shuffle, by a bit table that grows with what is wanted up to a fixed bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LARGEST = 1 << 27


def bit_table(keys: DataFrame, largest: int = LARGEST) -> np.ndarray | None:
    """A table with 16 bits or more for each of the distinct hashes of a column of longs, at most `largest` bits (16 MB).

    None where more were needed: then nothing may be dropped before the join, which is exact in either case.
    """
    column = keys.columns[0]
    distinct = keys.select(F.col(column).alias("hash")).distinct()
    bits = 1 << max(12, (16 * max(1, distinct.count()) - 1).bit_length())
    if bits > largest:
        return None
    slot = F.col("hash").bitwiseAND(bits - 1)
    packed = distinct.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    words = np.zeros(bits // 64, np.uint64)
    found = packed.toPandas()  # at most bits / 64 rows
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return words


def in_table(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.astype(np.uint64) & np.uint64(64 * len(words) - 1)
    return ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def members_of(rows: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = ("src", "id"), largest: int = LARGEST) -> DataFrame:
    """The rows whose keys are among the wanted ones; texts of other rows are hardly shuffled."""
    spark = rows.sparkSession
    wanted = wanted.select(*keys).distinct()
    hashed = F.xxhash64(*keys).alias("hash__")
    table = bit_table(wanted.select(hashed), largest)
    if table is not None:
        shared = spark.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_table(shared.value, batch.column(batch.num_columns - 1).to_numpy())))

        marked = rows.select("*", hashed)
        rows = marked.mapInArrow(run, marked.schema).drop("hash__")
    return rows.join(wanted, list(keys), "left_semi")
