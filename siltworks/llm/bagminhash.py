"""Near-duplicate records by BagMinHash signatures, banding and exact verification (problem 5).

BagMinHash (Ertl, 2018) gives each of `m` registers the smallest arrival time among Poisson processes, one for each element and
each slice of its weight, so that two rows agree in a register with a probability equal to their weighted Jaccard index. The
weight axis is cut at 0, 1, 2, 4, 8, ...; the slice from a to b is a process of rate b - a whose points carry a uniform
height, and a point counts if it lies below the element's weight. Points come in ascending order and an element stops when its
next point lies above all registers of its row, so a row costs about as many points as it has elements plus m log m.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.vectext import distinct_per_row, hash_strings, mix64, rebatch, row_set_keys, shingle_hashes, word_hashes
from siltworks.llm.components import connected_components
from siltworks.llm.semijoin import members_of
from siltworks.session import materialise

_TO_UNIT = 1.0 / (1 << 53)


def _uniform(bits: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from 64 random bits."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * _TO_UNIT


def bagminhash(elements: np.ndarray, weights: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """Arrival times (rows x m) of the distinct elements of each row with their weights; a row without elements keeps inf."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    times = np.full((len(offsets) - 1, m), np.inf)
    slices = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))), 0).astype(np.int64) + 1
    at = np.repeat(np.arange(len(elements)), slices)
    level = np.arange(len(at)) - np.repeat(np.cumsum(slices) - slices, slices)
    low = np.where(level == 0, 0.0, 2.0 ** np.maximum(level - 1, 0))
    width = np.where(level == 0, 1.0, low)
    seed = mix64(elements[at] ^ mix64(level.astype(np.uint64)))
    weight, row = weights[at].astype(np.float64), rows[at]
    time = np.zeros(len(at))
    flat = times.reshape(-1)
    step = 0
    while len(seed):
        with np.errstate(over="ignore"):
            bits = mix64(seed + np.uint64(2 * step + 1))
            time = time - np.log(_uniform(bits)) / width
            more = mix64(seed + np.uint64(2 * step + 2))
        limit = times.max(axis=1)
        below = time < limit[row]
        seed, time, width, low, weight, row, more = (x[below] for x in (seed, time, width, low, weight, row, more))
        height = low + width * ((more >> np.uint64(40)).astype(np.float64) + 0.5) / (1 << 24)
        counts = height < weight
        register = (more & np.uint64(0xFFFFFFFF)) % np.uint64(m)
        np.minimum.at(flat, (row * m + register.astype(np.int64))[counts], time[counts])
        step += 1
    return times


def signature_keys(times: np.ndarray, bands: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the bands (rows x bands) and a bit of each register, packed (rows x ceil(m / 64))."""
    bits = mix64(times.view(np.uint64))
    per_band = bits.shape[1] // bands
    keys = np.full((len(bits), bands), table, np.uint64)
    with np.errstate(over="ignore"):
        keys ^= np.arange(1, bands + 1, dtype=np.uint64)
        for k in range(per_band):
            keys = mix64(keys * np.uint64(0x100000001B3) + bits[:, k : per_band * bands : per_band])
    packed = np.packbits((bits & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little")
    packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
    return keys, packed.view(np.uint64).reshape(len(bits), -1)


def conversation_text(messages: str = "messages") -> Column:
    """The contents of all messages but system ones, in order, joined by a newline; null contents are empty."""
    kept = F.filter(messages, lambda m: ~F.coalesce(F.lower(F.trim(m["role"])) == "system", F.lit(False)))
    return F.array_join(F.transform(kept, lambda m: F.coalesce(m["content"], F.lit(""))), "\n")


def signatures(records: DataFrame, shingle: int, bands: int, rows_per_band: int, weighted: bool, remember: int = 500_000) -> DataFrame:
    """(src, id, set_key, bits0, bits1, bands): one row for each record with at least one shingle.

    `bands` is empty for a record whose shingles its task has met before, so that a hot group of copies shuffles one row a task.
    """
    m = bands * rows_per_band
    if not 64 <= m <= 128:
        raise ValueError("bands * rows_per_band must lie between 64 and 128")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in rebatch(batches, 8 << 20):
            words, at = word_hashes(batch.column(2))
            grams, at = shingle_hashes(words, at, shingle)
            grams, weights, at = distinct_per_row(grams, at)
            if not weighted:
                weights = np.ones_like(weights)
            tables = batch.column(0).to_pylist()
            salts = hash_strings(t or "" for t in tables)
            element = grams if not weighted else mix64(grams ^ mix64(weights.astype(np.uint64)))
            keys = row_set_keys(element, at)
            keys = np.where(keys == 0, 0, mix64(keys ^ salts))
            fresh = np.zeros(len(keys), bool)
            for i, k in enumerate(keys.tolist()):
                if k and k not in met:
                    fresh[i] = True
                    met.add(k)
            if len(met) > remember:
                met.clear()
            index = np.flatnonzero(fresh)
            size = np.diff(at)
            take = np.repeat(fresh, size)
            times = bagminhash(grams[take], weights[take], np.concatenate([[0], np.cumsum(size[index])]), m)
            band_keys, bits = signature_keys(times, bands, 0)
            band_keys = mix64(band_keys ^ salts[index][:, None])
            kept = np.flatnonzero(keys != 0)
            widths = np.where(fresh[kept], bands, 0)
            full = np.zeros((len(keys), 2), np.uint64)
            full[index, : bits.shape[1]] = bits
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)), pa.array(band_keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept)), batch.column(1).take(pa.array(kept)), *(pa.array(x[kept].view(np.int64)) for x in (keys, full[:, 0].copy(), full[:, 1].copy())), lists],
                names=["src", "id", "set_key", "bits0", "bits1", "bands"],
            )

    return records.mapInArrow(run, "src string, id long, set_key long, bits0 long, bits1 long, bands array<long>")


_WORD = re.compile(r"[^\W_]+")


def bag(text: str, shingle: int, weighted: bool) -> Counter | set:
    w = _WORD.findall(text.lower())
    grams = zip(*(w[k:] for k in range(shingle)))
    return Counter(grams) if weighted else set(grams)


def overlap(x: Counter | set, y: Counter | set) -> float:
    """The exact (weighted) Jaccard index of two bags of shingles; 0 if neither has any."""
    if isinstance(x, set):
        both = len(x & y)
        union = len(x) + len(y) - both
    else:
        both, union = (x & y).total(), (x | y).total()
    return both / union if union else 0.0


class NearDuplicates:
    """Classes of equal shingle sets and the links between classes.

    records: (src string, id long, text string), id unique within src; other columns are ignored. Only records of one src are
    compared. Null and empty texts and texts shorter than one shingle are in no class. Rows repeated with the same id count once.
    Very long texts are used whole. Ties and equal texts fall into one class. Empty tables give empty results.

    A band of `rows_per_band` registers is missed by a pair of similarity s with probability (1 - s^rows)^bands: at the defaults
    1.2 % at 0.6, 0.2 % at 0.65, 0.02 % at 0.7 and under 0.0001 % at 0.8. Pairs that share a band must also agree in enough single bits of all
    registers; those left are verified on their texts.
    """

    def __init__(self, records: DataFrame, threshold: float = 0.8, shingle: int = 5, weighted: bool = True, bands: int = 32, rows_per_band: int = 4, hot: int = 1000):
        self.hot = hot
        self.records = records.select(F.col("src").cast("string"), F.col("id").cast("long"), F.col("text").cast("string")).where("id is not null")
        self.threshold, self.shingle, self.weighted = threshold, shingle, weighted
        self.m = bands * rows_per_band
        self.signed = materialise(signatures(self.records, shingle, bands, rows_per_band, weighted), "signatures")

    def classes(self) -> DataFrame:
        """(src, id, set_key): the class of each record."""
        return self.signed.select("src", "id", "set_key").distinct()

    def candidates(self) -> DataFrame:
        """(key_a, key_b): classes that share a band and agree in enough bits.

        A band of more than `hot` classes is cut into blocks of its classes, and every pair of blocks is a task's work of its own.
        """
        m, t = self.m, self.threshold
        agree = (1 + t) / 2
        least = int(m * agree - 3.5 * (m * agree * (1 - agree)) ** 0.5)
        every = self.signed.select(F.explode("bands").alias("band"), "set_key", "bits0", "bits1")
        # a row a task and class at most: the counts are of classes or a little more
        hot = materialise(every.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > self.hot).select("band", F.ceil(F.col("n") / self.hot).cast("int").alias("blocks")), "hot")
        crowded = not hot.isEmpty()
        banded = every.join(hot, "band", "left_anti") if crowded else every
        banded = banded.repartition("band").dropDuplicates(["band", "set_key"])

        def met(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
            a, b = a.alias("a"), b.alias("b")
            differing = F.bit_count(F.col("a.bits0").bitwiseXOR(F.col("b.bits0"))) + F.bit_count(F.col("a.bits1").bitwiseXOR(F.col("b.bits1")))
            same = F.lit(True)
            for c in on:
                same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
            joined = a.join(b, same & (F.col("a.set_key") < F.col("b.set_key")) & (differing <= m - least))
            return joined.select(F.col("a.set_key").alias("key_a"), F.col("b.set_key").alias("key_b"))

        found = met(banded, banded, ["band"])
        if crowded:
            blocked = every.join(hot, "band").dropDuplicates(["band", "set_key"]).withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"))
            cells = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
            cells = cells.repartition("band", "low", "high")
            found = found.unionByName(met(cells, cells, ["band", "low", "high"]))
        return found.distinct()

    def links(self) -> DataFrame:
        """(src, key_a, key_b, similarity): pairs of different classes at or over the threshold, key_a < key_b."""
        shingle, weighted, threshold = self.shingle, self.weighted, self.threshold
        lead = self.signed.groupBy("set_key").agg(F.min_by("src", "id").alias("src"), F.min("id").alias("id"))
        pairs = self.candidates()
        for side in ("a", "b"):
            pairs = pairs.join(lead.select(F.col("set_key").alias(f"key_{side}"), F.col("id").alias(f"id_{side}"), *([F.col("src")] if side == "a" else [])), f"key_{side}")
        pairs = materialise(pairs, "candidates")
        wanted = pairs.select("src", F.explode(F.array("id_a", "id_b")).alias("id"))
        texts = members_of(self.records, wanted).dropDuplicates(["src", "id"])
        for side in ("a", "b"):
            pairs = pairs.join(texts.select("src", F.col("id").alias(f"id_{side}"), F.col("text").alias(f"text_{side}")), ["src", f"id_{side}"])

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rebatch(batches):
                bags: dict[int, Counter | set] = {}  # a class stands in several pairs of a batch

                def of(key: int, text: str) -> Counter | set:
                    found = bags.get(key)
                    if found is None:
                        found = bags[key] = bag(text, shingle, weighted)
                    return found

                keys_a, keys_b, texts_a, texts_b = (batch.column(k).to_pylist() for k in (1, 2, 3, 4))
                score = np.array([overlap(of(a, x), of(b, y)) for a, b, x, y in zip(keys_a, keys_b, texts_a, texts_b)], np.float64)
                kept = pa.array(np.flatnonzero(score >= threshold))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(kept) for k in range(3)), pa.array(score).take(kept)], names=["src", "key_a", "key_b", "similarity"])

        return pairs.select("src", "key_a", "key_b", "text_a", "text_b").mapInArrow(verify, "src string, key_a long, key_b long, similarity double")

    def pairs(self) -> DataFrame:
        """(src, id_a, id_b): all pairs of records at or over the threshold, id_a < id_b, copies expanded."""
        classes = self.classes()
        a = classes.select("src", F.col("set_key").alias("key_a"), F.col("id").alias("x"))
        b = classes.select("src", F.col("set_key").alias("key_b"), F.col("id").alias("y"))
        across = self.links().join(a, ["src", "key_a"]).join(b, ["src", "key_b"])
        across = across.select("src", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        within = a.join(b, (a["src"] == b["src"]) & (F.col("key_a") == F.col("key_b")) & (F.col("x") < F.col("y")))
        return across.unionByName(within.select(a["src"], F.col("x").alias("id_a"), F.col("y").alias("id_b")))

    def groups(self) -> DataFrame:
        """(src, id, group_id, links): the group of each record (its smallest id) and its number of similar records.

        Groups are the connected components of the links between classes; a record without similar ones, or without shingles, is its own group.
        """
        links = materialise(self.links().select("src", "key_a", "key_b"), "links")
        sizes = self.classes().groupBy("set_key").agg(F.count("*").alias("size"), F.min("id").alias("first"))
        both = links.select(F.col("key_a").alias("set_key"), F.col("key_b").alias("other")).union(links.select("key_b", "key_a"))
        linked = both.join(sizes.select(F.col("set_key").alias("other"), F.col("size").alias("n")), "other").groupBy("set_key").agg(F.sum("n").alias("n"))
        component = connected_components(links.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))).withColumnRenamed("node", "set_key")
        per_class = sizes.join(component, "set_key", "left").join(linked, "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
        first = per_class.groupBy("component").agg(F.min("first").alias("group_id"))
        per_class = per_class.join(first, "component").select("set_key", "group_id", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("links"))
        grouped = self.classes().join(per_class, "set_key").select("src", "id", "group_id", "links")
        every = self.records.select("src", "id").distinct().join(grouped, ["src", "id"], "left")
        return every.select("src", "id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
