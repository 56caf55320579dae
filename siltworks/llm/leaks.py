"""Held-out test passages in training text, by an FM-index per shard (problem 8).

The items' statements are normalised like the documents; paragraphs that several items share are left out; every run of
`length` words that belongs to one item only is a phrase. Phrases are worked out and counted by joins and grouped counts over the items, and
written as blocks of at most `block` phrases into the shared folder, so neither the driver nor a worker ever holds more than one block,
however many items there are; only the sorted hashes of the phrases' words, eight bytes each, are held whole. Each task cuts its documents
into shards, indexes every word of a shard once, searches the phrases of one block after the other backwards through the wavelet ranks
(those with a word that the shard lacks are dropped before), locates the hits by sampled suffix positions and merges overlapping hits into
removal spans. Documents never leave their task.

Normalisation: invisible characters go, compatibility forms are folded (NFKC), mark-up tags go (inline ones without a gap),
character references are resolved, a word broken at a line end is joined if the joined word is one of the items' words or its
halves are not, case is folded; words are runs of letters and digits.

Defined cases: null, empty and blank texts contain nothing; very long texts are indexed whole; repeated rows each give their
rows; an empty table of documents or of items gives an empty table; items with null text or key have no phrases.
"""

from __future__ import annotations

import html
import io
import re
import unicodedata
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.vectext import hash_strings, rebatch, split_words
from siltworks.llm.fmindex import FMIndex
from siltworks.session import materialise, write_shared

#: Fixed ranges of code points that show nothing: soft hyphen, joiners, fillers, marks of direction, variation selectors, tags.
_HIDDEN = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF),
]
_INVISIBLE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _HIDDEN) + "]")
_INLINE = re.compile(r"</?(?:a|abbr|b|big|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strong|sub|sup|tt|u|var|wbr)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[a-z!][^<>]*>", re.I)
_BROKEN = re.compile(r"([^\W_]+)[-\u2010\u2011]\r?\n[ \t]*(?:[^\w\s]+[ \t]*)*([^\W_]+)")


def plain(text: str | None, known: Container[str] | None = None) -> str:
    """The text with everything undone that does not matter for a passage; `known` are the words that passages have."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
        if not text.isascii():
            text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    if "-\n" in text or "-\r" in text or "\u2010" in text or "\u2011" in text:

        def join(m: re.Match) -> str:
            a, b = m[1].lower(), m[2].lower()
            apart = known is not None and a + b not in known and a in known and b in known
            return f"{m[1]} {m[2]}" if apart else m[1] + m[2]

        text = _BROKEN.sub(join, text)
    return text


_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None, known: Container[str] | None = None) -> list[str]:
    return _WORD.findall(plain(text, known).lower())


class HashedWords:
    """A set of words as the sorted array of their hashes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes

    def __contains__(self, word: str) -> bool:
        h = np.uint64(xxhash.xxh3_64_intdigest(word))
        at = int(np.searchsorted(self.hashes, h))
        return at < len(self.hashes) and self.hashes[at] == h


def _distinct_hashes(column: DataFrame) -> np.ndarray:
    """The sorted distinct values of a column of longs as hashes: eight bytes a word of the held-out set."""
    found = column.distinct().toArrow().column(0).to_numpy().view(np.uint64)
    return np.sort(found)


def _list(values: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)))


def item_phrases(items: DataFrame, length: int = 12, item_key: str = "question_id", item_text: str = "question_content") -> DataFrame:
    """(phrase long, words array<long>, item string): every run of `length` word hashes that one item only has, shared paragraphs left out."""
    spark = items.sparkSession
    held = items.select(F.col(item_key).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null").distinct()

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatch(batches):
            words = sorted({w for t in batch.column(0).to_pylist() for w in words_of(t)})
            yield pa.RecordBatch.from_arrays([pa.array(hash_strings(words).view(np.int64))], names=["word"])

    known = spark.sparkContext.broadcast(_distinct_hashes(held.select("text").mapInArrow(vocabulary, "word long")))

    def paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = HashedWords(known.value)
        for batch in rebatch(batches):
            item, place, words = [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, p in enumerate(re.split(r"\n[^\S\n]*\n", text)):
                    own = words_of(p, have)
                    if own:
                        item.append(name)
                        place.append(k)
                        words.append(hash_strings(own))
            keys = np.fromiter((xxhash.xxh3_64_intdigest(w.tobytes()) for w in words), np.uint64, len(words)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(place, pa.int32()), pa.array(keys), _list(words)], names=["item", "place", "para", "words"])

    parts = materialise(held.mapInArrow(paragraphs, "item string, place int, para long, words array<long>"), "paragraphs")
    shared = parts.groupBy("para").agg(F.min("item").alias("low"), F.max("item").alias("high")).where("low <> high").select("para", F.lit(True).alias("shared"))
    # the paragraphs of one item, a single text, in order; a shared one ends a run
    whole = parts.join(shared, "para", "left").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("place", "shared", "words"))).alias("parts"))
    runs = whole.select("item", F.transform("parts", lambda p: F.when(p["shared"], F.lit(None)).otherwise(p["words"])).alias("parts"))

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                flat: list[np.ndarray] = []
                joined: list[int] = []
                for p in [*parts, None]:
                    if p is not None:
                        joined.extend(p)
                        continue
                    if len(joined) >= length:
                        flat.append(np.lib.stride_tricks.sliding_window_view(np.array(joined, np.int64), length))
                    joined = []
                if flat:
                    rows = np.concatenate(flat)
                    keys = np.fromiter((xxhash.xxh3_64_intdigest(r.tobytes()) for r in rows), np.uint64, len(rows)).view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * length), pa.array(rows.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array(keys), lists, pa.array([name] * len(rows), pa.string())], names=["phrase", "words", "item"])

    every = runs.mapInArrow(phrases, "phrase long, words array<long>, item string")
    once = every.groupBy("phrase").agg(F.min("item").alias("item"), F.max("item").alias("high"), F.first("words").alias("words")).where("item = high")
    return once.select("phrase", "words", "item")


def _blocks(phrases: DataFrame, block: int) -> tuple[str, list[str]]:
    """Writes the sorted hashes of the words and the blocks of phrases into the shared folder; the names of the files on the workers."""
    spark = phrases.sparkSession
    phrases = materialise(phrases, "phrases")
    hashes = _distinct_hashes(phrases.select(F.explode("words").alias("word")))

    def ship(name: str, **arrays: np.ndarray) -> str:
        packed = io.BytesIO()
        np.savez(packed, **arrays)
        uri = write_shared(spark, name, packed.getvalue())
        spark.sparkContext.addFile(uri)
        return uri.rsplit("/", 1)[1]

    count = -(-phrases.count() // block)
    names = []
    for b in range(count):
        part = phrases.where(F.pmod("phrase", F.lit(count)) == b).toArrow()
        words = part.column("words").combine_chunks().flatten().to_numpy().view(np.uint64)
        owner = part.column("item").combine_chunks().dictionary_encode()
        matrix = (np.searchsorted(hashes, words) + 1).astype(np.int32).reshape(part.num_rows, -1)
        names.append(ship(f"phrases{b}.npz", matrix=matrix, owner=owner.indices.to_numpy().astype(np.int32), items=np.array(owner.dictionary.to_pylist(), dtype=str)))
    return ship("words.npz", hashes=hashes), names


def leak_spans(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "question_id",
    item_text: str = "question_content",
    length: int = 12,
    shard_bytes: int = 16 << 20,
    block: int = 500_000,
) -> DataFrame:
    """(key, item_key, start, end): the merged spans of words of each document that stand in an item, end exclusive."""
    words_file, block_files = _blocks(item_phrases(items, length, item_key, item_text), block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = np.load(SparkFiles.get(words_file))["hashes"]
        known, sigma = HashedWords(hashes), len(hashes) + 1
        for batch in rebatch(batches, shard_bytes):
            flat, offsets = split_words(pa.array([plain(t, known) for t in batch.column(1).to_pylist()], pa.large_string()))
            if not len(hashes) or not len(flat):
                continue
            coded = flat.dictionary_encode()
            own = hash_strings(coded.dictionary.to_pylist())
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            symbol = np.where(hashes[at] == own, at + 1, 0).astype(np.int32)
            # one 0 after each text; position of a text's word w: offset + row + w
            rows = len(offsets) - 1
            stream = np.zeros(len(flat) + rows, np.int32)
            stream[np.arange(len(flat)) + np.repeat(np.arange(rows), np.diff(offsets))] = symbol[coded.indices.to_numpy()]
            begin = offsets[:-1] + np.arange(rows)
            index = FMIndex(stream, sigma)
            met: list[tuple[np.ndarray, np.ndarray]] = []
            names: list[str] = []
            for file in block_files:
                with np.load(SparkFiles.get(file)) as part:
                    found, low, high = index.search(part["matrix"])
                    place, which = index.locate(low, high)
                    met.append((place, part["owner"][found[which]].astype(np.int64) + len(names)))
                    names.extend(part["items"].tolist())
            listed = sorted(set(names))
            number = np.searchsorted(np.array(listed, dtype=str), np.array(names, dtype=str))
            position, item = (np.concatenate(x) for x in zip(*met))
            if not len(position):
                continue
            item = number[item]
            row = np.searchsorted(begin, position, "right") - 1
            by = np.lexsort((position, item, row))
            row, item, start = row[by], item[by], (position - begin[row])[by]
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] > start[:-1] + length)
            head = np.flatnonzero(fresh)
            tail = np.append(head[1:], len(row)) - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row[head])), pa.array([listed[i] for i in item[head]], pa.string()), pa.array(start[head]), pa.array(start[tail] + length)],
                names=["key", "item", "start", "end"],
            )

    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = picked.schema["key"].dataType.simpleString()
    spans = picked.mapInArrow(run, f"key {kind}, item string, start long, end long")
    return spans.withColumnsRenamed({"key": key, "item": item_key})


def leaked_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "question_id", **options) -> DataFrame:
    """(key, item_key): each document with each item of which it holds at least `length` consecutive words."""
    return leak_spans(docs, items, key=key, item_key=item_key, **options).select(key, item_key).distinct()


def leaked_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "question_id", **options) -> DataFrame:
    """Every item with the number of documents and of words that leaked, 0 for an item that did not leak."""
    spans = leak_spans(docs, items, key=key, item_key=item_key, **options)
    per_doc = spans.groupBy(item_key, key).agg(F.sum(F.col("end") - F.col("start")).alias("words"))
    found = per_doc.groupBy(item_key).agg(F.count("*").alias("documents"), F.sum("words").alias("words"))
    every = items.select(F.col(item_key).cast("string").alias(item_key)).where(F.col(item_key).isNotNull()).distinct()
    return every.join(found, item_key, "left").na.fill(0, ["documents", "words"])
