"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 7).

Two passes over whole texts. The first counts pre-tokens in all documents; the most frequent ones (at most
`lexicon_size`, each of at most `max_word_bytes` bytes, so its size is bounded) are compiled with their ids into a
minimal acyclic transducer, written to the shared folder and memory-mapped by the workers. The second pass looks up the
distinct pre-tokens of a batch in the transducer and merges exactly, by ranks, those it does not hold. The result does
not depend on the lexicon, only the speed does.

Defined cases: null and empty texts give an empty list; strings that look like special tokens are ordinary text; blank
and very long texts are encoded whole; repeated rows are each encoded; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.vectext import rebatch
from siltworks.llm.transducer import Transducer, compile_transducer
from siltworks.session import materialise, write_shared

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed values of the public pre-tokenisation pattern: contractions, then letters, numbers, other marks and spaces.
_CONTRACTIONS = "'(?:[sdmt]|ll|ve|re)"
_WIDE_SPACES = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE = r"\t-\r " + "".join(map(chr, _WIDE_SPACES))


def _other_numbers() -> str:
    """The numbers that are not decimal digits, as class ranges; Python's word characters are letters, numbers and `_`."""
    member = np.fromiter((c.isnumeric() and not c.isdecimal() and unicodedata.category(c)[0] == "N" for c in map(chr, range(sys.maxunicode + 1))), np.int8)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], member, [0]])))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2))


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    more = _other_numbers()
    ascii_only = rf"{_CONTRACTIONS}| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
    full = rf"{_CONTRACTIONS}| ?[^\W\d_{more}]+| ?[\d{more}]+| ?(?:[^\w{_SPACE}]|_)+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    return re.compile(ascii_only), re.compile(full)


def pretokens(text: str) -> list[str]:
    """The text cut into pre-tokens; their concatenation is the text."""
    ascii_only, full = _patterns()
    return (ascii_only if text.isascii() else full).findall(text)


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_exactly(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges in order of rank, leftmost first; a heap and a linked list keep long words near-linear."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    import heapq

    n = len(word)
    end = list(range(1, n + 1))  # end[i]: where the part that begins at i ends; 0 once it is merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if i > 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def _is_space(data: np.ndarray) -> np.ndarray:
    """Marks the UTF-8 bytes of white space, single bytes and whole multi-byte characters."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xE3))
    for code in _WIDE_SPACES:
        raw = chr(code).encode()
        at = lead[data[lead] == raw[0]]
        at = at[at + len(raw) <= len(data)]
        for k in range(1, len(raw)):
            at = at[data[at + k] == raw[k]]
        for k in range(len(raw)):
            space[at + k] = True
    return space


def chunk_codes(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Cut every text where the pre-tokenisation pattern cannot cross: before a space that leads a word and around white space.

    Returns the distinct chunks, the code of each chunk in order, and the offsets of the texts in the codes. The pre-tokens of
    a text are those of its chunks, one after the other.
    """
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    if filled.offset or not len(filled):
        filled = pa.concat_arrays([filled, pa.array([], pa.large_string())])
    limits = np.frombuffer(filled.buffers()[1] or b"", np.int64)[: len(filled) + 1] if len(filled) else np.zeros(1, np.int64)
    if len(filled) == 0 or limits[-1] == limits[0]:
        return [], np.zeros(0, np.int64), np.zeros(len(filled) + 1, np.int64)
    data = np.frombuffer(filled.buffers()[2], np.uint8)[limits[0] : limits[-1]]
    limits = limits - limits[0]
    space = _is_space(data)
    first = np.zeros(len(data) + 1, bool)
    first[limits] = True
    change = np.flatnonzero((space[1:] != space[:-1]) & ~first[1:-1]) + 1
    word = change[~space[change]]  # a word after white space of its text
    last = word - 1
    for _ in range(3):
        last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
    first[change[space[change]]] = True
    first[last] = True
    first[word[data[word - 1] != 32]] = True
    edges = np.flatnonzero(first)
    chunks = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data))
    coded = chunks.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), np.searchsorted(edges, limits)


def count_pretokens(docs: DataFrame, text: str = "text", flush: int = 200_000) -> DataFrame:
    """(word, n) over all documents, combined within each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in rebatch(batches):
            chunks, codes, _ = chunk_codes(batch.column(0))
            for chunk, n in zip(chunks, np.bincount(codes, minlength=len(chunks)).tolist()):
                for w in pretokens(chunk):
                    counts[w] = counts.get(w, 0) + n
            if len(counts) > flush:
                yield emit()
        yield emit()

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", lexicon_size: int = 65_536, max_word_bytes: int = 48) -> str:
    """Compile the most frequent pre-tokens; returns the URI of the transducer in the shared folder."""
    counted = materialise(count_pretokens(docs, text).where((F.octet_length("word") <= max_word_bytes) & (F.octet_length("word") > 0) & (F.col("n") > 1)), "words")
    # how many words have which count, by steps of an eighth of a power of two: the counts of all words never meet in one place
    step = F.floor(F.log2("n") * 8).cast("int")
    steps = {r["step"]: r["words"] for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()}  # at most 512 rows
    low, taken = max(steps, default=0), 0
    for low in sorted(steps, reverse=True):
        taken += steps[low]
        if taken >= lexicon_size:
            break
    frequent = counted.where(step >= low).orderBy(F.desc("n"), "word").limit(lexicon_size).select("word").collect()
    ranks = load_ranks(vocabulary)
    entries = {(w := row.word.encode()): merge_exactly(w, ranks) for row in frequent}
    return write_shared(docs.sparkSession, "lexicon.npy", compile_transducer(entries))


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices values[start : start + length] one after the other, and where each begins (with the end as last)."""
    edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return values[np.repeat(starts - edges[:-1], lengths) + np.arange(edges[-1])], edges


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, lexicon_size: int = 65_536) -> DataFrame:
    """(key, ids array<int>) for every row of docs."""
    spark = docs.sparkSession
    uri = build_lexicon(docs, vocabulary, text, lexicon_size)
    with open(vocabulary, "rb") as f:  # on the driver; the workers get it with the lexicon
        ranks_uri = write_shared(spark, "ranks.txt", f.read())
    for file in (uri, ranks_uri):
        spark.sparkContext.addFile(file)
    name, ranks_name = (x.rsplit("/", 1)[1] for x in (uri, ranks_uri))
    opened: dict[str, Transducer] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = SparkFiles.get(name)
        lexicon = opened.get(path) or opened.setdefault(path, Transducer(path))
        for batch in rebatch(batches):
            chunks, codes, limits = chunk_codes(batch.column(1))
            found = [pretokens(c) for c in chunks]
            code: dict[str, int] = {}
            flat = np.fromiter((code.setdefault(w, len(code)) for w in chain.from_iterable(found)), np.int64)
            words = [w.encode() for w in code]
            rows = lexicon.rows(words)
            hit = rows >= 0
            starts, lengths = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            starts[hit] = lexicon.starts[rows[hit]]
            lengths[hit] = lexicon.starts[rows[hit] + 1] - starts[hit]
            pool, at = [lexicon.ids], len(lexicon.ids)
            if not hit.all():
                ranks = load_ranks(SparkFiles.get(ranks_name))
                for i in np.flatnonzero(~hit):
                    ids = merge_exactly(words[i], ranks)
                    starts[i], lengths[i] = at, len(ids)
                    at += len(ids)
                    pool.append(np.array(ids, np.int32))
            table = np.concatenate(pool)
            # ids of each distinct chunk, then of each text, as two gathers
            pool_of, chunk_at = _gather(table, starts[flat], lengths[flat])
            per_chunk = chunk_at[np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])]
            ids, at = _gather(pool_of, per_chunk[codes], per_chunk[codes + 1] - per_chunk[codes])
            lists = pa.ListArray.from_arrays(pa.array(at[limits].astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "ids"])

    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
