"""Languages of documents and of their segments (problem 9): multinomial naive Bayes over hashed character n-grams.

The model is fitted on at most `sample_rows` labelled documents (those with the smallest hashes of the key: ranges of hashes are counted and
only rows of the ranges that are wanted are sorted, so the bound holds at any size): each task counts the hashed uni- and trigrams of the prose per label, the counts are summed per bin, and a second fit uses only
the paragraphs that the first model gives the language of their label, which removes wrong labels and foreign paragraphs. The
log-probability matrix (bins x 8) is broadcast; a batch is scored as one flat array of code points, n-gram rows gathered and
summed per sentence. Sentences vote within their paragraph; runs of sentences of one language are the segments.

No prose, and blanked before: fenced code, what stands between submit tags, table lines, tags. A language counts for a document
if a segment has at least 12 words, or 30 characters of zh or ja.

Defined cases: null, empty and blank texts, and texts without prose, have no segments; a label may be null, a placeholder, any
usual spelling or several names; very long texts are scored whole; repeated rows give their rows; an empty table gives an empty
table; without any labelled row the model is flat and no language is found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.vectext import rebatch

LANGS = ("en", "zh", "es", "de", "fr", "pt", "ru", "ja")
#: Fixed spellings of the languages in labels, apart from the two-letter codes.
NAMES = {
    "english": "en", "eng": "en", "inglés": "en", "anglais": "en", "englisch": "en",
    "chinese": "zh", "zho": "zh", "chi": "zh", "cmn": "zh", "mandarin": "zh", "中文": "zh", "汉语": "zh", "漢語": "zh", "简体中文": "zh", "zh-hans": "zh", "zh-hant": "zh", "cn": "zh",
    "spanish": "es", "spa": "es", "español": "es", "espanol": "es", "castellano": "es", "castilian": "es",
    "german": "de", "deu": "de", "ger": "de", "deutsch": "de",
    "french": "fr", "fra": "fr", "fre": "fr", "français": "fr", "francais": "fr",
    "portuguese": "pt", "por": "pt", "português": "pt", "portugues": "pt",
    "russian": "ru", "rus": "ru", "русский": "ru",
    "japanese": "ja", "jpn": "ja", "日本語": "ja", "jp": "ja",
}
BINS = 1 << 17
_NO_PROSE = re.compile(r"(?:^|(?<=[ \t]))(`{3,}|~{3,})[^\n`]*\n.*?(?:^[ \t]*\1`*[ \t]*$|\Z)|<submit>.*?(?:</submit>|\Z)|^[ \t]*\|[^\n]*$|</?[a-zA-Z!][^<>\n]{0,200}>", re.M | re.S)


def label_languages(label: str | None) -> list[str]:
    """The languages a label names, in order; placeholders and programming languages name none."""
    found: list[str] = []
    for part in re.split(r"[\s;,/+&|]+", (label or "").strip().lower()):
        part = part.strip("()[]{}\"'.:")
        code = NAMES.get(part) or NAMES.get(re.split(r"[-_]", part)[0]) or re.split(r"[-_]", part)[0]
        if code in LANGS and code not in found:
            found.append(code)
    return found


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each BMP code point, 32 for what is no letter; and which are Han or kana."""
    low = np.full(1 << 16, 32, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            x = c.lower()
            low[i] = ord(x) if len(x) == 1 else i
    cjk = np.zeros(1 << 16, bool)
    for a, b in ((0x3005, 0x3007), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)):
        cjk[a : b + 1] = True
    return low, cjk


class Pieces:
    """The sentences of a batch of texts as flat arrays.

    For sentence k: row[k], para[k] (number of its paragraph in the batch), start[k] and end[k] (code points in its text), words[k],
    cjk[k] (characters), letters[k]; grams and gram_piece list the hashed n-grams.
    """

    def __init__(self, texts: list[str | None]):
        texts = [t or "" for t in texts]
        joined = "\0".join(texts) + "\0"
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        base = np.concatenate([[0], np.cumsum(lengths + 1)])
        low, is_cjk = _tables()
        small = np.where(raw < (1 << 16), raw, 0xFFFF)
        x = low[small]
        cjk = is_cjk[small]
        spans = [(int(b) + m.start(), int(b) + m.end(), m[0][0] == "<" and not m[0].startswith("<submit>")) for t, b in zip(texts, base) if "`" in t or "<" in t or "|" in t or "~~~" in t for m in _NO_PROSE.finditer(t)]
        cut = np.zeros(len(raw), bool)  # a new paragraph begins here
        for a, b, tag in spans:
            x[a:b] = 32
            cjk[a:b] = False
            if not tag:
                cut[a] = True
        ends = (raw == 0) | (raw == 46) | (raw == 33) | (raw == 63) | (raw == 0x3002) | (raw == 0xFF01) | (raw == 0xFF1F)
        # blank lines: two line ends with only blanks between
        solid = np.flatnonzero((raw != 32) & (raw != 9) & (raw != 13))
        y = raw[solid]
        cut[solid[1:][(y[1:] == 10) & (y[:-1] == 10)]] = True
        cut[base[:-1]] = True
        begins = cut.copy()
        begins[1:] |= ends[:-1]
        piece_start = np.flatnonzero(begins)
        piece_of = np.cumsum(begins) - 1
        para_of = np.cumsum(cut) - 1
        letter = x != 32
        word = letter & ~cjk
        word[1:] &= ~(letter[:-1] & ~cjk[:-1])
        n = len(piece_start)
        self.words = np.bincount(piece_of[word], minlength=n)
        self.cjk = np.bincount(piece_of[cjk], minlength=n)
        self.letters = np.bincount(piece_of[letter], minlength=n)
        self.row = np.searchsorted(base, piece_start, "right") - 1
        self.para = para_of[piece_start]
        self.start = piece_start - base[self.row]
        self.end = np.append(piece_start[1:], len(raw)) - base[self.row]
        self.end = np.minimum(self.end, lengths[self.row])
        # n-grams over single blanks
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        at = np.flatnonzero(keep)
        z = x[at]
        mask = np.uint32(BINS - 1)
        with np.errstate(over="ignore"):
            one = (z * np.uint32(0x9E3779B1)) >> np.uint32(13) & mask
            mid = z[1:-1] * np.uint32(0x85EBCA6B) + z[:-2] * np.uint32(0xC2B2AE35) + z[2:] * np.uint32(0x27D4EB2F) if len(z) > 2 else z[:0]
            three = (mid ^ (mid >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(11) & mask
        solo = z != 32
        self.grams = np.concatenate([one[solo], three])
        self.gram_piece = np.concatenate([piece_of[at[solo]], piece_of[at[1:-1]] if len(z) > 2 else piece_of[:0]])
        self.singles = int(solo.sum())

    def scores(self, model: np.ndarray) -> np.ndarray:
        """Log-likelihood of each sentence under each language (sentences x languages)."""
        out = np.zeros((len(self.row), model.shape[1]), np.float64)
        for part in (slice(0, self.singles), slice(self.singles, None)):
            grams, piece = self.grams[part], self.gram_piece[part]
            for a in range(0, len(grams), 1 << 20):
                g, p = grams[a : a + (1 << 20)], piece[a : a + (1 << 20)]
                first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
                out_at = p[first]
                np.add.at(out, out_at, np.add.reduceat(model[g], first, axis=0))
        return out


def _paragraph_sums(values: np.ndarray, para: np.ndarray) -> np.ndarray:
    if not len(para):
        return values
    first = np.flatnonzero(np.concatenate([[True], para[1:] != para[:-1]]))
    return np.repeat(np.add.reduceat(values, first, axis=0), np.diff(np.append(first, len(para))), axis=0)


def sentence_languages(pieces: Pieces, model: np.ndarray, margin: float = 12.0) -> tuple[np.ndarray, np.ndarray]:
    """(language number or -1, margin of the best over the second) of each sentence.

    A sentence has the language of its paragraph unless its own scores beat that by `margin`; one with too few letters has -1.
    """
    scores = pieces.scores(model)
    own = scores.argmax(axis=1)
    whole = _paragraph_sums(scores, pieces.para)
    lang = whole.argmax(axis=1) if len(whole) else own
    index = np.arange(len(own))
    better = scores[index, own] - scores[index, lang] > margin
    lang = np.where(better, own, lang)
    ordered = np.sort(scores, axis=1)
    gap = ordered[:, -1] - ordered[:, -2]
    few = (pieces.letters < 8) & (pieces.cjk < 2)
    return np.where(few, -1, lang), gap


def _log_model(counts: np.ndarray, alpha: float = 0.5) -> np.ndarray:
    smoothed = counts + alpha
    return np.log(smoothed / smoothed.sum(axis=0, keepdims=True)).astype(np.float32)


def _count_grams(sample: DataFrame, model: np.ndarray | None) -> np.ndarray:
    """(bins x languages) counts over the sample's prose; with a model, only of paragraphs that it gives their label's language."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BINS, len(LANGS)), np.int32)
        for batch in rebatch(batches, 8 << 20):
            label = np.array([LANGS.index(x) for x in batch.column(0).to_pylist()], np.int64)
            pieces = Pieces(batch.column(1).to_pylist())
            if not len(pieces.grams):
                continue
            lang = label[pieces.row]
            use = np.ones(len(lang), bool)
            if shared.value is not None:
                use = _paragraph_sums(pieces.scores(shared.value), pieces.para).argmax(axis=1) == lang
            keep = use[pieces.gram_piece]
            flat = pieces.grams[keep].astype(np.int64) * len(LANGS) + lang[pieces.gram_piece[keep]]
            total += np.bincount(flat, minlength=BINS * len(LANGS)).reshape(BINS, len(LANGS)).astype(np.int32)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(total[used, k].astype(np.int64)) for k in range(len(LANGS)))], names=["bin", *LANGS])

    partial = sample.mapInArrow(run, "bin long, " + ", ".join(f"{x} long" for x in LANGS))
    rows = partial.groupBy("bin").agg(*(F.sum(x).alias(x) for x in LANGS)).toPandas()  # at most BINS rows
    counts = np.zeros((BINS, len(LANGS)))
    if len(rows):
        counts[rows["bin"].to_numpy()] = rows[list(LANGS)].to_numpy()
    return counts


def _single_label(docs: DataFrame, key: str, label: str) -> DataFrame:
    """(key, one): the language of each row whose label names one language only; every label is read, whatever its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            named = [label_languages(x) for x in coded.dictionary.to_pylist()]
            one = pa.array([x[0] if len(x) == 1 else None for x in named], pa.string())
            found = one.take(coded.indices)
            kept = found.is_valid()
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), found.filter(kept)], names=["key", "one"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(label).cast("string").alias("label")).where("key is not null and label is not null").mapInArrow(run, f"key {kind}, one string")


def fit_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample_rows: int = 10_000, ranges: int = 1 << 16) -> np.ndarray:
    """The log-probability matrix, fitted on at most `sample_rows` rows whose label names one language."""
    labelled = _single_label(docs, key, label).withColumn("hash", F.xxhash64("key")).withColumn("range", F.pmod(F.shiftright("hash", 24), F.lit(ranges)).cast("int"))
    counts = {r["range"]: r["n"] for r in labelled.groupBy("range").agg(F.count("*").alias("n")).collect()}  # at most `ranges` rows
    if not counts:
        return np.zeros((BINS, len(LANGS)), np.float32)
    last, before = -1, 0
    for last in sorted(counts):
        if before + counts[last] >= sample_rows:
            break
        before += counts[last]
    picked = labelled.where(F.col("range") <= last).orderBy("range", "hash", "key").limit(sample_rows)
    sample = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(picked.select("key", "one").dropDuplicates(["key"])), "key").select("one", "text")
    first = _log_model(_count_grams(sample, None))
    return _log_model(_count_grams(sample, first))


def language_segments(docs: DataFrame, model: np.ndarray, key: str = "doc_id", text: str = "text", label: str = "lang", min_words: int = 12, min_cjk: int = 30, temperature: float = 8.0) -> DataFrame:
    """(key, segment, start, end, lang, confidence, prose, named): the runs of sentences of one language in each paragraph.

    start and end are code points of the text; `prose` tells a segment of at least min_words words or min_cjk characters of zh or ja;
    `named` whether the row's label names the language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    wide = np.array([x in ("zh", "ja") for x in LANGS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatch(batches, 8 << 20):
            pieces = Pieces(batch.column(1).to_pylist())
            lang, gap = sentence_languages(pieces, shared.value)
            if not shared.value.any():
                lang[:] = -1
            known = np.flatnonzero(lang >= 0)
            if not len(known):
                continue
            row, para, code = pieces.row[known], pieces.para[known], lang[known]
            fresh = np.ones(len(known), bool)
            fresh[1:] = (para[1:] != para[:-1]) | (code[1:] != code[:-1])
            head = np.flatnonzero(fresh)
            tail = np.append(head[1:], len(known)) - 1
            size = np.where(wide[code[head]], np.add.reduceat(pieces.cjk[known], head), np.add.reduceat(pieces.words[known], head))
            prose = size >= np.where(wide[code[head]], min_cjk, min_words)
            sure = 1 / (1 + np.exp(-np.minimum(np.add.reduceat(gap[known], head) / temperature, 50)))
            first_of_row = np.maximum.accumulate(np.where(np.concatenate([[True], row[head][1:] != row[head][:-1]]), np.arange(len(head)), 0))
            labels = batch.column(2).to_pylist()
            names = {x: label_languages(x) for x in set(labels)}
            named = [LANGS[c] in names[labels[r]] for c, r in zip(code[head].tolist(), row[head].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row[head])),
                    pa.array((np.arange(len(head)) - first_of_row).astype(np.int32)),
                    pa.array(pieces.start[known][head]),
                    pa.array(pieces.end[known][tail]),
                    pa.array([LANGS[c] for c in code[head]], pa.string()),
                    pa.array(sure),
                    pa.array(prose),
                    pa.array(named, pa.bool_()),
                ],
                names=["key", "segment", "start", "end", "lang", "confidence", "prose", "named"],
            )

    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label"))
    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, segment int, start long, end long, lang string, confidence double, prose boolean, named boolean").withColumnRenamed("key", key)


def unnamed_languages(docs: DataFrame, model: np.ndarray, key: str = "doc_id", **options) -> DataFrame:
    """(key, lang): the languages of running prose in each document that its label does not name."""
    return language_segments(docs, model, key=key, **options).where("prose and not named").select(key, "lang").distinct()


def document_languages(docs: DataFrame, model: np.ndarray, key: str = "doc_id", **options) -> DataFrame:
    """(key, lang, confidence, languages): one row for every key, with the language of most text, its confidence and the number of languages of prose.

    The confidence is that of the language's segments, weighted by their sizes and by the language's share. A document without a segment of
    prose is judged by all its segments with half the confidence and 0 languages; one without any segment has a null language and confidence.
    """
    s = language_segments(docs, model, key=key, **options)
    size = F.col("end") - F.col("start")
    per = s.groupBy(key, "prose", "lang").agg(F.sum(size).alias("size"), (F.sum(size * F.col("confidence")) / F.sum(size)).alias("sure"))
    top = per.groupBy(key, "prose").agg(F.max_by(F.struct("lang", "size", "sure"), F.struct("size", "lang")).alias("top"), F.sum("size").alias("all"), F.count("*").cast("int").alias("languages"))
    told = F.struct(F.col("top.lang").alias("lang"), (F.col("top.sure") * F.col("top.size") / F.col("all") * F.when(F.col("prose"), 1.0).otherwise(0.5)).alias("confidence"), F.when(F.col("prose"), F.col("languages")).otherwise(0).alias("languages"))
    best = top.groupBy(key).agg(F.max_by(told, F.col("prose")).alias("told"))
    every = docs.select(key).where(F.col(key).isNotNull()).distinct()
    return every.join(best, key, "left").select(key, "told.lang", "told.confidence", F.coalesce("told.languages", F.lit(0)).alias("languages"))
