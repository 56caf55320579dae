"""Stored model outputs that break off before their end (problem 1).

* Form. What the text itself shows is certain: a tag, a fence or a JSON value that stays open, or a mark left at the cut, is a cut; a text
  whose last part is a closed tag, fence or JSON value, or ends with a sentence mark, is whole. All others are undecided.
* Alignment. A near-copy of an undecided text holds `similar` of the five-word shingles of the text's last words, wherever they stand in it.
  The shingles are put in one order, the rarest first and equal ones by their hash, and the least ones of a text are its bands: as many as no
  near-copy can lack, so every near-copy is met. A pair is verified by all its shingles and aligned by edit distance over words. A text is cut
  if more copies run on where it ends than end there.
* Terminality. Of the unmatched, the closing words tell: over the whole corpus, how often do the last words (two of a list line, four of
  prose) close a line or a sentence of their kind, against how often they run on? A closing line without a sentence mark counts as a
  sign-off only if other texts end with the same line; a line of no other text cannot be told from a cut.

No band is left out, however many texts hold it: one of more than `hot` texts is paired in blocks of about that many, each of which is work of
its own. Texts whose last words are the same are paired once. The work for near-copies of one another that all differ in their last words
still grows with the square of their number, since each pair has an alignment of its own.

Corpus counts are kept by the full 64-bit hash of a word group, combined in each task with flushes, and only those of groups that
close an undecided text are looked up; so a task's memory is bounded and the counts are the same at every size.

Defined cases: null, empty and blank texts are no cases; rows repeated with the same key give one row; a text of fewer than nine words is
not aligned; very long texts are read whole; empty tables give empty results. `finish_reason` is not used.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions.vectext import distinct_per_row, hash_strings, mix64, rebatch, shingle_hashes, word_hashes
from siltworks.llm.grammars import parses
from siltworks.llm.semijoin import bit_table, in_table, members_of
from siltworks.session import materialise

WHOLE, CUT, OPEN, LACKS_TAG = 0, 1, 2, 3

_MARK = re.compile(r"(?:�+|[\[(<]\s*(?:truncated|cut(?: off| short)?|clipped|\.\.\.|…)\s*[\])>])\s*\Z", re.I)
_PARTIAL_TAG = re.compile(r"<(?:/?[a-z_]{0,12})?\Z", re.I)
_TAGS = ("think", "submit", "answer", "solution", "output", "tool_call")
_TAG = re.compile(rf"<(/?)({'|'.join(_TAGS)})>")
_FENCE = re.compile(r"^([^\n`]*?)(`{3,}|~{3,})([^\n`]*)$", re.M)
_ENDED = re.compile(r"[.!?…。！？؟।][\"'”’»」』)\]*_`]*\Z")
_BARE_NUMBER = re.compile(r"(?:^|\n)[ \t]*\d+[.)]\Z")
_LIST = r"^\s*(?:[-*+•]|\d+[.)])\s"
_CODE_START = re.compile(r"(?:def|class|async def) \w+|import \w|from [\w.]+ import |@\w|\"\"\"")
_JSON_LEAD = ('{"', "{\n", "[{", '["')
_CODE = re.compile(r"(?:^|(?<=[ \t]))(`{3,}|~{3,})[^\n`]*\n.*?(?:^[ \t]*\1[ \t]*$|\Z)|<submit>.*?(?:</submit>|\Z)", re.M | re.S)


def _fence_open(text: str) -> bool | None:
    """Whether a fence stays open at the end; None if the text has no fence."""
    inside, some = "", False
    for m in _FENCE.finditer(text):
        some = True
        if not inside:  # a fence may open behind other text of its line, but closes on a line of its own
            inside = m[2]
        elif m[2][0] == inside[0] and len(m[2]) >= len(inside) and not (m[1] + m[3]).strip():
            inside = ""
    return bool(inside) if some else None


def form(text: str, parsed: str | None = None, status: str | None = None) -> int:
    """WHOLE, CUT, OPEN (undecided) or LACKS_TAG (whole but for the closing submit tag)."""
    body = text.rstrip()
    if not body:
        return WHOLE
    if _MARK.search(body):
        return CUT
    if _PARTIAL_TAG.search(body) and "<" in body[-14:]:
        return CUT
    opened: list[str] = []
    last = 0
    for m in _TAG.finditer(body):
        if not m[1]:
            opened.append(m[2])
        elif m[2] in opened:
            while opened.pop() != m[2]:
                pass
        last = m.end()
    if opened:
        if opened != ["submit"]:
            return CUT
        code = text[text.rindex("<submit>") + 8 :]
        fence = _fence_open(code)
        if fence is not None:
            return CUT if fence or code.rstrip()[-3:] not in ("```", "~~~") else LACKS_TAG
        inner, known = code.strip(), (parsed or "").strip()
        if not text.endswith("\n") or not inner or (known != inner and known.startswith(inner)):
            return CUT
        if known == inner and (status or "ok") == "ok":
            return LACKS_TAG
        return LACKS_TAG if parses(code.strip("\r\n") + "\n", "python") else CUT
    if _fence_open(body):
        return CUT
    if not last and (status == "code" or _CODE_START.match(body)) and "```" not in body:
        if parses(text, "python"):
            return WHOLE
        if _CODE_START.match(body):
            return CUT
    lead = body[0]
    if lead in "{[" and not last:
        try:
            json.loads(body)
            return WHOLE
        except ValueError:
            if lead == "{" or body[1:2] in '"{[':
                return CUT
    if last == len(body):
        return WHOLE
    line = body[body.rfind("\n") + 1 :].strip()
    if line and set(line) <= {"`"} or set(line) <= {"~"}:
        return WHOLE if len(line) >= 3 else CUT
    if _BARE_NUMBER.search(body):
        return CUT
    if body.endswith("...") or body.endswith("…"):
        return OPEN
    return WHOLE if _ENDED.search(body) else OPEN


_DIGITS = re.compile(r"\d+")
_EDGE = "\"'“”‘’«»()[]{}*_`,;:.!?…。"


def _prose(text: str | None, status: str | None) -> str:
    """What stands outside fenced and submitted code; nothing of a JSON value or of bare code."""
    if not text or status == "code":
        return ""
    lead = text.lstrip()
    if lead[:2] in _JSON_LEAD or _CODE_START.match(lead):
        return ""
    return _CODE.sub("\n", text).rstrip()


def closing_statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of prose texts: key of the closing words of each text (-1: none), and rows (key, runs, ends) of how often such words run on and end.

    Words end if the last of them closes a sentence or a line; what closes a text itself is left out. Digits count as one digit.
    """
    lines = pc.split_pattern(texts, "\n")
    flat, at = lines.values, lines.offsets.to_numpy().astype(np.int64)
    flat, at = flat.slice(at[0], at[-1] - at[0]), at - at[0]
    listed = pc.match_substring_regex(flat, _LIST).to_numpy(zero_copy_only=False)
    words = pc.utf8_split_whitespace(flat)
    token, woff = words.values, words.offsets.to_numpy().astype(np.int64)
    token, woff = token.slice(woff[0], woff[-1] - woff[0]), woff - woff[0]
    coded = token.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    normal = [_DIGITS.sub("0", w.strip(_EDGE).lower()) for w in distinct]
    code = coded.indices.to_numpy()
    word = hash_strings(normal)[code] if len(distinct) else np.zeros(0, np.uint64)
    stop = np.fromiter((bool(_ENDED.search(w)) for w in distinct), bool, len(distinct))[code] if len(distinct) else np.zeros(0, bool)
    blank = np.fromiter((not n for n in normal), bool, len(normal))[code] if len(distinct) else np.zeros(0, bool)
    line_of = np.repeat(np.arange(len(woff) - 1), np.diff(woff))
    keep = ~blank
    word, stop, line_of = word[keep], stop[keep], line_of[keep]
    first = np.ones(len(word), bool)
    first[1:] = line_of[1:] != line_of[:-1]
    last = np.ones(len(word), bool)
    last[:-1] = first[1:]
    # the word with the one before it in a list line, with the three before it in prose, within the sentence
    fresh = first.copy()
    fresh[1:] |= stop[:-1]
    in_list = listed[line_of]
    nth = np.arange(len(word)) - np.maximum.accumulate(np.where(fresh, np.arange(len(word)), 0)) if len(word) else np.zeros(0, np.int64)
    key = word + in_list.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in (1, 2, 3):
            earlier = np.where(nth[k:] >= k, word[:-k], np.uint64(7)) if len(word) > k else word[:0]
            earlier = np.concatenate([np.full(len(word) - len(earlier), 7, np.uint64), earlier])
            key = np.where(in_list & (k > 1), key, mix64(key * np.uint64(0x9E3779B97F4A7C15) + earlier))
    pair = key.view(np.int64)
    row_of = np.searchsorted(at, line_of, "right") - 1
    closes = np.zeros(len(word), bool)
    closes[:-1] = row_of[1:] != row_of[:-1]
    closes[-1:] = True
    closing = np.full(len(texts), -1, np.int64)
    closing[row_of[closes]] = pair[closes]
    inner = ~closes
    ended = (stop | last)[inner].astype(np.int64)
    return closing, summed(np.stack([pair[inner], 1 - ended, ended], axis=1))


def summed(counts: np.ndarray) -> np.ndarray:
    """Rows (key, runs, ends) with each key once."""
    if not len(counts):
        return counts
    counts = counts[np.argsort(counts[:, 0], kind="stable")]
    starts = np.flatnonzero(np.concatenate([[True], counts[1:, 0] != counts[:-1, 0]]))
    return np.column_stack([counts[starts, 0], np.add.reduceat(counts[:, 1:], starts)])


SHINGLE, WINDOW, TAIL, RUN = 5, 6, 64, 8
_IDEOGRAPH = r"([\p{Han}\p{Hiragana}\p{Katakana}])"
_WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]|[^\W_\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")
_STOP = re.compile(r"[.!?…。！？؟।]")


def spaced_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, lower case, and their row offsets; an ideograph or kana is a word of its own."""
    return word_hashes(pc.replace_substring_regex(texts, _IDEOGRAPH, r" \1 "))


def window_bands(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bands of each row, their row offsets, and which of them lie within the last TAIL words of their row.

    A band is two shingles in a row that are each the least of a window. Two texts that share a run of SHINGLE + 2 * WINDOW - 1 words share
    a band, wherever the run stands. All shingles of a row with fewer than a window count as minima.
    """
    grams, at = shingle_hashes(*spaced_words(texts), SHINGLE)
    n = np.diff(at)
    chosen = np.repeat(n < WINDOW, n)
    starts = len(grams) - WINDOW + 1
    if starts > 0:
        mixed = mix64(grams)
        least = np.argmin(np.stack([mixed[k : k + starts] for k in range(WINDOW)]), axis=0) + np.arange(starts)
        chosen[least[np.arange(starts) + WINDOW <= np.repeat(at[1:], n)[:starts]]] = True
    late = np.arange(len(grams)) >= np.repeat(at[1:] - (TAIL - SHINGLE + 1), n)
    place = np.flatnonzero(chosen)
    row = np.searchsorted(at, place, "right") - 1
    joined = row[1:] == row[:-1]
    with np.errstate(over="ignore"):
        bands = mix64(grams[place[:-1]] * np.uint64(0x9E3779B97F4A7C15) + grams[place[1:]])[joined]
    return bands, np.searchsorted(row[1:][joined], np.arange(len(at))), late[place[:-1]][joined]


def spans(prose: str) -> list[tuple[str, int, int]]:
    """The words, lower case, with their places; an ideograph or kana is a word of its own."""
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(prose)]


def follows(copy: list[tuple[str, int, int]], whole: str, j: int, last: str) -> int | None:
    """1 if the copy, whose whole text is given, runs on in its line behind its word j, which is or begins with `last`; -1 if its line ends there, 0 at a sentence's end.

    None if word j is another one.
    """
    word, _, end = copy[j]
    if word != last:
        return 1 if word.startswith(last) else None
    rest = copy[j + 1][1] if j + 1 < len(copy) else len(whole)
    gap = whole[end:rest]
    return 0 if _STOP.search(gap) else -1 if rest == len(whole) or "\n" in gap or "<" in gap else 1


def aligned_end(text: list[tuple[str, int, int]], copy: list[tuple[str, int, int]], prose: str) -> int:
    """1 if the text ends where its copy, whose text is given, runs on in the same sentence and line; -1 if the copy ends its line there; 0 else.

    The last TAIL words are aligned with any part of the copy by bit-parallel edit distance; at most a quarter of them may be edited.
    The last word itself must be met, or be the beginning of the copy's word.
    """
    words = [w for w, _, _ in text[-TAIL:]]
    if len(words) <= RUN:
        return 0
    last = words.pop()
    m = len(words)
    full, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[str, int] = {}
    for i, w in enumerate(words):
        places[w] = places.get(w, 0) | 1 << i
    up, down, score, best, verdict = full, 0, m, m // 4 + 1, 0
    for j in range(len(copy) - 1):
        x = places.get(copy[j][0], 0) | down
        same = ((up + (x & up)) ^ up) | x
        fewer, more = up & same, down | (full & ~(up | same))
        score += bool(more & top) - bool(fewer & top)
        more <<= 1
        down, up = more & same & full, (fewer << 1 | ~(more | same)) & full
        if score < best:
            told = follows(copy, prose, j + 1, last)
            if told is not None and (copy[j + 1][0] == last or score == 0 or not last.isdigit()):
                best, verdict = score, told
    return verdict


def _lists(values: np.ndarray, at: np.ndarray, kept: np.ndarray) -> pa.ListArray:
    """The values kept of each row as lists."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)])[at].astype(np.int32)), pa.array(values[kept].view(np.int64)))


def _analysed(records: DataFrame, flush: int = 1_000_000, remember: int = 500_000) -> DataFrame:
    """One row a record (src, id, state, closing, line, listed, hash, seeds, last) and rows of counts (word_group, runs, ends) with a null src.

    `seeds` holds the shingles of a text and is empty for one that its task has met before; `last` the last TAIL words of an undecided text,
    null if they are too few to be aligned.
    """

    def emit(counts: np.ndarray) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.string()]
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(counts), t) for t in types), *(pa.array(counts[:, k].copy()) for k in range(3))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, held = [np.zeros((0, 3), np.int64)], 0
        met: set[int] = set()
        for batch in rebatch(batches, 8 << 20):
            texts = batch.column(2).to_pylist()
            states = np.array([form(t, p, s) if t else WHOLE for t, p, s in zip(texts, batch.column(3).to_pylist(), batch.column(4).to_pylist())], np.int8)
            prose = [_prose(t, s) for t, s in zip(texts, batch.column(4).to_pylist())]
            closing, counts = closing_statistics(pa.array(prose, pa.large_string()))
            counted.append(counts)
            held += len(counts)
            if held > flush:
                counted = [summed(np.concatenate(counted))]
                held = len(counted[0])
                if held > flush // 2:
                    yield emit(counted[0])
                    counted, held = [np.zeros((0, 3), np.int64)], 0
            open_ = states == OPEN
            tail = [_DIGITS.sub("0", p[p.rfind("\n") + 1 :].strip()) if o else "" for p, o in zip(prose, open_)]
            grams, at = shingle_hashes(*spaced_words(pa.array(prose, pa.large_string())), SHINGLE)
            last = [last_words(p) if o else None for p, o in zip(prose, open_)]
            # records of the same text share its hash and count once as a witness, but for results of one line, of which each record counts
            own = hash_strings((t or "") if "\n" in p else f"{len(p)} {s} {i}" for t, p, s, i in zip(texts, prose, *(batch.column(k).to_pylist() for k in (0, 1)))).view(np.int64)
            fresh = np.zeros(len(own), bool)
            for i, h in enumerate(own.tolist()):
                if h not in met:
                    fresh[i] = True
                    met.add(h)
            if len(met) > remember:
                met.clear()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(states.astype(np.int32)),
                    pa.array(closing),
                    pa.array(hash_strings(tail).view(np.int64)),
                    pa.array(np.fromiter((bool(re.match(_LIST, p[p.rfind("\n") + 1 :])) for p in prose), bool)),
                    pa.array(own),
                    _lists(grams, at, np.repeat(fresh, np.diff(at))),
                    pa.array(last, pa.string()),
                    *(pa.nulls(len(texts), pa.int64()) for _ in range(3)),
                ],
                names=names,
            )
        yield emit(summed(np.concatenate(counted)))

    names = ["src", "id", "state", "closing", "line", "listed", "hash", "seeds", "last", "word_group", "runs", "ends"]
    return records.mapInArrow(run, "src string, id string, state int, closing long, line long, listed boolean, hash long, seeds array<long>, last string, word_group long, runs long, ends long")


def last_words(prose: str) -> str | None:
    """The last TAIL words, lower case, with a space between; None if there are too few to be aligned."""
    words = [w for w, _, _ in spans(prose)[-TAIL:]]
    return " ".join(words) if len(words) > RUN else None


def last_shingles(last: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of last_words, but for those with the last word, which may be cut itself, and their row offsets."""
    grams, at = shingle_hashes(*spaced_words(last), SHINGLE)
    inner = np.ones(len(grams), bool)
    inner[at[1:][np.diff(at) > 0] - 1] = False
    values, _, offsets = distinct_per_row(grams[inner], np.concatenate([[0], np.cumsum(inner)])[at])
    return values, offsets


def _with_shingles(ends: DataFrame) -> DataFrame:
    """(ending, seeds) of rows (ending, last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatch(batches):
            grams, at = last_shingles(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(grams, at, np.ones(len(grams), bool))], names=["ending", "seeds"])

    return ends.select("ending", "last").mapInArrow(run, "ending long, seeds array<long>")


def _shingles_among(rows: DataFrame, table: np.ndarray | None) -> DataFrame:
    """(hash, seed) of rows (hash, seeds): one row for each distinct shingle that the table may hold."""
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, of = batch.column(1).flatten().to_numpy(), pc.list_parent_indices(batch.column(1)).to_numpy()
            if shared.value is not None:
                hit = in_table(shared.value, flat)
                flat, of = flat[hit], of[hit]
            seed, _, at = distinct_per_row(flat, np.searchsorted(of, np.arange(batch.num_rows + 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(at)))), pa.array(seed)], names=["hash", "seed"])

    return rows.select("hash", "seeds").mapInArrow(run, "hash long, seed long")


def _near_pairs(endings: DataFrame, texts: DataFrame, similar: float, hot: int) -> DataFrame:
    """(ending, hash), each once: all pairs of which the text may hold `similar` of the shingles of the ending, and few others.

    endings: (ending, seeds); texts: (hash, seeds), where a text may have several rows. Whatever order the shingles of an ending are put in, a
    text that holds m of its n shingles holds one of the first n - m + 1; the order, the rarest first, only keeps the pairs few.
    """
    wanted = materialise(endings.select("ending", F.size("seeds").alias("n"), F.explode("seeds").alias("seed")), "wanted")
    spread = _shingles_among(texts, bit_table(wanted.select("seed"))).groupBy("seed").agg(F.count("*").alias("spread"))
    rank = F.row_number().over(Window.partitionBy("ending").orderBy("spread", "seed"))
    least = wanted.join(spread, "seed").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(similar * F.col("n")) + 1)
    # a shingle of one text is the ending's own
    least = materialise(least.where("spread > 1").select("ending", "seed", F.ceil(F.col("spread") / hot).cast("int").alias("blocks")), "least")
    held = _shingles_among(texts, bit_table(least.select("seed"))).join(least.where("blocks > 1").select("seed", "blocks").distinct(), "seed", "left")
    held = held.select("seed", "hash", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("hash"), "blocks")).otherwise(0).cast("int").alias("block"))
    least = least.select("ending", "seed", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return least.join(held, ["seed", "block"]).select("ending", "hash").distinct()


def tail_shingles(words: list[tuple[str, int, int]]) -> set[tuple[str, ...]]:
    """The shingles of the last TAIL words but for the last word, which may be cut itself."""
    last = [w for w, _, _ in words[-TAIL:-1]]
    return set(zip(*(last[k:] for k in range(SHINGLE))))


def _verified(pairs: DataFrame, similar: float) -> DataFrame:
    """(ending, hash, verdict): 1 if the text runs on where the ending ends, -1 if it ends there. pairs: (ending, hash, last, text, status)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatch(batches):
            _, first, of = np.unique(batch.column(1).to_numpy(), return_index=True, return_inverse=True)
            prose = [_prose(batch.column(3)[i].as_py(), batch.column(4)[i].as_py()) for i in first.tolist()]
            grams, at = shingle_hashes(*spaced_words(pa.array(prose, pa.large_string())), SHINGLE)
            there = np.unique(mix64(grams ^ mix64(np.repeat(np.arange(len(prose)), np.diff(at)))))
            coded = batch.column(2).dictionary_encode()
            lasts = coded.dictionary.to_pylist()
            wanted, start = last_shingles(coded.dictionary)
            n = np.diff(start)[coded.indices.to_numpy()]
            pair = np.repeat(np.arange(len(n)), n)
            asked = wanted[np.arange(len(pair)) + np.repeat(start[coded.indices.to_numpy()] - np.cumsum(n) + n, n)]
            met = np.bincount(pair, np.isin(mix64(asked ^ mix64(of[pair])), there), len(n))
            verdicts = np.zeros(len(n), np.int32)
            copies: dict[int, list[tuple[str, int, int]]] = {}
            for k in np.flatnonzero((n > 0) & (met >= similar * n)).tolist():
                t = int(of[k])
                if t not in copies:
                    copies = {t: spans(prose[t])}  # the rows of one text mostly follow one another
                verdicts[k] = aligned_end([(w, 0, 0) for w in lasts[coded.indices[k].as_py()].split(" ")], copies[t], prose[t])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(verdicts)], names=["ending", "hash", "verdict"])

    return pairs.select("ending", "hash", "last", "text", "status").mapInArrow(run, "ending long, hash long, verdict int")


def _run_keys(words: list[tuple[str, int, int]]) -> np.ndarray:
    """Hashes of all runs of RUN words."""
    return shingle_hashes(hash_strings(w for w, _, _ in words), np.array([0, len(words)]), RUN)[0]


def _counted(records: DataFrame, hot: DataFrame) -> DataFrame:
    """(src, id, verdict) of the texts `hot` (src, id): different texts in which their last RUN whole words run on less those in which they end.

    No pairs are made: what follows the wanted runs is counted over all texts, and each text looks its own run up.
    """

    def closings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatch(batches):
            words = [spans(_prose(t, x))[-RUN - 1 :] for t, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            kept = pa.array([i for i, w in enumerate(words) if len(w) > RUN], pa.int64())
            own = [words[i.as_py()] for i in kept]
            keys = np.array([_run_keys(w)[0] for w in own], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array(keys, pa.int64()), pa.array([w[-1][0] for w in own], pa.string())], names=["src", "id", "key", "last"])

    asked = materialise(members_of(records, hot).select("src", "id", "text", "status").mapInArrow(closings, "src string, id string, key long, last string").dropDuplicates(["src", "id"]), "closings")
    shared = records.sparkSession.sparkContext.broadcast(bit_table(asked.select("key")))

    def followers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in rebatch(batches, 8 << 20):
            texts = [_prose(t, x) for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            keys, at = shingle_hashes(*spaced_words(pa.array(texts, pa.large_string())), RUN)
            hit = in_table(table, keys) if table is not None else np.ones(len(keys), bool)
            rows = []
            for i in np.unique(np.searchsorted(at, np.flatnonzero(hit), "right") - 1).tolist():
                text = texts[i]
                words = spans(text)
                own = _run_keys(words)[: max(0, len(words) - RUN)]
                for j in np.flatnonzero(in_table(table, own) if table is not None else np.ones(len(own), bool)).tolist():
                    word = words[j + RUN][0]
                    rows.append((int(own[j].view(np.int64)), word, follows(words, text, j + RUN, word), text))
            key, word, told, whole = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(word, pa.string()), pa.array(told, pa.int32()), pa.array(hash_strings(whole).view(np.int64))], names=["key", "word", "told", "whole"])

    met = records.select("text", "status").where("text is not null").mapInArrow(followers, "key long, word string, told int, whole long").distinct()
    counts = met.groupBy("key", "word", "told").agg(F.count("*").alias("n"))
    same = F.col("word") == F.col("last")
    begins = F.col("word").startswith(F.col("last")) & ~F.col("last").rlike(r"^\d+$")
    joined = asked.join(counts, "key").select("src", "id", F.when(same, F.col("told") * F.col("n")).when(begins, F.col("n")).otherwise(0).alias("verdict"))
    # the text itself is one that ends there
    return joined.groupBy("src", "id").agg((F.sum("verdict") + 1).cast("int").alias("verdict"))


def judged(records: DataFrame, similar: float = 0.8, hot: int = 128) -> DataFrame:
    """(src, id, state, evidence): WHOLE, CUT or LACKS_TAG of each record, and what told it: aligned, form or words.

    records: (src string, id string, text string, parsed string, status string); parsed and status may be null everywhere: they
    are what a parser took from the whole text, if it was kept. The status `code` tells that the text itself is bare Python code.
    """
    records = records.select(*(F.col(c).cast("string") for c in ("src", "id", "text", "parsed", "status"))).where("id is not null")
    seen = materialise(_analysed(records), "endings")
    each = seen.where("src is not null").drop("word_group", "runs", "ends").dropDuplicates(["src", "id"])
    open_ = each.where(F.col("state") == OPEN).select("src", "id", "closing", "line", "listed", "hash")
    counts = seen.where("word_group is not null").select("word_group", "runs", "ends").join(open_.select(F.col("closing").alias("word_group")).distinct(), "word_group", "left_semi")
    counts = counts.groupBy("word_group").agg(F.sum("runs").alias("runs"), F.sum("ends").alias("ends"))

    # terminality of the closing words; texts that end alike count once for each different text
    closers = open_.select("closing", "hash").distinct().groupBy("closing").agg(F.count("*").alias("closers"))
    liners = open_.select("line", "hash").distinct().groupBy("line").agg(F.count("*").alias("liners"))
    scored = open_.join(counts, F.col("closing") == F.col("word_group"), "left").join(closers, "closing", "left").join(liners, "line", "left").na.fill(0, ["runs", "ends", "closers", "liners"])
    listed = F.col("ends") / (F.col("ends") + F.col("runs") + 1)
    # without a sentence mark prose must close as other texts do, and its words must seldom run on elsewhere
    signed = F.col("ends") + F.col("closers") - 1
    alike = F.col("liners") - 1  # a rare line is scored by the other texts that end with it
    signs_off = ((F.col("liners") >= 3) & (signed * 4 >= F.col("runs"))) | (alike / (alike + F.col("runs") + 1) >= 0.4)
    whole = F.when(F.col("listed"), (listed >= 0.4) | signs_off).otherwise(signs_off)
    scored = scored.select("src", "id", F.when(whole, WHOLE).otherwise(CUT).alias("scored"))

    # alignment with near-copies; of the verdicts of all texts a text's own does not count
    tails = materialise(each.where((F.col("state") == OPEN) & F.col("last").isNotNull()).select("src", "id", "hash", F.xxhash64("last").alias("ending"), "last"), "tails")
    endings = tails.groupBy("ending").agg(F.min("last").alias("last"))
    own = seen.where("src is not null")
    alone = tails.groupBy("ending").agg(F.min("hash").alias("hash"), F.max("hash").alias("other")).where("hash = other").select("ending", "hash")
    pairs = _near_pairs(_with_shingles(endings), own.where("size(seeds) > 0"), similar, hot).join(alone, ["ending", "hash"], "left_anti")
    pairs = materialise(pairs, "copies")
    firsts = members_of(own.select("src", "id", "hash"), pairs, ("hash",)).groupBy("hash").agg(F.min(F.struct("src", "id")).alias("b")).select("hash", "b.src", "b.id")
    firsts = materialise(firsts, "firsts")
    texts = members_of(records.select("src", "id", "text", "status"), firsts).dropDuplicates(["src", "id"]).join(firsts, ["src", "id"]).select("hash", "text", "status")
    verdicts = _verified(pairs.join(endings, "ending").join(texts, "hash"), similar).where("verdict <> 0")
    verdicts = materialise(verdicts, "verdicts")
    sums = verdicts.groupBy("ending").agg(F.sum("verdict").alias("verdict"))
    judged_tails = tails.join(sums, "ending").join(verdicts.select("ending", "hash", F.col("verdict").alias("own")), ["ending", "hash"], "left")
    runs_on = materialise(judged_tails.where(F.col("verdict") - F.coalesce("own", F.lit(0)) > 0).select("src", "id", F.lit(CUT).alias("copied")), "cut")

    states = each.select("src", "id", "state").join(scored, ["src", "id"], "left").join(runs_on, ["src", "id"], "left")
    evidence = F.when(F.col("copied").isNotNull(), "aligned").when(F.col("state") == OPEN, "words").otherwise("form")
    return states.select("src", "id", F.coalesce("copied", F.when(F.col("state") == OPEN, F.col("scored")), "state").alias("state"), evidence.alias("evidence"))


def stored_outputs(turns: DataFrame, generations: DataFrame) -> DataFrame:
    """The records of both tables in the columns of judged()."""
    a = turns.select(F.lit("turns").alias("src"), F.concat_ws(":", "run_id", F.col("turn_index").cast("string")).alias("id"), F.col("raw_output").alias("text"), F.col("parsed_submit").alias("parsed"), F.col("parse_status").alias("status"))
    none = F.lit(None).cast("string")
    b = generations.select(F.lit("generations").alias("src"), F.col("gen_id").cast("string").alias("id"), F.col("text"), none.alias("parsed"), none.alias("status"))
    return a.unionByName(b)


def cut_outputs(turns: DataFrame, traces: DataFrame, generations: DataFrame, tagless: tuple[str, ...] = ()) -> DataFrame:
    """(src, id, cut, evidence): every record once. `tagless` names the providers that stop at the closing submit tag."""
    states = judged(stored_outputs(turns, generations)).withColumn("run_id", F.when(F.col("src") == "turns", F.regexp_replace("id", r":[^:]*$", "")))
    providers = traces.where(F.lower(F.trim("provider")).isin(*map(str.lower, tagless))).select("run_id").distinct().withColumn("tagless", F.lit(True))
    lacking = states.where(F.col("state") == LACKS_TAG).join(providers, "run_id", "left")
    rest = states.where(F.col("state") != LACKS_TAG).select("src", "id", (F.col("state") == CUT).alias("cut"), "evidence")
    return rest.unionByName(lacking.select("src", "id", F.col("tagless").isNull().alias("cut"), "evidence"))


def cut_rates(turns: DataFrame, traces: DataFrame, generations: DataFrame, tagless: tuple[str, ...] = ()) -> DataFrame:
    """(kind, name, records, cut, rate): per traces.model for turns and per source for generations; a null name is a group."""
    cut = materialise(cut_outputs(turns, traces, generations, tagless), "cut")
    models = traces.groupBy("run_id").agg(F.max("model").alias("name"))
    a = cut.where("src = 'turns'").withColumn("run_id", F.regexp_replace("id", r":[^:]*$", "")).join(models, "run_id", "left").select(F.lit("model").alias("kind"), "name", "cut")
    sources = generations.groupBy(F.col("gen_id").cast("string").alias("id")).agg(F.max("source").alias("name"))
    b = cut.where("src = 'generations'").join(sources, "id", "left").select(F.lit("source").alias("kind"), "name", "cut")
    both = a.unionByName(b).groupBy("kind", "name").agg(F.count("*").alias("records"), F.count_if("cut").alias("cut"))
    return both.withColumn("rate", F.col("cut") / F.col("records"))
