"""Defective answers of prompt and response pairs (problem 2).

Each answer has at most one defect, looked for in this order:

* empty: null, nothing visible but empty tags or an empty fence, or no assistant message after the user's last one;
* refusal: every sentence, thoughts aside, aligns with a template of refusals or of the courtesies around them (longest common
  subsequence of words, of characters for zh and ja; refusals of other wording by classes of words), and one at least with a refusal proper;
* copy: shingles of three words mark what the answer takes from the question; nearly all of the question comes back, nothing
  follows it, and what stands before is a short frame;
* truncated: the answer breaks off, by the rules of siltworks.llm.truncation over all answers;
* wrong_language: the prose of the answer is in another language than the question, which does not name that language.

Defined cases: null questions make no copy and no wrong language; rows repeated with the same id give one row; very long texts
are read whole; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.vectext import rebatch
from siltworks.llm.langid import LANGS, NAMES, Pieces
from siltworks.llm.truncation import CUT, judged
from siltworks.session import materialise

#: Fixed classes of words: all words of a class count as one in the alignment with a template.
CLASSES = {
    "#sorry": "sorry apologies apologize apologise regret unfortunately regrettably afraid désolé désolée pardon malheureusement siento perdón disculpa disculpe lamento lamentablemente desafortunadamente leider entschuldigung bedaure verzeihung desculpe desculpa infelizmente извините простите сожалению",
    "#not": "cant cannot wont unable refuse refusing decline declining impossible dont couldnt shouldnt wouldnt isnt arent not never no unwilling incapable ne pas peux puis nicht kann keine não нет не нельзя нет",
    "#do": "help assist answer provide write respond fulfil fulfill complete do doing comply support give produce create generate solve share offer continue proceed engage discuss perform handle deliver supply aider répondre ayudar ayudarte ayudarle responder helfen beantworten antworten ajudar помочь ответить отвечать выполнить",
    "#it": "this that it request question task prompt problem one topic matter query demand inquiry assignment exercise cette demande question esta esto petición pregunta solicitud diese dieser anfrage frage este esse isso pedido pergunta этот этим это запрос запросом вопрос",
    "#rule": "guidelines guideline policy policies rules permitted allowed allow permit appropriate comfortable outside scope safety restrictions terms",
    "#me": "i im id ill ive me my we our model ai assistant je me yo ich mir eu я мне",
}
#: Fixed texts: refusals proper.
REFUSALS = (
    "I'm sorry, but I can't help with this request.",
    "I can't assist with that.",
    "I cannot help you with that.",
    "I cannot fulfil this.",
    "I am unable to answer this question.",
    "Sorry, I am not able to write that for you.",
    "Unfortunately I won't be able to provide code for this task.",
    "I will not provide a solution to this.",
    "I won't do that.",
    "I must decline this one.",
    "I have to decline this request.",
    "I refuse to write this code.",
    "I refuse to do this.",
    "That is something I have to refuse.",
    "I'd rather not assist here.",
    "I would prefer not to answer this.",
    "My guidelines don't allow me to respond to this.",
    "This request falls outside what I am permitted to do.",
    "I am not permitted to answer this request.",
    "No answer can be given to this prompt under the usage policy.",
    "Providing a solution would not be appropriate.",
    "As a language model, I do not feel comfortable answering this.",
    "As an AI, I cannot do this.",
    "抱歉，我无法回答这个问题。",
    "对不起，我不能帮助完成这个请求。",
    "Désolé, je ne peux pas répondre à cette demande.",
    "Je suis désolé, mais je ne peux pas vous aider.",
    "Lo siento, no puedo ayudar con esta petición.",
    "Lo siento, pero no puedo responder a esta pregunta.",
    "Leider darf ich bei dieser Anfrage nicht helfen.",
    "Es tut mir leid, aber ich kann diese Frage nicht beantworten.",
    "Desculpe, não posso ajudar com este pedido.",
    "Infelizmente não posso responder a esta pergunta.",
    "Извините, я не могу помочь с этим запросом.",
    "К сожалению, я не могу ответить на этот вопрос.",
    "申し訳ありませんが、このご依頼にはお答えできません。",
    "すみませんが、お手伝いできません。",
)
#: Fixed texts: what may stand beside a refusal.
COURTESIES = (
    "Apologies!",
    "Sorry.",
    "I'm sorry.",
    "Thanks for understanding.",
    "Thank you for your understanding.",
    "Please ask something else.",
    "Is there anything else on your mind?",
    "Is there anything else I can help you with?",
    "Let me know if there is another topic I may support you with.",
    "If you rephrase it, I may be able to look again.",
    "You could consult a qualified teacher instead.",
    "It could be used for cheating in an exam.",
)
_THOUGHT = re.compile(r"<think>.*?(?:</think>|\Z)|\A(?:(?!<think>).)*?</think>", re.S)
_TAG = re.compile(r"</?[a-z_]+>", re.I)
_FENCE = re.compile(r"^[ \t]*(?:`{3,}|~{3,})[^\n]*$", re.M)
_HIDDEN = re.compile("[\\s" + "".join(map(chr, [0xAD, 0x34F, 0x61C, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF])) + "]+")
_SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？]*")
_WORD = re.compile(r"[^\W_]+")
_CJK = re.compile("[぀-ヿ㐀-鿿]")
_ASKED = re.compile(r"\b(" + "|".join(sorted((re.escape(n) for n in NAMES if len(n) > 4 and n.isascii()), key=len, reverse=True)) + r")\b|(" + "|".join(re.escape(n) for n in NAMES if not n.isascii()) + ")", re.I)


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    return not _HIDDEN.sub("", _FENCE.sub("", _TAG.sub("", answer)))


def _units(text: str) -> list[str]:
    words = _WORD.findall(text.lower().replace("’", "'").replace("'", ""))
    return [u for w in words for u in (w if _CJK.search(w) else (w,))]


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        met = row & places.get(y, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


_CLASS_OF = {w: c for c, words in CLASSES.items() for w in words.split()}


def _classes(text: str) -> list[str]:
    """The words with their classes in place of those that have one; a class that stands twice in a row counts once."""
    out: list[str] = []
    for u in _units(text):
        c = _CLASS_OF.get(u, u)
        if not out or c != out[-1] or c[0] != "#":
            out.append(c)
    return out


def _templates(refusals: tuple[str, ...], courtesies: tuple[str, ...]) -> list[tuple[list[str], list[str], bool]]:
    return [(_units(t), _classes(t), core) for texts, core in ((refusals, True), (courtesies, False)) for t in texts]


_TEMPLATES = _templates(REFUSALS, COURTESIES)


def _likeness(a: list[str], b: list[str], least: float) -> float:
    """Twice the common subsequence over both lengths; 0 where the lengths alone keep it under `least`."""
    both = len(a) + len(b)
    return 2 * _common(a, b) / both if both and 2 * min(len(a), len(b)) >= least * both else 0.0


def is_refusal(answer: str, least: float = 0.75, templates: list[tuple[list[str], list[str], bool]] = _TEMPLATES) -> bool:
    """Whether every sentence aligns with a template, by its words or by their classes, and one at least with a refusal proper.

    By classes only a sentence counts that has a `#not` with a `#do` or a `#rule`, and speaks of the speaker or of the request.
    """
    rest = _TAG.sub(" ", _THOUGHT.sub(" ", answer)).strip()
    if not rest:
        return False
    proper = False
    for m in _SENTENCE.finditer(rest):
        sentence = _units(m[0])
        if not sentence:
            continue
        best, core = max(((_likeness(sentence, t, least), c) for t, _, c in templates), default=(0.0, False))
        if best < least:
            own = _classes(m[0])
            if "#not" in own and ("#do" in own or "#rule" in own) and ("#me" in own or "#it" in own):
                best, core = max(((_likeness(own, t, least), c) for _, t, c in templates if c), default=(0.0, False))
            if best < least:
                return False
        proper |= core
    return proper


def is_copy(question: str, answer: str, covered: float = 0.9, frame: int = 12) -> bool:
    """Nearly the whole question comes back, after a frame of few words at most, and nothing follows it."""
    q, a = _units(question), _units(_TAG.sub(" ", _THOUGHT.sub(" ", answer)))
    if len(q) < 3 or len(a) < covered * len(q):
        return False
    grams = set(zip(q, q[1:], q[2:]))
    own = list(zip(a, a[1:], a[2:]))
    if own[-1] not in grams:
        return False
    met = [i for i, g in enumerate(own) if g in grams]
    if met[0] > frame or len({own[i] for i in met}) < covered * len(grams):
        return False
    taken = [False] * len(a)
    for i in met:
        taken[i] = taken[i + 1] = taken[i + 2] = True
    loose = len(a) - met[0] - sum(taken)
    return loose <= max(2, 0.02 * len(a)) and _common(q, a[met[0] : met[0] + 2 * len(q)]) >= covered * len(q)


def screen(pairs: DataFrame, model: np.ndarray, min_words: int = 8, min_cjk: int = 10, margin: float = 15.0) -> DataFrame:
    """pairs (src, id, field, question, answer) -> (src, id, field, defect): all defects but truncation; wrong_language comes last.

    `defect` is null where none is found.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(model)
    wide = np.array([x in ("zh", "ja") for x in LANGS])

    def languages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        p = Pieces(texts)
        n = len(texts)
        scores = np.zeros((n, len(LANGS)))
        np.add.at(scores, p.row, p.scores(shared.value))
        return scores, scores.argmax(axis=1), np.bincount(p.row, p.words, n), np.bincount(p.row, p.cjk, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatch(batches, 8 << 20):
            fields, questions, answers = (batch.column(k).to_pylist() for k in (2, 3, 4))
            defect: list[str | None] = [None] * len(answers)
            prose: list[str | None] = [None] * len(answers)
            for i, (f, q, a) in enumerate(zip(fields, questions, answers)):
                if is_empty(a):
                    defect[i] = "empty"
                elif is_refusal(a):
                    defect[i] = "refusal"
                elif q and is_copy(q, a):
                    defect[i] = "copy"
                elif f != "solution" and q and not a.lstrip().startswith(("def ", "class ", "import ", "from ")):
                    prose[i] = a
            at = [i for i, p in enumerate(prose) if p]
            if at and shared.value.any():
                scores, own, words, cjk = languages([prose[i] for i in at])
                asked, question, _, _ = languages([questions[i] for i in at])
                enough = np.where(wide[own], cjk >= min_cjk, words >= min_words)
                known = asked.any(axis=1)
                index = np.arange(len(at))
                for k in np.flatnonzero(enough & known & (own != question) & (scores[index, own] - scores[index, question] > margin)):
                    named = {NAMES[(m[1] or m[2]).lower()] for m in _ASKED.finditer(questions[at[k]])}
                    if LANGS[own[k]] not in named:
                        defect[at[k]] = "wrong_language"
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(defect, pa.string())], names=["src", "id", "field", "defect"])

    return pairs.select("src", "id", "field", "question", "answer").mapInArrow(run, "src string, id string, field string, defect string")


def _last_pair(messages: Column) -> tuple[Column, Column]:
    """The content of the last user message and of the last assistant message after it."""
    role = lambda m: F.lower(F.trim(F.coalesce(m["role"], F.lit(""))))
    at = F.array_max(F.transform(messages, lambda m, i: F.when(role(m) == "user", i)))
    question = F.get(messages, at)["content"]
    after = F.slice(messages, F.coalesce(at, F.lit(-1)) + 2, F.size(messages) + 1)
    answers = F.filter(after, lambda m: role(m) == "assistant")
    return question, F.try_element_at(answers, F.lit(-1))["content"]


def stored_pairs(sft: DataFrame, samples: DataFrame, tasks: DataFrame) -> DataFrame:
    """(src, id, field, question, answer) of both tables; a null list of messages has no answer."""
    messages = F.coalesce(F.col("messages"), F.array().cast(sft.schema["messages"].dataType))
    question, answer = _last_pair(messages)
    a = sft.select(F.lit("sft_train").alias("src"), F.col("row_id").cast("string").alias("id"), F.lit("messages").alias("field"), question.alias("question"), answer.alias("answer"))
    prompts = tasks.groupBy("task_id").agg(F.max("prompt").alias("question"))
    joined = samples.join(prompts, "task_id", "left")
    both = F.explode(F.array(F.struct(F.lit("raw_output").alias("field"), F.col("raw_output").alias("answer")), F.struct(F.lit("solution").alias("field"), F.col("solution").alias("answer"))))
    b = joined.select(F.lit("eval_samples").alias("src"), F.col("sample_id").cast("string").alias("id"), "question", both.alias("x")).select("src", "id", "x.field", "question", "x.answer")
    return a.unionByName(b).where("id is not null")


def defective_answers(pairs: DataFrame, model: np.ndarray) -> DataFrame:
    """(src, id, field, defect) of every defective answer."""
    screened = materialise(screen(pairs, model), "screened").dropDuplicates(["src", "id", "field"])
    records = pairs.select(F.concat_ws("/", "src", "field").alias("src"), "id", F.col("answer").alias("text"), F.lit(None).cast("string").alias("parsed"), F.when(F.col("field") == "solution", "code").alias("status"))
    cut = judged(records).where(F.col("state") == CUT).select(F.split("src", "/")[0].alias("src"), F.split("src", "/")[1].alias("field"), "id", F.lit("truncated").alias("cut"))
    both = screened.join(cut, ["src", "id", "field"], "left")
    defect = F.when(F.col("defect").isin("empty", "refusal", "copy"), F.col("defect")).otherwise(F.coalesce("cut", "defect"))
    return both.select("src", "id", "field", defect.alias("defect")).where("defect is not null")


def defect_rates(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(src, field, defect, answers, rate) per table, field and defect."""
    total = pairs.select("src", "field", "id").distinct().groupBy("src", "field").agg(F.count("*").alias("total"))
    per = found.groupBy("src", "field", "defect").agg(F.count("*").alias("answers"))
    return per.join(total, ["src", "field"]).select("src", "field", "defect", "answers", (F.col("answers") / F.col("total")).alias("rate"))
