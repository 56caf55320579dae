import re

import numpy as np
import pytest

from siltworks.llm.langid import LANGS, Pieces, document_languages, fit_languages, label_languages, language_segments, unnamed_languages
from siltworks.session import table

SF = "/root/testdata/sf0.01"
TEXT = {
    "en": "The counter keeps the number of open items and the loop must not touch it before the list is sorted again.",
    "es": "La función recibe varios paquetes y devuelve cuántos de ellos siguen siendo únicos después de contar el resto.",
    "de": "Die Funktion bekommt viele Knoten und gibt zurück, wie viele davon nach dem Durchlauf noch im Lager liegen.",
    "fr": "La fonction reçoit des tonneaux et renvoie combien d'entre eux restent cassés après le parcours de la cave.",
    "pt": "A função recebe alguns bilhetes e devolve quantos deles continuam quebrados depois de ordenar os outros nós.",
    "ru": "Функция получает много чисел и возвращает, сколько из них осталось в погребе после обхода всех вершин дерева.",
    "zh": "这个函数接收许多节点，返回第一行中重复元素的个数。题目要求在花园把最短的车票全部交换，并输出剩余的数量。",
    "ja": "この関数は庭にある数字を受け取り、奇数のものの数を返します。すべての荷物を順番に調べて、累積和に入れていきます。",
}


@pytest.fixture(scope="module")
def model(spark):
    return fit_languages(table(spark, SF, "documents"))


def test_labels():
    assert label_languages("pt-BR") == ["pt"] and label_languages("zh / es") == ["zh", "es"] and label_languages("Simplified Chinese") == ["zh"]
    assert label_languages("de_DE+ENG") == ["de", "en"] and label_languages("FRENCH") == ["fr"]
    assert [label_languages(x) for x in (None, "", "und", "n/a", "python", "c++")] == [[]] * 6


def test_held_out_sentences(spark, model):
    df = spark.createDataFrame([(i, t, l, "clash") for i, (l, t) in enumerate(TEXT.items())], "doc_id long, text string, lang string, label string")
    got = {r.doc_id: r for r in document_languages(df, model).collect()}
    assert [got[i].lang for i in range(8)] == list(TEXT)
    assert all(0.5 < r.confidence <= 1 for r in got.values())
    assert unnamed_languages(df, model).count() == 0


def test_held_out_accuracy(spark):
    every = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text", "lang")
    model = fit_languages(every.where("doc_id % 3 <> 0"))
    docs = every.where("doc_id % 3 = 0")
    # a second opinion by function words and scripts, on documents of one paragraph
    words = {l: set(w.split()) for l, w in dict(en="the of and to in that is", es="el los las que una con para del", de="der die das und wenn den ist nicht", fr="le les des une est dans pour", pt="os uma para não com que dos são").items()}
    rows = [r for r in docs.where("length(text) between 300 and 700 and not text like '%\\n%' and not text like '%<%'").collect()]
    found = {r.doc_id: r.lang for r in document_languages(docs, model).collect()}
    right = total = 0
    for r in rows:
        w = re.findall(r"[^\W\d_]+", r.text.lower())
        if re.search("[\u3040-\u30ff]", r.text):
            own = "ja"
        elif re.search("[\u4e00-\u9fff]{6}", r.text):
            own = "zh"
        elif sum("а" <= x[0] <= "я" for x in w) > len(w) / 2:
            own = "ru"
        else:
            own = max(words, key=lambda l: sum(x in words[l] for x in w))
        total += 1
        right += found.get(r.doc_id) == own
    assert total > 100 and right / total > 0.99


def test_segments_and_what_is_no_prose(spark, model):
    mixed = f"{TEXT['en']} {TEXT['en']}\n\n{TEXT['de']} {TEXT['de']}\n\n```python\ndef f():\n    \"\"\"{TEXT['fr']} {TEXT['fr']}\"\"\"\n```\n\n| {TEXT['es']} |\n<submit>\n{TEXT['pt']}\n</submit>\nNote the label reads “仓库”."
    rows = [(1, mixed, "en"), (2, mixed, "en+de"), (3, None, None), (4, "", "x"), (5, "   \n", None), (6, TEXT["zh"][:20], None), (7, "one two three four five six seven", None), (8, (TEXT["ru"] + " ") * 2000, ""), (8, (TEXT["ru"] + " ") * 2000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang) for r in unnamed_languages(df, model).collect()} == {(1, "de"), (8, "ru")}
    s = [r for r in language_segments(df.where("doc_id = 1"), model).where("prose").orderBy("start").collect()]
    assert [r.lang for r in s] == ["en", "de"]
    assert mixed[s[1].start : s[1].end].strip().startswith("Die Funktion")
    assert language_segments(df.limit(0), model).count() == 0


def test_without_labels_nothing_is_found(spark):
    df = spark.createDataFrame([(1, TEXT["en"], None)], "doc_id long, text string, lang string")
    flat = fit_languages(df)
    assert not flat.any() and unnamed_languages(df, flat).count() == 0


def test_pieces_cover_the_text():
    texts = ["a. b? c", None, "x\n\ny", "中。文"]
    p = Pieces(texts)
    for i, t in enumerate(texts):
        at = np.flatnonzero(p.row == i)
        assert p.start[at[0]] == 0 and p.end[at[-1]] == len(t or "")
    assert len(LANGS) == 8


def test_every_document_has_a_row(spark, model):
    rows = [(1, TEXT["de"], "de"), (2, None, None), (3, "  ", None), (4, "```python\nx = 1\n```", "en"), (5, "Der kleine Knoten liegt noch im Lager.", None), (5, "Der kleine Knoten liegt noch im Lager.", None)]
    got = {r.doc_id: r for r in document_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    assert len(got) == 5 and got[1].languages == 1
    assert got[2].lang is None and got[3].confidence is None and got[4].lang is None
    assert got[5].lang == "de" and got[5].confidence < 0.51 and got[5].languages == 0


def test_long_and_many_labels(spark):
    rows = [(i, TEXT["de"] + f" {i}", "german" + " " * 60 + f"({i})") for i in range(6000)] + [(9000 + i, TEXT["en"] + f" {i}", "en") for i in range(50)]
    fitted = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=500)
    df = spark.createDataFrame([(1, TEXT["de"], "en")], "doc_id long, text string, lang string")
    assert [r.lang for r in unnamed_languages(df, fitted).collect()] == ["de"]
