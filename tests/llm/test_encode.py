import random

import pytest

from siltworks.llm.encode import VOCABULARY, chunk_codes, encode_documents, load_ranks, merge_exactly, pretokens
from siltworks.llm.transducer import Transducer, compile_transducer

pa = pytest.importorskip("pyarrow")
tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    None,
    "",
    " ",
    "\n\n  \t x",
    "I'll can't 'S don''t",
    "a  b   c\n\n\n  def f():\n\treturn 1\r\n",
    "<|endoftext|> is text",
    "注意重复值的情况，否则读数会被压缩两次。x",
    "naïve café Ünïcode ²½Ⅷ ٣٤ _under_score",
    "sp\xa0ace\u2003wide\u3000end\u3000",
    "👩\u200d💻 🇪🇺 emoji\u200b",
    "x" * 5000,
    "word " * 3000,
    "Ångström  \u2028 next\x85line",
]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_encoding_equals_the_public_library(spark, reference):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(0, "repeated row", "", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, n int")
    got = [(r.doc_id, r.ids) for r in encode_documents(df).collect()]
    assert sorted(got) == sorted((i, reference(t)) for i, t, _, _ in rows)
    assert [r.ids for r in encode_documents(df, lexicon_size=1).where("doc_id = 4").collect()] == [reference(TEXTS[4])]


def test_empty_table(spark):
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chunks_have_the_pretokens_of_the_text():
    rng = random.Random(4)
    pieces = ["a", "bc", " ", "  ", "\n", "\t", "'s", ".", "é", "中文", "\xa0", "\u3000", "1", "_"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(400)] + [None]
    chunks, codes, at = chunk_codes(pa.array(texts))
    for i, t in enumerate(texts):
        cut = [chunks[c] for c in codes[at[i] : at[i + 1]]]
        assert "".join(cut) == (t or "")
        assert [p for c in cut for p in pretokens(c)] == pretokens(t or "")
    sliced = pa.array(texts).slice(100, 50)
    assert [chunk_codes(sliced)[0][c] for c in chunk_codes(sliced)[1]] == [c for t in texts[100:150] for c in [chunks[k] for k in codes[at[texts.index(t)] : at[texts.index(t) + 1]]]]


def test_merges_are_exact(reference):
    ranks = load_ranks(VOCABULARY)
    for word in ["tokenization", " unbelievable", "aaaaaaaaaaaaaaaaab", "zzxqjk", "注意重复值的情况", "\n\n\n\n"]:
        assert merge_exactly(word.encode(), ranks) == reference(word)


def test_transducer_is_minimal_and_round_trips(tmp_path):
    rng = random.Random(1)
    words = {("".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) + "ing").encode() for _ in range(300)}
    entries = {w: [i, i + 1][: 1 + i % 2] for i, w in enumerate(words)}
    path = tmp_path / "t.npy"
    path.write_bytes(compile_transducer(entries))
    t = Transducer(str(path))
    listed = [*words, b"nope", b"", b"aing" * 20]
    rows = t.rows(listed)
    for w, r in zip(listed, rows):
        assert (t.ids[t.starts[r] : t.starts[r + 1]].tolist() if r >= 0 else None) == entries.get(w)
    assert len(t.finals) < sum(len(w) for w in words) / 3  # endings are shared
    empty = tmp_path / "e.npy"
    empty.write_bytes(compile_transducer({}))
    assert Transducer(str(empty)).rows([b"x"]).tolist() == [-1]
