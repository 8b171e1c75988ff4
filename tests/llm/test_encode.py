import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from lorekeep.llm.encode import VOCABULARY, Decoder, decode, encode, encode_texts

AWKWARD = ["", " ", "\n", "  a", "a  b", "it's we'll I'D 'tis", "''s", "'sabc", " 's", "\t's", "x'", "日本語 テキスト", "İstanbul ß", "😀😀", "a b", " 'll", "a\0b", "\r\n\r\nx", "1234five", "!?!'re", "a" * 3000, "ab" * 2000, "<|endoftext|>"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_awkward_and_random_texts(reference):
    rnd = random.Random(3)
    parts = ["a", "s", "'", "re", "ll", " ", "\n", "  ", "\t", "1", "é", "日", "!", "'s", "'ve", " ", "😀", "the", "\r\n", "tion"]
    texts = AWKWARD + ["".join(rnd.choices(parts, k=rnd.randint(0, 14))) for _ in range(3000)]
    got = encode_texts(texts, VOCABULARY).to_pylist()
    assert got == [reference.encode_ordinary(t) for t in texts]
    table = Decoder(VOCABULARY)
    assert [table.decode(np.array(x)).decode() for x in got] == texts


def test_nulls_repeats_and_other_columns(spark, reference):
    df = spark.createDataFrame([(1, None, 5, "x"), (2, "", 5, "x"), (3, "Hello there", 5, "x"), (3, "Hello there", 6, "y"), (None, "q", 7, "z"), (4, "word " * 60_000, 1, "")], "doc_id long, text string, ids int, __x string")
    got = sorted(((r["doc_id"] or 0, r["ids"]) for r in encode(df).collect()), key=lambda r: (r[0], len(r[1])))
    hello = reference.encode_ordinary("Hello there")
    assert got == [(0, reference.encode_ordinary("q")), (1, []), (2, []), (3, hello), (3, hello), (4, reference.encode_ordinary("word " * 60_000))]
    assert encode(df.where("false")).count() == 0
    back = {r["doc_id"]: r["text"] for r in decode(encode(df)).collect()}
    assert back[3] == "Hello there" and back[1] == ""


def test_chunks_cover_the_text_and_know_their_lines(spark):
    from lorekeep.llm.encode import token_chunks

    text = "\n".join(f"line {k} has some words, and the number {k * 37}" for k in range(300))
    rows = [(1, text, "x"), (2, "short", "y"), (3, None, "z"), (4, "", "z"), (2, "short", "y")]
    got = token_chunks(spark.createDataFrame(rows, "doc_id long, text string, piece string")).orderBy("doc_id", "piece").collect()
    assert [r["text"] for r in got if r["doc_id"] == 2] == ["short", "short"] and {r["doc_id"] for r in got} == {1, 2}
    one = [r for r in got if r["doc_id"] == 1]
    assert [r["piece"] for r in one] == list(range(len(one))) and all(r["n_tokens"] == 400 for r in one[:-1]) and one[-1]["n_tokens"] <= 400
    at = 0
    for r in one:
        at = text.index(r["text"], at)
        assert r["start_line"] == 1 + text[:at].count("\n") and r["end_line"] == 1 + text[: at + len(r["text"])].count("\n")
    assert at + len(one[-1]["text"]) == len(text)
    n = {size: len([r for r in token_chunks(spark.createDataFrame(rows[:1], "doc_id long, text string, piece string"), size=size, step=size).collect()]) for size in (50, 10**6)}
    assert n[10**6] == 1 and n[50] > 10
