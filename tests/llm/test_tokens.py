import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from speechlake.llm import tokens as K
from tokenizers import Tokenizer

NAME = "word_bpe_49k.json"
ODD = " abcdefXYZ'sté²½Σßİ\x1c\x1d​ 中文😀1234,.!<|endoftext|>ﬁé\n\t\x85"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


@pytest.fixture(scope="module")
def counter():
    return K.counter(public_tokenizers.path(NAME))


def length(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def samples(rows):
    rng = random.Random(2)
    out = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    return out + [t[:90] for _, t, *_ in rows if t] + ["x <|endoftext|> y<|startoftext|>", "<|ENDOFTEXT|>", "İstanbul ΣΑΣ", "a" * 500]


def test_every_prefix_counts_as_the_library_counts(counter, library, rows):
    for text in samples(rows):
        assert counter.count(text) == length(library, text)
        if "<|" not in text:
            seg = counter.segments(text)[0]
            assert counter.prefix_counts(seg).tolist() == [length(library, seg[:i]) for i in range(len(seg) + 1)]


def test_prefixes_go_on_behind_special_strings(spark, counter, library, rows):
    texts = ["one two <|startoftext|> three four five six", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", *[t for t in samples(rows) if "<|" in t][:60]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in K.token_counts(df, NAME, 5, True).collect():
        got, text = r["prefix_tokens"], texts[r["doc_id"]]
        assert got[-1] == r["n_tokens"] == length(library, text) and len(got) == counter.counted(text)[1] + 1
        if text.isascii() and text == text.lower():
            inside = {i for m in counter.special.finditer(text) for i in range(m.start() + 1, m.end())}
            assert [c for i, c in enumerate(got) if i not in inside] == [length(library, text[:i]) for i in range(len(text) + 1) if i not in inside]
        assert got[r["n_fitting_chars"]] <= 5
    assert K.token_counts(df.limit(1), NAME, 5, True).first()["prefix_tokens"][-1] == 7


def test_longest_prefix(counter, library, rows):
    for text in samples(rows)[::5]:
        if "<|" in text:
            continue
        seg = counter.segments(text)[0]
        counts = [length(library, seg[:i]) for i in range(len(seg) + 1)]
        for budget in (0, 3, 7):
            if counts[-1] > budget:
                assert counter.longest_prefix(text, budget) == next(i for i, c in enumerate(counts) if c > budget) - 1


def test_awkward_empty_and_clashing(awkward, nothing):
    out = K.token_counts(awkward.withColumn("n_tokens", F.lit("x")), NAME, 2, True).collect()
    assert len(out) == awkward.count() and all(r["n_tokens"] == 0 and r["prefix_tokens"] == [0] for r in out if not r["text"])
    assert K.token_counts(nothing, NAME).count() == 0


def test_query(spark, sf, rows, library):
    text = {i: t or "" for i, t, *_ in rows}
    for r in K.op6_prefix_token_counts(spark, sf).collect():
        n = length(library, text[r["doc_id"]])
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 2048, len(text[r["doc_id"]].encode()))
        assert n > 2048 or r["n_fitting_chars"] == len("".join(K.counter(public_tokenizers.path(NAME)).segments(text[r["doc_id"]])))
