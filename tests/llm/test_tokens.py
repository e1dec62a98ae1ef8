import os
import random
from array import array

import pytest
import tiktoken

from stridewell.llm import tokens

RANKS = tokens.read_ranks(f"{tokens.FOLDER}/byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def oracle():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def samples():
    rng = random.Random(0)
    alphabet = list("abcdefgh ETAOIN  \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2003\u3000\u200b'’.,;:-_0123½²٣éşığüÃ©\ufeff🙂👩🏽\u200d🍳漢字かなконькиß")
    yield from ("", " ", "  ", "a", "\n\n x", "don't we'll I'M", "<|endoftext|>", "e" * 5000, " " * 3000 + "x", "漢" * 700, "0" * 2001, "ab" * 1500, "🙂" * 300, "Ω≈ç√∫˜µ")
    for _ in range(400):
        yield "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
    for _ in range(30):
        yield "".join(chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(rng.randrange(80)))


def test_ids_equal_the_public_library(oracle):
    e = tokens.Encoder(RANKS)
    for text in samples():
        out = array("i")
        e.encode(text, out)
        assert out.tolist() == oracle.encode_ordinary(text), repr(text)


def test_tables(spark, oracle):
    rows = [(1, "Hello there", 5), (2, None, 5), (3, "", 5), (4, " ", 5), (None, "x", 5), (1, "Hello there", 5), (7, "long " * 30_000, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id or 0), r.ids) for r in tokens.token_ids(df).collect())
    assert got == sorted(((a or 0), oracle.encode_ordinary(b or "")) for a, b, _ in rows)
    counts = sorted(((r.doc_id or 0), r.n_tokens) for r in tokens.token_counts(df).collect())
    assert counts == sorted((a, len(b)) for a, b in got)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert tokens.token_ids(empty).count() == 0


def test_round_trip():
    back = {v: k for k, v in RANKS.items()}
    e = tokens.Encoder(RANKS)
    for text in samples():
        out = array("i")
        e.encode(text, out)
        assert b"".join(back[i] for i in out).decode() == text


def test_other_rank_files(spark):
    path = os.path.join(tokens.FOLDER, "byte_bpe_multi_50k.tiktoken")
    if not os.path.exists(path):
        pytest.skip("no such file")
    own = tiktoken.Encoding("other", pat_str=tokens.PATTERN, mergeable_ranks=tokens.read_ranks(path), special_tokens={})
    texts = ["Guten Morgen, wie geht's?", "Доброе утро 123", "", "おはよう  \n x", "a" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.ids for r in tokens.token_ids(df, path=path).collect()}
    assert got == {k: own.encode_ordinary(x) for k, x in enumerate(texts)}
    words = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, path=path, pattern=r"\p{L}+").collect()}
    assert words[2] == 0 and words[1] < len(got[1])
