import random

import pytest

from loomline.llm import bpe

PATH = f"{bpe.TOKENIZERS}/byte_bpe_50k.json"
TEXTS = ["", " ", "a", "Hello world", "don't we'll I'M", "  two  spaces \n\n tab\t.", "größer naïve 世界 担当者がlot_idの照合", "🙂🙂👩🏽‍💻", "aaaaaaaaaaaaaaaaaaaaaaaaa", "1234567890 3.14 0x1F", "<|endoftext|> x", "﻿x\xa0y​", "==--__!!??", "raw_market.trade_feed\r\n", "a" * 5000, " " * 3000 + "x", "é" * 1000]


@pytest.fixture(scope="module")
def automaton():
    return bpe.load(PATH)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_equals_the_public_tokenizer(automaton, reference):
    rnd = random.Random(1)
    words = "the of lineage trade_feed Kurs größe über 12 3 ... !! \n \t 漢字 ё 🙂 ' 's x".split(" ")
    texts = TEXTS + ["".join(rnd.choice(words) + rnd.choice(["", " ", "  "]) for _ in range(60)) for _ in range(200)] + ["".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(160, 1500), rnd.randint(0x4E00, 0x4F00)])) for _ in range(80)) for _ in range(200)]
    encoder = bpe.Encoder(automaton)
    for t in texts:
        assert encoder.encode(t) == reference.encode(t, add_special_tokens=False).ids, repr(t[:60])


def test_round_trip(automaton):
    encoder = bpe.Encoder(automaton)
    for t in TEXTS:
        assert automaton.decode(encoder.encode(t)).decode() == t


def test_automaton_accepts_tokenizations_only(automaton):
    # a small vocabulary: a, b, ab, aba; merges in this order
    vocab = {b"a": 0, b"b": 1, b"ab": 2, b"aba": 3, b"aa": 4}
    small = bpe.Automaton(vocab, [(b"a", b"b"), (b"ab", b"a"), (b"a", b"a")])

    def slow(word):
        parts = [bytes([c]) for c in word]
        for x, y in ((b"a", b"b"), (b"ab", b"a"), (b"a", b"a")):
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (x, y):
                    parts[i : i + 2] = [x + y]
                i += 1
        return [vocab[p] for p in parts]

    import itertools

    for n in range(1, 9):
        for w in itertools.product(b"ab", repeat=n):
            word = bytes(w)
            ids = small.encode_word(word)
            assert ids == slow(word), word
            assert all(small.arc(x, y) for x, y in itertools.pairwise(ids))


def test_null_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello world", "x"), (3, "Hello world", "x"), (4, "z" * 200_000, "x"), (None, "a", None)], "doc_id bigint, text string, ids string")
    got = sorted(((r["doc_id"], len(r["ids"]), list(r["ids"])[:2]) for r in bpe.encode(df).collect()), key=repr)
    by = {g[0]: g for g in got}
    assert by[1][1] == 0 and by[2][1] == 0 and by[3][2] == [15496, 995] and by[None][2] == [64] and len(got) == 6
    assert bpe.encode(df.limit(0)).collect() == []
    assert bpe.encode(df).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]


def test_decoding_gives_the_texts_back(spark):
    texts = ["load the rates\r\n\tof größe 円 🙂 'll", "", None, "x" * 20_000, "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(df)).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")).first()["text"] is None
