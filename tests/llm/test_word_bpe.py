"""BPE with word ends against the tokenizers library, whole and by halves of any size."""

import hashlib
import random

import pytest
from test_llm_small import ODD, docs
from tokenizers import Tokenizer

from chronolith.llm import word_bpe

SIGNS = [
    *"abes'! \n\t1²", "'s", "ll", "the", "ing", "é", "é", "Σ", "ς", "\x1c", "?!", "日本", "<|endoftext|>", "<|ENDOFTEXT|>", "<|start", "oftext|>", "İ",
    "ა", "ͅ", "\x00", "\U00010400", "한", "한", "aaaa", "ൊ", "ẞ", "ǅ", "ﬃ", "½", "﻿", "​", "　", "\u0085", "\U0001d7d8",
    "\U00011935\U00011930", "\U0001f600",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_bpe.default_path())


@pytest.fixture(scope="module")
def own():
    return word_bpe.word_vocabulary(word_bpe.default_path())


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_random_texts_equal_the_library(library, own):
    rng = random.Random(11)
    for _ in range(2500):
        text = "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40)))
        ids, decoded = expected(library, text)
        assert own.encode_text(text) == (" ".join(map(str, ids)), decoded), text
        assert own.join_all([own.encode_parts(*p) for p in own.halves(text, rng.randint(1, 9))]) == ids, text


@pytest.mark.parametrize("text", ["a" * 5001, "ab" * 3000, "the" * 777, "!?" * 999, "thing" * 1000, "ing" * 2 + "á" * 3333])
def test_unsplit_text_by_halves(library, own, text):
    ids, _ = expected(library, text)
    assert own.encode_part(text, True) == ids
    for most in (700, 64, 5):
        assert own.join_all([own.encode_parts(*p) for p in own.halves(text, most)]) == ids


def test_windows_grow_until_both_sides_agree(own):
    """Neither side of a run of one letter keeps its ids when its length is odd: the window grows to the next agreement."""
    for n in range(1, 60):
        for cut in range(1, n):
            symbols = [own.inner[ord("a")]] * n
            assert own.join(own.tree(symbols[:cut]), own.tree(symbols[cut:])) == word_bpe.merge_in_order(symbols, own.pairs, own.size)


@pytest.mark.parametrize("block", [32_768, 50])
def test_rows_of_any_kind(spark, library, block):
    texts = [*ODD, "x" * 3000, "'s" * 200 + " <|endoftext|> " * 20, "".join(SIGNS) * 9]
    some = docs(spark, texts).withColumnRenamed("n_chars", "TEXT")
    some = some.union(some)
    got = word_bpe.encode_words(some, with_ids=True, block_chars=block).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        ids, decoded = expected(library, texts[r["doc_id"]] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    again = word_bpe.decode_words(spark.createDataFrame([(r["doc_id"], r["ids"]) for r in got], "doc_id long, ids array<int>"))
    assert {r["doc_id"]: r["decoded"] for r in again.collect()} == {i: expected(library, t or "")[1] for i, t in enumerate(texts)}
    assert word_bpe.encode_words(some.where("false")).count() == 0
    nameless = word_bpe.encode_words(spark.createDataFrame([(None, "a b")], "doc_id string, text string")).collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in nameless] == [(None, 2)]


def test_query_equals_the_library(spark, sf_dir, library):
    from chronolith.llm.common import table

    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    rows = word_bpe.op11_word_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, decoded = expected(library, texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
