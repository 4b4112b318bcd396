"""Spelling variants against brute force, and the automata by themselves."""

import random
import re
import zlib
from collections import Counter

import pytest
from test_llm_small import docs

from chronolith.llm import variants


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_automaton_is_minimal_and_numbers_words():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(300)})
    own = variants.Automaton(words)
    for k, w in enumerate(words):
        state, number = own.walk(own.root, 0, w)
        assert own.final[state] and number == k
    rights = set()
    for w in words:
        for i in range(len(w) + 1):
            rights.add(frozenset(x[i:] for x in words if x.startswith(w[:i])))
    assert len(own.arcs) == len(rights)  # as many states as there are sets of what may follow
    for _ in range(300):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 7)))
        cut = rng.randint(0, len(w))
        want = {k for k, x in enumerate(words) if x.startswith(w[:cut]) and one_apart(x[cut:], w[cut:])}
        assert own.one_error(w[:cut], w[cut:]) == want
    assert variants.Automaton([]).one_error("", "a") == set()


def brute(counts):
    near = {w: [x for x in counts if one_apart(w, x)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("group", [4_000, 3])
def test_variants_equal_brute_force(spark, monkeypatch, group):
    """Also where groups of one beginning are split."""
    monkeypatch.setattr(variants, "GROUP_WORDS", group)
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdeàÿ÷") for _ in range(rng.randint(5, 9))) for _ in range(40)] + ["aaaaa", "aaaaaa", "aaaaaaa", "abababab"]
    words = set(base)
    for w in base * 4:
        i = rng.randrange(len(w) + 1)
        words.add(rng.choice([w[:i] + rng.choice("abz") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abz") + w[i + 1 :]]))
    counts = {w: rng.choice([3, 3, 4, 6, 8, 12, 17, 40, 100]) for w in words if len(w) >= 5}
    got = variants.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == brute(counts) and len(got) == len(counts)


def test_words_of_texts(spark):
    texts = [None, "", "abcde ABCDE abcdé", "ÀBCDE àbcde 12abcde_abcde", "abcdefg " * 500, "x" * 9000, "abcde×÷ ªabcdeŁabcde", *["counted here twice counted"] * 3]
    rows = [(i if i != 3 else None, t, t) for i, t in enumerate(texts)]
    some = spark.createDataFrame(rows, "doc_id long, text string, WORD string")
    got = {r["word"]: r["n"] for r in variants.word_counts(some, 97).collect()}
    want = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(str.maketrans(variants.UPPER, variants.LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    assert got == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    assert variants.group_variants(variants.word_counts(docs(spark, [None, ""]))).count() == 0
    assert variants.group_variants(variants.word_counts(docs(spark, ["a"]).where("false"))).count() == 0


def test_long_chains_have_one_root(spark):
    """Each word is one letter from the next, which is more frequent than twice as much."""
    counts = {}
    w = list("aaaaaaaaaaaaaaaaaaaa")
    for k in range(20):
        counts["".join(w)] = 3 * 3**k
        w[k] = "b"
    got = {r["word"]: r["root"] for r in variants.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert set(got.values()) == {max(counts, key=counts.get)}
