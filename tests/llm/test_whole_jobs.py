"""Inputs on which an operator once did less than its whole job."""

import itertools
import random

from pyspark.sql import functions as F
from test_llm_small import docs

from chronolith.llm import html_text, near_dup, url_filter


def test_chained_copies_are_one_component(spark):
    rng = random.Random(4)
    chain = [[f"w{rng.randrange(5000)}" for _ in range(100)]]
    for _ in range(399):
        copy = list(chain[rng.randrange(len(chain))])
        copy[rng.randrange(len(copy))] = f"w{rng.randrange(5000)}"
        chain.append(copy)
    sets = [{tuple(c[i : i + 5]) for i in range(96)} for c in chain]
    parent = list(range(len(chain)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(chain)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = near_dup.near_duplicates(docs(spark, [" ".join(c) for c in chain])).collect()
    wrong = [r["doc_id"] for r in got if r["component_id"] != find(r["doc_id"])]
    assert not wrong, f"{len(wrong)} of {len(chain)}"


def _lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = list(itertools.accumulate(range(len(b)), lambda left, j: row[j] + 1 if x == b[j] else max(left, row[j + 1]), initial=0))
    return row[-1]


def test_lcs_is_longest_at_every_size():
    rng = random.Random(6)
    for size, kinds in ((30, 4), (200, 9), (2100, 40)):
        a, b = ([rng.randrange(kinds) for _ in range(size)] for _ in range(2))
        got = html_text.shared_lines(a, b)
        assert len(got) == _lcs_length(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in sorted(got))


def test_copies_of_a_page_keep_its_text(spark):
    page = lambda *own: "<body>" + "".join(f"<p>{x}</p>" for x in ("Menu", *own, "Foot")) + "</body>"
    rows = [
        (1, "http://a.org/x/1", page("one", "two")),
        (2, "http://a.org/x/1?s=2", page("one", "two")),
        (3, "http://a.org/x/1", page("one", "two")),
        (4, "http://a.org/x/2", page("three")),
        (5, "http://a.org/x/3", page("one", "two")),
        (6, "http://b.org/x", page("alone")),
        (7, "http://b.org/x", page("alone")),
    ]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    alone = "Menu\n\nalone\n\nFoot"
    assert got == {1: "one\n\ntwo", 2: "one\n\ntwo", 3: "one\n\ntwo", 4: "three", 5: "one\n\ntwo", 6: alone, 7: alone}


def test_relative_links_carry_decisions(spark):
    refs = ["b.html", "./b.html", "../x/b.html", "../../../x/b.html", "b.html?u=http://c.org/", "b.html#top"]  # a query doesn't change which rule fits
    pages = [(i, f"http://a.org/x/p{i}", f'<link rel="canonical" href="{r}">') for i, r in enumerate(refs)]
    pages += [(10, "http://a.org/x/q", '<meta http-equiv="refresh" content="0; url=b.html">'), (11, "http://a.org/x/", '<link rel=canonical href="b.html">')]
    pages += [(12, "http://a.org/x/self", '<link rel=canonical href="?id=2">'), (13, "http://a.org/x/m", '<link rel=canonical href="mailto:b.html">')]
    pages += [(14, "http://a.org/x/d/", '<link rel=canonical href="..">'), (15, "http://a.org", '<link rel=canonical href="x/b.html">')]
    rules = (("block", "a.org", "/x/b.html"),)
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(table, rules).collect()}
    assert {i for i, v in got.items() if v == "block"} == {*range(len(refs)), 10, 11, 14, 15}


def test_references_resolve_against_the_page(spark):
    want = {"g": "/b/c/g", "../g": "/b/g", "../..": "/", "?y": "/b/c/d?y", "#s": "/b/c/d?q", "g/": "/b/c/g/", "./": "/b/c/", "/x/../g": "/g", "g/./h/../i": "/b/c/g/i", "g?y/../x": "/b/c/g?y/../x", "g?u=http://c.org/": "/b/c/g?u=http://c.org/"}
    df = spark.createDataFrame([(t,) for t in want], "t string").select("t", url_filter.resolved(F.col("t"), *map(F.lit, ("a.org", "/b/c/d", "?q"))).alias("u"))
    assert {r["t"]: r["u"] for r in df.collect()} == {t: "http://a.org" + p for t, p in want.items()}
