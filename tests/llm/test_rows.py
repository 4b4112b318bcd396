"""Rows that repeat an id or have none, and markup that is never closed."""

import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chronolith.llm import html_text, near_dup, secrets, sharding, topk, url_filter


def test_texts_that_share_a_doc_id_stay_apart_in_the_stage(spark):
    a, b = ("one two three four five six seven " * 3 + x for x in ("alpha beta", "gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"))
    rows = [(3, b), (5, a), (5, b), (5, a), (None, b), (None, a), (7, None), (8, "")]
    out = near_dup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(3, b), (5, a), (5, a), (None, b), (None, a), (7, None), (8, "")], key=str)


def test_shards_hold_every_row(spark, tmp_path):
    rows = [(1, "a", "en", "s", 1), (1, "b" * 50, "de", "t", 2), (None, "c", None, None, 3), (None, None, "en", "s", 4), (2, "a", "en", "s", 5), (1, "a", "en", "s", 6)]
    some = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, SHARD int")
    path = str(tmp_path / "shards")
    sharding.write_shards(some, path, 4)
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.select(*some.columns).collect()), key=str) == sorted(rows, key=str)
    places = back.groupBy("shard_").agg(F.sort_array(F.collect_list("slot")).alias("slots")).collect()
    assert sorted(len(r["slots"]) for r in places) == [1, 1, 2, 2] and all(r["slots"] == list(range(len(r["slots"]))) for r in places)
    assert pq.read_table(path).num_rows == len(rows)


def test_every_row_is_a_query_and_a_vector(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 2).collect()
    lists = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)
    assert lists == [(0, 1, 1, 65536), (0, 1, 1, 65536), (0, 2, 0, 0), (0, 2, 2, 32768)]


SHAPES = ["<a ", "<div>", "<div></p>", '<a ">"', "<a '", "<a \"'>", "<link ", "<meta ", "<script>", "<!--", '<b x="', "</p>", "<p>x", "<article class='comments'>", "<![CDATA["]


@pytest.mark.parametrize("shape", SHAPES)
def test_markup_of_any_shape_takes_linear_time(shape):
    began = time.time()
    html_text.blocks_of(shape * (1_000_000 // len(shape)))
    assert time.time() - began < 20


def test_links_of_pages_never_closed(spark):
    pages = [(i, f"http://a.net/{i}", shape * (1_000_000 // len(shape))) for i, shape in enumerate(["<link ", "<meta ", "<link rel=canonical href='x'", '<link rel="canonical" href="/b">'])]
    began = time.time()
    rows = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(rows) == 4 and time.time() - began < 60


def test_comments_and_names_of_articles():
    kinds = lambda page: [(k, t) for k, t in html_text.blocks_of(page) if k != html_text.LOOSE]
    main, doubt = html_text.MAIN, html_text.DOUBT
    assert kinds('<div class="comments"><article><p>reader</p></article></div><article class="post"><p>yes</p></article>') == [(main, "yes")]
    assert kinds('<article class="post comments"><p>text</p></article>') == [(doubt, "text")]
    assert kinds('<article>a<section class="related">b</section><div class="search">c</div><div class="ad">d</div></article>') == [(main, "a"), (doubt, "b"), (doubt, "c")]
    assert kinds('<div class="related"><article>a</article></div>') == [(main, "a")]
    assert kinds('<main>t<div id="comments"><article>c</article></div></main>') == [(main, "t")]
    assert kinds('<article id="comment-12" class="comment">c</article>') == []


def test_whole_pages_with_planted_boilerplate(spark):
    """Pages without an article: what the pages of a host share goes, what a page has of its own stays."""
    own = {i: [f"own line {i} {k}" for k in range(6)] for i in range(8)}
    frame = ["Home and more", "Read this too", "All rights kept"]
    page = lambda i: "".join(f"<div>{x}</div>" for x in [frame[0], *own[i][:3], frame[1], *own[i][3:], frame[2]])
    rows = [(i, f"http://h.org/a/{i}", f"<html><body><nav>menu {i}</nav>{page(i)}<script>x</script></body></html>") for i in own]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n\n".join(lines) for i, lines in own.items()}


@pytest.mark.parametrize("gap", [1, 3000])
def test_neighbours_of_a_candidate_are_words_of_any_length(gap):
    forest = secrets.train_forest()
    key = "c9Vb3Lq8Zx2Wm5RtK7pQ1nS4d"
    text = f"secret token {chr(121) * gap} {key} and more"
    n, found = secrets.scan_text(text, None, forest)
    assert n == 1 and [text[a:b] for a, b, *_ in found] == [key]


def test_every_page_is_differenced(spark):
    """Menus and feet take part in the alignment of pages with an article; the check returns the sentence that articles share."""
    page = lambda i, *own: f"<html><body><nav><a>home</a></nav><div class=ad>buy {i}</div><article><p>{'</p><p>'.join(own)}</p></article><footer>foot</footer></body></html>"
    rows = [(1, "http://h.org/a/1", page(1, "one", "both")), (2, "http://h.org/a/2", page(2, "two", "both")), (3, "http://z.org/", page(3, "alone"))]
    got = {r["page_id"]: (r["text"], r["n_shared"], r["n_returned"]) for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("one\n\nboth", 3, 1), 2: ("two\n\nboth", 3, 1), 3: ("alone", 0, 0)}


def test_copies_with_other_menus_are_copies(spark):
    page = lambda menu, *own: f"<html><body><nav>{menu}</nav><p>top</p><p>{'</p><p>'.join(own)}</p></body></html>"
    rows = [(1, "http://h.org/a/1", page("mon", "one")), (2, "http://h.org/a/1?x", page("tue", "one")), (3, "http://h.org/b", page("mon", "two"))]
    got = {r["page_id"]: (r["text"], r["n_shared"]) for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("one", 2), 2: ("one", 1), 3: ("two", 1)} or got == {1: ("one", 2), 2: ("one", 1), 3: ("two", 2)}
