"""Main text of web pages: containers where a page names them, and differencing against the nearest URL elsewhere."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import global_rank, materialize, pick, slices, table
from .url_filter import host_of, path_of

#: Elements whose content is raw text up to their end tag.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Elements that hold no main text, whatever they're called.
_CHROME = frozenset(
    "nav header footer aside form noscript template svg canvas button select option datalist dialog menu object audio video map head".split()
)
#: Elements that begin and end a block.
_BLOCK = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html legend li "
    "main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Hides an article within it too, as what holds comments does; a main element and an article within any other element begin anew.
_SEALED = frozenset("nav footer aside dialog".split())
_UNSEEN = frozenset("noscript template svg canvas select option datalist object audio video map head".split())
#: Classes, ids and roles that as a whole name what isn't main text.
_SURE = re.compile(
    r"(?:ads?|adverts?|advertisements?|advertising|ad-?(?:banner|box|block|slot|unit|container|wrapper)|sponsor(?:ed)?|promo(?:tion)?s?|"
    r"cookie-?(?:banner|notice|consent|bar|box)|consent|notices?|gdpr|popup|modal|overlay|side-?bar|widgets?|navbar|nav|navigation|menus?|breadcrumbs?|pagination|"
    r"pager|toolbar|(?:site|page|main)-?(?:header|footer|nav|menu)|masthead|footer|comments?|comments?-?(?:area|list|form|section|box|block)|disqus(?:_thread)?|"
    r"replies|respond|shar(?:e|ing)|social|related|recommended|newsletter|subscribe|signup|login|search|search-?(?:form|box|bar)|skip-?link|complementary|contentinfo)",
    re.I,
)
#: Of these, what holds the comments of readers, and what is one of them.
_COMMENTS = re.compile(r"comments|comments?-?(?:area|list|section|box|block)|disqus(?:_thread)?|replies", re.I)
_COMMENT = re.compile(r"comment|comment-?(?:body|item|entry|content|\d+)|reply", re.I)
#: Of these, what may be a part of an article as well, and within one only raises a doubt.
_SOFT = re.compile(r"related|recommended|search", re.I)
#: Words within them that only raise a doubt.
_DOUBT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banners?|cookies?|consent|notices?|gdpr|popup|modal|overlay|side-?bar|widgets?|nav\w*|menus?|"
    r"breadcrumbs?|pagination|pager|toolbar|header|masthead|footer|comments?|commentlist|disqus|replies|respond|shar(?:e|ing)|social|related|recommended|"
    r"newsletter|subscribe|signup|login|search|skip)(?:$|[\s_-])",
    re.I,
)
#: Attributes that hide an element, or give it a role.
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_STOP = re.compile("[>\"']")


class _Tags:
    """Finds the marks of a page from left to right, in time linear in the page whatever is left open."""

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'>"}
        self.quoted = True

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose name ends at ``at``; -1 if there is none.

        A quote without a partner is a sign like others. Where all that follows lies in quotes, they are given up from there on.
        """
        if at > self.last[">"]:
            return -1
        begin = at
        while self.quoted:
            m = _STOP.search(self.page, at)
            if not m:
                self.quoted = False
            elif m.group() == ">":
                return m.start()
            else:
                at = m.end()
                if m.start() < self.last[m.group()]:
                    at = self.page.find(m.group(), at) + 1
        return self.page.find(">", begin)

    def next(self, at: int) -> tuple[re.Match, int] | None:
        """The next mark from ``at`` on, and where it ends."""
        while m := _MARK.search(self.page, at):
            if m.group(2) is None:
                return m, m.end()
            if (end := self.end(m.end())) < 0:
                return None
            return m, end + 1
        return None


#: Kinds of blocks: outside articles; within one; within one, in an element whose name raises a doubt; plainly no main text.
LOOSE, MAIN, DOUBT, CHROME = 0, 1, 2, 3


def blocks_of(page: str | None, with_chrome: bool = False) -> list[tuple[int, str]]:
    """(kind, block) of all blocks in page order; what is plainly no main text, as menus and feet, only ``with_chrome``.

    What an element's name says never hides an article or main element within it: there all begins anew, but for
    articles in menus, feet and asides, and in what surely holds comments. An article is hidden itself if it is a comment
    by its name, or if all of its names say that it is no text; one such name among others raises a doubt. So do a header
    within an article, names that may be those of an article's own parts, and names that only hint.
    """
    out: list[tuple[int, str]] = []
    if not page:
        return out
    text: list[str] = []
    chrome: list[str] = []
    # Open elements that matter: name; what they add to the counts below; whether a container; counts before an outermost one.
    stack: list[tuple[str, tuple[int, int, int, int], bool, tuple[int, int] | None]] = []
    hidden = doubts = sealed = unseen = within = 0
    at, end = 0, len(page)
    tags, open_names = _Tags(page), Counter()

    def flush() -> None:
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            if block:
                out.append(((DOUBT if doubts else MAIN) if within else LOOSE, block))
            text.clear()
        if chrome:
            block = " ".join(html.unescape("".join(chrome)).split())
            if block:
                out.append((CHROME, block))
            chrome.clear()

    def add(some: str) -> None:
        if not hidden:
            text.append(some)
        elif with_chrome:
            chrome.append(some)

    def push(name: str, adds: tuple[int, int, int, int], container: bool = False, before: tuple[int, int] | None = None) -> None:
        nonlocal hidden, doubts, sealed, unseen, within
        stack.append((name, adds, container, before))
        open_names[name] += 1
        hidden, doubts, sealed, unseen, within = hidden + adds[0], doubts + adds[1], sealed + adds[2], unseen + adds[3], within + container

    def close(upto: int) -> None:
        nonlocal hidden, doubts, sealed, unseen, within
        while len(stack) > upto:
            name, adds, container, before = stack.pop()
            open_names[name] -= 1
            hidden, doubts, sealed, unseen, within = hidden - adds[0], doubts - adds[1], sealed - adds[2], unseen - adds[3], within - container
            if before:
                hidden, doubts = before

    while at < end:
        if not (found := tags.next(at)):
            add(page[at:])
            break
        m, after = found
        if m.start() > at:
            add(page[at : m.start()])
        at = after
        if m.group(2) is None:
            if m.group().startswith("<![CDATA["):
                add(html.escape(m.group()[9:].removesuffix("]]>"), quote=False))
            continue
        name, inside = m.group(2).lower(), page[m.end() : after - 1]
        if m.group(1):
            if name in _BLOCK or name in _CHROME:
                flush()
            if open_names[name]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name in _RAW:
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if name == "textarea" or name == "plaintext":
                flush()
            at = stop.end() if stop else end
            continue
        if name == "br":
            add(" ")
        if name in _BLOCK or name in _CHROME:
            flush()
            if name == "body":
                close(0)
            elif stack and stack[-1][0] == "p" or stack and stack[-1][0] == name == "li":
                close(len(stack) - 1)  # their end tags may be left out
        if name in _VOID or inside.rstrip().endswith("/"):
            continue
        attributes = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(inside)} if inside.strip() else {}
        names = " ".join(attributes.get(k, "") for k in ("class", "id", "role"))
        named = name not in ("body", "html", "main") and bool(names.strip())
        gone = name in _UNSEEN or "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attributes.get("style", "")))
        tokens = names.split() if named else []
        sure = [t for t in tokens if _SURE.fullmatch(t)]
        soft = bool(within) and all(map(_SOFT.fullmatch, sure))  # also where none is sure
        called = bool(sure) and not soft
        if name in ("article", "main") or attributes.get("role") == "main":
            flush()
            before = None
            if not within:
                before = hidden, doubts
                hidden, doubts = unseen + (sealed if name == "article" else 0), 0
            hides = gone or any(map(_COMMENT.fullmatch, tokens)) or bool(sure) and len(sure) == len(tokens)
            push(name, (int(hides), int(bool(sure) and not hides), 0, int(gone)), True, before)
            continue
        hides = gone or called or name in _CHROME and not (name == "header" and within)
        doubt = not hides and (name == "header" or named and name in _BLOCK and bool(sure or _DOUBT.search(names)))
        if hides or doubt or name not in ("p", "li", "td", "th", "tr", "dd", "dt", "option", "b", "i", "a", "span", "em", "strong"):
            if hides or doubt:
                flush()
            push(name, (int(hides), int(doubt), int(name in _SEALED or any(map(_COMMENTS.fullmatch, sure))), int(gone)))
    flush()
    return out


def _line_key(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def shared_lines(own: list[int], other: list[int]) -> set[int]:
    """Places in ``own`` of a longest common subsequence with ``other``.

    Ends that are alike are taken off first. The rest is aligned by Hirschberg's halving: lengths over prefixes of
    ``own`` and over suffixes say where ``other`` is to be cut, so space is linear at every size. A row of lengths is the
    bits of one integer (Hyyro), so a pass takes a step a line, whose words of bits are the lines of the other list.
    """
    out: set[int] = set()
    todo = [(0, len(own), 0, len(other))]
    while todo:
        a, x, b, y = todo.pop()
        while a < x and b < y and own[a] == other[b]:
            out.add(a)
            a, b = a + 1, b + 1
        while x > a and y > b and own[x - 1] == other[y - 1]:
            x, y = x - 1, y - 1
            out.add(x)
        if a == x or b == y:
            continue
        if x - a == 1:
            if own[a] in other[b:y]:
                out.add(a)
            continue
        half = (a + x) // 2
        before = _lcs_lengths(own[a:half], other[b:y])
        after = _lcs_lengths(own[half:x][::-1], other[b:y][::-1])
        best = max(range(y - b + 1), key=lambda j: before[j] + after[y - b - j])
        todo += [(a, half, b, b + best), (half, x, b + best, y)]
    return out


def _lcs_lengths(lines: list[int], other: list[int]) -> list[int]:
    """Lengths of the longest common subsequences of ``lines`` and each prefix of ``other``."""
    n = len(other)
    full = (1 << n) - 1
    places: dict[int, list[int]] = {}
    for j, line in enumerate(other):
        places.setdefault(line, []).append(j)
    masks = {}
    for line in set(lines) & places.keys():
        bits = bytearray(n // 8 + 1)
        for j in places[line]:
            bits[j >> 3] |= 1 << (j & 7)
        masks[line] = int.from_bytes(bits, "little")
    row = full  # a zero bit is a place where the length grows
    for line in lines:
        if line in masks:
            met = row & masks[line]
            row = ((row + met) | (row - met)) & full
    out = [0] * (n + 1)
    grown = row.to_bytes(n // 8 + 1, "little")
    for j in range(n):
        out[j + 1] = out[j] + (not grown[j >> 3] >> (j & 7) & 1)
    return out


def _digest(blocks: list[tuple[int, str]]) -> bytes:
    whole = "\n".join(f"{kind} {x}" for kind, x in blocks)  # no block holds a line break
    return hashlib.blake2b(whole.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _lined(batches):
    """The lines of whole pages as hashes; digests of those that may be text, and of all."""
    for batch in slices(batches):
        lines, digests, wholes = [], [], []
        for page in batch.column("html").to_pylist():
            blocks = blocks_of(page, True)
            lines.append([_line_key(x) for _, x in blocks])
            digests.append(_digest([b for b in blocks if b[0] != CHROME]))
            wholes.append(_digest(blocks))
        out = {c: batch.column(c) for c in ("host", "path", "tag")}
        yield pa.RecordBatch.from_pydict(out | {"lines": pa.array(lines, pa.list_(pa.int64())), "digest": pa.array(digests, pa.binary()), "whole": pa.array(wholes, pa.binary())})


def _parsed(batches):
    """The blocks that the check of the markup lets through, their places among all lines, and whether it is sure of them."""
    for batch in slices(batches):
        parts, places, sures, wholes = [], [], [], []
        for page in batch.column("html").to_pylist():
            blocks = blocks_of(page, True)
            contained = any(kind in (MAIN, DOUBT) for kind, _ in blocks)
            own = [i for i, (kind, _) in enumerate(blocks) if kind != CHROME and (not contained or kind != LOOSE)]
            parts.append([blocks[i][1] for i in own])
            places.append(own)
            sures.append([blocks[i][0] == MAIN for i in own])
            wholes.append(_digest(blocks))
        out = {c: batch.column(c) for c in ("page_id", "url", "host")} | {"whole": pa.array(wholes, pa.binary())}
        out |= {"parts": pa.array(parts, pa.list_(pa.string())), "places": pa.array(places, pa.list_(pa.int32())), "sure": pa.array(sures, pa.list_(pa.bool_()))}
        yield pa.RecordBatch.from_pydict(out)


def _aligned(batches):
    """The places of a page's lines that its partner shares."""
    for batch in slices(batches):
        shared = [sorted(shared_lines(own, other)) for own, other in zip(batch.column("own").to_pylist(), batch.column("other").to_pylist(), strict=True)]
        out = {"host": batch.column("host"), "whole": batch.column("whole"), "shared": pa.array(shared, pa.list_(pa.int32()))}
        yield pa.RecordBatch.from_pydict(out)


def _differenced(batches):
    """Texts without the lines shared, but for those that the markup is sure of."""
    for batch in slices(batches):
        texts, counts, backs = [], [], []
        for parts, places, sure, shared in zip(*(batch.column(c).to_pylist() for c in ("parts", "places", "sure", "shared")), strict=True):
            gone = set(shared or ())
            texts.append("\n\n".join(part for part, at, keep in zip(parts, places, sure, strict=True) if keep or at not in gone))
            counts.append(len(gone))
            backs.append(sum(keep and at in gone for at, keep in zip(places, sure, strict=True)))
        out = {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string())}
        out |= {"n_chars": pa.array([len(t) for t in texts], pa.int64()), "n_shared": pa.array(counts, pa.int64()), "n_returned": pa.array(backs, pa.int64())}
        yield pa.RecordBatch.from_pydict(out)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared, n_returned of every row of pages (page_id, url, html).

    Every page is paired with the page of the nearest URL on its host, and all their lines, menus and feet among them, are
    aligned by longest common subsequence; shared lines (n_shared) are deleted. A check of the markup follows, since
    articles share sentences and a page may have a menu of its own: it returns lines (n_returned) that are surely text, and
    takes out others that surely are not. Sure of being no text: menus, feet, asides, forms, headers outside articles,
    hidden parts, and elements whose class, id or role is a usual name of menus, notices, adverts, comments or such. Sure
    of being text: all else in an article or main element, or one with that role; where a page has one, what lies outside
    isn't taken. So the difference alone decides on all of a page without such an element, and within one on headers and
    on elements whose names only hint at something else. Scripts and styles are no lines.

    Pages of a host whose blocks that may be text are equal are copies: one class, aligned with the nearest page of another class, so that all
    copies have the same text. Nearest: of the neighbours of its members in the order of paths, the one with most path in
    common, the earlier in a tie.

    Null html counts as empty: an empty text. Null or malformed urls share an empty host. Pages without another class
    on their host, and pages that share no line, are left as they are. An empty table gives an empty result.

    Scale: pages are parsed twice, for their hashes and for their texts, so that texts are written once. Neighbours come from
    a global rank over host and path, so a host with a third of all pages is spread over tasks, and from joins on unique
    ranks; classes are aggregated, partially on the map side, and equal pages aligned once. Shared lines grow with
    the pages, so no side of these joins is broadcast. Only hashes of lines meet, not pages.
    """
    base = pick(pages, "page_id", "url", "html").withColumn("tag", F.monotonically_increasing_id())
    base = base.withColumn("url", F.col("url").cast("string")).withColumn("html", F.col("html").cast("string"))
    base = base.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "tag", "html")
    kind = base.schema["page_id"].dataType.simpleString()
    lined = materialize(base.mapInArrow(_lined, "host string, path string, tag bigint, lines array<bigint>, digest binary, whole binary"), "pages")

    places = global_rank(lined.select("host", "path", "tag", "digest"), ["host", "path", "tag"])
    ranked = materialize(places.select("host", "path", "tag", "digest", "rank"), "page-ranks")
    sides = ranked.select("host", "path", "digest", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"), "rank")
    sides = sides.withColumn("next", F.col("rank") + F.col("side"))
    there = ranked.select(F.col("rank").alias("next"), F.col("host").alias("their_host"), F.col("path").alias("their_path"), F.col("tag").alias("their_tag"), F.col("digest").alias("their_digest"))
    near = sides.join(there, "next").where((F.col("host") == F.col("their_host")) & (F.col("digest") != F.col("their_digest")))
    alike = _common_prefix(F.col("path"), F.col("their_path"))
    near = near.withColumn("alike", alike)
    # In the order of paths the most path in common with a page of another class is that of two neighbours.
    best = near.groupBy("host", "digest").agg(F.max_by("their_tag", F.struct("alike", -F.col("side"), -F.col("rank"))).alias("their_tag"))
    each = lined.groupBy("host", "digest", "whole").agg(F.min("tag").alias("tag"))
    own = lined.select("tag", F.col("lines").alias("own"))
    other = lined.select(F.col("tag").alias("their_tag"), F.col("lines").alias("other"))
    pairs = each.join(best.hint("merge"), ["host", "digest"]).join(own.hint("merge"), "tag").join(other.hint("merge"), "their_tag").select("host", "whole", "own", "other")
    shared = materialize(pairs.mapInArrow(_aligned, "host string, whole binary, shared array<int>"), "shared-lines")
    parsed = base.mapInArrow(_parsed, f"page_id {kind}, url string, host string, whole binary, parts array<string>, places array<int>, sure array<boolean>")
    compared = parsed.join(shared.hint("merge"), ["host", "whole"], "left").select("page_id", "url", "parts", "places", "sure", "shared")
    return compared.mapInArrow(_differenced, f"page_id {kind}, url string, text string, n_chars bigint, n_shared bigint, n_returned bigint")


def _common_prefix(a, b):
    """Length of the common prefix of two strings."""
    least = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: a.substr(i, F.lit(1)) != b.substr(i, F.lit(1)))
    return F.when(F.size(differ) > 0, differ[0] - 1).otherwise(least)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(table(spark, sf_dir, "pages"))
