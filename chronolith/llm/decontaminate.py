"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick, set_aside, slices, table

WINDOW = 10
#: Words of an item block whose tables one pass ships to the executors, and bytes of its texts; larger benchmarks take
#: several passes. A worker's tables take some 1,200 bytes a word, so 120 MB.
BLOCK_WORDS, BLOCK_BYTES = 100_000, 4_000_000

#: Bytes that aren't of a word become spaces, A-Z become a-z; all bytes from 0x80 belong to words.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else 32 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Runs of ``size`` words; fewer words, but not none, are one window."""
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class WuManber:
    """Search for patterns of one length, in words.

    ``shift`` tells for a block of words how far the search may skip: to the nearest place at which the block could
    end within a pattern. Where that is 0, the bucket of the block, as a pattern's last one, has the patterns by their
    first block, and direct comparison confirms them.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], list]):
        self.length = m = len(next(iter(patterns)))
        self.block = b = min(3, m)
        self.skip = m - b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = {}
        for pattern, items in patterns.items():
            for end in range(b, m + 1):
                key = pattern[end - b : end]
                self.shift[key] = min(self.shift.get(key, self.skip), m - end)
            self.buckets.setdefault(pattern[m - b :], {}).setdefault(pattern[:b], []).append((pattern, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list]]:
        """(start, items of the pattern) of every occurrence."""
        m, b, skip, shift, buckets = self.length, self.block, self.skip, self.shift.get, self.buckets
        end, n = m, len(words)
        while end <= n:
            key = tuple(words[end - b : end])
            step = shift(key, skip)
            if step:
                end += step
                continue
            start = end - m
            if rest := buckets[key].get(tuple(words[start : start + b])):
                here = tuple(words[start:end])
                for pattern, items in rest:
                    if pattern == here:
                        yield start, items
            end += 1


def build(items: list[tuple[str, bytes | None]]) -> list[WuManber]:
    """A searcher for each pattern length, over items (id as text, text)."""
    by_length: dict[int, dict[tuple[bytes, ...], set]] = {}
    for name, text in items:
        for window in windows_of(words_of(text)):
            by_length.setdefault(len(window), {}).setdefault(window, set()).add(name)
    return [WuManber({w: sorted(names) for w, names in p.items()}) for _, p in sorted(by_length.items())]


def mark(words: list[bytes], searchers: list[WuManber], spans: list[tuple[int, int]], items: set[str]) -> list[tuple[int, int]]:
    """The merged spans of words within occurrences, ``spans`` included; adds to ``items``."""
    found = list(spans)
    for s in searchers:
        for start, names in s.search(words):
            found.append((start, start + s.length))
            items.update(names)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str, bytes | None]]]:
    """Items in blocks of about ``most`` words or BLOCK_BYTES, and at least one; the driver holds one block at a time."""
    block, words, size = [], 0, 0
    for name, text in pick(benchmark, "item_id", "text").where("item_id is not null").select(
        F.col("item_id").cast("string"), F.col("text").cast("string").cast("binary")
    ).toLocalIterator():
        text = bytes(text) if text is not None else None
        block.append((name, text))
        words += len(words_of(text))
        size += len(text or b"")
        if words >= most or size >= BLOCK_BYTES:
            yield block
            block, words, size = [], 0, 0
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, block_words: int = BLOCK_WORDS, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans of every row of docs (doc_id, text).

    ``spans`` lists starts and ends of the hit runs of words. ``keep`` names further columns of docs to carry, ``with_text``
    carries the text.

    Null or empty texts have no words and aren't contaminated; null or empty items have no windows; items with null id
    don't take part. Repeated rows are each judged. Equal windows of several items count for all of them. An empty
    benchmark marks nothing; an empty docs table gives an empty result.

    One narrow pass over the documents for each block of the benchmark, no exchange. A block's tables are broadcast;
    their size is bounded by ``block_words`` and BLOCK_BYTES, but for a single longer item. A larger benchmark takes more
    passes, each over what the one before has written to the shared folder, so neither driver nor executors hold more
    than one block. A text of any length is one value of a Python worker, some sixty bytes for each of its words.
    """
    keep = keep or []
    spark = docs.sparkSession
    now = pick(docs, "doc_id", *keep, "text")
    head = now.schema.fields[:-1]
    now = now.withColumn("text", F.col("text").cast("string")).withColumnRenamed("text", "__text")
    blocks = _blocks(benchmark, block_words)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        shipped = spark.sparkContext.broadcast(block)
        now = now.mapInArrow(_marker(shipped, after is None, with_text), _schema(head, after is None, with_text))
        if after is not None:
            now = materialize(now, "marked")
            shipped.destroy()
        block = after
    return now


def _schema(head: list, last: bool, with_text: bool) -> str:
    ends = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<bigint>"
    names = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in head] + ["text string"] * (last and with_text))
    return f"{names}, {ends if last else '__text string, __spans array<bigint>, __items array<string>'}"


def _marker(shipped, last: bool, with_text: bool):
    """One pass: adds the occurrences of a block's windows; the last pass also makes the digests."""

    def search(batches):
        searchers = build(shipped.value)
        for batch in slices(batches):
            texts = batch.column("__text").cast(pa.binary()).to_pylist()
            first = "__spans" not in batch.schema.names
            had = [[]] * len(texts) if first else batch.column("__spans").to_pylist()
            names = [[]] * len(texts) if first else batch.column("__items").to_pylist()
            counts, spans, items = [], [], []
            for text, flat, before in zip(texts, had, names, strict=True):
                words, found = words_of(text), set(before)
                merged = mark(words, searchers, list(zip(flat[::2], flat[1::2], strict=True)), found)
                counts.append(len(words))
                spans.append([x for span in merged for x in span])
                items.append(sorted(found))
            head = [c for c in batch.schema.names if c not in ("__text", "__spans", "__items")]
            out = {c: batch.column(c) for c in head}
            flat = pa.array(spans, pa.list_(pa.int64()))
            if last:
                if with_text:
                    out["text"] = batch.column("__text")
                out["n_words"] = pa.array(counts, pa.int64())
                out["n_hit"] = pa.array([sum(s[1::2]) - sum(s[::2]) for s in spans], pa.int64())
                out["n_items"] = pa.array([len(i) for i in items], pa.int64())
                out["items_sha256"] = pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string())
                out["contaminated"] = pa.array([bool(s) for s in spans], pa.bool_())
                out["spans"] = flat
            else:
                out |= {"__text": batch.column("__text"), "__spans": flat, "__items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict(out)

    return search


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document has of the benchmark's windows."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without those that hold a window of the benchmark."""
    plain, names = set_aside(docs, "doc_id", "text")
    rest = [c for c in names if c not in ("doc_id", "text")]
    found = find_contamination(plain, benchmark, keep=rest, with_text=True)
    return found.where(~F.col("contaminated")).select(*names).toDF(*docs.columns)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS m, array_to_string(ws[s:s + least(10, len(ws)) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS s FROM i WHERE len(ws) > 0)),
ms AS (SELECT DISTINCT m FROM iw),
dw AS (
  SELECT doc_id, m, s, array_to_string(ws[s:s + m - 1], ' ') AS win
  FROM (SELECT doc_id, m, ws, unnest(range(1, len(ws) - m + 2)) AS s FROM w, ms WHERE len(ws) >= m)),
occ AS (SELECT d.doc_id, d.m, d.s, iw.item_id FROM dw d JOIN iw ON d.m = iw.m AND d.win = iw.win),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(s, s + m)) AS p FROM occ) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
