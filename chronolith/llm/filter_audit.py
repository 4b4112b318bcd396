"""Filter interaction audit by inclusion and exclusion over all 32 intersections of five filters."""

from __future__ import annotations

import hashlib
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, slices, table

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
#: What is counted: rows, rows of good quality, toxic rows.
WEIGHTS = ("rows", "good", "toxic")
CAPITALS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"


def text_failures(batches):
    """doc_id, part, digest and the flags A to D of Arrow batches (doc_id, part, text): what a text alone decides.

    White space that parts words is that of bytes.split(); every other sign that is counted is one byte wide, too.
    """
    for batch in slices(batches, 1024):
        rows = []
        column = batch.column("text")
        for text, points in zip(column.cast(pa.binary()).to_pylist(), pc.utf8_length(column).to_pylist(), strict=True):
            words = text.split()
            capitals = len(text) - len(text.translate(None, CAPITALS))
            marked = len(text) != len(text.translate(None, MARKS))
            fails = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * capitals > 5 * points, marked)
            rows.append((hashlib.sha256(text).digest(), *map(int, fails)))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        arrays = [pa.array(c, pa.binary() if i == 0 else pa.int32()) for i, c in enumerate(columns)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), *arrays], ["doc_id", "part", "digest", *"ABCD"])


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, the flags A to E, and ``rows`` (1), ``good``, ``toxic`` of every row of docs (doc_id, text, source).

    Only a digest of the text, the flags and ids leave the scan. E: another row, with a smaller doc_id, has the same text
    (SHA-256); a null doc_id is smaller than none and larger than none. A doc_id that labels hold several times is good or
    toxic if any of its rows says so.
    """
    base = pick(docs, "doc_id", "text", "source")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    base = base.select("doc_id", text("source").alias("part"), text("text"))
    own = base.mapInArrow(text_failures, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, part string, digest binary, A int, B int, C int, D int")
    # A text that occurs once needs no partner: only those of several rows are joined back, which a hot text's rows reach by a skewed join.
    least = own.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    marks = pick(labels, "doc_id", "quality", "toxic").filter("doc_id IS NOT NULL").groupBy("doc_id")
    marks = marks.agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(k) for k, c in (("good", "quality"), ("toxic", "toxic"))])
    joined = own.join(least.select("digest", "least"), "digest", "left").join(marks, "doc_id", "left")
    late = F.coalesce((F.col("doc_id") > F.col("least")).cast("int"), F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select("part", *"ABCD", late.alias("E"), F.lit(1).alias("rows"), zero("good").alias("good"), zero("toxic").alias("toxic"))


def joint_counts(flags: DataFrame) -> DataFrame:
    """One row per part with, for each weight, the array of 32 joint counts: how many fail every filter of a set, by the set's bits.

    Each is a sum of products of flags, added up before the exchange, so no part's rows meet in one task.
    """

    product = lambda weight, mask: " * ".join([weight, *(name for i, name in enumerate(FILTERS) if mask >> i & 1)])
    joint = [F.expr(f"array({', '.join(f'sum({product(w, m)})' for m in range(ALL + 1))})").alias(w) for w in WEIGHTS]
    return flags.groupBy("part").agg(*joint)


def _array(joint: str, sums: list[list[tuple[int, int]]]) -> Column:
    """Array of sums of (factor, set) over the joint counts."""
    terms = lambda some: " + ".join(f"{factor} * {joint}[{mask}]" for factor, mask in some)
    return F.expr(f"array({', '.join(terms(some) for some in sums)})")


def _subsets(mask: int) -> list[int]:
    return [m for m in range(mask + 1) if m & ~mask == 0]


def survivors(joint: str) -> Column:
    """Array by a set's bits: how many fail none of the set (inclusion and exclusion over its subsets)."""
    return _array(joint, [[((-1) ** m.bit_count(), m) for m in _subsets(mask)] for mask in range(ALL + 1)])


def alone(joint: str) -> Column:
    """Array by filter: how many fail it and nothing else (Möbius inversion over the supersets)."""
    return _array(joint, [[((-1) ** m.bit_count(), m | 1 << i) for m in _subsets(ALL ^ 1 << i)] for i in range(len(FILTERS))])


def shapley(joint: str) -> Column:
    """Array by filter: rows it removes, summed over all orders.

    The rows that a set of filters removes are a game; by inclusion and exclusion the Harsanyi dividend of a set is its
    joint count, negative for sets of even size. A filter gets an equal share of every dividend it takes part in: in 120
    orders, 120 / size.
    """
    return _array(joint, [[(120 // m.bit_count() * (-1) ** (m.bit_count() + 1), m) for m in range(1, ALL + 1) if m >> i & 1] for i in range(len(FILTERS))])


def orders() -> Column:
    """All orders and their steps as an array: order, step, filter, and the sets of bits before and after the step."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(FILTERS[i] for i in order), step, f, before, before | 1 << f))
            before |= 1 << f
    kinds = (("filter_order", "string"), ("step", "int"), ("filter", "int"), ("before", "int"), ("after", "int"))
    return F.arrays_zip(*[F.split(F.lit(",".join(str(s[k]) for s in steps)), ",").cast(f"array<{kind}>").alias(name) for k, (name, kind) in enumerate(kinds)])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes, at every step of all 120 orders, in every part of docs (doc_id, text, source).

    One row per ``part`` (a source; null: empty string), ``filter_order`` and ``step``: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley, all long. A null text is empty; repeated rows each count, and rows of
    equal doc_id and text do not fail E by one another. An empty table gives no rows. 96 sums per part are all that is gathered.
    """
    counts = joint_counts(flagged(docs, labels))
    solved = counts.select(
        "part", _array("rows", [[(1, 1 << i)] for i in range(len(FILTERS))]).alias("fails"),
        *[survivors(w).alias(f"left_{w}") for w in WEIGHTS], alone("rows").alias("alone"), shapley("rows").alias("shares"),
    )
    rows = solved.select("*", F.explode(orders()).alias("o")).select("*", "o.*")
    at = lambda array, place: F.get(F.col(array), F.col(place))
    gone = lambda w: at(f"left_{w}", "before") - at(f"left_{w}", "after")
    return rows.select(
        "part", "filter_order", "step", at("left_rows", "after").alias("kept"), gone("rows").alias("removed"),
        (at("fails", "filter") - gone("rows")).alias("redundant"), at("alone", "filter").alias("unique_fails"),
        gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), at("shares", "filter").alias("shapley"),
    )


#: The same by going through every order, pattern by pattern.
ORACLE = r"""
WITH RECURSIVE labelled AS (
  SELECT doc_id, max(coalesce((quality = 1)::INT, 0)) AS good, max(coalesce((toxic = 1)::INT, 0)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
),
own AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    min(doc_id) OVER (PARTITION BY text) AS least
  FROM own
),
failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN cut.doc_id > least THEN 'E' ELSE '' END AS fails
  FROM cut LEFT JOIN labelled ON cut.doc_id = labelled.doc_id
),
patterns AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, fails),
orders(o) AS (
  SELECT '' UNION ALL SELECT o || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE NOT contains(o, f)
),
steps AS (SELECT o, s, substr(o, s, 1) AS f, substr(o, 1, s - 1) AS earlier FROM orders, range(1, 6) t(s) WHERE length(o) = 5),
met AS (
  SELECT part, o, s, f, n, good, toxic,
    contains(fails, f) AS here, fails = f AS only_here,
    len(list_filter(string_split(earlier, ''), lambda x: x <> '' AND contains(fails, x))) > 0 AS gone
  FROM patterns, steps
),
rows_ AS (
  SELECT part, o, s, f,
    sum(n) FILTER (NOT gone AND NOT here) AS kept, sum(n) FILTER (NOT gone AND here) AS removed,
    sum(n) FILTER (gone AND here) AS redundant, sum(n) FILTER (only_here) AS unique_fails,
    sum(good) FILTER (NOT gone AND here) AS good_lost, sum(toxic) FILTER (NOT gone AND here) AS toxic_lost
  FROM met GROUP BY part, o, s, f
)
SELECT part, o AS filter_order, s::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM rows_
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all documents, part by part and order by order."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
