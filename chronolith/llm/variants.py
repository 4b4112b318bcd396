"""Spelling variant grouping: words one error apart, found by automata that are read forwards and backwards.

Of two words that differ by one error, either the first half of the one begins the other, or its second half ends it. So
words meet by halves: a task holds the words that share beginnings (or ends) as a minimal acyclic automaton, walks the
half that must match exactly, and completes the rest with one error. The automaton numbers its words perfectly, in the
order of the alphabet, which leads back to the words and their counts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick, table

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word has at least so many code points and occurrences; a form is at least so many times as frequent.
LEAST_LENGTH, LEAST_N, TIMES = 5, 3, 2
#: Every so many-th run loses a code point, in the query.
SPOILT = 97
#: Words of one beginning or end that one task takes; more of them are dealt out to several.
GROUP_WORDS = 4_000
#: Words of one automaton, but for those of one group.
CELL_WORDS = 20_000


class Automaton:
    """The minimal acyclic automaton of sorted distinct words, with the number of each word along its path.

    Built by adding word after word: what the next word can't change any more is replaced by an equal state met before.
    An arc has the number of words that come before it in its state.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        counts: list[int] = []
        register: dict[tuple, int] = {}

        def close(final: bool, arcs: list[tuple[str, int]]) -> int:
            key = (final, tuple(arcs))
            at = register.get(key)
            if at is None:
                at = register[key] = len(counts)
                before, out = int(final), {}
                for sign, to in arcs:
                    out[sign] = (to, before)
                    before += counts[to]
                self.arcs.append(out)
                self.final.append(final)
                counts.append(before)
            return at

        path: list[tuple[str, list]] = []  # sign that leads to a state still open, and [final, arcs]
        root = [False, []]
        states = [root]
        last = ""
        for word in words:
            same = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                same += 1
            while len(states) - 1 > same:
                done = states.pop()
                states[-1][1].append((path.pop(), close(*done)))
            for sign in word[same:]:
                path.append(sign)
                states.append([False, []])
            states[-1][0] = True
            last = word
        while len(states) > 1:
            done = states.pop()
            states[-1][1].append((path.pop(), close(*done)))
        self.root = close(*root)

    def walk(self, state: int, number: int, text: str) -> tuple[int, int] | None:
        """State and number after text, or None."""
        arcs = self.arcs
        for sign in text:
            found = arcs[state].get(sign)
            if found is None:
                return None
            state, number = found[0], number + found[1]
        return state, number

    def one_error(self, exact: str, rest: str) -> set[int]:
        """Numbers of the words that begin with ``exact`` and go on like ``rest`` but for exactly one error."""
        out: set[int] = set()
        at = self.walk(self.root, 0, exact)
        if at is None:
            return out
        arcs, final = self.arcs, self.final
        state, number = at
        for i in range(len(rest) + 1):
            here = rest[i] if i < len(rest) else None
            after = rest[i + 1 :]
            for sign, (to, before) in arcs[state].items():
                if (end := self.walk(to, number + before, rest[i:])) and final[end[0]]:  # one more
                    out.add(end[1])
                if here is not None and sign != here and (end := self.walk(to, number + before, after)) and final[end[0]]:  # another
                    out.add(end[1])
            if here is None:
                break
            if (end := self.walk(state, number, after)) and final[end[0]]:  # one less
                out.add(end[1])
            found = arcs[state].get(here)
            if found is None:
                break
            state, number = found[0], number + found[1]
        return out


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def spoil(run: Column, doc_id: Column, every: int = SPOILT) -> Column:
    """The run, or where ``every`` divides the CRC of ``<doc_id>:<run>``, the run without the code point that the CRC points at."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, spoilt: int | None = None) -> DataFrame:
    """word, n: runs of letters of docs (doc_id, text), A to Z in lower case, of enough code points and occurrences.

    Null texts have none, a null doc_id counts as ''. Counts are added up before the exchange, so frequent words cost a row a task.
    """
    base = pick(docs, "doc_id", "text")
    runs = base.select("doc_id", F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    run = lower_ascii(F.col("run"))
    word = runs.select((spoil(run, F.col("doc_id"), spoilt) if spoilt else run).alias("word"))
    return word.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_N)


def _met(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, word, n) of words as what is searched, and rows (key, exact, word) of words that search.

    Words are turned round for the ends, so in both directions the exact part is a beginning. A word of m code points
    searches with its first m / 2, and, turned round, with its last m - m / 2. It is found by every beginning with which a
    word of one code point fewer, as many, or one more may search.
    """
    both = words.select(F.explode(F.array(F.struct(F.lit("F").alias("way"), F.col("word").alias("w")), F.struct(F.lit("B").alias("way"), F.reverse("word").alias("w")))), "word", "n")
    both = both.select("col.*", "word", "n").withColumn("m", F.length("w"))
    searching = lambda m: F.when(F.col("way") == "F", F.floor(m / 2)).otherwise(m - F.floor(m / 2)).cast("int")
    key = lambda h: F.concat(F.col("way"), F.substring(F.col("w"), F.lit(1), h))
    places = F.array_distinct(F.array(*[searching(F.col("m") + d) for d in (-1, 0, 1)]))
    there = both.select("way", "w", "n", F.explode(places).alias("h"), "m").filter("h <= m")
    there = there.select(key(F.col("h")).alias("key"), F.col("w").alias("word"), "n")
    asked = both.select(key(searching(F.col("m"))).alias("key"), searching(F.col("m")).alias("exact"), F.col("w").alias("word"))
    return there, asked


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: every pair of words (word, n), both ways round, that differ by exactly one code point, once each.

    Groups of one beginning (or end) are dealt to cells of about ``CELL_WORDS`` words; a group of more than ``GROUP_WORDS`` is split,
    and its searches go to each of its parts. A cell's automaton is all that a task holds; pairs follow from the words, at
    most some hundreds for one.
    """
    there, asked = _met(words)
    sizes = there.groupBy("key").agg(F.count(F.lit(1)).alias("words")).filter(F.col("words") > GROUP_WORDS)
    sizes = materialize(sizes.select("key", F.ceil(F.col("words") / GROUP_WORDS).cast("int").alias("parts")), "hot-groups")
    if sizes.head(1):
        there, asked = there.join(sizes, "key", "left"), asked.join(sizes, "key", "left")
        there = there.withColumn("piece", F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int"))
        asked = asked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    else:
        there, asked = there.withColumn("piece", F.lit(0)), asked.withColumn("piece", F.lit(0))
    spark = words.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = max(4 * tasks, 4 * words.count() // CELL_WORDS)
    cell = F.pmod(F.xxhash64("key", "piece"), F.lit(cells)).cast("int")
    way = F.substring("key", 1, 1)
    rows = there.select(cell.alias("cell"), way.alias("way"), F.lit(0).alias("exact"), "word", "n")
    rows = rows.unionByName(asked.select(cell.alias("cell"), way.alias("way"), "exact", "word", F.lit(0).cast("long").alias("n")))
    dealt = rows.repartition(max(tasks, cells // 16), "cell").sortWithinPartitions("cell", "way", "exact", "word")

    def search(batches):
        now, words, counts, own = None, [], [], None
        for batch in batches:
            found: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("cell", "way", "exact", "word", "n"))
            for at, way, exact, word, n in zip(*columns, strict=True):
                if (at, way) != now:
                    now, words, counts, own = (at, way), [], [], None
                if not exact:
                    if not words or words[-1] != word:
                        words.append(word)
                        counts.append(n)
                    continue
                if own is None:
                    own = Automaton(words)
                turn = -1 if way == "B" else 1
                found += [(word[::turn], words[k][::turn], counts[k]) for k in own.one_error(word[:exact], word[exact:])]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["word", "near", "near_n"])

    pairs = dealt.mapInArrow(search, "word string, near string, near_n bigint")
    return pairs.groupBy("word", "near").agg(F.max("near_n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain from each word of forms (word, form), by doubling jumps.

    Counts at least double along a chain, so it has no rings and at most some 60 links: seven rounds or fewer.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("__at"), F.col("root").alias("__next"))
        stepped = now.join(ahead, F.col("root") == F.col("__at"), "left")
        stepped = materialize(stepped.select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "roots")
        now = stepped.select("word", "root")
        if not stepped.filter("moved").head(1):
            return now


def group_variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a table (word, n), each word once.

    A word's form is its near word of largest n (ties: first in code-point order) if that is at least ``TIMES`` as frequent,
    else null; the root is where forms lead to, the word itself if it has none. An empty table gives an empty result.
    """
    words = materialize(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    fits = -F.col("best.less") >= F.lit(TIMES) * F.col("n")
    formed = materialize(
        joined.select(
            "word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, -F.col("best.less")).alias("form_n")
        ),
        "forms",
    )
    ends = roots(formed.filter("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same by shared deletions; the CRC is computed byte by byte.
ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
),
each AS (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY doc_id, run),
bytes AS (
  SELECT *, list_transform(flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)), lambda b: b::BIGINT) AS b
  FROM each
),
hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM bytes, crc_table
),
spoilt AS (
  SELECT times, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed
),
words AS (SELECT word, sum(times)::BIGINT AS n FROM spoilt WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
pairs AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT DISTINCT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION
  SELECT DISTINCT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
),
best AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS place FROM pairs
),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word AND place = 1
),
chain AS (
  SELECT word, coalesce(form, word) AS at, form AS next FROM formed
  UNION ALL
  SELECT c.word, f.form, f.form FROM chain c JOIN formed f ON f.word = c.next AND f.form IS NOT NULL
),
steps AS (SELECT c.word, c.at FROM chain c JOIN formed f ON f.word = c.at AND f.form IS NULL)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN steps s ON s.word = f.word
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents, every 97th run spoilt."""
    return group_variants(word_counts(table(spark, sf_dir, "documents"), SPOILT))
