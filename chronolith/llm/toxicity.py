"""Toxicity scores: a learned lexicon, met through Levenshtein automata, and the context of each hit."""

from __future__ import annotations

import math
import re
from bisect import bisect, bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick, set_aside, slices, table

#: Labelled rows, about, that the model is fitted on; one half makes the lexicon, the other the weights.
SAMPLE_ROWS = 24_000
#: A term is in so many toxic rows of its half at least, as a share and as a count, and so much likelier there.
TERM_SHARE, TERM_ROWS, TERM_RATIO = 0.01, 3, 15.0
THRESHOLD = 0.3
#: Least hashes by which near copies in the sample are told.
KEYS = 3
#: Words on either side of a hit that tell what it is.
WINDOW = 6
#: Words whose nearness to the lexicon a process remembers.
REMEMBERED = 150_000
#: Words that introduce what another has said, fixed values.
REPORTING = frozenset(
    "said says wrote writes called calls quoted quote quotes reported reportedly stated according cited "
    "sagte schrieb nannte zitierte zitat laut dit écrit appelé cité selon dijo escribió llamó citó según".split()
)
_QUOTES = re.compile("[\"\u201c\u201d\u201e\u00ab\u00bb\u2039\u203a]")
_ODD = re.compile("[\u00a1\u00ab\u00bb\u00bf\u2000-\u206f\u3000-\u303f]")
_WORD = re.compile(r"[^\W_]+")
#: All that isn't of a word, in lower-cased UTF-8.
_FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))


def edits_allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 8 else 2


class Levenshtein:
    """Automaton of the words within ``k`` edits of a word; a state is the row of distances of its prefixes, cut at k + 1."""

    def __init__(self, word: str, k: int):
        self.word, self.k = word, k

    def start(self) -> tuple[int, ...]:
        return tuple(min(i, self.k + 1) for i in range(len(self.word) + 1))

    def step(self, state: tuple[int, ...], char: str) -> tuple[int, ...]:
        out = [min(state[0] + 1, self.k + 1)]
        for i, c in enumerate(self.word):
            out.append(min(out[i] + 1, state[i] + (c != char), state[i + 1] + 1, self.k + 1))
        return tuple(out)

    def alive(self, state: tuple[int, ...]) -> bool:
        return min(state) <= self.k

    def distance(self, state: tuple[int, ...]) -> int:
        return state[-1]


class Lexicon:
    """Terms with weights in a trie; ``ordinary`` words are never taken for misspelled terms."""

    def __init__(self, terms: dict[str, float], ordinary: frozenset[str] = frozenset()):
        self.terms, self.ordinary = terms, ordinary
        self.trie: dict = {}
        # One of k + 1 parts of a term is whole in each word within k edits, at most k places from its own:
        # {length of a part: {part: [(place, term, k)]}}.
        self.parts: dict[int, dict[str, list[tuple[int, str, int]]]] = {}
        self.letters = {term: Counter(term) for term in terms}
        for term in terms:
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
            k = edits_allowed(len(term))
            cuts = [len(term) * i // (k + 1) for i in range(k + 2)]
            for i in range(k + 1 if k else 0):
                part = term[cuts[i] : cuts[i + 1]]
                self.parts.setdefault(len(part), {}).setdefault(part, []).append((cuts[i], term, k))
        self.known: dict[bytes, tuple[str, int] | None] = {}

    def may_be_near(self, word: str) -> bool:
        """False for a word that no term is near, by the parts, lengths and letters of the terms."""
        n = len(word)
        for size, parts in self.parts.items():
            for at in range(n - size + 1):
                for place, term, k in parts.get(word[at : at + size], ()):
                    if abs(at - place) <= k and abs(n - len(term)) <= k:
                        common = sum(min(word.count(c), m) for c, m in self.letters[term].items())
                        if max(n, len(term)) - common <= k:
                            return True
        return False

    def search(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its allowed edits and their number; of several, the first by edits, then order."""
        if word in self.terms:
            return word, 0
        k = edits_allowed(len(word) + 2)  # as many as the longest term in reach allows
        if not k or word in self.ordinary or not self.may_be_near(word):
            return None
        automaton, best = Levenshtein(word, k), None
        stack = [(self.trie, automaton.start())]
        while stack:
            node, state = stack.pop()
            for c, below in node.items():
                if c == "":
                    d = automaton.distance(state)
                    if d <= edits_allowed(len(below)) and d <= k and (best is None or (d, below) < best):
                        best = d, below
                else:
                    after = automaton.step(state, c)
                    if automaton.alive(after):
                        stack.append((below, after))
        return best and (best[1], best[0])

    def near(self, word: bytes) -> tuple[str, int] | None:
        try:
            return self.known[word]
        except KeyError:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            found = self.known[word] = self.search(word.decode("utf-8", "replace"))
            return found


def words_of(text: str) -> list[bytes]:
    if _ODD.search(text):
        text = _ODD.sub(" ", text)
    return text.lower().encode("utf-8", "replace").translate(_FOLD).split()


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Of a whole text: weight of plain hits, of misspelled ones, of quoted ones, the highest weight, hits a word."""
    words = words_of(text) if text else []
    hits = {w for w in set(words) if lexicon.near(w)}
    if not hits:
        return [0.0] * 5
    plain = misspelled = quoted = most = 0.0
    count = 0
    lowered = _ODD.sub(lambda m: '"' if _QUOTES.match(m.group()) else " ", text.lower())
    marks = [m.start() for m in re.finditer('"', lowered)]
    lines = [0, *[m.end() for m in re.finditer("\n", lowered)]]
    spans = [(m.start(), m.group()) for m in _WORD.finditer(lowered)]
    for i, (a, word) in enumerate(spans):
        if word.encode() not in hits or not (found := lexicon.near(word.encode())):
            continue
        line = lines[bisect(lines, a) - 1]
        open_quote = marks and (bisect(marks, a) - bisect_left(marks, line)) % 2
        term, edits = found
        weight = lexicon.terms[term]
        around = [w for _, w in spans[max(0, i - WINDOW) : i + WINDOW + 1]]
        told = sum(w in REPORTING for w in around)
        # Within quotation marks or beside a reporting word a term is cited; both together count in full.
        cited = min(1.0, 0.6 * bool(open_quote) + 0.4 * min(told, 2))
        count += 1
        most = max(most, weight * (1 - cited) * (1 if not edits else 0.7))
        quoted += weight * cited
        if edits:
            misspelled += weight * (1 - cited)
        else:
            plain += weight * (1 - cited)
    return [math.log1p(plain), math.log1p(misspelled), math.log1p(quoted), most, min(1.0, 10 * count / max(1, len(words)))]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression with a ridge on all but the intercept, by Newton steps; the intercept is last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _keyed(batches):
    """Adds keys that near copies of a text mostly share: least hashes of its runs of three words, in KEYS orders.

    Rare words of a toxic text would look like terms if its copies counted.
    """
    odd = np.random.default_rng(4).integers(0, 2**63, KEYS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in slices(batches):
        keys = []
        for text in batch.column("text").to_pylist():
            words = words_of(text or "")
            runs = {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, runs), np.uint64, len(runs))
            keys.append(((hashes[:, None] * odd).min(axis=0) >> np.uint64(1)).astype(np.int64))
        columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(KEYS)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *[f"key{i}" for i in range(KEYS)]])


def _counted(batches):
    """Words of texts by the rows that have them: (word, toxic rows, clean rows) of a part."""
    counts = Counter(), Counter()

    def out():
        words = sorted(set(counts[0]) | set(counts[1]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode("utf-8", "replace") for w in words]), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())],
            ["word", "toxic", "clean"],
        )

    for batch in slices(batches):
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            counts[label].update(set(words_of(text or "")))
        if len(counts[0]) + len(counts[1]) > 300_000:
            yield from out()
            counts[0].clear(), counts[1].clear()
    yield from out()


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def __reduce__(self):
        return _model, (self.lexicon.terms, self.lexicon.ordinary, self.weights.tolist())

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([[*features(t, self.lexicon), 1.0] for t in texts]).reshape(len(texts), 6)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _model(terms, ordinary, weights) -> Model:
    return Model(Lexicon(terms, ordinary), np.array(weights))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from labelled rows that aren't held out, ``sample_rows`` of them at most, about.

    Rows of the sample are those of least hash; a doc_id with several labels has the highest. One row stands for those
    that share any of their least hashes, as copies and near copies mostly do. Words are counted on the
    executors; what comes to the driver is bounded by the sample: the terms, the ordinary words near one of them, and five
    numbers a row.
    """
    known = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    total = known.count()
    buckets = 1 << 20
    cut = min(buckets, int(buckets * sample_rows / max(1, total)) + 1)
    place = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(2 * buckets))
    sample = known.withColumn("place", place).where(F.expr(f"place div 2 < {cut}"))
    base = pick(docs, "doc_id", "text")
    rows = base.join(F.broadcast(sample), "doc_id").select(
        F.col("text").cast("string").alias("text"), F.col("label"), (F.col("place") % 2 == 0).alias("first")
    )
    rows = rows.mapInArrow(_keyed, "text string, label int, first boolean" + "".join(f", key{i} bigint" for i in range(KEYS)))
    for i in range(KEYS):
        rows = rows.dropDuplicates([f"key{i}", "label"]).drop(f"key{i}")
    rows = materialize(rows, "toxic-sample")
    sizes = {(r["first"], r["label"]): r["count"] for r in rows.groupBy("first", "label").count().collect()}
    toxic, clean = sizes.get((True, 1), 0), sizes.get((True, 0), 0)

    words = rows.where("first").select("text", "label").mapInArrow(_counted, "word string, toxic bigint, clean bigint")
    words = materialize(words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic-words")
    ratio = ((F.col("toxic") + 0.5) / (toxic + 1.0)) / ((F.col("clean") + 0.5) / (clean + 1.0))
    least = max(TERM_ROWS, TERM_SHARE * toxic)
    chosen = words.where((F.col("toxic") >= least) & (ratio >= TERM_RATIO)).select("word", F.log(ratio).alias("weight"))
    terms = {r["word"]: r["weight"] for r in chosen.collect()}
    lexicon = Lexicon(terms)

    def like(batches, terms=terms):
        own = Lexicon(terms)
        for batch in batches:
            near = [w not in own.terms and own.search(w) is not None for w in batch.column("word").to_pylist()]
            yield batch.filter(pa.array(near, pa.bool_()))

    if terms:
        near = words.where("clean > 0").select("word").mapInArrow(like, "word string")
        lexicon.ordinary = frozenset(r["word"] for r in near.collect())
    shipped = docs.sparkSession.sparkContext.broadcast(Model(lexicon, np.zeros(6)))

    def measured(batches):
        own = shipped.value.lexicon
        for batch in slices(batches):
            x = [features(t, own) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    got = rows.where("not first").select("text", "label").mapInArrow(measured, "label int, x array<double>").toPandas()
    y = got["label"].to_numpy(np.float64)
    if len(y) == 0 or y.min() == y.max():
        share = (sum(n for (_, label), n in sizes.items() if label) + 0.5) / (sum(sizes.values()) + 1)
        weights = np.array([1.0, 1.0, 0.0, 0.0, 0.0, math.log(share / (1 - share))])
    else:
        weights = fit(np.array(got["x"].tolist()), y)
    return Model(lexicon, weights)


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text); labels: doc_id, toxic.

    Null and empty texts have no hits: the score is that of texts without any. Repeated rows are each scored alike. A
    null doc_id is not held out. Without labels of both kinds the score rests on their share and any lexicon there is.
    An empty table gives an empty result. ``keep`` names further columns to carry, ``with_text`` carries the text.

    The final pass is narrow: no exchange; the model that it broadcasts is bounded by the words of the sample.
    """
    keep = keep or []
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    base = pick(docs, "doc_id", *keep, "text").withColumn("held_out", held_out(F.col("doc_id"))).withColumn("text", F.col("text").cast("string"))
    base = base.select("doc_id", *keep, "held_out", "text")

    def run(batches):
        model = shipped.value
        for batch in slices(batches):
            score = model.score(batch.column("text").to_pylist())
            names = batch.schema.names[: None if with_text else -1]
            columns = [batch.column(n) for n in names] + [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "score", "predicted"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[: None if with_text else -1])
    return base.mapInArrow(run, f"{head}, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, by a model of the labels that aren't held out."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without those predicted to be toxic."""
    plain, names = set_aside(docs, "doc_id", "text")
    rest = [c for c in names if c not in ("doc_id", "text")]
    scored = score_toxicity(plain, labels, keep=rest, with_text=True)
    return scored.where("predicted = 0").select(*names).toDF(*docs.columns)
