"""Secret scans: candidates by pattern, false positives removed by a random forest trained from labelled findings."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_left, bisect_right
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, set_aside, slices, table

#: Labelled findings that a forest is trained on, at most; more are sampled by hash.
MOST_FINDINGS = 20_000
TREES, DEPTH, LEAF = 40, 10, 3
#: A candidate with this share of votes or more is a secret.
VOTES = 0.5
#: Signs of what is left of a candidate beside another one, at least.
LEAST = 6
MASK = "[SECRET]"

#: Shapes of candidates: name, what a lower-cased text has if there is one, pattern.
_SHAPES = (
    ("key_id", ("akia", "asia", "aida", "aroa"), re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AIDA|AROA)[0-9A-Z]{16}(?![A-Za-z0-9])")),
    ("prefixed", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "aiza", "glpat-"), re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[0-9A-Za-z_-]{35}|glpat-[A-Za-z0-9_-]{20,})")),
    ("private_key", ("-----begin",), re.compile(
        r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----(?:(?:\s|\\[nr])++[A-Za-z][A-Za-z0-9-]*+:[ \t][^\r\n\\]*+)*+"  # headers of an encrypted key
        r"(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,}+)++(?:(?:\s|\\[nr])++[A-Za-z0-9+/=]{1,15}(?=(?:\s|\\[nr])*+(?:-----END|\Z)|[ \t]*\n))?"
        r"(?:(?:\s|\\[nr])*+-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----)?"
    )),
    ("web_token", ("eyj",), re.compile(r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("assigned", ("passw", "pwd", "passphrase", "secret", "token", "key", "credential"), re.compile(r"(?i)(?:passw(?:or)?d|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|client[_-]?secret|credentials?)[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}[\"']?([^\s\"'<>,;]{6,})")),
    ("dense", (), re.compile(r"(?<![A-Za-z0-9+/_.@-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9@])")),
)
#: What a text with a dense candidate has.
_RUN = re.compile(r"[A-Za-z0-9+/_-]{24,}")

#: Words that stand in for a secret or are beside what isn't one, fixed values.
PLACEHOLDERS = (
    "example sample dummy fake test placeholder changeme change your here insert replace none null undefined xxxx redacted removed hidden masked "
    "password secret token default value string foobar abcdef abc123 123456 1234567890 lorem ipsum todo"
).split()
_HARMLESS = frozenset("sha sha1 sha256 sha512 md5 checksum digest hash commit revision uuid guid etag integrity build version fingerprint id image file isbn".split())
_TELLING = frozenset("password passwd pwd passphrase secret token key apikey api credential credentials auth bearer login private access".split())
_TEST_PATH = re.compile(r"(?i)(?:^|[/._-])(?:tests?|examples?|samples?|mocks?|fixtures?|docs?|demo|spec)(?:[/._-]|$)")
_NEAR = re.compile(r"[A-Za-z0-9]+")
#: Neighbouring words that are looked at.
BEFORE, AFTER = 5, 3


def candidates(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, shape) of what may be a secret, in order.

    Where they overlap, the first shape has the place, and what the others have before and after it stays, if it is
    LEAST signs long or longer, so that all of a text that any shape finds is judged.
    """
    if not text:
        return []
    low = text.lower()
    found: list[tuple[int, int, str]] = []
    for shape, hints, pattern in _SHAPES:
        if any(h in low for h in hints) if hints else _RUN.search(text):
            found += [(*m.span(1 if pattern.groups else 0), shape) for m in pattern.finditer(text)]
    kept: list[tuple[int, int, str]] = []  # apart from one another, in order
    for shape in dict.fromkeys(x[2] for x in found):  # in the order of shapes
        taken, fresh, i = kept, [], 0
        for a, b in ((a, b) for a, b, s in found if s == shape):
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            at, j = a, i
            while j < len(taken) and taken[j][0] < b:
                if taken[j][0] - at >= LEAST:
                    fresh.append((at, taken[j][0], shape))
                at, j = max(at, taken[j][1]), j + 1
            if b - at >= LEAST or at == a:
                fresh.append((at, b, shape))
        kept = sorted(taken + fresh)
    return kept


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


@lru_cache(1)
def _usual() -> dict[str, float]:
    """Log-likelihoods of letter pairs in plain words, from the words that this module lists."""
    pairs: dict[str, int] = {}
    plain = [*PLACEHOLDERS, *_HARMLESS, *_TELLING, *"the and for that with this from have are was not you all can had her one our out day get has him his how man new now old see two way who".split()]
    for word in plain:
        for a, b in zip(word, word[1:], strict=False):
            pairs[a + b] = pairs.get(a + b, 0) + 1
    total = sum(pairs.values()) + 676
    return {k: math.log((v + 1) / total) for k, v in pairs.items()} | {"": math.log(1 / total)}


FEATURES = ("length", "entropy", "kinds", "transitions", "pairs", "figures", "covered", "repeated", "test_path", "telling", "harmless", "assigned", "hexadecimal", "known_prefix")


def measures(candidate: str, before: str, after: str, path: str | None) -> list[float]:
    """Length, character transitions, dictionary coverage, path and neighbouring words of a candidate, as numbers."""
    n = len(candidate) or 1
    counts = Counter(candidate)
    kinds = [_kind(c) for c in candidate]
    low = candidate.lower()
    usual = _usual()
    covered = np.zeros(n, bool)
    for word in PLACEHOLDERS:
        at = low.find(word)
        while at >= 0:
            covered[at : at + len(word)] = True
            at = low.find(word, at + 1)
    near = {w.lower() for w in _NEAR.findall(before)[-BEFORE:]} | {w.lower() for w in _NEAR.findall(after)[:AFTER]}
    return [
        math.log2(len(candidate) + 1),
        -sum(v / n * math.log2(v / n) for v in counts.values()),
        len(set(kinds)),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        sum(usual.get(a + b, usual[""]) for a, b in zip(low, low[1:], strict=False)) / n,
        sum(k == 2 for k in kinds) / n,
        float(covered.mean()),
        max(counts.values(), default=0) / n,
        float(bool(path and _TEST_PATH.search(path))),
        float(len(near & _TELLING)),
        float(len(near & _HARMLESS)),
        float(bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", candidate))),
        float(bool(re.match(r"AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk-|AIza|glpat-|eyJ|-----BEGIN", candidate))),
    ]


def made_findings(n: int = 6000, seed: int = 9) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (candidate, before, after, path, label) made by rule, used where none are given.

    Secrets are random strings of usual formats beside telling words or bare; false positives are placeholders,
    digests, identifiers and words, some of them beside telling words too.
    """
    rng = random.Random(seed)
    some = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    hexes, alnum, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    words = [*PLACEHOLDERS, "north", "river", "table", "window", "letter", "simple", "garden", "market"]
    plain = [w for w in words if w not in PLACEHOLDERS] + "summer winter dragon monkey tiger hunter orange silver".split()
    prose = lambda: " ".join(rng.choice(words[20:]) for _ in range(3)) + " "
    ask = lambda: rng.choice(["password=", "token = \"", "secret: ", "api_key=", "access_key = '", "passwd: ", "pwd="])
    out = []
    for i in range(n):
        path = rng.choice(["src/app.py", "config/prod.env", "notes.txt", "", "src3", "deploy/run.sh"])
        if i % 2:
            made = rng.choice(
                [
                    lambda: (rng.choice(["AKIA", "ASIA"]) + some(upper, 16), prose()),
                    lambda: ("AKIA" + some(rng.choice([upper, string.ascii_uppercase]), 16), prose() + rng.choice(["", ask()])),
                    lambda: ("ghp_" + some(alnum, 36), prose() + rng.choice(["", ask()])),
                    lambda: ("sk-" + some(alnum, 40), prose() + rng.choice(["", ask()])),
                    lambda: (some(hexes, rng.choice([16, 20, 32, 40, 64])), prose() + ask()),
                    lambda: (some(alnum, rng.randint(10, 44)), prose() + ask()),
                    lambda: (some(alnum + "!@#$%^&*", rng.randint(8, 20)), prose() + ask()),
                    lambda: (rng.choice(plain) + some(string.digits, rng.randint(1, 4)) + rng.choice(["", "!", "$", rng.choice(plain), rng.choice(plain) + some(string.digits, 1)]), prose() + ask()),
                    lambda: (rng.choice(plain).capitalize() + rng.choice(["_", "@", ""]) + some(string.digits, rng.randint(2, 6)) + rng.choice(["!", "#", ""]), prose() + ask()),
                    lambda: ("eyJ" + some(alnum, 20) + "." + some(alnum, 30) + "." + some(alnum, 40), prose() + rng.choice(["bearer ", ask()])),
                    lambda: ("-----BEGIN RSA PRIVATE KEY-----\n" + some(alnum + "+/", 120), prose()),
                ]
            )()
            out.append((made[0], made[1], rng.choice(["", '"', " " + prose()]), path, 1))
        else:
            made = rng.choice(
                [
                    lambda: (rng.choice(["your_", "my-", "<", "example_", "test_", "INSERT_", ""]) + rng.choice(PLACEHOLDERS) + rng.choice(["_here", "123", "-" + rng.choice(PLACEHOLDERS), ""]), prose() + ask()),
                    lambda: (rng.choice("x*-0") * rng.randint(6, 40), prose() + ask()),
                    lambda: (some(hexes, rng.choice([32, 40, 64])), prose() + rng.choice(["sha256 ", "md5: ", "commit ", "checksum ", "digest=", "etag: ", "revision "])),
                    lambda: ("-".join(some(hexes, k) for k in (8, 4, 4, 4, 12)), prose() + rng.choice(["uuid ", "guid: ", "id="])),
                    lambda: ("".join(rng.choice(words).capitalize() for _ in range(rng.randint(3, 6))) + str(rng.randint(0, 99)), prose()),
                    lambda: ("_".join(rng.choice(words) for _ in range(rng.randint(3, 7))) + str(rng.randint(0, 99)), prose()),
                    lambda: ("/".join(rng.choice(words) for _ in range(rng.randint(3, 7))) + "/" + str(rng.randint(0, 2000)), prose() + rng.choice(["file ", "image ", ""])),
                    lambda: (rng.choice(words[20:]) + rng.choice(words[20:]), prose() + ask()),
                    lambda: ("${" + rng.choice(["SECRET", "API_KEY", "DB_PASSWORD"]) + "}", prose() + ask()),
                    lambda: ("AKIA" + "EXAMPLE".join([some("X0", 4), ""]) + "X" * 5, prose()),
                ]
            )()
            out.append((made[0], made[1], rng.choice(["", '"', " " + prose()]), rng.choice([path, "tests/fixture.py", "docs/example.md"]), 0))
    return out


class Forest:
    """Classification trees on bootstrap rows and random features, by Gini impurity; trees are flat arrays."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        self.trees = trees

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 1) -> Forest:
        rng = np.random.default_rng(seed)
        tries = max(1, round(math.sqrt(x.shape[1])))
        return cls([cls._tree(x, y, rng, tries) for _ in range(trees)])

    @staticmethod
    def _tree(x, y, rng, tries):
        feature, cut, left, right, value = [], [], [], [], []

        def grow(rows, depth) -> int:
            at = len(feature)
            for a, v in ((feature, -1), (cut, 0.0), (left, -1), (right, -1), (value, float(y[rows].mean()))):
                a.append(v)
            if depth == DEPTH or len(rows) < 2 * LEAF or value[at] in (0.0, 1.0):
                return at
            best = None
            for f in rng.permutation(x.shape[1])[:tries]:
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, t = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(rows) + 1)
                split = np.flatnonzero(v[1:] > v[:-1])
                split = split[(split + 1 >= LEAF) & (len(rows) - split - 1 >= LEAF)]
                if not len(split):
                    continue
                p, q = t[split] / n[split], (t[-1] - t[split]) / (len(rows) - n[split])
                gini = n[split] * p * (1 - p) + (len(rows) - n[split]) * q * (1 - q)
                i = int(gini.argmin())
                if best is None or gini[i] < best[0]:
                    best = gini[i], f, (v[split[i]] + v[split[i] + 1]) / 2
            if best is None:
                return at
            _, feature[at], cut[at] = best
            low = x[rows, best[1]] <= best[2]
            left[at] = grow(rows[low], depth + 1)
            right[at] = grow(rows[~low], depth + 1)
            return at

        grow(rng.integers(0, len(x), len(x)), 0)
        return tuple(np.array(a) for a in (feature, cut, left, right, value))

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets in the leaves that each row reaches."""
        total = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                low = x[inner, f[inner]] <= cut[at[inner]]
                at[inner] = np.where(low, left[at[inner]], right[at[inner]])
            total += value[at]
        return total / max(1, len(self.trees))


def train_forest(findings: DataFrame | None = None) -> Forest:
    """A forest from labelled findings (candidate, before, after, path, label), or from made ones.

    Null candidates or labels take no part. More than MOST_FINDINGS rows: about so many, those of least hash.
    """
    if findings is None:
        rows = made_findings()
    else:
        known = pick(findings, "candidate", "before", "after", "path", "label").where("candidate is not null and label is not null")
        total = known.count()
        if total > MOST_FINDINGS:
            known = known.where(F.pmod(F.xxhash64("candidate", "before"), F.lit(total)) < MOST_FINDINGS)
        rows = [tuple(r) for r in known.orderBy("candidate", "before", "after", "path", "label").collect()]
    x = np.array([measures(c, b or "", a or "", p) for c, b, a, p, _ in rows]).reshape(len(rows), len(FEATURES))
    y = np.array([int(r[4]) for r in rows], np.float64)
    return Forest.train(x, y) if len(rows) else Forest([])


def scan_text(text: str | None, path: str | None, forest: Forest) -> tuple[int, list[tuple[int, int, str, float]]]:
    """(number of candidates, confirmed findings: start, end, shape, votes) of a whole text."""
    found = candidates(text)
    if not found:
        return 0, []
    spans = [m.span() for m in _NEAR.finditer(text)]
    starts, ends = [a for a, _ in spans], [b for _, b in spans]

    def around(a: int, b: int) -> tuple[str, str]:
        """The text from the fifth word before a, and up to the third one after b, whole words of any length."""
        i, j = bisect_left(starts, a), bisect_right(ends, b)
        return text[starts[max(0, i - BEFORE)] if i else 0 : a], text[b : ends[min(j + AFTER, len(ends)) - 1] if j < len(ends) else len(text)]

    x = np.array([measures(text[a:b], *around(a, b), path) for a, b, _ in found])
    votes = forest.votes(x)
    return len(found), [(a, b, shape, float(v)) for (a, b, shape), v in zip(found, votes, strict=True) if v >= VOTES]


def masked(text: str | None, found: list[tuple[int, int, str, float]]) -> str | None:
    """The text with MASK in place of each finding."""
    if not found:
        return text
    edges = [0, *[x for a, b, _, _ in found for x in (a, b)], len(text)]
    return MASK.join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, keep: list[str] | None = None, path_column: str = "source") -> DataFrame:
    """doc_id, n_candidates, n_secrets, findings, findings_sha256, redacted of every row of docs (doc_id, text, source).

    ``findings``: array of (start, end, shape, votes), in code points; ``redacted``: the text with MASK in place of each.
    The digest is of ``start:end:shape`` joined by commas. Null texts have no candidates and stay null; repeated rows
    are each scanned; a null path, or none, tells nothing. An empty table gives an empty result. ``keep`` names further columns.

    A narrow pass, no exchange; the forest that it broadcasts is bounded by its trees and depth.
    """
    keep = keep or []
    shipped = docs.sparkSession.sparkContext.broadcast(train_forest(findings))
    known = any(c.lower() == path_column.lower() for c in docs.columns)
    base = pick(docs, "doc_id", *keep, *[path_column] * known, "text").toDF("doc_id", *keep, *["__path"] * known, "text")
    path = F.col("__path").cast("string") if known else F.lit(None).cast("string")
    base = base.select("doc_id", *keep, path.alias("__path"), "text")
    base = base.withColumn("text", F.col("text").cast("string"))
    item = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("shape", pa.string()), ("votes", pa.float64())]))

    def run(batches):
        forest = shipped.value
        for batch in slices(batches):
            counts, all_found, digests, texts = [], [], [], []
            for text, path in zip(batch.column("text").to_pylist(), batch.column("__path").to_pylist(), strict=True):
                n, found = scan_text(text, path, forest)
                counts.append(n)
                all_found.append([dict(zip(("start", "end", "shape", "votes"), f, strict=True)) for f in found])
                digests.append(hashlib.sha256(",".join(f"{a}:{b}:{shape}" for a, b, shape, _ in found).encode()).hexdigest())
                texts.append(masked(text, found))
            names = batch.schema.names[:-2]
            out = {c: batch.column(c) for c in names}
            out["n_candidates"] = pa.array(counts, pa.int64())
            out["n_secrets"] = pa.array([len(f) for f in all_found], pa.int64())
            out["findings"] = pa.array(all_found, item)
            out["findings_sha256"] = pa.array(digests, pa.string())
            out["redacted"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(out)

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-2])
    tail = "n_candidates bigint, n_secrets bigint, findings array<struct<start:bigint,end:bigint,shape:string,votes:double>>, findings_sha256 string, redacted string"
    return base.mapInArrow(run, f"{head}, {tail}")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the secrets of every document."""
    return scan_secrets(table(spark, sf_dir, "documents")).drop("findings", "redacted")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with secrets in text masked, and n_chars, if there is one, counted anew."""
    counted = ["n_chars"] * ("n_chars" in docs.columns)
    sourced = ["source"] * ("source" in docs.columns)
    plain, names = set_aside(docs, "doc_id", "text", *counted, *sourced)
    kept = [c for c in names if c not in ("doc_id", "text")]
    scanned = scan_secrets(plain, keep=kept)
    columns = {c: F.col(c) for c in names} | {"text": F.col("redacted")}
    for c in counted:
        columns[c] = F.when(F.col("n_secrets") > 0, F.length("redacted").cast(plain.schema[c].dataType)).otherwise(F.col(c))
    return scanned.select(*[v.alias(c) for c, v in columns.items()]).toDF(*docs.columns)
