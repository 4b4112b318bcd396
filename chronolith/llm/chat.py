"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import global_rank, materialize, pick, table

ROLES = ("system", "user", "assistant")
#: Rows of a block; more where the table has over MOST_BLOCKS of them, so what the driver sees of blocks is bounded.
BLOCK_ROWS, MOST_BLOCKS = 4096, 50_000
#: Log-probabilities are whole numbers of this part of a nat, so sums don't depend on their order.
SCALE = 1000
_NEVER = -(10**12)

#: Speaker markers at the head of a line, for each role; fixed values.
MARKERS = {
    "system": r"system|developer|instructions?|context",
    "user": r"user|human|customer|client|student|question|prompt|you|q",
    "assistant": r"assistant|ai|bot|chatbot|model|agent|teacher|answer|response|gpt|a",
}


def _marker(role: str) -> str:
    names = MARKERS[role]
    return rf"(?i)^\s*(?:<\|(?:im_start\|>)?\s*(?:{names})\s*(?:\|>)?|\[(?:{names})\]|#{{1,6}}\s*(?:{names})\s*:?\s*(?:\n|$)|\*\*(?:{names})\s*:?\*\*\s*:?|(?:{names})\s*(?:\(\d[\d:]*\))?\s*(?::|>|»))\s*"


def marker_of(text: Column) -> Column:
    """0 without a speaker marker, else the place of its role from 1."""
    out = F.lit(0)
    for i, role in reversed(list(enumerate(ROLES, 1))):
        out = F.when(text.rlike(_marker(role)), F.lit(i)).otherwise(out)
    return out


def without_marker(text: Column, role: Column) -> Column:
    """The text without one speaker marker of the given role at its head, and without a mark of its end."""
    out = text
    for name in ROLES:
        out = F.when(role == name, F.regexp_replace(text, _marker(name), "")).otherwise(out)
    return F.trim(F.regexp_replace(out, r"<\|(?:im_end|end|eot_id)\|>\s*$", ""))


#: Sizes of the line features: marker, length, lines, question, list or code, opening words of an instruction.
SIZES = (4, 12, 5, 2, 2, 2)


def observation(text: Column) -> list[Column]:
    """Features of a line or turn: marker, log of length, log of lines, a question, code or lists, an instruction."""
    text = F.coalesce(text, F.lit(""))
    log = lambda x, most: F.least(F.lit(most), F.floor(F.log2(x + 1)))
    return [
        marker_of(text),
        log(F.length(text), SIZES[1] - 1),
        log(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), SIZES[2] - 1),
        text.rlike(r"[?？]\s*$").cast("int"),
        text.rlike(r"(?m)^\s*(?:[-*•]\s|\d+[.)]\s|```)").cast("int"),
        text.rlike(r"(?i)\b(?:you are|you must|always answer|your task)\b").cast("int"),
    ]


def split_lines(transcripts: DataFrame) -> DataFrame:
    """conv_id, turn, text: a row for each line of transcripts (conv_id, text)."""
    base = pick(transcripts, "conv_id", "text")
    return base.select("conv_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("turn", "text"))


class Hmm:
    """Whole-number log-probabilities of first roles, of role after role, and of each feature's values in a role."""

    def __init__(self, first: np.ndarray, step: np.ndarray, emit: list[np.ndarray]):
        self.first, self.step, self.emit = first, step, emit

    @classmethod
    def counted(cls, first, step, emit) -> Hmm:
        def logs(x):
            x = np.asarray(x, np.float64) + 0.5
            return np.rint(SCALE * np.log(x / x.sum(axis=-1, keepdims=True))).astype(np.int64)

        return cls(logs(first), logs(step), [logs(e) for e in emit])

    @classmethod
    def usual(cls) -> Hmm:
        """Without labelled rows: markers tell roles, turns alternate, systems come first, assistants write more."""
        length = [np.exp(-0.5 * ((np.arange(SIZES[1]) - m) / 2.5) ** 2) * 100 for m in (6, 6, 8)]
        lines = [np.exp(-np.arange(SIZES[2]) * s) * 100 for s in (1.5, 1.5, 0.8)]
        marker = [[20, 100, 0, 0], [20, 0, 100, 0], [20, 0, 0, 100]]
        return cls.counted(
            [20, 75, 5], [[1, 98, 1], [1, 9, 90], [1, 90, 9]],
            [np.array(marker), np.array(length), np.array(lines), np.array([[95, 5], [60, 40], [90, 10]]), np.array([[90, 10], [95, 5], [80, 20]]), np.array([[40, 60], [95, 5], [98, 2]])],
        )

    def emissions(self, observed: np.ndarray) -> np.ndarray:
        return sum(e[:, observed[:, i]].T for i, e in enumerate(self.emit))


def viterbi(hmm: Hmm, emitted: np.ndarray, before: int | None = None, last: int | None = None) -> list[int]:
    """The best roles of a run of rows; ``before``: the role of the row before it, ``last``: that of its last row."""
    n = len(emitted)
    score = (hmm.first if before is None else hmm.step[before]) + emitted[0]
    back = np.zeros((n, len(ROLES)), np.int64)
    for t in range(1, n):
        ways = score[:, None] + hmm.step
        back[t] = ways.argmax(axis=0)
        score = ways.max(axis=0) + emitted[t]
    at = int(score.argmax()) if last is None else last
    out = [at]
    for t in range(n - 1, 0, -1):
        at = int(back[t, at])
        out.append(at)
    return out[::-1]


def _ways(hmm: Hmm, emitted: np.ndarray) -> np.ndarray:
    """Best score of a run for each role before it and each role of its last row."""
    ways = hmm.step + emitted[0]
    for e in emitted[1:]:
        ways = (ways[:, :, None] + hmm.step[None]).max(axis=1) + e
    return ways


def _begins(hmm: Hmm, emitted: np.ndarray) -> np.ndarray:
    """Best score of a run that begins a conversation, for each role of its last row."""
    score = hmm.first + emitted[0]
    for e in emitted[1:]:
        score = (score[:, None] + hmm.step).max(axis=0) + e
    return score


def _runs(conv: list) -> list[tuple[int, int]]:
    cuts = [0, *[i for i in range(1, len(conv)) if conv[i] != conv[i - 1]], len(conv)]
    return list(zip(cuts, cuts[1:], strict=False))


def _ordered(part: pa.Table) -> tuple[pa.Table, list, np.ndarray]:
    part = part.combine_chunks().sort_by("rank")
    columns = [part.column(f"f{i}").to_numpy() for i in range(len(SIZES))]
    return part, part.column("conv").to_pylist(), np.stack(columns, axis=1).astype(np.int64)


def _summary(hmm: Hmm):
    schema = pa.schema([("block", pa.int64()), ("first_conv", pa.string()), ("last_conv", pa.string()), ("single", pa.bool_()), ("ways", pa.list_(pa.int64())), ("begin", pa.list_(pa.int64())), ("end", pa.list_(pa.int64()))])

    def run(part: pa.Table) -> pa.Table:
        part, conv, observed = _ordered(part)
        emitted, runs = hmm.emissions(observed), _runs(conv)
        (a, b), (c, d) = runs[0], runs[-1]
        row = {"block": part.column("block")[0].as_py(), "first_conv": conv[0], "last_conv": conv[-1], "single": len(runs) == 1}
        row |= {"ways": _ways(hmm, emitted[a:b]).ravel().tolist(), "begin": _begins(hmm, emitted[a:b]).tolist(), "end": _begins(hmm, emitted[c:d]).tolist()}
        return pa.Table.from_pylist([row], schema=schema)

    return run, "block bigint, first_conv string, last_conv string, single boolean, ways array<bigint>, begin array<bigint>, end array<bigint>"


def _joined(summaries: list) -> dict[int, tuple[int | None, int | None, int | None]]:
    """(role before, role of the first run's last row, role of the last run's last row) for blocks that runs cross."""
    k = len(ROLES)
    chains: list[list] = []
    open_chain: list | None = None
    for s in summaries:
        ways, begin, end = np.array(s["ways"]).reshape(k, k), np.array(s["begin"]), np.array(s["end"])
        goes_on = open_chain is not None and open_chain[0] == s["first_conv"]
        if goes_on:
            delta = (open_chain[1][-1][1][:, None] + ways).max(axis=0)
            open_chain[1].append((s["block"], delta, ways))
            if not s["single"]:
                chains.append(open_chain)
        elif open_chain is not None:
            chains.append(open_chain)
        if not s["single"]:
            open_chain = [s["last_conv"], [(s["block"], end, None)]]
        elif not goes_on:
            open_chain = [s["last_conv"], [(s["block"], begin, None)]]
    if open_chain is not None:
        chains.append(open_chain)
    out: dict[int, list] = {}
    for _, parts in chains:
        if len(parts) == 1:
            continue
        at = int(parts[-1][1].argmax())
        for i in range(len(parts) - 1, -1, -1):
            block, _, ways = parts[i]
            entry = out.setdefault(block, [None, None, None])
            if i == 0:
                entry[2] = at
            else:
                before = int((parts[i - 1][1] + ways[:, at]).argmax())
                entry[0], entry[1] = before, at
                at = before
    return {b: tuple(e) for b, e in out.items()}


def _decoder(hmm: Hmm, shipped):
    schema = pa.schema([("block", pa.int64()), ("rank", pa.int64()), ("found", pa.int32()), ("begins", pa.bool_()), ("start", pa.int64())])

    def run(part: pa.Table) -> pa.Table:
        part, conv, observed = _ordered(part)
        emitted, runs = hmm.emissions(observed), _runs(conv)
        before, first_last, last_last = shipped.value.get(part.column("block")[0].as_py(), (None, None, None))
        roles, begins = [], []
        for i, (a, b) in enumerate(runs):
            was = before if i == 0 else None
            last = first_last if i == 0 and first_last is not None else last_last if i == len(runs) - 1 else None
            found = viterbi(hmm, emitted[a:b], was, last)
            begins += [x != y for x, y in zip([was, *found], found, strict=False)]
            roles += found
        ranks, starts, start = part.column("rank").cast(pa.int64()), [], None
        for rank, new in zip(ranks.to_pylist(), begins, strict=True):
            start = rank if new else start
            starts.append(start)
        blocks = part.column("block").cast(pa.int64())
        return pa.Table.from_arrays([blocks, ranks, pa.array(roles, pa.int32()), pa.array(begins, pa.bool_()), pa.array(starts, pa.int64())], schema=schema)

    return run, "block bigint, rank bigint, found int, begins boolean, start bigint"


def held_out(conv_id: Column) -> Column:
    """Conversations whose roles aren't learnt from."""
    return F.coalesce(F.crc32(conv_id.cast("string")) % 4 == 2, F.lit(False))


def train(rows: DataFrame) -> Hmm:
    """Counts over all ranked rows with a known role that aren't held out; only the tables of counts reach the driver."""
    known = rows.where(F.col("role").isin(*ROLES) & ~held_out(F.col("conv_id")))
    place = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int") - 1
    known = known.select("conv", "rank", place.alias("r"), *[f"f{i}" for i in range(len(SIZES))])
    emit = [np.zeros((len(ROLES), n)) for n in SIZES]
    cells = known.select("r", F.posexplode(F.array(*[F.col(f"f{i}").cast("int") for i in range(len(SIZES))])).alias("i", "v"))
    total = 0
    for r, i, v, n in cells.groupBy("r", "i", "v").count().collect():
        emit[i][r, v] += n
        total += n
    if not total:
        return Hmm.usual()
    before = known.select((F.col("rank") + 1).alias("rank"), F.col("conv").alias("conv_before"), F.col("r").alias("r_before"))
    pairs = known.select("rank", "conv", "r").join(before, "rank", "left")
    was = F.when(F.col("conv").eqNullSafe(F.col("conv_before")), F.col("r_before"))
    first, step = np.zeros(len(ROLES)), np.zeros((len(ROLES), len(ROLES)))
    for r, b, n in pairs.groupBy("r", was.alias("b")).count().collect():
        if b is None:
            first[r] += n
        else:
            step[b, r] += n
    # Without markers in the labelled rows a marker would tell nothing; a marker of its role is worth as in usual().
    usual = np.array([[20, 100, 0, 0], [20, 0, 100, 0], [20, 0, 0, 100]])
    emit[0] = emit[0] + usual * max(1.0, total / len(SIZES) / 1e6)
    return Hmm.counted(first, step, emit)


def parse_chats(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, turn, role, role_found, begins_turn, rendered, rank, start of every row of rows (conv_id, turn, text, and
    role if known); ``render_turns`` joins them to turns.

    Rows are lines or turns of transcripts. The roles of a conversation's rows, in the order of turn, are the best path
    of a hidden Markov model whose states are ROLES; its tables are counted from rows with a known role (conversations
    held out by the checksum of conv_id are never counted), or usual ones without such rows. ``begins_turn``: its role
    differs from the row before; a canonical turn is such a row and those after it, up to the next. ``rendered``: the
    text without a speaker marker of the role found; a row that begins a turn has a canonical head, ``<|role|>`` and a
    new line. ``rank`` is the place of a row among all, ``start`` that of the row which begins its turn.

    Null conv_id is a conversation of its own, null turns come first; rows with equal turns follow the order of their
    texts; repeated rows are lines like others. Null and empty texts are short lines. An empty table gives an empty
    result.

    Scale: rows are ranked over all conversations, without a single-task window, and dealt in blocks of equal size, so a
    conversation of any length is spread. A block gives the best score from each role before it to each last role;
    these small matrices are chained on the driver (MOST_BLOCKS of them at most) and each block is decoded between the
    roles so found: the same path as over the whole conversation.
    """
    if not any(c.lower() == "role" for c in rows.columns):
        rows = rows.withColumn("role", F.lit(None).cast("string"))
    base = pick(rows, "conv_id", "turn", "role", "text")
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))
    base = base.withColumn("conv", conv).withColumn("text", F.col("text").cast("string"))
    base = base.select("*", *[f.cast("int").alias(f"f{i}") for i, f in enumerate(observation(F.col("text")))])
    ranked = materialize(global_rank(base, ["conv", "turn", "text"]), "chats")
    total = ranked.count()
    size = max(block_rows, -(-total // MOST_BLOCKS))
    hmm = train(ranked)
    narrow = ranked.select("rank", "conv", *[f"f{i}" for i in range(len(SIZES))]).withColumn("block", F.expr(f"rank div {size}"))
    function, schema = _summary(hmm)
    summaries = narrow.groupBy("block").applyInArrow(function, schema)
    shipped = rows.sparkSession.sparkContext.broadcast(_joined(sorted((r.asDict() for r in summaries.collect()), key=lambda r: r["block"])))
    function, schema = _decoder(hmm, shipped)
    found = materialize(narrow.groupBy("block").applyInArrow(function, schema), "roles")
    # A turn that goes on from an earlier block began at the last row before that does; a row for each block is gathered.
    last = found.groupBy("block").agg(F.max("start").alias("start"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("block", F.last("start", ignorenulls=True).over(before).alias("carried"))
    found = found.join(F.broadcast(carried), "block").select("rank", "found", "begins", F.coalesce("start", "carried").alias("start"))
    name = F.element_at(F.array(*map(F.lit, ROLES)), F.col("found") + 1)
    plain = without_marker(F.coalesce("text", F.lit("")), F.col("role_found"))
    out = ranked.select("rank", "conv_id", "turn", "role", "text").join(found, "rank").withColumn("role_found", name)
    head = F.when(F.col("begins"), F.concat(F.lit("<|"), "role_found", F.lit("|>\n"))).otherwise(F.lit(""))
    return out.select("conv_id", "turn", "role", "role_found", F.col("begins").alias("begins_turn"), F.concat(head, plain).alias("rendered"), "rank", "start")


def render_turns(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, role_found, n_rows, rendered of every canonical turn of what parse_chats returns.

    ``turn`` is that of the turn's first row. ``rendered`` is the head and the texts of all its rows, by line breaks, in
    their order; a turn is one value, so its rows meet in one task, but those of a conversation don't.
    """
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "rendered"))), lambda x: x["rendered"])
    turns = parsed.groupBy("start").agg(
        F.min_by("conv_id", "rank").alias("conv_id"), F.min_by("turn", "rank").alias("turn"), F.min("role_found").alias("role_found"),
        F.count(F.lit(1)).alias("n_rows"), F.array_join(lines, "\n").alias("rendered"),
    )
    return turns.drop("start")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every canonical turn of conversations, found as if roles weren't known, which are counted in training only."""
    turns = render_turns(parse_chats(table(spark, sf_dir, "conversations")))
    return turns.select("conv_id", "turn", "role_found", "n_rows", F.sha2("rendered", 256).alias("rendered_sha256"), F.length("rendered").cast("long").alias("n_chars"))
