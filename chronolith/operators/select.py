"""Constrained selection of moments: minimum gaps, budgets, even spreads, novelty.

Greedy rules depend on what was chosen before. A track of up to ``LONG`` rows is folded by itself: over an array of the
moments that follow one another by less than the gap, or along its sorted rows. A longer one is spread over tasks. Minimum
gaps fall apart by time: a moment that outranks all within the gap is kept whatever else happens, so bins of time settle
theirs in rounds. Rules that look at all that was kept before are settled block by block: what a block does is summed up for
whatever may come into it, summaries are gone through in order, and the blocks are replayed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators.timeline import nearest
from chronolith.shared import global_rank, materialize

#: Rows of a track that one task takes; longer tracks are spread over tasks.
LONG = 10_000
#: Rows of a block of a long track.
BLOCK_ROWS = 8_192
#: Local winners are found so often between two exchanges; a bin of time is so many gaps wide.
ROUNDS, BIN_GAPS = 4, 512


def islands(moments: DataFrame, track: list[str], clock: str, gap: float, out: str = "__island") -> DataFrame:
    """Numbers runs of moments that follow one another by less than ``gap``."""
    w = Window.partitionBy(*track).orderBy(clock)
    new = F.coalesce(F.col(clock) - F.lag(clock).over(w) >= gap, F.lit(True)).cast("long")
    return moments.withColumn(out, F.sum(new).over(w.rangeBetween(Window.unboundedPreceding, 0)))


def _spread(moments: Column, gap: float, already: Column | None = None) -> Column:
    """Fold: keep a moment (struct with ts) if it is ``gap`` or more from all kept; moments come in their order."""
    start = already if already is not None else F.slice(moments, 1, 0)
    return F.aggregate(
        moments, start,
        lambda kept, m: F.when(F.forall(kept, lambda k: F.abs(k["ts"] - m["ts"]) >= gap), F.concat(kept, F.array(m))).otherwise(kept),
    )


def _by_length(rows: DataFrame, track: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows of the tracks of up to LONG rows, rows of the others or None)."""
    long = rows.groupBy(*track).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > LONG).drop("__n")
    if not long.head(1):
        return rows, None
    same = lambda side: [side[c].eqNullSafe(other[c]) for c in track]
    other = long.select(*[F.col(c).alias(c) for c in track])
    return rows.join(other, same(rows), "left_anti"), rows.join(other, same(rows), "left_semi")


def _over(track: list[str], bounds: str) -> str:
    """A frame along the clock of a bin of a track."""
    return f"OVER (PARTITION BY {', '.join(f'`{c}`' for c in track)}, __bin ORDER BY __ts RANGE BETWEEN {bounds})"


def _settled(moments: DataFrame, track: list[str], gap: float) -> DataFrame:
    """moments (track, __ts, __rank, __state: 1 kept, 0 open) after ROUNDS rounds; those struck are left out.

    In a round a moment that outranks all open ones within the gap is kept, and open ones nearer than the gap to a kept one
    are struck. A bin has the moments of its time and, on either side, as many more as the rounds can be told by, so all
    rounds take one exchange. Frames are a little wider than the gap, which only makes a winner wait; what is struck is
    tested by the distance itself.
    """
    reach = gap * 1.001 + 1e-6
    halo, width = 2 * (ROUNDS + 1) * reach, BIN_GAPS * reach
    place = lambda c: F.floor(c / width).cast("long")
    ts = F.col("__ts")
    dealt = moments.withColumn("__own", place(ts)).withColumn("__bin", F.explode(F.array_distinct(F.array(place(ts - halo), place(ts), place(ts + halo)))))
    near, back, ahead = (_over(track, b) for b in (f"{reach}D PRECEDING AND {reach}D FOLLOWING", f"{reach}D PRECEDING AND CURRENT ROW", f"CURRENT ROW AND {reach}D FOLLOWING"))

    def struck(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("__last", F.expr(f"max(CASE WHEN __state = 1 THEN __ts END) {back}")).withColumn("__next", F.expr(f"min(CASE WHEN __state = 1 THEN __ts END) {ahead}"))
        hit = (F.col("__ts") - F.col("__last") < gap) | (F.col("__next") - F.col("__ts") < gap)
        return rows.withColumn("__state", F.when((F.col("__state") == 0) & F.coalesce(hit, F.lit(False)), -1).otherwise(F.col("__state"))).drop("__last", "__next")

    dealt = struck(dealt)
    for _ in range(ROUNDS):
        dealt = dealt.withColumn("__best", F.expr(f"min(CASE WHEN __state = 0 THEN __rank END) {near}"))
        dealt = struck(dealt.withColumn("__state", F.when((F.col("__state") == 0) & (F.col("__rank") == F.col("__best")), 1).otherwise(F.col("__state"))).drop("__best"))
    return dealt.where("__bin = __own and __state >= 0").drop("__bin", "__own")


def _greedy(rows: DataFrame, track: list[str], gap: float, most: int, kept: DataFrame | None = None) -> DataFrame:
    """track, __ts, __rank of moments (the same columns) that the greedy rule keeps beside ``kept``: the first ``most`` of each
    track by rank among them.

    Every round settles the best open moment of a track at least, and a track is done when ``most`` kept ones rank before
    all that is open, so there are ``most`` rounds at the very most, and a few as a rule.
    """
    keys = [*track, "__ts", "__rank"]
    open_ = rows.select(*keys, F.lit(0).alias("__state"))
    if kept is not None:
        open_ = open_.unionByName(kept.select(*keys, F.lit(1).alias("__state")))
    found = None
    while True:
        settled = materialize(_settled(open_, track, gap), "settled")
        new = settled.where("__state = 1")
        found = new if found is None else found.unionByName(new)
        rest = settled.where("__state = 0")
        first = rest.groupBy(*track).agg(F.min("__rank").alias("__first"))
        firsts = first.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(track)], "__first")
        same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(track)]
        ahead = found.join(firsts, [*same, F.col("__rank") < F.col("__first")]).groupBy(*track).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= most)
        done = ahead.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(track)])
        open_ = materialize(rest.join(done, same, "left_anti"), "open")
        if not open_.head(1):
            break
    if kept is not None:
        found = found.join(kept.select("__rank"), "__rank", "left_anti")
    return found.select(*keys)


def _ranked(moments: DataFrame, track: list[str], clock: str, order: list[Column]) -> DataFrame:
    """moments that have a clock, with __ts and a __rank that orders the rows of each track, written."""
    usable = moments.where(F.col(clock).isNotNull()).withColumn("__ts", F.col(clock).cast("double"))
    return materialize(global_rank(usable, [*[F.col(c) for c in track], *order], "__rank").drop("total"), "ranked")


def _first(found: DataFrame, track: list[str], order: list[str], most: int, out: str) -> DataFrame:
    return found.withColumn(out, F.row_number().over(Window.partitionBy(*track).orderBy(*order))).where(F.col(out) <= most)


def spread(moments: DataFrame, track: list[str], clock: str, order: list[Column], gap: float, most: int) -> DataFrame:
    """Moments in the given order, each ``gap`` or more from those kept before, ``most`` of a track at most.

    Never empty for a track with moments: its first is always kept. Moments without a clock take no part.
    """
    moments = moments.where(F.col(clock).isNotNull())
    cols = [c for c in moments.columns if c not in track]
    short, long = _by_length(moments, track)
    out = _spread_islands(short, track, clock, order, gap, most).select(*track, *cols)
    if long is None:
        return out
    ranked = _ranked(long, track, clock, order)
    kept = _first(_greedy(ranked, track, gap, most), track, ["__rank"], most, "__n").select("__rank")
    return out.unionByName(ranked.join(kept, "__rank").select(*track, *cols))


def _spread_islands(moments: DataFrame, track: list[str], clock: str, order: list[Column], gap: float, most: int) -> DataFrame:
    w = Window.partitionBy(*track).orderBy(*order)
    ranked = islands(moments.withColumn("__rank", F.row_number().over(w)), track, clock, gap)
    cols = [c for c in moments.columns if c not in track]
    item = F.struct(F.col("__rank").alias("rank"), F.col(clock).alias("ts"), F.struct(*cols).alias("row"))
    kept = ranked.groupBy(*track, "__island").agg(_spread(F.array_sort(F.collect_list(item)), gap).alias("kept"))
    flat = kept.select(*track, F.explode("kept").alias("__kept"))
    return _first(flat, track, ["__kept.rank"], most, "__n").select(*track, "__kept.row.*")


def top_with_gap(moments: DataFrame, track: list[str], clock: str, score: str, tie: list[str], *, gap: float = 20.0, clip: float = 6.0, most: int = 10) -> DataFrame:
    """The best moments by score with a minimum gap, and, if they are too few, more with a smaller one.

    The second gap is 0.4 of the first, but no less than a clip. Ties go by ``tie``. ``pick`` numbers the choices.
    """
    moments = moments.where(F.col(clock).isNotNull())
    second = max(clip, 0.4 * gap)
    order = [F.col(score).desc(), *[F.col(c) for c in tie]]
    cols = [c for c in moments.columns if c not in track]
    short, long = _by_length(moments, track)
    out = _top_islands(short, track, clock, order, gap, second, most).select(*track, *cols, "pick")
    if long is None:
        return out
    ranked = _ranked(long, track, clock, order)
    one = materialize(_greedy(ranked, track, gap, most), "first-round")
    # Only tracks with too few take part in a second round.
    enough = one.groupBy(*track).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= most)
    enough = enough.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(track)])
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(track)]
    poor = ranked.join(enough, same, "left_anti").join(one.select("__rank"), "__rank", "left_anti")
    two = _greedy(poor, track, second, most, one.join(enough, same, "left_anti"))
    both = one.withColumn("__round", F.lit(1)).unionByName(two.withColumn("__round", F.lit(2)))
    picks = _first(both, track, ["__round", "__rank"], most, "pick").select("__rank", "pick")
    return out.unionByName(ranked.join(picks, "__rank").select(*track, *cols, "pick"))


def _top_islands(moments: DataFrame, track: list[str], clock: str, order: list[Column], gap: float, second: float, most: int) -> DataFrame:
    w = Window.partitionBy(*track).orderBy(*order)
    ranked = islands(moments.withColumn("__rank", F.row_number().over(w)), track, clock, max(gap, second))
    cols = [c for c in moments.columns if c not in track]
    item = F.struct(F.col("__rank").alias("rank"), F.col(clock).alias("ts"), F.struct(*cols).alias("row"))
    folded = ranked.groupBy(*track, "__island").agg(F.array_sort(F.collect_list(item)).alias("__all"))
    folded = folded.withColumn("__one", _spread(F.col("__all"), gap)).withColumn("__two", _spread(F.col("__all"), second, F.col("__one")))
    tag = lambda a, n: F.transform(a, lambda m: F.struct(F.lit(n).alias("round"), m["rank"].alias("rank"), m["row"].alias("row")))
    both = F.concat(tag(F.col("__one"), 1), tag(F.array_except("__two", "__one"), 2))
    flat = folded.select(*track, F.explode(both).alias("__kept"))
    return _first(flat, track, ["__kept.round", "__kept.rank"], most, "pick").select(*track, "__kept.row.*", "pick")


def clips(chosen: DataFrame, clock: str, low: Column, high: Column, *, lead: float = 0.6, clip: float = 6.0) -> DataFrame:
    """start and end of a clip about each moment: a little before it, within [low, high]; under a second is dropped."""
    start = F.least(F.greatest(low, F.col(clock) - lead), F.greatest(low, high - clip))
    out = chosen.withColumn("start", start).withColumn("end", F.least(high, F.col("start") + clip))
    return out.where(F.col("end") - F.col("start") >= 1.0)


def clip_budget(most_seconds: Column, clip: float = 6.0, card: float = 3.2, cards: bool = True) -> Column:
    """Whole clips that fit beside two cards, one at least."""
    return F.greatest(F.lit(1), F.floor(F.greatest(F.lit(0.0), most_seconds - 2 * card * cards) / clip)).cast("int")


def even_picks(moments: DataFrame, track: list[str], order: list[str], n: int) -> DataFrame:
    """``n`` rows of each track spread evenly by their number; all, if there are no more.

    Row i of m is picked if some k gives i = floor(k * m / n): a test on row numbers, no gathering.
    """
    w = Window.partitionBy(*track)
    number = F.row_number().over(w.orderBy(*order)) - 1
    ranked = moments.withColumn("__i", number).withColumn("__m", F.count(F.lit(1)).over(w))
    k = F.ceil(F.col("__i") * n / F.col("__m"))
    hit = (F.col("__m") <= n) | ((F.floor(k * F.col("__m") / n) == F.col("__i")) & (k < n))
    return ranked.where(hit).drop("__i", "__m")


def best_of_windows(found: DataFrame, track: list[str], start: str, end: str, score: Column, refill: Column, n: int, tie: list[str]) -> DataFrame:
    """``n`` rows of each track: the best by ``score`` of each of n equal windows of its span, then by ``refill``."""
    whole = Window.partitionBy(*track)
    order = whole.orderBy(start, *tie)
    last = F.last(end).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    span = F.greatest(F.lit(1e-6), last - F.min(start).over(whole))
    bucket = F.floor((F.col(start) - F.min(start).over(whole)) / span * n)
    out = found.withColumn("__m", F.count(F.lit(1)).over(whole)).withColumn("__bucket", bucket).withColumn("__score", score).withColumn("__refill", refill)
    inside = (F.col("__bucket") >= 0) & (F.col("__bucket") < n)
    best = F.row_number().over(Window.partitionBy(*track, "__bucket").orderBy(F.col("__score").desc(), start, *tie))
    out = out.withColumn("__best", inside & (best == 1))
    place = F.row_number().over(whole.orderBy(F.col("__best").desc(), F.when(~F.col("__best"), F.col("__refill")).desc_nulls_last(), start, *tie))
    return out.withColumn("__place", place).where((F.col("__m") <= n) | (F.col("__place") <= n)).drop("__m", "__bucket", "__score", "__refill", "__best", "__place")


def _fold(rows: DataFrame, track: list[str], order: list[str], begin, step) -> DataFrame:
    """Rows whose ``__v`` is kept by ``step(state, v)``; the state begins anew with ``begin()`` at each track's first row.

    The state is carried along the sorted rows of a task, batch by batch, so it is for tracks that one task can take. step
    returns None for a row that goes. Rows of equal order come by ``__v``.
    """
    first = F.row_number().over(Window.partitionBy(*track).orderBy(*order, "__v")) == 1
    ranked = rows.withColumn("__first", first)

    def run(batches):
        state = None
        for batch in batches:
            keep = []
            for i, (is_first, v) in enumerate(zip(batch["__first"].to_pylist(), batch["__v"].to_pylist(), strict=True)):
                if is_first:
                    state = begin()
                if step(state, v) is not None:
                    keep.append(i)
            if keep:
                yield batch.drop_columns(["__first"]).take(pa.array(keep, pa.int64()))

    return ranked.mapInArrow(run, rows.schema)


def pack(found: DataFrame, track: list[str], order: list[str], length: str, *, per: float, budget: float, least: float = 3.0) -> DataFrame:
    """Rows in order, each with as much of ``per`` seconds and of the budget as it can take (column ``taken``).

    ``length`` bounds what a row can give; null is no bound. Packing ends where less than ``least`` is left; a row that gives
    less is left out, so each row taken uses ``least`` or more: only the first budget / least rows of a track that can give so
    much are ever looked at, and a fold takes no more than these.
    """
    cols = [c for c in found.columns if c not in track]
    most = F.coalesce(F.nanvl(F.col(length).cast("double"), F.lit(per)), F.lit(per))
    give = found.withColumn("__give", F.least(most, F.lit(float(per)))).where((F.col("__give") >= least) & (F.lit(budget) >= least))
    first = _first(give, track, [*order, "__give"], math.floor(budget / least) + 1, "__n")
    item = F.struct(F.col("__n").alias("n"), F.col("__give").alias("give"), F.struct(*cols).alias("row"))
    rows = first.groupBy(*track).agg(F.array_sort(F.collect_list(item)).alias("__rows"))
    start = F.struct(F.lit(0.0).alias("used"), F.transform(F.slice("__rows", 1, 0), lambda m: F.struct(m["row"].alias("row"), F.lit(0.0).alias("taken"))).alias("kept"))

    def step(acc: Column, m: Column) -> Column:
        take = F.least(m["give"], F.lit(budget) - acc["used"])
        more = F.struct((acc["used"] + take).alias("used"), F.concat(acc["kept"], F.array(F.struct(m["row"].alias("row"), take.alias("taken")))).alias("kept"))
        return F.when(F.lit(budget) - acc["used"] >= least, more).otherwise(acc)

    kept = rows.select(*track, F.explode(F.aggregate("__rows", start, step)["kept"]).alias("__kept"))
    return kept.select(*track, "__kept.row.*", F.col("__kept.taken").alias("taken"))


def lengthen(clips_: DataFrame, track: list[str], *, least: float, clip: float, most: float = 14.0) -> DataFrame:
    """Clips made longer evenly, to ``most`` each, where a track's are shorter than ``least`` in all."""
    w = Window.partitionBy(*track)
    have, n = F.sum(F.col("end") - F.col("start")).over(w), F.count(F.lit(1)).over(w)
    per = F.least(F.lit(most), F.lit(clip) + (F.lit(least) - have) / n)
    out = clips_.withColumn("__end", F.when(have < least, F.col("start") + per).otherwise(F.col("end")))
    return out.withColumn("end", F.col("__end")).drop("__end")


def fallback_clips(tracks: DataFrame, low: Column, high: Column, clip: float, n: int = 12) -> DataFrame:
    """``n`` equally spaced clips of each row."""
    out = tracks.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(n))))
    start = F.greatest(low, F.least(low + F.col("j") * (high - low) / (n + 1), high - clip))
    return out.withColumn("start", start).withColumn("end", F.least(high, F.col("start") + clip))


def manual_clips(marks: DataFrame, track: list[str], clock: str, length: Column, clip: float, most: int) -> DataFrame:
    """A clip for each of the first ``most`` marks in time order, moved to lie within the track."""
    w = Window.partitionBy(*track).orderBy(clock)
    out = marks.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
    return out.withColumn("start", F.greatest(F.lit(0.0), F.least(F.col(clock), length - clip))).withColumn("end", F.least(length, F.col("start") + clip))


def nearest_clean(marks: DataFrame, clean: DataFrame, key: list[str], clock: str, *, step: float = 3.0, search: float = 120.0) -> DataFrame:
    """Each mark, or, unless it is clean, the nearest clean moment by steps outward, forward first; else the mark.

    ``clean``: key and ``at``, the moments that are clean. A moment lies whole steps from a mark if both leave the same rest
    by the step, so marks and moments of one key and rest are put on one time line, as in an as-of join both ways.
    """
    n = int(search // step)
    micros = lambda c: F.round(F.col(c) * 1_000_000).cast("long")
    place = lambda c: F.pmod(micros(c), F.lit(round(step * 1_000_000)))
    moments = clean.select(*key, F.col("at").alias("__at")).distinct().withColumn("__place", place("__at"))
    moments = moments.withColumn("__ahead", -micros("__at"))  # of two as near, the later one
    found = nearest(marks.withColumn("__place", place(clock)), moments, [*key, "__place"], clock, "__at", "__ahead", ["__at"])
    near = F.abs(micros("__at") - micros(clock)) <= round(step * 1_000_000) * n
    return found.withColumn("at", F.when(near, F.col("__at")).otherwise(F.col(clock))).drop("__at", "__place")


def anchored(samples: DataFrame, track: list[str], order: list[str], value: str, threshold: float, most: int = 80) -> DataFrame:
    """Samples that differ by ``threshold`` or more from the last one kept; a track's first is kept.

    Unlike the difference from the previous sample, it notices slow drift. ``most`` of a track are kept. Samples without a
    value are left out.
    """

    def step(kept: list, v: float) -> bool | None:
        """kept: how many, and the value of the last one."""
        if kept[0] and (kept[0] >= most or abs(v - kept[1]) < threshold):
            return None
        kept[:] = kept[0] + 1, v
        return True

    v = F.col(value).cast("double").alias("__v")
    rows = samples.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*track, *order, v)
    short, long = _by_length(rows, track)
    out = _fold(short, track, order, lambda: [0, None], step)
    if long is not None:
        out = out.unionByName(_anchored_blocks(long, track, order, threshold, most))
    return out.withColumnRenamed("__v", value)


def _blocked(rows: DataFrame, track: list[str], order: list[str]) -> DataFrame:
    """rows of long tracks with __rank, in the order of the tracks and their rows, and the __block of their track, written."""
    ranked = global_rank(rows, [*track, *order, "__v"], "__rank").drop("total")
    return materialize(ranked.withColumn("__block", F.expr(f"__rank div {BLOCK_ROWS}")), "blocks")


def _anchored_blocks(rows: DataFrame, track: list[str], order: list[str], threshold: float, most: int) -> DataFrame:
    """The samples that anchored() keeps of long tracks.

    The first sample of a block that differs enough from an anchor before it is higher, or lower, than all before it in the
    block: a record. So a block is summed up by its records and, for each, by the last sample kept from there on and how many
    are. Records are gone through in order, one row each; then every block is replayed from the anchor that comes into it.
    """
    blocks = _blocked(rows, track, order)
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*track).schema.fields)

    def leaves(v: np.ndarray, i: int, anchor: float) -> int:
        """The first place from i on whose value differs enough from the anchor, or the end."""
        step = 64
        while i < len(v):
            far = np.abs(v[i : i + step] - anchor) >= threshold
            if far.any():
                return i + int(far.argmax())
            i, step = i + step, 2 * step
        return len(v)

    def records(part: pa.Table) -> pa.Table:
        part = part.sort_by("__rank").combine_chunks()
        v = part["__v"].to_numpy()
        high, low = np.maximum.accumulate(v), np.minimum.accumulate(v)
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] > high[:-1]) | (v[1:] < low[:-1])
        ends: dict[int, tuple[float, int]] = {}
        for i in np.flatnonzero(new).tolist():
            path = []
            while i not in ends and i < len(v):
                path.append(i)
                i = leaves(v, i + 1, v[i])
            last, steps = ends.get(i, (None, 0))
            for j in reversed(path):
                last, steps = (float(v[j]), 0) if last is None else (last, steps + 1)
                ends[j] = last, steps
        at = np.flatnonzero(new)
        out = part.select([*track, "__block", "__rank", "__v"]).take(pa.array(at))
        return out.append_column("__end", pa.array([ends[i][0] for i in at.tolist()], pa.float64())).append_column("__steps", pa.array([ends[i][1] for i in at.tolist()], pa.int64()))

    def chained(part: pa.Table) -> pa.Table:
        part = part.sort_by("__rank").combine_chunks()
        block, v, ends, steps = (part[c].to_numpy() for c in ("__block", "__v", "__end", "__steps"))
        edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        anchor, count, out = None, 0, []
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(block)], strict=True):
            if count >= most:
                break
            out.append((a, anchor, count))
            i = a if anchor is None else a + leaves(v[a:b], 0, anchor)
            if i < b:
                anchor, count = ends[i], count + 1 + int(steps[i])
        places = pa.array([a for a, *_ in out], pa.int64())
        return part.select([*track, "__block"]).take(places).append_column("__anchor", pa.array([x for _, x, _ in out], pa.float64())).append_column("__count", pa.array([n for *_, n in out], pa.int64()))

    def replayed(part: pa.Table) -> pa.Table:
        part = part.sort_by("__rank").combine_chunks()
        v, anchor, count = part["__v"].to_numpy(), part["__anchor"][0].as_py(), part["__count"][0].as_py()
        kept, i = [], 0
        while count < most and (i := i if anchor is None else leaves(v, i, anchor)) < len(v):
            kept.append(i)
            anchor, count, i = v[i], count + 1, i + 1
        return part.select([*track, *order, "__v"]).take(pa.array(kept, pa.int64()))

    found = blocks.groupBy(*track, "__block").applyInArrow(records, f"{keys}, __block bigint, __rank bigint, __v double, __end double, __steps bigint")
    coming = found.groupBy(*track).applyInArrow(chained, f"{keys}, __block bigint, __anchor double, __count bigint")
    coming = coming.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(track)], F.col("__block").alias("__b"), "__anchor", "__count")
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(track)]
    joined = blocks.join(coming, [F.col("__block") == F.col("__b"), *same]).select(*rows.columns, "__rank", "__block", "__anchor", "__count")
    return joined.groupBy(*track, "__block").applyInArrow(replayed, rows.schema)


def mean_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of two vectors, in double precision."""
    size = F.size(a)
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / size


def novel(vectors: DataFrame, track: list[str], order: str, vector: str, threshold: float, most: int = 60) -> DataFrame:
    """Leaders: vectors ``threshold`` or more from all leaders before them, ``most`` of a track at most.

    Vectors that are null or hold a null take no part; vectors of unlike sizes can't be compared, so one that isn't of the
    leaders' size is no leader.
    """

    def step(leaders: list[np.ndarray], components: list[float]) -> bool | None:
        if leaders and (len(leaders) >= most or len(components) != leaders[0].size):
            return None
        v = np.asarray(components, np.float64)
        if leaders:
            # Summed one after the other, so that the sums are those of mean_distance.
            sums = np.add.accumulate(np.abs(np.stack(leaders) - v), axis=1)[:, -1]
            if (sums / v.size < threshold).any():
                return None
        leaders.append(v)
        return True

    v = F.col(vector).cast("array<double>")
    usable = F.col("__v").isNotNull() & (F.size("__v") > 0) & F.forall("__v", lambda x: x.isNotNull())
    rows = vectors.select(*track, order, v.alias("__v")).where(usable)
    short, long = _by_length(rows, track)
    out = _fold(short, track, [order], list, step)
    if long is not None:
        out = out.unionByName(_novel_blocks(long, track, order, threshold, most))
    return out.drop("__v")


def _far(matrix: np.ndarray, leader: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows are ``threshold`` or more from the leader; sums go one component after the other."""
    return np.cumsum(np.abs(matrix - leader), axis=1)[:, -1] / leader.size >= threshold


def _novel_blocks(rows: DataFrame, track: list[str], order: str, threshold: float, most: int) -> DataFrame:
    """The leaders of long tracks. Blocks find their own, given what is known of the leaders before them; all that were found
    are gone through in order, and blocks look again, until the list of leaders stays as it was.

    By then each block has been given the leaders that really come before it. The first block is right at once and each
    round makes one more so at least; as leaders become few along a track, rounds are few.
    """
    blocks = _blocked(rows, track, [order])
    names = [F.col(c).alias(f"__k{i}") for i, c in enumerate(track)]
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(track)]
    sizes = blocks.groupBy(*track).agg(F.min_by(F.size("__v"), "__rank").alias("__size")).select(*names, "__size")
    blocks = materialize(blocks.join(sizes, [*same, F.size("__v") == F.col("__size")]).select(*blocks.columns), "vectors")
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*track).schema.fields)
    schema = f"{keys}, `{order}` {rows.schema[order].dataType.simpleString()}, __v array<double>, __rank bigint, __block bigint"
    columns = [*track, order, "__v", "__rank", "__block"]

    def own(part: pa.Table) -> pa.Table:
        part = part.sort_by("__rank").combine_chunks()
        matrix = np.array(part["__v"].to_pylist(), np.float64)
        before = part["__before"][0].as_py() or []
        open_ = np.ones(len(matrix), bool)
        for leader in before:
            open_ &= _far(matrix, np.asarray(leader, np.float64), threshold)
        kept, count = [], len(before)
        while count < most and open_.any():
            i = int(open_.argmax())
            kept.append(i)
            count += 1
            open_[i:] &= _far(matrix[i:], matrix[i], threshold)
            open_[: i + 1] = False
        return part.select(columns).take(pa.array(kept, pa.int64()))

    def settled(part: pa.Table) -> pa.Table:
        part = part.sort_by("__rank").combine_chunks()
        matrix = np.array(part["__v"].to_pylist(), np.float64)
        kept: list[int] = []
        for i in range(len(matrix)):
            if len(kept) >= most:
                break
            if not kept or _far(matrix[kept], matrix[i], threshold).all():
                kept.append(i)
        return part.take(pa.array(kept, pa.int64()))

    leaders = None
    while True:
        given = blocks.withColumn("__before", F.lit(None).cast("array<array<double>>"))
        if leaders is not None:
            starts = blocks.groupBy(*track, "__block").agg(F.min("__rank").alias("__start"))
            known = leaders.select(*names, F.col("__rank").alias("__at"), F.col("__v").alias("__leader"))
            lists = starts.join(known, [*same, F.col("__at") < F.col("__start")]).groupBy(*track, "__block").agg(F.array_sort(F.collect_list(F.struct("__at", "__leader"))).alias("__list"))
            lists = lists.select(*names, F.col("__block").alias("__b"), F.transform("__list", lambda x: x["__leader"]).alias("__before"))
            given = blocks.join(lists, [F.col("__block") == F.col("__b"), *same], "left").select(*blocks.columns, "__before")
        found = given.groupBy(*track, "__block").applyInArrow(own, schema)
        now = materialize(found.groupBy(*track).applyInArrow(settled, schema), "leaders")
        if leaders is not None and not now.select("__rank").exceptAll(leaders.select("__rank")).head(1) and not leaders.select("__rank").exceptAll(now.select("__rank")).head(1):
            return now.select(*rows.columns)
        leaders = now
