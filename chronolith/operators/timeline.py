"""Operators on timelines: steps, differences, alignment of two streams.

A timeline is a table with a track (one or more columns), an order and a clock. Every operator works by window or by
equi-join on the track, so tracks are spread over tasks; none gathers a whole track into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The difference of a first sample, which has none before it; fixed value.
FIRST_CHANGE = 255.0


def change_from_previous(samples: DataFrame, track: list[str], order: list[str], value: str, out: str = "change") -> DataFrame:
    """Absolute difference to the previous sample of the track; FIRST_CHANGE for the first."""
    w = Window.partitionBy(*track).orderBy(*order)
    return samples.withColumn(out, F.coalesce(F.abs(F.col(value) - F.lag(value).over(w)), F.lit(FIRST_CHANGE)))


def scenes(samples: DataFrame, threshold: float, change: str = "change") -> DataFrame:
    """Samples that begin a scene: those whose change from the previous one reaches the threshold."""
    return samples.where(F.col(change) >= threshold)


def steps(
    samples: DataFrame, track: list[str], order: list[str], clock: str, change: str = "change", *, sample_seconds: float = 1.5,
    threshold: float = 3.0, dead_change: float = 0.40, dead_seconds: float = 8.0, typing: float = 0.18, dead_activity: float = 0.15,
    min_step: float = 2.5,
) -> DataFrame:
    """Steady steps of each track: index, start, end, change, activity, dead.

    A sample whose change reaches ``threshold``, or a track's first, opens a step; a step ends where the next begins, the
    last one a sample after its last. change and activity are of the samples after the opening one: the highest, and the
    share of ``typing`` and more. A step without movement for ``dead_seconds`` is dead. A live step shorter than
    ``min_step`` joins the live step before it, which keeps its own figures. Needs dead_seconds > min_step.
    """
    assert dead_seconds > min_step
    w = Window.partitionBy(*track).orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col(change) >= threshold) | (F.row_number().over(w) == 1)
    marked = samples.withColumn("__opens", opens).withColumn("__raw", F.sum(F.col("__opens").cast("long")).over(running))
    later = ~F.col("__opens")
    raw = marked.groupBy(*track, "__raw").agg(
        F.min(clock).alias("start"),
        F.max(clock).alias("__last"),
        F.coalesce(F.max(F.when(later, F.col(change))), F.lit(0.0)).alias("change"),
        F.coalesce(F.avg(F.when(later, (F.col(change) >= typing).cast("double"))), F.lit(0.0)).alias("activity"),
    )
    by_step = Window.partitionBy(*track).orderBy("__raw")
    raw = raw.withColumn("end", F.coalesce(F.lead("start").over(by_step), F.col("__last") + sample_seconds))
    length = F.greatest(F.lit(0.0), F.col("end") - F.col("start"))
    dead = (F.col("change") < dead_change) & (F.col("activity") < dead_activity) & (length >= dead_seconds)
    raw = raw.withColumn("dead", dead)
    joins = (length < min_step) & ~F.col("dead") & ~F.coalesce(F.lag("dead").over(by_step), F.lit(True))
    raw = raw.withColumn("__island", F.sum((~joins).cast("long")).over(by_step.rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda c: F.min_by(c, "__raw").alias(c)
    merged = raw.groupBy(*track, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), first("change"), first("activity"), first("dead"))
    return merged.select(*track, F.col("__island").cast("int").alias("index"), "start", "end", "change", "activity", "dead")


def duration(start: str = "start", end: str = "end") -> Column:
    return F.greatest(F.lit(0.0), F.col(end) - F.col(start))


def useful_steps(found: DataFrame, low: float = 0.0, high: float = 1e9, least: float = 2.0) -> DataFrame:
    """Steps that overlap an interval, strictly, are alive, no meeting panel, and last long enough."""
    alive = ~F.col("dead") if "artifact" not in found.columns else ~F.col("dead") & (F.col("artifact") != "teams")
    return found.where(alive & (F.col("end") > low) & (F.col("start") < high) & (duration() >= least))


def without_repeats(found: DataFrame, track: list[str], order: list[str], key: list[str]) -> DataFrame:
    """Rows whose key differs from that of the row before, null-safe."""
    w = Window.partitionBy(*track).orderBy(*order)
    same = F.lag(F.struct(*key)).over(w).eqNullSafe(F.struct(*key)) & (F.row_number().over(w) > 1)
    return found.withColumn("__same", same).where(~F.col("__same")).drop("__same")


def occurrence(track: list[str], key: list[str], order: list[str]) -> Column:
    """How often the key has occurred before, from 0."""
    return F.row_number().over(Window.partitionBy(*track, *key).orderBy(*order)) - 1


def capped(found: DataFrame, track: list[str], key: list[str], order: list[Column], most: int = 4) -> DataFrame:
    """The first ``most`` rows of each key."""
    w = Window.partitionBy(*track, *key).orderBy(*order)
    return found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def offsets(items: DataFrame, track: list[str], order: list[str], length: str, out: str = "offset") -> DataFrame:
    """Where each item begins on the track's time line: the sum of the lengths before it."""
    w = Window.partitionBy(*track).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn(out, F.coalesce(F.sum(length).over(w), F.lit(0.0)))


def acts(items: DataFrame, track: list[str], order: list[str], position: Column) -> DataFrame:
    """Act 0, 1 or 2 of each item: the third of ``position`` (0 to 1), or of its number where an act would be empty."""
    whole = Window.partitionBy(*track)
    by_place = F.when(position < 1 / 3, 0).when(position < 2 / 3, 1).otherwise(2)
    n = F.count(F.lit(1)).over(whole)
    number = F.row_number().over(Window.partitionBy(*track).orderBy(*order)) - 1
    third = F.greatest(F.lit(1), F.floor(n / 3))
    by_number = F.least(F.lit(2), F.floor(number / third)).cast("int")
    out = items.withColumn("__place", by_place).withColumn("__kinds", F.size(F.collect_set("__place").over(whole)))
    return out.withColumn("act", F.when((n >= 3) & (F.col("__kinds") < 3), by_number).otherwise(F.col("__place"))).drop("__place", "__kinds")


def chapters(tracks: DataFrame, length: str, minutes: float = 12.0, most: int = 6) -> DataFrame:
    """Equal chapters of each row: count by length, 1 to ``most``; the last ends with the track."""
    k = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col(length) / (minutes * 60.0) + 0.5))).cast("int")
    out = tracks.withColumn("chapters", k).withColumn("chapter", F.explode(F.sequence(F.lit(0), F.col("chapters") - 1)))
    each = F.col(length) / F.col("chapters")
    end = F.when(F.col("chapter") < F.col("chapters") - 1, (F.col("chapter") + 1) * each).otherwise(F.col(length))
    return out.withColumn("start", F.col("chapter") * each).withColumn("end", end)


def import_clock(segments: DataFrame, track: list[str], order: list[str], clock: str) -> DataFrame:
    """The clock, or, where it is null, the number of the segment in its track from 0."""
    number = F.row_number().over(Window.partitionBy(*track).orderBy(*order)) - 1
    return segments.withColumn(clock, F.coalesce(F.col(clock), number.cast("double")))


def nearest(left: DataFrame, right: DataFrame, track: list[str], left_clock: str, right_clock: str, right_order: str, take: list[str]) -> DataFrame:
    """Each row of left with the columns ``take`` of the row of right nearest in time on its track, either way.

    Equal distances go to the row that is first by ``right_order``; no row gives nulls. Both sides are put on one time
    line and the last and next row of right are carried along it, so nothing grows with the product of the sides.
    """
    payload = F.struct(F.col(right_clock).alias("at"), F.col(right_order).alias("ord"), *take)
    kind = right.select(payload.alias("p")).schema["p"].dataType
    a = left.withColumn("__id", F.monotonically_increasing_id())
    line = a.select(*track, F.col(left_clock).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__o"), F.lit(None).cast(kind).alias("__p"), F.struct("*").alias("__row"))
    rows = line.schema["__row"].dataType
    b = right.select(*track, F.col(right_clock).alias("__at"), F.lit(0).alias("__side"), F.col(right_order).cast("long").alias("__o"), payload.alias("__p"), F.lit(None).cast(rows).alias("__row"))
    both = line.unionByName(b)
    # Of rows of right with one time, the first by order is wanted from either side.
    back = Window.partitionBy(*track).orderBy(F.col("__at"), F.col("__side"), F.col("__o").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*track).orderBy(F.col("__at").desc(), F.col("__side"), F.col("__o").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__back", F.last("__p", ignorenulls=True).over(back)).withColumn("__ahead", F.last("__p", ignorenulls=True).over(ahead))
    found = both.where("__side = 1").select("__row.*", "__back", "__ahead")
    far = lambda c: F.abs(F.col(f"{c}.at") - F.col(left_clock))
    later_first = F.col("__ahead.ord") < F.col("__back.ord")
    ahead_wins = F.col("__back").isNull() | (far("__ahead") < far("__back")) | ((far("__ahead") == far("__back")) & later_first)
    best = F.when(F.coalesce(ahead_wins, F.lit(False)) & F.col("__ahead").isNotNull(), F.col("__ahead")).otherwise(F.col("__back"))
    return found.withColumn("__best", best).select(*left.columns, *[F.col(f"__best.{c}").alias(c) for c in take])


def within(points: DataFrame, intervals: DataFrame, track: list[str], clock: str, start: str, end: str, slack: float = 0.0, bin_seconds: float = 60.0) -> DataFrame:
    """Pairs of points and intervals of a track with ``start - slack <= clock <= end + slack``.

    An equi-join on the track and a bin of time, and a residual test: an interval is in as many bins as it spans.
    Choose bins of about the usual length of an interval.
    """
    bin_of = lambda c: F.floor(c / bin_seconds).cast("long")
    p = points.withColumn("__bin", bin_of(F.col(clock)))
    low, high = F.col(start) - slack, F.col(end) + slack
    i = intervals.where(low <= high).withColumn("__bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
    return p.join(i, [*track, "__bin"]).where(F.col(clock).between(low, high)).drop("__bin")


def longest_phrase(segments: DataFrame, intervals: DataFrame, track: list[str], key: list[str], bin_seconds: float = 60.0) -> DataFrame:
    """The longest text spoken within ``[start - 1, end)`` of each interval (columns key, lo, hi); the first of equals."""
    pairs = within(segments, intervals, track, "start", "lo", "hi", 1.0, bin_seconds)
    pairs = pairs.where((F.col("start") >= F.col("lo") - 1) & (F.col("start") < F.col("hi")))
    return pairs.groupBy(*track, *key).agg(F.max_by("text", F.struct(F.length("text"), -F.col("ord"))).alias("text"))


def merged_timeline(audio: DataFrame, visual: DataFrame) -> DataFrame:
    """Two streams (track, ts, ord, text) as one, with ``source``; order by track, ts, rank, ord: audio before visual."""
    a = audio.select("track", "ts", "ord", "text", F.lit("audio").alias("source"), F.lit(0).alias("rank"))
    v = visual.select("track", "ts", "ord", "text", F.lit("visual").alias("source"), F.lit(1).alias("rank"))
    return a.unionByName(v)


def probes(windows: DataFrame, start: str, length: float = 10.0, samples: int = 5) -> DataFrame:
    """Evenly spaced moments of each window, its ends included: column ``probe``."""
    gap = length / max(1, samples - 1)
    return windows.withColumn("probe", F.explode(F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.col(start) + k * F.lit(gap))))


def most_at_probes(windows: DataFrame, samples: DataFrame, track: list[str], start: str, clock: str, order: str, value: str, *, length: float = 10.0, n: int = 5, out: str = "most") -> DataFrame:
    """windows with ``out``: the greatest value among the first samples at or after each of ``n`` probes of the window.

    Probes and samples are put on one time line, from its end, so the last sample met is the next one in time; of samples at
    one time it is the first by ``order``. A probe after the last sample sees nothing; a window of such probes has null.
    """
    w = windows.withColumn("__id", F.monotonically_increasing_id())
    line = probes(w.select(*track, "__id", start), start, length, n)
    line = line.select(*track, F.col("probe").cast("double").alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__o"), "__id", F.lit(None).cast("struct<v:double>").alias("__v"))
    seen = samples.select(*track, F.col(clock).cast("double").alias("__at"), F.lit(0).alias("__side"), F.col(order).cast("long").alias("__o"), F.lit(None).cast("long").alias("__id"), F.struct(F.col(value).cast("double").alias("v")).alias("__v"))
    back = Window.partitionBy(*track).orderBy(F.col("__at").desc(), "__side", F.col("__o").desc()).rowsBetween(Window.unboundedPreceding, 0)
    met = line.unionByName(seen).withColumn("__v", F.last("__v", ignorenulls=True).over(back)).where("__side = 1")
    most = met.groupBy("__id").agg(F.max("__v.v").alias(out))
    return w.join(most, "__id", "left").drop("__id")


def in_window(moments: DataFrame, clock: str, low: Column, high: Column) -> DataFrame:
    """Moments with ``low <= clock < high``."""
    return moments.where((F.col(clock) >= low) & (F.col(clock) < high))


def listed(*names: DataFrame) -> DataFrame:
    """The distinct rows of several listings; order them where they are shown."""
    out = names[0]
    for more in names[1:]:
        out = out.union(more)
    return out.distinct()


def sampled(samples: DataFrame, track: list[str], clock: str, every: float) -> DataFrame:
    """The first sample at or after each multiple of ``every`` seconds of a track."""
    slot = F.ceil(F.col(clock) / every)
    w = Window.partitionBy(*track, "__slot").orderBy(clock)
    return samples.withColumn("__slot", slot).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__slot", "__n")


def sampling_step(length: Column, step: float, most: int = 120) -> Column:
    return F.greatest(F.lit(float(step)), length / most)
