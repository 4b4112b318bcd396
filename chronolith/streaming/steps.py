"""Streaming variants of two timeline operators: an extension, for sources that don't end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STEP_SCHEMA = "track string, start double, end double, change double, activity double"
STATE_SCHEMA = "start double, last double, previous double, change double, typing long, samples long"


def windowed_activity(samples: DataFrame, clock: str, value: str, *, window: str = "1 hour", late: str = "10 minutes", least: float = 0.18) -> DataFrame:
    """Share of samples of each track and window that reach ``least``; late samples up to ``late`` count."""
    timed = samples.withWatermark(clock, late)
    return timed.groupBy("track", F.window(clock, window).alias("w")).agg(
        F.count(F.lit(1)).alias("samples"), F.avg((F.col(value) >= least).cast("double")).alias("activity"), F.max(value).alias("change")
    ).select("track", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "samples", "activity", "change")


def streaming_steps(samples: DataFrame, threshold: float = 3.0, typing: float = 0.18) -> DataFrame:
    """Steps as they close: (track, t, value) in order of t within a track; a step is emitted when the next one opens.

    The state of a track is six numbers. Short steps aren't joined, as their neighbours are out already.
    """

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, previous, change, busy, count = state.get if state.exists else (None,) * 3 + (0.0, 0, 0)
        out = []
        rows = pd.concat(list(parts)).sort_values("t")
        for t, value in zip(rows["t"], rows["value"], strict=True):
            moved = abs(value - previous) if previous is not None else None
            if moved is None or moved >= threshold:
                if start is not None:
                    out.append((key[0], start, float(t), change, busy / count if count else 0.0))
                start, change, busy, count = float(t), 0.0, 0, 0
            else:
                change, busy, count = max(change, moved), busy + (moved >= typing), count + 1
            last, previous = float(t), float(value)
        if start is not None:
            state.update((start, last, previous, float(change), int(busy), int(count)))
        yield pd.DataFrame(out, columns=["track", "start", "end", "change", "activity"])

    return samples.groupBy("track").applyInPandasWithState(advance, STEP_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
