"""Selection on tracks that are spread over tasks, against plain models and against the folds of short tracks."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_folds import plain_anchored, plain_novel, plain_pack, tracks_of

from chronolith.operators import select


@pytest.fixture
def long_tracks(monkeypatch):
    monkeypatch.setattr(select, "LONG", 20)
    monkeypatch.setattr(select, "BLOCK_ROWS", 16)
    monkeypatch.setattr(select, "BIN_GAPS", 24)


def plain_top(moments, gap, second, most):
    """moments: (ts, id) in order of rank."""
    kept = []
    for reach in (gap, second):
        for m in moments:
            if m not in kept and len(kept) < most and all(abs(m[0] - k[0]) >= reach for k in kept):
                kept.append(m)
    return [i for _, i in kept]


def moments_of(kind, rng):
    n = {"few": 12, "ramp": 90, "fall": 90, "random": 150, "ties": 80, "sparse": 60}[kind]
    ts = [i * 1.5 for i in range(n)] if kind in ("ramp", "fall") else [float(rng.randrange(40)) for _ in range(n)] if kind == "ties" else [rng.random() * n * (40 if kind == "sparse" else 2) for _ in range(n)]
    score = {"ramp": lambda i: i, "fall": lambda i: -i}.get(kind, lambda i: rng.randrange(9))
    return [(t, i, float(score(i))) for i, t in enumerate(ts)]


@pytest.mark.parametrize("most", [4, 60])
def test_minimum_gaps(spark, long_tracks, most):
    rng = random.Random(most)
    tracks = {kind: moments_of(kind, rng) for kind in ("few", "ramp", "fall", "random", "ties", "sparse")} | {None: moments_of("random", rng)}
    rows = [(name, t, i, s) for name, own in tracks.items() for t, i, s in own] + [("random", None, 999, 50.0)]
    some = spark.createDataFrame(rows, "k string, t double, id long, score double")
    got = {}
    for r in select.top_with_gap(some, ["k"], "t", "score", ["id"], gap=20.0, clip=6.0, most=most).collect():
        got.setdefault(r["k"], {})[r["pick"]] = r["id"]
    want = {name: plain_top([(t, i) for t, i, _ in sorted(own, key=lambda m: (-m[2], m[1]))], 20.0, 8.0, most) for name, own in tracks.items()}
    assert {name: [p[n] for n in sorted(p)] for name, p in got.items()} == want
    for order, key in (([F.col("t"), F.col("id")], lambda m: (m[0], m[1])), ([F.col("t").desc(), F.col("id")], lambda m: (-m[0], m[1]))):
        got = {}
        for r in select.spread(some, ["k"], "t", order, 6.0, most).collect():
            got.setdefault(r["k"], set()).add(r["id"])
        assert got == {name: set(plain_top([(t, i) for t, i, _ in sorted(own, key=key)], 6.0, 6.0, most)) for name, own in tracks.items()}


def values_of(n, rng):
    return [rng.choice([rng.random() * 9, float(i % 40), i * 0.2, 5.0]) for i in range(n)]


@pytest.mark.parametrize("most", [7, 400])
def test_anchors_by_blocks(spark, long_tracks, most):
    rng = random.Random(3)
    tracks = {f"t{n}": values_of(n, rng) for n in (1, 15, 16, 21, 33, 300)} | {"up": [i * 0.5 for i in range(200)], "same": [2.0] * 100, "down": [-i * 0.3 for i in range(150)]}
    rows = [(t, i, v) for t, values in tracks.items() for i, v in enumerate(values)] + [("t300", 1000, None), ("t300", 1001, float("nan"))]
    rng.shuffle(rows)
    got = tracks_of(select.anchored(spark.createDataFrame(rows, "track string, ord long, v double"), ["track"], ["ord"], "v", 3.0, most))
    assert {t: [r["ord"] for r in own] for t, own in got.items()} == {t: plain_anchored(values, 3.0, most) for t, values in tracks.items()}


@pytest.mark.parametrize("most", [5, 100])
def test_leaders_by_blocks(spark, long_tracks, most):
    rng = np.random.default_rng(4)
    tracks = {f"t{n}": [[float(x) for x in v] for v in rng.integers(0, 4, (n, 3))] for n in (2, 19, 40, 200)}
    tracks["t200"][7] = [1.0]
    tracks["drift"] = [[i * 0.1, 0.0, 0.0] for i in range(120)]
    rows = [(t, i, v) for t, own in tracks.items() for i, v in enumerate(own)] + [("t200", 900, None), ("t200", 901, [1.0, None, 2.0])]
    got = tracks_of(select.novel(spark.createDataFrame(rows, "track string, ord long, v array<double>"), ["track"], "ord", "v", 0.9, most))
    assert {t: [r["ord"] for r in own] for t, own in got.items()} == {t: plain_novel(own, 0.9, most) for t, own in tracks.items()}


def test_packing_looks_at_few_rows(spark):
    rng = random.Random(6)
    tracks = {f"t{n}": [rng.choice([None, 1.0, 2.9, 3.0, 7.5, 30.0]) for _ in range(n)] for n in (0, 1, 5, 400)}
    rows = [(t, i, v) for t, own in tracks.items() for i, v in enumerate(own)]
    got = tracks_of(select.pack(spark.createDataFrame(rows, "track string, ord long, v double"), ["track"], ["ord"], "v", per=9.0, budget=61.0, least=3.0))
    assert {t: {r["ord"]: r["taken"] for r in own} for t, own in got.items()} == {t: plain_pack(own, 9.0, 61.0, 3.0) for t, own in tracks.items() if plain_pack(own, 9.0, 61.0, 3.0)}


def test_clean_moments_both_ways(spark):
    rng = random.Random(8)
    marks = [(k, float(rng.randrange(0, 300)) / 2) for k in range(5) for _ in range(30)]
    marks = sorted(set(marks))
    clean = [(k, float(rng.randrange(0, 300)) / 2) for k in range(5) for _ in range(6)] + [(9, 1.0)]
    there = set(clean)
    want = {}
    for k, c in marks:
        tries = [c] + [c + s * i * 3.0 for i in range(1, 8) for s in (1, -1)]
        want[k, c] = next((t for t in tries if (k, t) in there), c)
    got = select.nearest_clean(spark.createDataFrame(marks, "k long, clock double"), spark.createDataFrame(clean + clean, "k long, at double"), ["k"], "clock", step=3.0, search=21.0).collect()
    assert {(r["k"], r["clock"]): r["at"] for r in got} == want and len(got) == len(marks)


def test_a_track_of_a_million(spark):
    """Samples closer than the gap all along, so the whole track is one run."""
    base = spark.range(1_000_000).select(F.lit("one").alias("track"), F.col("id").alias("ord"), (F.col("id") * 1.5).alias("t"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double")).alias("v"))
    began = time.time()
    found = select.top_with_gap(base, ["track"], "t", "v", ["ord"], gap=20.0, clip=6.0, most=300).collect()
    assert time.time() - began < 240
    rows = sorted(((r["v"], -r["ord"], r["t"], r["ord"]) for r in base.where(F.col("v") > 990_000).collect()), reverse=True)
    want = plain_top([(t, i) for *_, t, i in rows], 20.0, 8.0, 300)
    assert [r["ord"] for r in sorted(found, key=lambda r: r["pick"])] == want
