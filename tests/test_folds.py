"""The folds that go along sorted rows, against plain models, over many tracks and batches; ids without a single task."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import entities, select


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, before)


def plain_anchored(values, threshold, most):
    kept = []
    for i, v in enumerate(values):
        if v is not None and (not kept or (len(kept) < most and abs(v - values[kept[-1]]) >= threshold)):
            kept.append(i)
    return kept


def plain_pack(lengths, per, budget, least):
    used, out = 0.0, {}
    for i, n in enumerate(lengths):
        take = min(x for x in (per, budget - used, n) if x is not None)
        if used < budget and budget - used >= least and take >= least:
            used, out[i] = used + take, take
    return out


def plain_novel(vectors, threshold, most):
    kept = []
    for i, v in enumerate(vectors):
        far = all(len(v) == len(vectors[k]) and sum(abs(a - b) for a, b in zip(v, vectors[k], strict=True)) / len(v) >= threshold for k in kept)
        if len(kept) < most and far:
            kept.append(i)
    return kept


def tracks_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["track"], []).append(r)
    return {k: sorted(v, key=lambda r: r["ord"]) for k, v in out.items()}


def shuffled(spark, tracks, kind):
    rows = [(t, i, v) for t, values in tracks.items() for i, v in enumerate(values)]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, f"track string, ord long, v {kind}")


def test_anchored_over_batches(spark, small_batches):
    rng = random.Random(1)
    tracks = {f"t{k}": [rng.choice([None, float(rng.randrange(40))]) if rng.random() < 0.2 else float(rng.randrange(40)) for _ in range(rng.randrange(1, 60))] for k in range(12)}
    got = tracks_of(select.anchored(shuffled(spark, tracks, "double"), ["track"], ["ord"], "v", 9.0, 6))
    want = {t: plain_anchored(v, 9.0, 6) for t, v in tracks.items()}
    assert {t: [r["ord"] for r in rows] for t, rows in got.items()} == {t: v for t, v in want.items() if v}
    assert all(r["v"] == tracks[t][r["ord"]] for t, rows in got.items() for r in rows)


def test_pack_over_batches(spark, small_batches):
    rng = random.Random(2)
    tracks = {f"t{k}": [None if rng.random() < 0.1 else float(rng.randrange(20)) for _ in range(rng.randrange(1, 50))] for k in range(12)}
    rows = shuffled(spark, tracks, "double").withColumn("other", F.concat("track", F.col("ord").cast("string")))
    got = tracks_of(select.pack(rows, ["track"], ["ord"], "v", per=9.0, budget=70.0))
    want = {t: plain_pack(v, 9.0, 70.0, 3.0) for t, v in tracks.items()}
    assert {t: {r["ord"]: r["taken"] for r in rows} for t, rows in got.items()} == {t: v for t, v in want.items() if v}
    assert all(r["other"] == f"{t}{r['ord']}" for t, rows in got.items() for r in rows)


def test_novel_over_batches(spark, small_batches):
    rng = random.Random(3)
    tracks = {f"t{k}": [[rng.random() for _ in range(rng.choice([4, 4, 4, 5]))] for _ in range(rng.randrange(1, 60))] for k in range(8)}
    got = tracks_of(select.novel(shuffled(spark, tracks, "array<float>"), ["track"], "ord", "v", 0.3, 5))
    single = {t: [[float(np.float32(x)) for x in v] for v in vs] for t, vs in tracks.items()}
    assert {t: [r["ord"] for r in rows] for t, rows in got.items()} == {t: plain_novel(v, 0.3, 5) for t, v in single.items()}


def test_novel_leaves_unusable_vectors_out(spark):
    rows = spark.createDataFrame([("a", 0, None), ("a", 1, [1.0, None]), ("a", 2, []), ("a", 3, [1.0, 1.0]), ("a", 4, [1.0, 1.1]), ("a", 5, [3.0, 3.0])], "track string, ord long, v array<double>")
    assert [r["ord"] for r in tracks_of(select.novel(rows, ["track"], "ord", "v", 0.5))["a"]] == [3, 5]


def test_folds_of_empty_tables(spark):
    rows = spark.createDataFrame([], "track string, ord long, v double")
    assert select.anchored(rows, ["track"], ["ord"], "v", 1.0).count() == 0
    assert select.pack(rows, ["track"], ["ord"], "v", per=1.0, budget=9.0).count() == 0


def test_ids_are_numbered_over_parts(spark):
    rows = spark.range(1000).select(F.format_string("n%04d", F.col("id")).alias("name")).repartition(9)
    known = spark.createDataFrame([("UC-041",), ("other",), (None,)], "use_case_id string")
    got = entities.next_ids(rows, known, "use_case_id", "UC", ["name"])
    assert got.columns == ["name", "use_case_id"]
    assert {r["name"]: r["use_case_id"] for r in got.collect()} == {f"n{i:04d}": f"UC-{i + 42:03d}" for i in range(1000)}
    assert entities.next_ids(rows.limit(0), known, "use_case_id", "UC", ["name"]).count() == 0
