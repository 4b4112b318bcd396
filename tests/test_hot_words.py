"""Name matching where words are in half of all names, against plain models."""

import random

import pytest

from chronolith.functions import text as T
from chronolith.operators import entities, timeline
from pyspark.sql import functions as F


def names(rng, n):
    words = ["north", "river", "stone", "table", "garden", "market", "window", "silver"]
    return [" ".join(rng.sample(["common", "usual"], rng.randint(0, 2)) + rng.sample(words, rng.randint(0, 3))) for _ in range(n)]


@pytest.mark.parametrize("hot", [1_000, 3])
def test_best_and_strictest_names(spark, monkeypatch, hot):
    monkeypatch.setattr(entities, "HOT", hot)
    rng = random.Random(hot)
    left, right = names(rng, 80), names(rng, 70)
    make = lambda some: spark.createDataFrame(list(enumerate(some)), "id long, name string")
    parts = lambda some: {r["id"]: (set(r["t"]), r["c"]) for r in make(some).select("id", T.tokens(F.col("name")).alias("t"), T.compact(F.col("name")).alias("c")).collect()}
    l, r = parts(left), parts(right)
    want = {}
    for i, (lt, lc) in l.items():
        scored = [(-(len(lt & rt) + (len(rt) if rt <= lt else 0) + (10 if lc and lc == rc else 0)), j) for j, (rt, rc) in r.items() if rt]
        best = min((s for s in scored if s[0] < 0), default=None)
        if best:
            want[i] = (best[1], -best[0])
    a, b = make(left).toDF("lid", "ln"), make(right).toDF("rid", "rn")
    got = {x["lid"]: (x["rid"], x["score"]) for x in entities.token_match(a, b, "lid", "ln", "rid", "rn").collect()}
    assert got == want
    claims = {i: {j for j, (rt, _) in r.items() if rt and rt <= lt} for i, (lt, _) in l.items()}
    strict = {(i, j) for i, own in claims.items() for j in own if not any(r[j][0] < r[k][0] for k in own)}
    assert {(x["lid"], x["rid"]) for x in entities.most_specific(a, b, "lid", "ln", "rid", "rn").collect()} == strict


def test_probes_see_the_next_sample(spark):
    samples = spark.createDataFrame([("a", 0.0, 1, 5.0), ("a", 4.0, 2, 1.0), ("a", 4.0, 3, 9.0), ("a", 7.0, 4, None), ("b", 1.0, 5, 2.0)], "k string, t double, id long, v double")
    windows = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("a", 5.0), ("a", 8.0), ("b", 0.0), ("c", 0.0)], "k string, s double")
    got = {(r["k"], r["s"]): r["most"] for r in timeline.most_at_probes(windows, samples, ["k"], "s", "t", "id", "v", length=4.0, n=3).collect()}
    assert got == {("a", 1.0): 1.0, ("a", 0.0): 5.0, ("a", 5.0): None, ("a", 8.0): None, ("b", 0.0): 2.0, ("c", 0.0): None}


def test_lengths_of_one_family(spark):
    """Lengths beside the ends of bands, below one, repeated and odd ones: all pairs decide, and no pairs are made."""
    rng = random.Random(2)
    lengths = [0.0, None, float("nan"), float("inf"), -3.0, -1e300, 0.02, 1e-9, 0.98, 1.0, 1.02, 100.0, 102.0, 100 / 1.02, 102.0408163265306]
    lengths += [round(rng.uniform(0, 3), 2) for _ in range(60)] + [round(90 * 1.3 ** rng.uniform(0, 3), 1) for _ in range(120)]
    places = list(range(len(lengths)))
    rng.shuffle(places)
    known = [(f"k{o}", "a.mp4", d, 1, o) for o, d in zip(places, lengths, strict=True)]
    asked = lengths + [x for d in lengths[11:] for x in (d * 1.02, d / 1.02, d * 0.98)]
    schema = "video_id string, file_name string, duration_seconds double"
    store, new = spark.createDataFrame(known, schema + ", version int, ord long"), spark.createDataFrame([(f"n{i}", "a.mp4", d) for i, d in enumerate(asked)], schema)
    some = [(d, o) for _, _, d, _, o in known if d]
    for band in (0.02, 0.3, 0.0, 0.7):
        got = {r["video_id"]: r["match"] for r in entities.classify_videos(new, store, band=band).collect() if r["status"] == "LIKELY_DUPLICATE"}
        first = {f"n{i}": min((o for s, o in some if x and abs(s - x) / max(s, 1.0) <= band), default=None) for i, x in enumerate(asked)}
        assert got == {k: f"k{o}" for k, o in first.items() if o is not None}


def joined_rows(plan):
    """The rows that came out of all joins of a plan that has run."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return joined_rows(plan.executedPlan())
    if name.endswith("QueryStage"):
        return joined_rows(plan.plan())
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().apply("numOutputRows").value() if name.endswith("Join") else 0
    return own + sum(map(joined_rows, below))


def test_a_family_of_many_lengths(spark):
    """3,000 known and as many new lengths of a family, all in the band of each other: 9,000,000 pairs, and none is made."""
    known = spark.range(3_000).select(F.concat(F.lit("k"), "id").alias("video_id"), F.format_string("a_v%d.mp4", "id").alias("file_name"), (1000 + F.col("id") / 1e4).alias("duration_seconds"), F.lit(1).alias("version"), (-F.col("id")).alias("ord"))
    out = entities.classify_videos(known.select(F.concat(F.lit("n"), "video_id").alias("video_id"), "file_name", "duration_seconds"), known)
    rows = out.collect()
    assert len(rows) == 3_000 and {(r["status"], r["match"]) for r in rows} == {("LIKELY_DUPLICATE", "k2999")}
    assert 9_000 <= joined_rows(out._jdf.queryExecution().executedPlan()) < 60_000


def test_claims_send_no_names_to_the_driver(spark):
    """Rows of words are many times a file's size: no join may broadcast them, however small the file is thought to be."""
    some = spark.range(300).select("id", F.concat(F.lit("common w"), F.col("id") % 40, F.lit(" x"), F.col("id") % 7).alias("name"))
    out = entities.most_specific(some.toDF("lid", "ln"), some.where("id < 40").toDF("rid", "rn"), "lid", "ln", "rid", "rn")
    assert out.count() == 60
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
