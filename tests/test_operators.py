"""Small adversarial cases, with results worked out by hand, and plain models of the sequential rules."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from chronolith.functions import clock, rules
from chronolith.functions import text as T
from chronolith.operators import entities, gate, select, timeline, topics


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def series(spark, changes, gap=1.5):
    return spark.createDataFrame([("a", i, i * gap, float(c)) for i, c in enumerate(changes)], "track string, ord long, t double, change double")


def test_steps_with_a_dead_one(spark):
    changes = [255, 0.2, 0.1, 0, 9, 0, 0, 0, 0, 0, 0, 5, 6, 0.5, 0.5]
    got = timeline.steps(series(spark, changes), ["track"], ["ord"], "t").orderBy("index").collect()
    assert [(r["start"], r["end"], round(r["activity"], 4), r["dead"]) for r in got] == [(0, 6, 0.3333, False), (6, 16.5, 0, True), (16.5, 18, 0, False), (18, 22.5, 1.0, False)]


def test_short_steps_join(spark):
    got = timeline.steps(series(spark, [255, 0.2, 0.1, 9, 9, 0.5, 0.5]), ["track"], ["ord"], "t").orderBy("index").collect()
    assert [(r["start"], r["end"]) for r in got] == [(0, 6), (6, 10.5)]


def plain_steps(changes, gap=1.5):
    steps, cur, seen = [], None, []

    def close(end):
        change, activity = max(seen, default=0.0), sum(c >= 0.18 for c in seen) / len(seen) if seen else 0.0
        dead = change < 0.4 and activity < 0.15 and end - cur >= 8.0
        if steps and end - cur < 2.5 and not steps[-1][2] and not dead:
            steps[-1][1] = end
        else:
            steps.append([cur, end, dead])

    for i, c in enumerate(changes):
        if cur is None or c >= 3.0:
            if cur is not None:
                close(i * gap)
            cur, seen = i * gap, []
        else:
            seen.append(c)
    close(len(changes) * gap)
    return steps


def test_steps_equal_a_plain_model(spark):
    rng = random.Random(5)
    tracks = {f"t{k}": [255.0] + [rng.choice([0, 0, 0, 0.1, 0.3, 1.0, 4.0, 9.0]) for _ in range(rng.randint(0, 60))] for k in range(60)}
    rows = [(k, i, i * 1.5, float(c)) for k, v in tracks.items() for i, c in enumerate(v)]
    df = timeline.steps(spark.createDataFrame(rows, "track string, ord long, t double, change double"), ["track"], ["ord"], "t")
    got = {}
    for r in df.orderBy("track", "index").collect():
        got.setdefault(r["track"], []).append([r["start"], r["end"], r["dead"]])
    assert got == {k: plain_steps(v) for k, v in tracks.items()}


def test_lag_and_anchor_differ_on_slow_drift(spark):
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([0, 4, 8, 12, 16, 20])], "track string, ord long, v double")
    lagged = timeline.scenes(timeline.change_from_previous(rows, ["track"], ["ord"], "v"), 9.0)
    assert [r["ord"] for r in lagged.collect()] == [0]
    assert sorted(r["ord"] for r in select.anchored(rows, ["track"], ["ord"], "v", 9.0).collect()) == [0, 3]


def moments(spark, times):
    return spark.createDataFrame([("a", i, float(t), float(-i)) for i, t in enumerate(times)], "track string, ord long, ts double, score double")


def test_top_with_gap(spark):
    pick = lambda times, most: sorted(r["ts"] for r in select.top_with_gap(moments(spark, times), ["track"], "ts", "score", ["ord"], gap=20.0, clip=6.0, most=most).collect())
    assert pick([50, 55, 80, 10, 100], 4) == [10, 50, 80, 100]
    assert pick([50, 55, 80, 10, 100, 61], 5) == [10, 50, 61, 80, 100]


def test_top_with_gap_equals_a_plain_model(spark):
    rng = random.Random(3)
    tracks = {f"t{k}": [rng.randint(0, 400) for _ in range(rng.randint(1, 40))] for k in range(40)}
    rows = [(k, i, float(t), float(-i)) for k, v in tracks.items() for i, t in enumerate(v)]
    df = select.top_with_gap(spark.createDataFrame(rows, "track string, ord long, ts double, score double"), ["track"], "ts", "score", ["ord"], gap=20.0, clip=6.0, most=7)
    got = {}
    for r in df.collect():
        got.setdefault(r["track"], set()).add(r["ord"])
    for k, v in tracks.items():
        chosen = []
        for gap in (20.0, 8.0):
            for i, t in enumerate(v):
                if len(chosen) < 7 and i not in chosen and all(abs(t - v[j]) >= gap for j in chosen):
                    chosen.append(i)
        assert got[k] == set(chosen)


def test_spread_and_even(spark):
    got = select.spread(moments(spark, [10, 12, 30, 45]), ["track"], "ts", [F.col("ord")], 6.0, 3)
    assert sorted(r["ts"] for r in got.collect()) == [10, 30, 45]
    ten = moments(spark, range(10))
    assert sorted(r["ts"] for r in select.even_picks(ten, ["track"], ["ord"], 4).collect()) == [0, 2, 5, 7]
    for m in range(1, 30):
        for n in (1, 3, 7):
            want = sorted({int(i * m / n) for i in range(n)}) if m > n else list(range(m))
            if m in (1, 8, 13, 29):
                assert sorted(int(r["ts"]) for r in select.even_picks(moments(spark, range(m)), ["track"], ["ord"], n).collect()) == want


def test_packing_keeps_to_the_budget(spark):
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([10, 2, 14, 14, 20])], "track string, ord long, len double")
    got = {r["ord"]: r["taken"] for r in select.pack(rows, ["track"], ["ord"], "len", per=14.0, budget=40.0).collect()}
    assert got == {0: 10.0, 2: 14.0, 3: 14.0}


def test_marks_and_clocks(spark):
    assert one(spark, clock.marks(F.lit("1:20,2:10 90 x 1:00:05"))) == [80, 130, 90, 3605]
    assert one(spark, clock.clock(F.lit(3725.9))) == "01:02:05"
    assert one(spark, clock.clock_millis(F.lit(3725.25))) == "01:02:05.250"
    assert one(spark, clock.seconds_of(F.lit("1:02:03"))) == 3723 and one(spark, clock.seconds_of(F.lit("x"))) == 0
    assert one(spark, clock.span_minutes(F.lit("00:10:00-00:22:00"))) == 12 and one(spark, clock.span_minutes(F.lit("?"))) == 0
    assert str(one(spark, clock.date_of(F.lit("24/08/2026")))) == "2026-08-24" == str(one(spark, clock.date_of(F.lit("2026-08-24"))))
    assert one(spark, clock.date_tag(clock.date_of(F.lit("2026-08-24")))) == "24-08-2026"
    assert one(spark, F.regexp_like(F.lit("reunion_26082026"), clock.date_pattern(F.to_date(F.lit("2026-08-26")))))
    with pytest.raises(Exception, match="not a date"):
        one(spark, clock.date_of(F.lit("nonsense")))


def test_chapter_count(spark):
    rows = spark.createDataFrame([(float(s),) for s in (100, 1079, 1080, 1800, 9000)], "len double")
    got = timeline.chapters(rows, "len").groupBy("len").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("end")).orderBy("len").collect()
    assert [(r["n"], r["end"]) for r in got] == [(1, 100), (1, 1079), (2, 1080), (3, 1800), (6, 9000)]


def test_focus(spark):
    rows = spark.createDataFrame([(10, 12.0), (4, 12.0), (5, 22.0), (3, 3.0), (0, 5.0)], "m int, s double")
    got = [r[0] for r in rows.select(topics.focus_of(F.col("m"), F.col("s"), F.lit(False))).collect()]
    assert got == ["new", "new", "dispersed", "weak", "weak"]


def use_case(spark, key, **fields):
    row = {"name": "", "objective": "", "actor": "", "flow": "", "trigger": "", "functionalities": []} | fields
    return spark.createDataFrame([(key, 0, *row.values())], "cand_id string, ord long, name string, objective string, actor string, flow string, trigger string, functionalities array<string>")


def test_similarity_of_use_cases(spark):
    def match(a, b):
        stored = use_case(spark, "UC-001", **b).withColumnRenamed("cand_id", "use_case_id")
        r = entities.match_use_cases(use_case(spark, "c", **a), stored).collect()[0]
        return r["status"], round(r["score"], 4)

    same = {"name": "Alta de cliente", "objective": "registrar"}
    assert match(same, same) == ("DUPLICATE", 1.0)
    assert match({"name": "Alta de cliente"}, same)[1] == 0.5385
    assert match({"name": "Alta de cliente", "functionalities": ["x"]}, same | {"functionalities": ["x", "y"]}) == ("RELATED", 0.5714)


@pytest.mark.parametrize("a,b,want", [("night", "nacht", 0.6), ("abcd", "bcda", 0.75), ("", "x", 0.0)])
def test_ratio(spark, a, b, want):
    got = one(spark, entities.ratio(F.lit(a), F.lit(b)))
    assert round(got, 2) == want == round(SequenceMatcher(None, a, b).ratio(), 2)


def test_families_and_names(spark):
    name = lambda x: one(spark, T.family(F.lit(x)))
    assert [name("Demo_v2_final.mp4"), name("Final.mp4"), name("Grabación Única-rev3.mp4")] == ["demo", "", "grabacion-unica"]
    assert one(spark, T.slug(F.lit("¿Qué es? ñandú"), "x")) == "Que-es-nandu" and one(spark, T.slug(F.lit("¿?"), "item")) == "item"
    good = ["Customer Actions Hub", "GLUON Panel", "Resumen Mensual"]
    bad = ["chat", "ndo pant", "Ctrl + C", "ArriagadaArriagada", "AAAAAAA", "Es/createy", "Teams Chat", "x"]
    assert [one(spark, T.is_screen_name(F.lit(x))) for x in good + bad] == [True] * 3 + [False] * 8
    assert one(spark, T.screen_title(F.lit("12:30\nfile\nCustomer Actions Hub\nOther Name"))) == "Customer Actions Hub"


def test_video_identity(spark):
    known = spark.createDataFrame([("h1", "demo_v1.mp4", 100.0, 1, 0), ("h2", "demo_v2.mp4", 300.0, 2, 1), ("h3", "final.mp4", 5.0, 1, 2)], "video_id string, file_name string, duration_seconds double, version int, ord long")
    rows = [("h1", "x.mp4", 1.0), ("n1", "demo_final.mp4", 102.0), ("n2", "demo.mp4", 103.0), ("n3", "demo.mp4", 0.0), ("n4", "other.mp4", 5.0), ("n5", "final.mp4", 5.0)]
    new = spark.createDataFrame(rows, "video_id string, file_name string, duration_seconds double")
    got = {r["video_id"]: (r["status"], r["match"], r["suggested_version"]) for r in entities.classify_videos(new, known).collect()}
    assert got == {
        "h1": ("EXACT_DUPLICATE", "h1", None), "n1": ("LIKELY_DUPLICATE", "h1", None), "n2": ("NEW_VERSION", "h2", 3),
        "n3": ("NEW_VERSION", "h2", 3), "n4": ("NEW_VIDEO", None, None), "n5": ("NEW_VIDEO", None, None),
    }


def test_store_updates_and_evidence(spark):
    schema = "use_case_id string, name string, version int, business_rules array<string>, evidence array<struct<video_id:string>>"
    store = spark.createDataFrame([("UC-001", "a", 1, ["r2"], []), ("UC-007", "b", 3, [], [])], schema)
    changes = spark.createDataFrame([("UC-001", "fix", None, ["r1", "r2"])], "use_case_id string, reason string, name string, business_rules array<string>")
    new, audit = entities.update_use_cases(store, changes, F.lit("2024"))
    got = {r["use_case_id"]: (r["name"], r["version"], r["business_rules"]) for r in new.collect()}
    assert got == {"UC-001": ("a", 2, ["r1", "r2"]), "UC-007": ("b", 3, [])}
    assert '"version":1' in audit.collect()[0]["previous"]
    more = spark.createDataFrame([("UC-007", 1, ("v2",)), ("UC-007", 0, ("v1",)), ("UC-009", 0, ("v3",))], "use_case_id string, ord int, item struct<video_id:string>")
    kept, lost = entities.add_evidence(store, more)
    assert {r["use_case_id"]: [e["video_id"] for e in r["evidence"]] for r in kept.collect()} == {"UC-001": [], "UC-007": ["v1", "v2"]}
    assert [r["use_case_id"] for r in lost.collect()] == ["UC-009"]
    ids = entities.next_ids(spark.createDataFrame([("x",), ("y",)], "name string"), store, "use_case_id", "UC", ["name"])
    assert sorted(r["use_case_id"] for r in ids.collect()) == ["UC-008", "UC-009"]


def test_matching_by_names(spark):
    videos = spark.createDataFrame([("Demo-FrontEnd-Flujo-Jira",), ("Demo-FrontEnd",), ("PrimerEntregable",)], "video string")
    folders = spark.createDataFrame([("FrontEnd",), ("FrontEnd-Flujo-Jira",), ("Primer-Entregable",)], "folder string")
    got = {r["video"]: r["folder"] for r in entities.token_match(videos, folders, "video", "video", "folder", "folder").collect()}
    assert got == {"Demo-FrontEnd-Flujo-Jira": "FrontEnd-Flujo-Jira", "Demo-FrontEnd": "FrontEnd", "PrimerEntregable": "Primer-Entregable"}
    outputs = spark.createDataFrame([("FrontEnd-Flujo-Jira-Temas",), ("FrontEnd-API",)], "output string")
    claims = entities.most_specific(outputs, videos, "output", "output", "video", "video")
    assert sorted(tuple(r) for r in claims.collect()) == [("FrontEnd-API", "Demo-FrontEnd"), ("FrontEnd-Flujo-Jira-Temas", "Demo-FrontEnd-Flujo-Jira")]


def test_rules(spark):
    assert one(spark, rules.canonical_topic(F.lit("rapido"))) == "API / Mesa" and one(spark, rules.canonical_topic(F.lit("zzz"))) is None
    assert one(spark, rules.matches(F.lit("ÉPICA"), "épica")) and not one(spark, rules.matches(F.lit("éapi"), r"\bapi\b"))
    sheet = one(spark, rules.artifact_of(F.lit("10,5\n20\n30 %\n$ 40\nlibre")))
    assert (sheet["artifact"], sheet["score"]) == ("excel", 1)
    assert one(spark, rules.artifact_of(F.lit("import os\nclass Foo")))["artifact"] == "code"
    assert one(spark, rules.artifact_of(F.lit(None).cast("string")))["artifact"] == "otro"
    act = lambda text, change, activity: one(spark, rules.action_of(F.lit(text), F.lit(change), F.lit(activity)))
    assert [act("Filtrar y crear", 0.0, 0.0), act("", 30.0, 0.0), act("", 7.0, 0.0), act("", 0.0, 0.2), act("", 0.0, 0.0)] == ["filtrar", "cambiar", "escribir", "interactuar", "revisar"]
    assert one(spark, rules.value_score(F.lit("Jira backlog"))) == 6.5
    assert one(spark, rules.voice_of(F.lit("MX-m"))) == "es-MX-JorgeNeural" and one(spark, rules.voice_of(F.lit(""))) == rules.DEFAULT_VOICE
    slugs = topics.themes_of_slugs(spark.createDataFrame([("x, panel-cascade,nope,PANEL-CASCADE,mcp-conexion",)], "slugs string"))
    assert [r["slug"] for r in slugs.orderBy("place").collect()] == ["Panel-Cascade", "MCP-Conexion"]


def test_gate(spark):
    rows = [("a", True, 100.0, 1280, 720, "h264", "aac", 0), ("b", True, 400.0, 640, 720, "vp9", None, 2), ("c", True, 30.0, 1280, 720, "h264", "aac", 0), ("d", False, None, None, None, None, None, None)]
    checks = spark.createDataFrame(rows, "name string, exists boolean, seconds double, width int, height int, vcodec string, acodec string, people_samples int")
    got = {r["name"]: (r["verdict"], len(r["reasons"])) for r in gate.verify(checks).collect()}
    assert got == {"a": ("PASS", 0), "b": ("FAIL", 5), "c": ("WARN", 1), "d": ("FAIL", 1)}
    total = gate.overall(gate.verify(checks)).collect()[0]
    assert (total["verdict"], total["n_pass"], total["n_warn"], total["n_fail"]) == ("FAIL", 1, 1, 2)


def test_phrases_and_sections(spark):
    md = "# Reunion (x): El *tema* real\n## 1. A\nno\n## 2. Resumen\n(1) primero hecho; y (2) segundo hecho.\n## 3. C\n"
    assert one(spark, T.enumerated(T.section(F.lit(md), 2))) == ["Primero hecho.", "Segundo hecho."]
    assert one(spark, T.clean_markdown(F.lit("**a** [b](c) , d"))) == "a, d"
    long = "palabra " * 40
    assert len(one(spark, T.phrase(F.lit(long)))) <= 166 and one(spark, T.phrase(F.lit(""))) == ""


def test_nothing_from_nothing(spark):
    empty = series(spark, [1]).where("false")
    assert timeline.steps(empty, ["track"], ["ord"], "t").count() == 0
    none = moments(spark, [1]).where("false")
    assert select.top_with_gap(none, ["track"], "ts", "score", ["ord"]).count() == 0
    assert select.even_picks(none, ["track"], ["ord"], 3).count() == 0
    assert gate.overall(spark.createDataFrame([], "verdict string")).collect()[0]["verdict"] == "PASS"
