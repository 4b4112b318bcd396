"""Compositions and the streaming extension."""

import pytest
from pyspark.sql import functions as F

from chronolith.functions import rules
from chronolith.functions import text as T
from chronolith.operators import entities, reports, select, timeline, topics
from chronolith.sources import sinks
from chronolith.streaming import steps as streaming


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def test_captions_and_scripts(spark):
    caption = lambda i, s, a: one(spark, reports.step_caption(F.lit(i), F.lit(s), F.lit(a)))
    assert caption(3, "Customer Hub", "crear") == "Paso 3 · Customer Hub · crear el elemento" and caption(1, "", "raro") == "Paso 1 · raro"
    assert len(caption(1, "x" * 80, "crear")) == 64 and caption(1, "x" * 80, "crear").endswith("…")
    script = one(spark, reports.grounded_script(F.lit("CI/CD"), F.lit("Luego, algo.")))
    assert script.startswith("En esta cápsula revisamos la integración") and " Luego, algo. El procedimiento" in script
    assert one(spark, reports.topic_profile(F.lit("Foo / Bar")))["name"] == "foo y bar"
    assert one(spark, rules.act_caption(F.lit(9), F.lit("T"))) == "¿Cuál es el resultado? · T"
    assert one(spark, reports.item_seconds(F.lit(4.0), F.lit(6.0))) == 6.4 and one(spark, reports.item_seconds(F.lit(4.0), F.lit(None).cast("double"))) == 4.0
    lines = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(s).alias("score"), F.lit(t).alias("text")) for x, y, s, t in [(50, 5, 0.9, "b"), (1, 7, 0.9, "a"), (0, 40, 0.9, "c"), (0, 0, 0.1, "no")]])
    assert one(spark, T.ocr_text(lines)) == "b\na\nc"  # 7 / 12 rounds to the next row


def test_walkthroughs_prefer_specific_actions(spark):
    rows = [("t", i, float(i), ("revisar", "crear", "filtrar", "validar")[i % 4], "Panel" if i % 3 else "", "browser") for i in range(60)]
    steps = spark.createDataFrame(rows, "track string, index int, start double, action string, screen string, artifact string")
    got = reports.walkthrough_steps(steps, ["track"]).orderBy("n").collect()
    assert len(got) == 12 and {r["action"] for r in got} == {"crear", "filtrar", "validar"} and [r["n"] for r in got] == list(range(12))
    few = reports.walkthrough_steps(steps.where("index < 5"), ["track"]).orderBy("n").collect()
    assert [r["action"] for r in few] == ["revisar", "crear", "filtrar", "validar", "revisar"]
    assert few[0]["clause"] == "se revisa el detalle desplegado en la aplicación web" and few[4]["clause"] == "se observa el resultado en pantalla en Panel"


def test_discovered_use_cases(spark):
    rows = [("v", i, i * 30.0, t, "browser", 0.0, 0.0) for i, t in enumerate(["jira sprint"] * 4 + ["swagger mcp"] * 2 + ["nada"] * 3)]
    moments = spark.createDataFrame(rows, "track string, ord int, ts double, ocr_text string, artifact string, skin double, value double")
    lengths = spark.createDataFrame([("v", 270.0)], "track string, length double")
    got = [(r["slug"], r["place"], r["start"], r["end"]) for r in reports.discovered_use_cases(moments, lengths, ["track"]).orderBy("place").collect()]
    assert got == [("Que-es-un-Agente", 0, 0.0, 270.0), ("Jira-HDU-Refinamiento", 1, 0.0, 90.0)]


def test_registry_reports(spark):
    videos = spark.createDataFrame([("Demo-FrontEnd",), ("Otra-Cosa",)], "video string")
    folders = spark.createDataFrame([("FrontEnd",)], "folder string")
    found = spark.createDataFrame([("FrontEnd", 0, "MCP / Integración", "00:00:00-00:05:00", 6), ("FrontEnd", 1, "API / Mesa", "00:00:00-01:00:00", 9), ("FrontEnd", 2, "QA / Pruebas", "00:00:00-00:05:00", 5)], "folder string, ord int, topic string, interval string, mentions int")
    outputs = spark.createDataFrame([(f"{entities.OUTPUT_PREFIXES[0]}FrontEnd-QA-01-02-2026.mp4", None, "frontend-qa", 0)], "output string, topic string, slug string, ord int")
    cases = reports.open_cases(videos, folders, found, outputs)
    assert {r["topic"]: r["focus"] for r in cases.collect()} == {"MCP / Integracion": "new", "API / Mesa": "dispersed", "QA / Pruebas": "covered"}
    claims = spark.createDataFrame([("Demo-FrontEnd", f"{entities.OUTPUT_PREFIXES[0]}FrontEnd-QA-01-02-2026.mp4")], "video string, output string")
    named = topics.covered_topics(outputs, "ord")
    report = {r["video"]: r for r in reports.video_report(videos, cases, claims, named).collect()}
    assert report["Demo-FrontEnd"]["new_cases"] == ["MCP / Integracion"] and not report["Demo-FrontEnd"]["nothing_new"]
    assert report["Demo-FrontEnd"]["objective"] == ["API / Mesa", "MCP / Integracion", "QA / Pruebas"] and not report["Otra-Cosa"]["processed"]
    ids = spark.createDataFrame([("a", "EXACT_DUPLICATE", "Demo-FrontEnd"), ("b", "NEW_VIDEO", None)], "video_id string, status string, match string")
    assert {r["video_id"]: r["process"] for r in reports.may_process(ids, claims).collect()} == {"a": False, "b": True}
    files = spark.createDataFrame([(f"{entities.OUTPUT_PREFIXES[0]}Demo-Jira-01-02-2026.mp4",), ("known.mp4",)], "output string")
    new = entities.missing_outputs(spark.createDataFrame([("known.mp4",)], "output string"), files).collect()
    assert [(r["slug"], r["topic"]) for r in new] == [("Demo-Jira", "Jira / HDU")]
    rows = [("a", False, True, [], True, True), ("b", True, False, [], True, True), ("c", True, True, ["x"], True, True), ("d", True, True, [], False, True), ("e", True, True, [], True, False), ("f", True, True, [], True, True)]
    got = entities.deletable(spark.createDataFrame(rows, "n string, registered boolean, processed boolean, new_cases array<string>, present boolean, confirmed boolean")).orderBy("n")
    assert [r["decision"] for r in got.collect()] == ["BLOCKED_NOT_REGISTERED", "BLOCKED_NOT_PROCESSED", "BLOCKED_NEW_CASES", "SKIP_ABSENT", "DRY_RUN", "DELETE"]


def test_new_use_cases_or_evidence(spark):
    fields = "name string, objective string, actor string, flow string, trigger string, functionalities array<string>"
    cand = spark.createDataFrame([("c1", "alta de cliente", "o", "", "", "", []), ("c2", "otra cosa distinta", "", "", "", "", [])], f"cand_id string, {fields}")
    store = spark.createDataFrame([("UC-004", 0, "alta de cliente", "o", "", "", "", [])], f"use_case_id string, ord int, {fields}")
    matches = entities.match_use_cases(cand, store)
    new, evidence = reports.added_use_cases(cand, matches, store)
    assert [(r["cand_id"], r["use_case_id"]) for r in new.collect()] == [("c2", "UC-005")] and [(r["cand_id"], r["use_case_id"]) for r in evidence.collect()] == [("c1", "UC-004")]
    forced, none = reports.added_use_cases(cand, matches, store, force=True)
    assert forced.count() == 2 and none.count() == 0


def test_clips_and_fallbacks(spark):
    marks = spark.createDataFrame([("t", 2.0), ("t", 98.0)], "track string, ts double")
    got = select.clips(marks, "ts", F.lit(0.0), F.lit(100.0)).orderBy("ts").collect()
    assert [(round(r["start"], 3), round(r["end"], 3)) for r in got] == [(1.4, 7.4), (94.0, 100.0)]
    longer = select.lengthen(select.clips(marks, "ts", F.lit(0.0), F.lit(100.0)), ["track"], least=30.0, clip=6.0).collect()
    assert all(round(r["end"] - r["start"], 3) == 14.0 for r in longer)
    lengths = spark.createDataFrame([(60.0,), (5.0,)], "s double")
    assert [r[0] for r in lengths.select(select.clip_budget(F.col("s"))).collect()] == [8, 1]
    assert select.fallback_clips(spark.createDataFrame([("t",)], "track string"), F.lit(0.0), F.lit(130.0), 6.0).count() == 12
    clean = spark.createDataFrame([("t", 8.0), ("t", 92.0), ("t", 2.0)], "track string, at double")
    assert {r["ts"]: r["at"] for r in select.nearest_clean(marks, clean, ["track"], "ts").collect()} == {2.0: 2.0, 98.0: 92.0}
    assert [r["probe"] for r in timeline.probes(marks.limit(1), "ts").orderBy("probe").collect()] == [2.0, 4.5, 7.0, 9.5, 12.0]


def test_streaming_steps_close_as_the_next_opens(spark, tmp_path):
    folder = tmp_path / "in"
    rows = [("a", float(t), v) for t, v in enumerate([0.0, 0.5, 9.0, 9.1, 20.0, 20.0])] + [("b", 0.0, 1.0)]
    spark.createDataFrame(rows, "track string, t double, value double").coalesce(1).write.parquet(str(folder))
    stream = spark.readStream.schema("track string, t double, value double").parquet(str(folder))
    query = streaming.streaming_steps(stream).writeStream.outputMode("append").format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        got = sorted((r["track"], r["start"], r["end"], r["change"], r["activity"]) for r in spark.table("closed").collect())
    finally:
        query.stop()
    assert got == [("a", 0.0, 2.0, 0.5, 1.0), ("a", 2.0, 4.0, pytest.approx(0.1), 0.0)]


def test_theme_script_leaves_out_what_is_missing(spark):
    n = F.lit(None).cast("string")
    script = one(spark, reports.theme_script(F.lit("API Mesa"), F.lit(""), F.lit("qué."), F.lit("para."), F.lit("fin."), n, n, F.lit("")))
    assert script == f"Cápsula. Veamos primero el contexto. qué. {reports.THEME_ASKS} ¿Cómo funciona api mesa y qué gano con esto? {reports.THEME_ANSWERS} para. {reports.THEME_RESULT} fin. {reports.THEME_CLOSE}"
    assert [one(spark, rules.act_caption(F.lit(a), F.lit("T"))) for a in (-1, 0, 1, 7)] == ["¿Qué hace? · T", "¿Qué hace? · T", "¿Para qué sirve? · T", "¿Cuál es el resultado? · T"]


def test_deliverables(spark, tmp_path):
    rows = [(0, 0.0, 2.0, "hola | eco", True, False, ["A"]), (1, 61.0, 62.0, "x" * 100, False, True, []), (2, 3700.0, 3701.0, None, False, False, [])]
    segments = spark.createDataFrame(rows, "ord int, start double, end double, text string, intent boolean, question boolean, topics array<string>")
    cases = spark.createDataFrame([(1, "A", 0.0, 62.0, 3, "¿y?", "")], "n int, topic string, start double, end double, mentions int, question string, intent string")
    mapped = segments.withColumn("artifact", F.lit("code"))
    sinks.write_deliverables(str(tmp_path), segments.where("text is not null"), mapped, cases)
    lines = lambda name: [r["value"] for r in spark.read.text(f"{tmp_path}/{name}").collect()]
    assert lines("02_discovery_video") == [
        "| 00:00:00 | 00:00:02 | INTENCION | A | code | hola / eco |", f"| 00:01:01 | 00:01:02 | PREGUNTA | - | code | {'x' * 87}… |", "| 01:01:40 | 01:01:41 | · | - | code |  |",
    ]
    assert lines("04_matriz_casos_uso") == ["| 1 | A | 00:00:00–00:01:02 | 3 | ¿y? | - |"]
    assert lines("03_casos_de_uso")[0] == "## Caso 1: A" and len(lines("01_transcripcion")) > 2
    found = spark.createDataFrame([(1, "T", 0.0, 30.0, 4, "a", "b", "c")], "n int, title string, start double, end double, moments int, what string, purpose string, result string")
    assert sinks.theme_lines(found).first()["value"].split("\n\n") == ["## 1. T", "- **Tramo en el video:** 00:00:00–00:00:30 · 4 momentos", "**¿Qué hace?** a", "**¿Para qué sirve?** b", "**¿Cuál es el resultado?** c\n"]
