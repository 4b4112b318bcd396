"""Transcripts, reports, stores and folders."""

import json

import pytest
from pyspark.sql import functions as F

from chronolith.operators import timeline
from chronolith.sources import files, sinks, transcripts


def texts(spark, *bodies):
    return spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, text string")


def test_timed_transcripts(spark):
    md = "# x\n---\n[00:00:01.500 → 00:00:04.000]\nhola  mundo\nsegunda\n[01:00:00.000 → 01:00:02.000]\nfin"
    rows = transcripts.timed_blocks(texts(spark, md), "id").orderBy("ord").collect()
    assert [(r["start"], r["end"], r["text"]) for r in rows] == [(1, 4, "hola mundo segunda"), (3600, 3602, "fin")]
    assert transcripts.timed_lines(texts(spark, md), "id").orderBy("ord").first()["text"] == "hola mundo"


def test_imported_transcripts_and_the_choice_between_them(spark):
    md = "# T\n- **Fecha**: hoy\n**Estado**: x\n## Transcripción\n[1:05] **Ana**: hola\nsin reloj\n[1:00:00] fin\n---\n"
    rows = transcripts.transcript(texts(spark, md, "[00:00:01.000 → 00:00:02.000]\nuno"), "id").orderBy("id", "ord").collect()
    assert [(r["id"], r["start"], r["speaker"], r["text"]) for r in rows] == [(0, 65, "Ana", "hola"), (0, 1, None, "sin reloj"), (0, 3600, None, "fin"), (1, 1, None, "uno")]


def test_reports_round_trip(spark):
    cases = spark.createDataFrame([(1, "CI/CD", 60.0, 125.0, 4), (2, "API / Mesa", 0.0, 30.0, 2)], "n int, topic string, start double, end double, mentions int")
    md = "# Casos\n" + "".join(r["value"] for r in sinks.case_lines(cases).orderBy("n").collect())
    got = transcripts.discovery_cases(texts(spark, md, "nada"), "id").orderBy("ord").collect()
    assert [(r["topic"], r["interval"], r["mentions"]) for r in got] == [("CI/CD", "00:01:00-00:02:05", 4), ("API / Mesa", "00:00:00-00:00:30", 2)]


def test_summaries(spark):
    md = "# Resumen (24-08): El **tema**\n## 2. Ejecutivo\nHicimos (1) la primera parte; y (2) la segunda parte.\n"
    r = transcripts.summary_context(texts(spark, md), "id").first()
    assert (r["theme"], r["points"], r["source"]) == ("El tema", ["La primera parte.", "La segunda parte."], "resumen")


def test_stores(spark, tmp_path):
    good, bad = tmp_path / "m.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"memory_version": "1.0", "videos": [{"video_id": "a", "file_name": "x.mp4", "version": 1}]}))
    bad.write_text('{"videos": [')
    store = files.read_memory(spark, str(good))
    assert store.first()["use_cases"] == [] and files.entities(store, "videos").first()["video_id"] == "a"
    with pytest.raises(Exception):
        files.read_memory(spark, str(bad)).collect()
    df = spark.range(3)
    sinks.save_version(df, str(tmp_path / "s"), 1)
    sinks.save_version(df.limit(1), str(tmp_path / "s"), 2)
    assert sinks.latest_version(spark, str(tmp_path / "s")).count() == 1
    calls = []
    make = lambda: calls.append(1) or spark.range(2)
    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "c"), {"a": 1}, make).count() == 2
    assert len(calls) == 1


def test_folders(spark, tmp_path):
    for name in ("Grabación 2026-08-26 100002.mp4", "reunion_27082026.mp4", "z.txt"):
        (tmp_path / name).write_text("x")
    found = files.with_extensions(files.listing(spark, str(tmp_path)), [".mp4"])
    dates = spark.sql("select explode(array(date'2026-08-26', date'2026-08-27', date'1999-01-01')) as date")
    got = {str(r["date"]): r["rank"] for r in files.for_dates(found, dates).collect()}
    assert got == {"2026-08-26": 0, "2026-08-27": 0}
    assert files.latest(found).count() == 1


def test_merged_timeline_and_lines(spark):
    a = spark.createDataFrame([("t", 5.0, 0, "dicho")], "track string, ts double, ord long, text string")
    rows = sinks.timeline_lines(timeline.merged_timeline(a, a)).orderBy("ts", "rank", "ord").collect()
    assert [r["value"] for r in rows] == ["**[00:00:05]** dicho", "### [00:00:05] dicho"]
    steps = spark.createDataFrame([("t", 0, 2, "a"), ("t", 1, 2, "b"), ("t", 2, 2, "c")], "track string, n int, last int, clause string")
    assert sinks.walkthrough(steps, ["track"]).first()["script"] == "Para comenzar, a. A continuación, b. Para cerrar el procedimiento, c."
    assert sinks.json_lines(spark.range(1)).first()["value"] == '{"id":0}'
    assert F is not None
