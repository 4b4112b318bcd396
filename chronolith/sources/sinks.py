"""Results as files: stores with a version each, manifests, reports as rows of text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import clock as C
from chronolith.functions import rules

#: How seconds are shown: C.clock, whose hours go on after a day, or C.time_of_day.
Clock = Callable[[Column], Column]


def save_version(df: DataFrame, folder: str, version: int) -> str:
    """Write a new version beside the old ones; a path that is being read is never written over."""
    path = f"{folder.rstrip('/')}/v={version:06d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def latest_version(spark: SparkSession, folder: str) -> DataFrame:
    """The version written last, by its number."""
    versions = spark.read.parquet(folder)
    return versions.where(F.col("v") == versions.agg(F.max("v")).collect()[0][0]).drop("v")


def save_json(df: DataFrame, path: str, stamp: Column | None = None) -> None:
    out = df if stamp is None else df.withColumn("actualizado", stamp)
    out.write.mode("overwrite").json(path)


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_report(lines: DataFrame, path: str, order: list[str]) -> None:
    """Rows of text in order; one file for each part of the range of the order."""
    lines.sort(*order).select("value").write.mode("overwrite").text(path)


def step_lines(steps: DataFrame, clock: Clock = C.clock) -> DataFrame:
    """A readable table row for each step: columns ``value``, and index to order by."""
    state = F.when(F.col("dead"), "espera").otherwise("útil")
    return steps.select("index", F.format_string("| %d | %s | %s | %.1f | %.4f | %s |", "index", clock(F.col("start")), clock(F.col("end")), F.col("change"), F.col("activity"), state).alias("value"))


def transcript_lines(segments: DataFrame) -> DataFrame:
    stamp = F.concat(F.lit("["), C.clock_millis(F.col("start")), F.lit(" → "), C.clock_millis(F.col("end")), F.lit("]\n"))
    return segments.select("ord", F.concat(stamp, "text", F.lit("\n")).alias("value"))


def case_lines(cases: DataFrame) -> DataFrame:
    """Discovery cases as blocks that the discovery source reads again; columns n (from 1) and value."""
    interval = F.concat(C.clock(F.col("start")), F.lit("-"), C.clock(F.col("end")))
    value = F.concat(F.lit("## Caso "), F.col("n").cast("string"), F.lit(": "), "topic", F.lit("\n- **Tramo:** "), interval, F.lit("\n- **menciones:** "), F.col("mentions").cast("string"), F.lit("\n"))
    return cases.select("n", value.alias("value"))


def _cell(text: Column) -> Column:
    """A text inside a row of a table."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("/"))


def _span(clock: Clock = C.clock) -> Column:
    return F.concat(clock(F.col("start")), F.lit("–"), clock(F.col("end")))


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]), F.lit(" |"))


def rundown_lines(parts: DataFrame, clock: Clock = C.clock) -> DataFrame:
    """A table row for each part of a cut: its number, origin, seconds (halves to even) and caption; columns n and value."""
    seconds = F.concat(F.bround(F.col("end") - F.col("start")).cast("long").cast("string"), F.lit("s"))
    return parts.select("n", _row(F.col("n"), _span(clock), seconds, F.col("caption")).alias("value"))


def map_lines(mapped: DataFrame, track: tuple[str, ...] = (), most: int = 90) -> DataFrame:
    """A table row for each segment of a temporal map: interval, mark, topics, artifact, text cut to ``most``; track, ord, value."""
    mark = F.when(F.col("question"), "PREGUNTA").when(F.col("intent"), "INTENCION").otherwise("·")
    names = F.when(F.size("topics") > 0, F.array_join("topics", ", ")).otherwise("-")
    text = _cell(F.col("text"))
    text = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("…"))).otherwise(text)
    return mapped.select(*track, "ord", _row(C.clock(F.col("start")), C.clock(F.col("end")), mark, names, F.coalesce("artifact", F.lit("-")), text).alias("value"))


def matrix_lines(cases: DataFrame, track: tuple[str, ...] = (), most: int = 60) -> DataFrame:
    """A table row for each case: number, topic, interval, mentions, question and intent cut to ``most``; track, n, value."""
    said = lambda c: F.substring(_cell(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))), 1, most)
    return cases.select(*track, "n", _row(F.col("n"), F.col("topic"), _span(), F.col("mentions"), said("question"), said("intent")).alias("value"))


def theme_lines(found: DataFrame) -> DataFrame:
    """A block for each use case of the catalogue: interval, moments, and what, what for and with which result."""
    part = lambda head, c: F.concat(F.lit(f"**{head}** "), F.coalesce(c, F.lit("")))
    head = F.concat(F.lit("## "), F.col("n").cast("string"), F.lit(". "), "title")
    where = F.concat(F.lit("- **Tramo en el video:** "), _span(), F.lit(" · "), F.col("moments").cast("string"), F.lit(" momentos"))
    blocks = [head, where, part("¿Qué hace?", F.col("what")), part("¿Para qué sirve?", F.col("purpose")), part("¿Cuál es el resultado?", F.col("result"))]
    return found.select("n", F.concat(F.concat_ws("\n\n", *blocks), F.lit("\n")).alias("value"))


def write_deliverables(folder: str, segments: DataFrame, mapped: DataFrame, cases: DataFrame) -> None:
    """The four results of the discovery of a recording: transcript, temporal map, cases, matrix of cases.

    segments: ord, start, end, text; mapped: of temporal_map, or all segments with artifact; cases: n, topic, start, end,
    mentions, question, intent.
    """
    for name, lines, order in (
        ("01_transcripcion", transcript_lines(segments), "ord"), ("02_discovery_video", map_lines(mapped), "ord"),
        ("03_casos_de_uso", case_lines(cases), "n"), ("04_matriz_casos_uso", matrix_lines(cases), "n"),
    ):
        write_report(lines, f"{folder.rstrip('/')}/{name}", [order])


def timeline_lines(merged: DataFrame, clock: Clock = C.clock) -> DataFrame:
    head = F.concat(F.lit("["), clock(F.col("ts")), F.lit("]"))
    value = F.when(F.col("source") == "audio", F.concat(F.lit("**"), head, F.lit("** "), "text")).otherwise(F.concat(F.lit("### "), head, F.lit(" "), "text"))
    return merged.select("ts", "rank", "ord", value.alias("value"))


def walkthrough(steps: DataFrame, track: list[str]) -> DataFrame:
    """One text for each track: a sentence a step, with connectors and turns of phrase; steps: n (from 0), last, clause."""
    connector = F.coalesce(F.get(F.array(*map(F.lit, rules.CONNECTORS)), F.col("n")), F.lit(rules.LATER_CONNECTOR))
    connector = F.when((F.col("n") == F.col("last")) & (F.col("last") > 0), rules.LAST_CONNECTOR).otherwise(connector)
    sentence = F.concat(connector, F.lit(", "), "clause", F.lit("."))
    return steps.withColumn("s", F.struct("n", sentence.alias("t"))).groupBy(*track).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]), " ").alias("script"))
