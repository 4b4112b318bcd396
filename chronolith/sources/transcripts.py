"""Semi-structured texts as tables: transcripts, discovery reports, summaries. Input: a key column and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions import clock as C
from chronolith.functions import text as T

_TIME = r"\d{2}:\d{2}:\d{2}\.\d{3}"


def _timed(texts: DataFrame, key: str, body: str) -> DataFrame:
    pattern = rf"(?s)\[({_TIME})\s*→\s*({_TIME})\]\s*\n({body})"
    groups = [F.regexp_extract_all("text", F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    rows = texts.select(key, F.posexplode(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("a", "b", "t"), strict=True)])).alias("ord", "s"))
    return rows.select(key, "ord", C.seconds_of(F.substring("s.a", 1, 8)).alias("start"), C.seconds_of(F.substring("s.b", 1, 8)).alias("end"), F.array_join(T.words(F.col("s.t")), " ").alias("text"))


def timed_lines(texts: DataFrame, key: str) -> DataFrame:
    """Segments ``[H:M:S.mmm → H:M:S.mmm]`` with one line each: key, ord, start, end, text; fractions are cut off."""
    return _timed(texts, key, r"[^\n]+")


def timed_blocks(texts: DataFrame, key: str) -> DataFrame:
    """The same with bodies of several lines, up to the next ``[`` at the head of a line."""
    return _timed(texts, key, r".+?(?=\n\[|\z)").where("text <> ''")


def imported_lines(texts: DataFrame, key: str) -> DataFrame:
    """Segments ``[m:ss] **Speaker**: text``, time and speaker optional; headings and metadata are skipped.

    key, ord, start, end, text, speaker. Without a time, the number of the segment is its clock.
    """
    body = F.coalesce(F.regexp_extract("text", r"(?s)^.*?## Transcripci[oó]n(.*)$", 1), F.lit(""))
    body = F.when(F.col("text").rlike(r"## Transcripci[oó]n"), body).otherwise(F.col("text"))
    lines = texts.select(key, F.posexplode(F.split(body, r"\R")).alias("line", "raw")).withColumn("raw", F.trim("raw"))
    skip = (F.col("raw") == "") | F.col("raw").rlike(r"^(#|---|\*\*Estado\*\*|\*Generado)") | F.col("raw").rlike(r"^-\s+\*\*[^*]+\*\*\s*:")
    pattern = r"^(?:\[(\d{1,2}:\d{2}(?::\d{2})?)\]\s*)?(?:\*\*([^*]{1,60})\*\*:\s*)?(.+?)\s*$"
    got = lines.where(~skip).select(key, "line", *[F.regexp_extract("raw", pattern, i).alias(n) for i, n in ((1, "t"), (2, "sp"), (3, "txt"))]).where("trim(txt) <> ''")
    number = F.row_number().over(Window.partitionBy(key).orderBy("line")) - 1
    got = got.withColumn("ord", number).withColumn("start", F.when(F.col("t") != "", C.seconds_of(F.col("t"))).otherwise(F.col("ord").cast("double")))
    return got.select(key, "ord", "start", F.col("start").alias("end"), F.array_join(T.words(F.col("txt")), " ").alias("text"), F.nullif(F.trim("sp"), F.lit("")).alias("speaker"))


def transcript(texts: DataFrame, key: str) -> DataFrame:
    """Timed blocks of each text, or, for a text without any, its imported lines."""
    timed = timed_blocks(texts, key).withColumn("speaker", F.lit(None).cast("string"))
    rest = texts.where(~F.col("text").rlike(rf"(?s)\[{_TIME}\s*→\s*{_TIME}\]\s*\n."))
    return timed.unionByName(imported_lines(rest, key))


def discovery_cases(texts: DataFrame, key: str, look: int = 400) -> DataFrame:
    """Cases of discovery reports: key, ord, topic, interval, mentions, from ``look`` characters after each heading."""
    blocks = F.split("text", r"(?=## Caso \d+:)")
    rows = texts.select(key, F.posexplode(blocks).alias("n", "block")).where(F.col("block").rlike(r"^## Caso \d+:\s*\S"))
    head = F.regexp_extract("block", r"^(## Caso \d+:\s*[^\n]+)", 1)
    tail = F.substring(F.col("block"), F.length(head) + 1, F.lit(look))
    interval = F.regexp_extract(tail, r"\*\*Tramo:\*\*\s*([\d:]+[–-][\d:]+)", 1)
    mentions = F.regexp_extract(tail, r"\*\*menciones:\*\*\s*(\d+)", 1).try_cast("int")
    out = rows.select(
        key, (F.row_number().over(Window.partitionBy(key).orderBy("n")) - 1).alias("ord"),
        F.trim(F.regexp_extract("block", r"^## Caso \d+:\s*([^\n]+)", 1)).alias("topic"),
        F.when(interval != "", interval).otherwise("?").alias("interval"), F.coalesce(mentions, F.lit(0)).alias("mentions"),
    )
    return out


def summary_context(texts: DataFrame, key: str) -> DataFrame:
    """Theme and up to three points of summary documents: the title, and the facts or first sentences of section 2."""
    title = F.regexp_extract("text", r"(?m)^#\s+([^\n]+)$", 1)
    after = F.when(title.contains("):"), F.expr("substring(title, locate('):', title) + 2)")).otherwise(F.col("title"))
    out = texts.withColumn("title", title).withColumn("theme", T.clean_markdown(after)).withColumn("block", T.section(F.col("text"), 2))
    sentences = F.split(T.clean_markdown(F.col("block")), r"(?<=[.])\s+")
    spoken = F.transform(F.filter(F.slice(sentences, 1, 3), lambda s: F.length(s) > 30), lambda s: T.phrase(s))
    facts = T.enumerated(F.col("block"))
    points = F.slice(F.when(F.size(facts) > 0, facts).otherwise(spoken), 1, 3)
    out = out.withColumn("points", points)
    source = F.when((F.col("theme") != "") | (F.size("points") > 0), "resumen").otherwise("generico")
    return out.select(key, "theme", "points", source.alias("source"))
