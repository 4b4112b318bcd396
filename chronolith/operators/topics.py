"""Topics: tagging of segments, cases with evidence, focus, coverage, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions import clock, rules


def tag_segments(segments: DataFrame, topics=rules.TOPICS) -> DataFrame:
    """Adds intent, question and topics to segments with a text."""
    text = F.col("text")
    return segments.withColumn("intent", rules.is_intent(text)).withColumn("question", rules.is_question(text)).withColumn("topics", rules.topics_of(text, topics))


def topic_cases(tagged: DataFrame, track: list[str], start: str, end: str, order: str, least: int = 2) -> DataFrame:
    """Topics of a track with ``least`` mentions: first and last moment, mentions, first question and first intent."""
    each = tagged.withColumn("topic", F.explode("topics"))
    first = lambda flag: F.coalesce(F.min_by("text", F.when(F.col(flag), F.col(order))), F.lit(""))
    cases = each.groupBy(*track, "topic").agg(
        F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("mentions"),
        first("question").alias("question"), first("intent").alias("intent"),
    )
    return cases.where(F.col("mentions") >= least)


def focus_of(mentions: Column, minutes: Column, covered: Column, *, least: int = 4, most_minutes: float = 3.0) -> Column:
    """covered, new, dispersed or weak: mentions enough and close together; without mentions they are far apart."""
    density = F.when(mentions > 0, minutes / mentions).otherwise(F.lit(999.0))
    return (
        F.when(covered, "covered").when((mentions >= least) & (density <= most_minutes), "new").when(mentions >= least, "dispersed").otherwise("weak")
    )


def covered_topics(outputs: DataFrame, order: str) -> DataFrame:
    """The first output of each topic, unclassified ones left out; outputs: output, topic (null: from the slug), slug."""
    topic = F.coalesce("topic", rules.canonical_topic(F.col("slug")))
    known = outputs.withColumn("topic", topic).where(F.col("topic").isNotNull() & (F.col("topic") != rules.UNCLASSIFIED))
    return known.groupBy("topic").agg(F.min_by("output", order).alias("output"))


def best_candidates(candidates: DataFrame, order: list[str]) -> DataFrame:
    """One candidate of each topic: most mentions, then the first by ``order``."""
    w = Window.partitionBy("topic").orderBy(F.col("mentions").desc(), *order)
    return candidates.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def present_themes(moments: DataFrame, track: list[str], clock_: str, text: str, artifact: str, value: str, themes=rules.THEMES[1:], least: int = 3) -> DataFrame:
    """Themes that ``least`` moments of a track show: slug, start, end, moments, best score.

    The themes are a few constant rules, so their scores are columns of one pass, not a join.
    """
    scores = rules.theme_scores(F.col(text), F.col(artifact), F.col(value), themes)
    shown = moments.select(*track, clock_, F.explode(scores).alias("t")).select(*track, clock_, "t.slug", "t.score")
    return shown.groupBy(*track, "slug").agg(
        F.min(clock_).alias("start"), F.max(clock_).alias("end"), F.count(F.lit(1)).alias("moments"), F.max("score").alias("score")
    ).where(F.col("moments") >= least)


def themes_of_slugs(slugs: DataFrame, text: str = "slugs", themes=rules.THEMES) -> DataFrame:
    """Themes of a comma list of slugs: any case, unknown ones left out, each at its first place."""
    table = {t[0].lower(): t[0] for t in themes}
    each = slugs.select("*", F.posexplode(F.split(text, ",")).alias("place", "__slug"))
    each = each.withColumn("slug", rules.lookup(F.lower(F.trim("__slug")), table, "")).where("slug <> ''")
    return each.groupBy(*slugs.columns, "slug").agg(F.min("place").alias("place"))


def screen_pool(moments: DataFrame, track: list[str], artifact: str = "artifact", skin: str = "skin", most_skin: float = 0.045) -> DataFrame:
    """Moments without people: of screen artifacts if the track has any, else all."""
    clean = moments.where(~has_people(artifact, skin, most_skin))
    strong = F.col(artifact).isin(*rules.DOCUMENT_ARTIFACTS)
    out = clean.withColumn("__any", F.max(strong.cast("int")).over(Window.partitionBy(*track)))
    return out.where((F.col("__any") == 0) | strong).drop("__any")


def has_people(artifact: str = "artifact", skin: str = "skin", most_skin: float = 0.045) -> Column:
    return (F.col(artifact) == "teams") | (F.col(skin) >= most_skin)


def moment_scores(moments: DataFrame, track: list[str], most_skin: float = 0.045) -> DataFrame:
    """Adds value and score: artifact weight, text, sound and scene each by the track's highest, value; people cost 95 %.

    Columns: artifact, ocr_len, audio_rms, scene_diff, skin, ocr_text. First samples' change is left out of the highest.
    """
    w = Window.partitionBy(*track)
    top = lambda c, least: F.coalesce(F.nullif(F.max(c).over(w), F.lit(0.0)), F.lit(least))
    scene = F.coalesce(F.max(F.when(F.col("scene_diff") < 255, F.col("scene_diff"))).over(w), F.lit(1.0))
    base = rules.lookup(F.col("artifact"), rules.ARTIFACT_WEIGHTS, 0.8)
    text = F.when(F.col("artifact").isin(*rules.DOCUMENT_ARTIFACTS), 0.8 * F.col("ocr_len") / top("ocr_len", 1.0)).otherwise(0.0)
    out = moments.withColumn("value", rules.value_score(F.col("ocr_text")))
    total = base + text + 0.4 * F.col("audio_rms") / top("audio_rms", 1e-9) + 0.2 * F.least("scene_diff", scene) / scene + F.col("value")
    return out.withColumn("score", F.when(F.col("skin") >= most_skin, total * 0.05).otherwise(total))


def case_minutes(interval: Column) -> Column:
    return clock.span_minutes(interval)
