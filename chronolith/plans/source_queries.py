"""Registered queries of the parsers, clocks and small text functions: texts are composed of driver tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.functions import clock as C
from chronolith.functions import rules
from chronolith.functions import text as T
from chronolith.operators import entities, gate, reports, timeline, topics
from chronolith.sources import transcripts

from .catalog import register
from .common import SAMPLES_SQL, samples, table


def _said(spark, sf_dir):
    """Turns of conversations with their words by single spaces, numbered, from 0, among those of a conversation that have any."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array_join(T.words(F.col("text")), " ").alias("words"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "words")) - 1
    return c.where("words <> ''").withColumn("ord", number).withColumn("start", F.col("ord") * 30.0)


_SAID = r"""WITH w AS (SELECT conv_id, turn, role, array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''), ' ') AS words FROM conversations),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, words) - 1 AS ord FROM w WHERE words <> '')"""
_SPAN = 'CAST(ord * 30 AS DOUBLE) AS start, CAST(ord * 30 + 25 AS DOUBLE) AS "end"'


def _composed(rows, line):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("conv_id").agg(F.concat(F.lit("Cabecera\n---\n"), F.array_join(lines, "\n")).alias("text"))


def _stamp():
    return F.concat(F.lit("["), C.clock_millis(F.col("start") + 0.25), F.lit(" → "), C.clock_millis(F.col("start") + 25.5), F.lit("]\n"))


@register("timed_lines", f"{_SAID} SELECT conv_id, CAST(ord AS INTEGER) AS ord, {_SPAN}, words AS text FROM s")
def timed_lines(spark, sf_dir):
    return transcripts.timed_lines(_composed(_said(spark, sf_dir), F.concat(_stamp(), "words")), "conv_id")


@register("timed_blocks", f"{_SAID} SELECT conv_id, CAST(ord AS INTEGER) AS ord, {_SPAN}, words AS text FROM s")
def timed_blocks(spark, sf_dir):
    broken = F.regexp_replace("words", " ([a-z])", "\n$1")
    return transcripts.timed_blocks(_composed(_said(spark, sf_dir), F.concat(_stamp(), broken)), "conv_id")


@register("imported_lines", f"{_SAID} SELECT conv_id, CAST(ord AS INTEGER) AS ord, CAST(ord * 30 AS DOUBLE) AS start, CAST(ord * 30 AS DOUBLE) AS \"end\", words AS text, role AS speaker FROM s")
def imported_lines(spark, sf_dir):
    minute = F.format_string("[%d:%02d] **", F.floor(F.col("start") / 60), F.col("start").cast("long") % 60)
    texts = _composed(_said(spark, sf_dir), F.concat(minute, "role", F.lit("**: "), "words"))
    return transcripts.imported_lines(texts.withColumn("text", F.concat(F.lit("# T\n**Estado** x\n## Transcripción\n- **a**: b\n"), F.substring_index("text", "---\n", -1))), "conv_id")


@register("transcripts", f"{_SAID} SELECT conv_id, CAST(ord AS INTEGER) AS ord, CASE WHEN conv_id % 2 = 0 THEN role END AS speaker, words AS text FROM s")
def transcript(spark, sf_dir):
    said = _said(spark, sf_dir)
    timed = _composed(said.where("conv_id % 2 <> 0"), F.concat(_stamp(), "words"))
    spoken = _composed(said.where("conv_id % 2 = 0"), F.concat(F.lit("**"), "role", F.lit("**: "), "words"))
    spoken = spoken.withColumn("text", F.concat(F.lit("## Transcripcion\n"), F.substring_index("text", "---\n", -1)))
    return transcripts.transcript(timed.union(spoken), "conv_id").select("conv_id", F.col("ord").cast("int").alias("ord"), "speaker", "text")


@register("discovery_cases", """WITH g AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY lang) - 1 AS INTEGER) AS ord, lang AS topic,
  CASE WHEN n % 3 = 0 THEN '?' ELSE '0:00:10–0:' || lpad(CAST(n % 60 AS VARCHAR), 2, '0') || ':00' END AS "interval", CASE WHEN n % 5 = 0 THEN 0 ELSE CAST(n AS INTEGER) END AS mentions FROM g""")
def discovery_cases(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    span = F.when(F.col("n") % 3 != 0, F.format_string("**Tramo:** 0:00:10–0:%02d:00\n", F.col("n") % 60)).otherwise("")
    count = F.when(F.col("n") % 5 != 0, F.format_string("**menciones:** %d\n", "n")).otherwise("")
    case = F.struct("lang", F.concat(F.col("lang"), F.lit("\n"), span, count).alias("body"))
    bodies = F.transform(F.array_sort(F.collect_list(case)), lambda x, i: F.concat(F.lit("## Caso "), (i + 1).cast("string"), F.lit(": "), x["body"]))
    found = transcripts.discovery_cases(g.groupBy("source").agg(F.concat(F.lit("# Informe\n"), F.array_join(bodies, "\n")).alias("text")), "source")
    return found.withColumn("ord", F.col("ord").cast("int"))


@register("summary_context", """SELECT doc_id, 'Notas de ' || lang || ' y mas' AS theme,
  CASE WHEN n_chars % 2 = 0 THEN 'Idioma ' || lang || '.|Signos ' || CAST(n_chars AS VARCHAR) || '.' ELSE 'El texto tiene signos y renglones en total ' || CAST(n_chars AS VARCHAR) || '.' END AS points, 'resumen' AS source FROM documents""")
def summary_context(spark, sf_dir):
    n = F.col("n_chars").cast("string")
    facts = F.concat(F.lit("(1) idioma **"), "lang", F.lit("**; y (2) y signos "), n, F.lit(","))
    plain = F.concat(F.lit("El texto tiene *signos* y renglones en total "), n, F.lit(". Corto."))
    text = F.concat(F.lit("# Resumen (doc): Notas de _"), "lang", F.lit("_ y mas\n## 1. Uno\nnada\n## 2. Dos\n"), F.when(F.col("n_chars") % 2 == 0, facts).otherwise(plain), F.lit("\n## 3. Tres\nfin"))
    d = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return transcripts.summary_context(d, "doc_id").withColumn("points", F.array_join("points", "|"))


@register("sections", "SELECT doc_id, '\nsobre ' || lang || '\n' AS body, '' AS missing FROM documents")
def sections(spark, sf_dir):
    text = F.concat(F.lit("# A\n## 1. x\nuno\n## 2. y\nsobre "), "lang", F.lit("\n## 3. z\ntres"))
    return table(spark, sf_dir, "documents").select("doc_id", T.section(text, 2).alias("body"), T.section(text, 7).alias("missing"))


@register("sampled", f"""WITH s AS ({SAMPLES_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, ceil(t / 24.0) ORDER BY t, event_id) AS n FROM s)
SELECT user_id, event_id, t FROM r WHERE n = 1""")
def sampled(spark, sf_dir):
    # A struct of time and id as clock would not divide; equal times of a user don't occur in events.
    return timeline.sampled(samples(spark, sf_dir).select("user_id", "event_id", "t"), ["user_id"], "t", 24.0)


@register("sampling_steps", "SELECT o_orderkey, greatest(1.5, o_totalprice / 120) AS step FROM orders")
def sampling_steps(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", timeline.sampling_step(F.col("o_totalprice"), 1.5).alias("step"))


@register("marks", "SELECT l_orderkey, l_linenumber, CAST(l_suppkey % 60 * 60 + l_partkey % 60 AS DOUBLE) AS first, CAST(l_orderkey AS DOUBLE) AS second, CAST(3600 * l_linenumber + 65 AS DOUBLE) AS third, CAST(3 AS INTEGER) AS n FROM lineitem")
def marks(spark, sf_dir):
    text = F.concat(F.format_string("%d:%02d, ", F.col("l_suppkey") % 60, F.col("l_partkey") % 60), F.col("l_orderkey").cast("string"), F.lit(" nada,"), F.format_string("%d:01:05", "l_linenumber"))
    m = C.marks(text)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", m[0].alias("first"), m[1].alias("second"), m[2].alias("third"), F.size(m).alias("n"))


@register("clock_seconds", "SELECT l_orderkey, l_linenumber, CAST(l_partkey % 50 * 3600 + l_suppkey % 60 * 60 + 7 AS DOUBLE) AS long_clock, CAST(l_partkey % 50 * 60 + 9 AS DOUBLE) AS short_clock, CAST(0 AS DOUBLE) AS no_clock, CAST(l_linenumber AS DOUBLE) AS minutes FROM lineitem")
def clock_seconds(spark, sf_dir):
    hours, minutes = F.col("l_partkey") % 50, F.col("l_suppkey") % 60
    span = F.format_string("00:00:05–00:%02d:05", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", C.seconds_of(F.format_string("%d:%02d:07", hours, minutes)).alias("long_clock"), C.seconds_of(F.format_string("%d:09", hours)).alias("short_clock"),
        C.seconds_of(F.lit("1:2:3:4")).alias("no_clock"), C.span_minutes(span).alias("minutes"),
    )


@register("clock_millis", "SELECT l_orderkey, l_linenumber, strftime(make_timestamp(CAST(l_quantity * 1000000 + l_partkey % 1000 * 1000 AS BIGINT)), '%H:%M:%S.%g') AS at FROM lineitem")
def clock_millis(spark, sf_dir):
    at = F.col("l_quantity") + (F.col("l_partkey") % 1000) / 1000.0
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.clock_millis(at).alias("at"))


@register("date_strings", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS day_first, strftime(o_orderdate, '%d-%m-%Y') AS tag, '2020-02-02' AS today, true AS in_name, true AS in_other_name, false AS in_no_name FROM orders""")
def date_strings(spark, sf_dir):
    day, fixed = F.col("o_orderdate"), F.lit("2020-02-02").cast("date")
    pattern = C.date_pattern(day.cast("date"))
    name = lambda p: F.concat(F.lit("toma "), F.date_format(day, p), F.lit(" b.mp4"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", C.date_of(F.date_format(day, "yyyy-MM-dd"), fixed).cast("string").alias("iso"), C.date_of(F.date_format(day, "dd/MM/yyyy"), fixed).cast("string").alias("day_first"), C.date_tag(day).alias("tag"),
        C.date_of(F.lit(" Hoy "), fixed).cast("string").alias("today"), F.regexp_like(name("yyyy_MM_dd"), pattern).alias("in_name"), F.regexp_like(name("ddMMyyyy"), pattern).alias("in_other_name"), F.regexp_like(F.lit("toma"), pattern).alias("in_no_name"),
    )


@register("cut_texts", "SELECT doc_id, CASE WHEN length(text) > 30 THEN regexp_replace(substr(text, 1, 29), ' +$', '') || '…' ELSE text END AS short FROM documents")
def cut_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.cut_off(F.col("text"), 30).alias("short"))


@register("voices", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'es-MX-JorgeNeural' WHEN c_custkey % 4 = 1 THEN 'es-CL-CatalinaNeural' WHEN c_custkey % 4 = 2 THEN c_name ELSE 'es-MX-DaliaNeural' END AS voice FROM customer")
def voices(spark, sf_dir):
    k = F.col("c_custkey") % 4
    alias = F.when(k == 0, "MX-m").when(k == 1, "cl").when(k == 2, F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", rules.voice_of(alias).alias("voice"))


@register("act_captions", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '¿Qué hace?' WHEN p_size % 5 = 1 THEN '¿Para qué sirve?' ELSE '¿Cuál es el resultado?' END || ' · ' || p_name AS caption FROM part")
def act_captions(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", rules.act_caption((F.col("p_size") % 5).cast("int"), F.col("p_name")).alias("caption"))


@register("step_captions", """WITH c AS (SELECT l_orderkey, l_linenumber, 'Paso ' || CAST(l_linenumber AS VARCHAR) || CASE WHEN l_linenumber % 2 = 0 THEN ' · ' || p_name || ' ' || p_type ELSE '' END || ' · ' || CASE WHEN l_linenumber % 3 = 0 THEN 'aplicar filtros' ELSE p_brand END AS c
  FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, l_linenumber, CASE WHEN length(c) > 40 THEN regexp_replace(substr(c, 1, 39), '[ ·]+$', '') || '…' ELSE c END AS caption FROM c""")
def step_captions(spark, sf_dir):
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n = F.col("l_linenumber")
    screen, action = F.when(n % 2 == 0, F.concat_ws(" ", "p_name", "p_type")), F.when(n % 3 == 0, "filtrar").otherwise(F.col("p_brand"))
    return both.select("l_orderkey", "l_linenumber", reports.step_caption(n, screen, action, 40).alias("caption"))


@register("item_seconds", "SELECT l_orderkey, l_linenumber, greatest(l_quantity / 10, CASE WHEN l_discount > 0 THEN l_discount * 50 + 0.4 ELSE 0 END) AS seconds FROM lineitem")
def item_seconds(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", reports.item_seconds(F.col("l_quantity") / 10, F.col("l_discount") * 50).alias("seconds"))


@register("skin_colours", """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey % 256 AS r, l_suppkey * 7 % 256 AS g, l_orderkey % 256 AS b FROM lineitem),
k AS (SELECT *, r > 95 AND g > 40 AND b > 20 AND abs(r - g) > 15 AND r > g AND r > b AS base FROM c)
SELECT l_orderkey, l_linenumber, base AND greatest(r, g, b) - least(r, g, b) > 15 AS wide, base AND r - b > 15 AS strict FROM k""")
def skin_colours(spark, sf_dir):
    r, g, b = F.col("l_partkey") % 256, F.col("l_suppkey") * 7 % 256, F.col("l_orderkey") % 256
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", gate.is_skin(r, g, b).alias("wide"), gate.is_skin(r, g, b, True).alias("strict"))


@register("ocr_lines", r"""WITH l AS (SELECT l_orderkey, CAST(round_even(l_extendedprice / 100 / 12, 0) AS BIGINT) AS band, l_quantity AS x, l_linenumber, l_returnflag || CAST(l_linenumber AS VARCHAR) AS t FROM lineitem WHERE l_discount >= 0.03)
SELECT l_orderkey, string_agg(t, chr(10) ORDER BY band, x, t) AS text FROM l GROUP BY 1""")
def ocr_lines(spark, sf_dir):
    line = F.struct(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 100).alias("y"), F.col("l_discount").alias("score"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"))
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    return pages.select("l_orderkey", T.ocr_text(F.col("lines"), 0.03).alias("text")).where("text <> ''")


@register("themes_of_slugs", "SELECT s_suppkey, unnest(['MCP-Conexion', 'Panel-Cascade']) AS slug, unnest([0, 2]) AS place FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'Software-de-Terceros', 1 FROM supplier WHERE s_suppkey % 2 = 1")
def themes_of_slugs(spark, sf_dir):
    given = F.when(F.col("s_suppkey") % 2 == 0, "mcp-conexion, nada ,PANEL-cascade,Mcp-Conexion").otherwise(",Software-de-Terceros")
    return topics.themes_of_slugs(table(spark, sf_dir, "supplier").select("s_suppkey", given.alias("slugs"))).drop("slugs")


_LOOP = """WITH g AS (SELECT source, 'tema ' || lang || CAST(doc_id % 10 AS VARCHAR) AS topic, CAST(3 * count(*) AS INTEGER) AS mentions, CAST(1 + sum(n_chars) % 40 AS INTEGER) AS m FROM documents GROUP BY 1, 2),
o AS (SELECT 'Demo-' || source AS video, 'Capsula-' || CAST(doc_id AS VARCHAR) || '.mp4' AS output, 'tema ' || lang || CAST(doc_id % 10 AS VARCHAR) AS topic FROM documents WHERE doc_id % 50 = 7),
k AS (SELECT 'Demo-' || source AS video, topic, mentions, '0:00:10–0:' || lpad(CAST(m AS VARCHAR), 2, '0') || ':00' AS "interval",
  NOT EXISTS (SELECT 1 FROM o WHERE o.topic = g.topic) AND mentions >= 4 AND (m * 60 - 10) / 60.0 / mentions <= 3 AS fresh FROM g)"""


def _loop(spark, sf_dir):
    """(videos, cases of their discovery reports, claims, outputs): documents of a source are told in one report."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.concat(F.lit("tema "), "lang", (F.col("doc_id") % 10).cast("string")).alias("topic"))
    g = docs.groupBy("source", "topic").agg((F.count(F.lit(1)) * 3).alias("n"), (F.sum("n_chars") % 40 + 1).alias("m"))
    case = F.struct("topic", F.format_string("%s\n- **Tramo:** 0:00:10–0:%02d:00 · **menciones:** %d\n", "topic", "m", "n").alias("body"))
    bodies = F.transform(F.array_sort(F.collect_list(case)), lambda x, i: F.concat(F.lit("## Caso "), (i + 1).cast("string"), F.lit(": "), x["body"]))
    texts = g.groupBy(F.col("source").alias("folder")).agg(F.concat(F.lit("# Casos\n"), F.array_join(bodies, "")).alias("text"))
    found = transcripts.discovery_cases(texts, "folder")
    outputs = docs.where("doc_id % 50 = 7").select(F.concat(F.lit("Demo-"), "source").alias("video"), F.concat(F.lit("Capsula-"), F.col("doc_id").cast("string"), F.lit(".mp4")).alias("output"), "topic", F.lit("").alias("slug"), F.col("doc_id").alias("ord"))
    videos = docs.select(F.concat(F.lit("Demo-"), "source").alias("video")).distinct()
    return videos, reports.open_cases(videos, texts.select("folder"), found, outputs), outputs.select("video", "output"), outputs


@register("more_cases", _LOOP + """ SELECT topic, video, "interval", mentions FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY mentions DESC, video, "interval") AS n FROM k WHERE fresh) WHERE n = 1""")
def more_cases(spark, sf_dir):
    """New cases of all reports that no output covers, the best one of each topic."""
    _, cases, _, _ = _loop(spark, sf_dir)
    return topics.best_candidates(cases.where("focus = 'new'"), ["video", "interval"]).select("topic", "video", "interval", "mentions")


@register("recorded_videos", _LOOP + """, v AS (SELECT DISTINCT 'Demo-' || source AS video, CAST(substr(source, 4) AS INTEGER) % 2 = 0 AS known, CAST(substr(source, 4) AS INTEGER) % 4 = 0 AS gone FROM documents),
t AS (SELECT video, array_to_string(list_sort(list(DISTINCT topic)), ',') AS objective FROM (SELECT video, topic FROM k UNION ALL SELECT video, topic FROM o) GROUP BY 1),
n AS (SELECT video, array_to_string(list_sort(list(DISTINCT topic)), ',') AS new_cases FROM k WHERE fresh GROUP BY 1),
c AS (SELECT video, array_to_string(list_sort(list(DISTINCT output)), ',') AS outputs FROM o GROUP BY 1)
SELECT video, objective, coalesce(outputs, '') AS outputs, coalesce(new_cases, '') AS new_cases, true AS processed, new_cases IS NULL AS nothing_new, CASE WHEN known THEN '2020-01-01' ELSE '2024-01-01' END AS registered, '2024-01-01' AS updated
  FROM v LEFT JOIN t USING (video) LEFT JOIN n USING (video) LEFT JOIN c USING (video)
UNION ALL SELECT video || '-antes', 'old', '', '', true, true, '2020-01-01', '2020-01-01' FROM v WHERE gone""")
def recorded_videos(spark, sf_dir):
    """Reports of all videos merged into the records: the first time stays, and so do records of videos that are gone."""
    videos, cases, claims, outputs = _loop(spark, sf_dir)
    number = F.regexp_extract("video", r"(\d+)$", 1).cast("int")
    none, stamp = F.array().cast("array<string>"), F.lit("2020-01-01")
    old = lambda rows: rows.select("video", F.array(F.lit("old")).alias("objective"), none.alias("outputs"), none.alias("new_cases"), F.lit(True).alias("processed"), F.lit(True).alias("nothing_new"), stamp.alias("registered"), stamp.alias("updated"))
    gone = videos.where(number % 4 == 0).withColumn("video", F.concat("video", F.lit("-antes")))
    known = old(videos.where(number % 2 == 0)).unionByName(old(gone))
    out = entities.merge_by_name(known, reports.video_report(videos, cases, claims, outputs), "video", F.lit("2024-01-01"))
    return out.select("video", *[F.array_join(c, ",").alias(c) for c in ("objective", "outputs", "new_cases")], "processed", "nothing_new", "registered", "updated")
