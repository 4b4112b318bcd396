"""Registered queries of the text, topic, identity and gate operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.functions import clock, rules
from chronolith.functions import text as T
from chronolith.operators import entities, gate, topics

from .catalog import register
from .common import segments, table

#: Rules in the words of the driver's invented prose, in the form of the default ones.
WORDS = (
    ("alpha", r"\bthe\b|\bthat\b|tion\b"),
    ("beta", r"\bder\b|ung|\bund\b"),
    ("gamma", r"\bles?\b|ment\b|aux"),
    ("delta", r"\bque\b|ción\b|\blos\b"),
)
#: Themes in these words, and one of the default ones.
SHOWN = (
    ("Alpha", "Alpha", 1, ("en",), (r"\bthe\b", r"\bwith\b", r"tion\b")),
    ("Beta", "Beta", 2, ("de", "fr"), (r"\bder\b", r"\bund\b", r"keit\b", r"\bles\b")),
    ("Gamma", "Gamma", 3, (), (r"license|licencia", r"\bversion\s+\d")),
    rules.THEMES[6],
)

_EDGE = r"[^\p{L}\p{N}_]"


def _hit(column: str, pattern: str) -> str:
    return f"regexp_matches(coalesce({column}, ''), {rules.quoted(rules.re2(pattern))})"


def _topics_sql(column: str, topics_) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_hit(column, p)} THEN {rules.quoted(n)} END" for n, p in topics_) + "], lambda x: x IS NOT NULL)"


_TAGGED = f"""t AS (SELECT conv_id AS track, turn AS ord, CAST(turn * 30.0 AS DOUBLE) AS start, CAST(turn * 30.0 + 25.0 AS DOUBLE) AS "end", text,
  {_hit('text', rules.INTENT)} AS intent, regexp_matches(text, '[?¿]') AND len(regexp_split_to_array(trim(text), '\\s+')) >= 3 AS question, {_topics_sql('text', WORDS)} AS topics FROM conversations)"""


@register("topic_tags", f"WITH {_TAGGED} SELECT track, ord, coalesce(intent, false) AS intent, coalesce(question, false) AS question, array_to_string(topics, ',') AS topics FROM t")
def topic_tags(spark, sf_dir):
    return topics.tag_segments(segments(spark, sf_dir), WORDS).select("track", "ord", "intent", "question", F.array_join("topics", ",").alias("topics"))


@register("default_topic_tags", f"SELECT doc_id, array_to_string({_topics_sql('text', rules.TOPICS)}, ',') AS topics, {_hit('text', rules.INTENT)} AS intent FROM documents")
def default_topic_tags(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(rules.topics_of(text), ",").alias("topics"), rules.is_intent(text).alias("intent"))


_CASES = f"""WITH {_TAGGED}, e AS (SELECT *, unnest(topics) AS topic FROM t),
c AS (SELECT track, topic, min(start) AS start, max("end") AS "end", count(*) AS mentions, coalesce(arg_min(text, CASE WHEN question THEN ord END), '') AS question, coalesce(arg_min(text, CASE WHEN intent THEN ord END), '') AS intent
  FROM e GROUP BY 1, 2 HAVING count(*) >= 2)"""


@register("topic_cases", _CASES + ' SELECT track, topic, start, "end", mentions, question, intent FROM c')
def topic_cases(spark, sf_dir):
    return topics.topic_cases(topics.tag_segments(segments(spark, sf_dir), WORDS), ["track"], "start", "end", "ord")


_FOCUS = _CASES + """, l AS (SELECT DISTINCT doc_id AS track FROM labels),
f AS (SELECT c.track, c.topic, c.mentions, (c."end" - c.start) / 60.0 AS minutes, l.track IS NOT NULL AS covered FROM c LEFT JOIN l ON c.track = l.track),
g AS (SELECT *, CASE WHEN covered THEN 'covered' WHEN mentions >= 3 AND CASE WHEN mentions > 0 THEN minutes / mentions ELSE 999.0 END <= 0.5 THEN 'new' WHEN mentions >= 3 THEN 'dispersed' ELSE 'weak' END AS focus FROM f)"""


def _focus(spark, sf_dir):
    cases = topics.topic_cases(topics.tag_segments(segments(spark, sf_dir), WORDS), ["track"], "start", "end", "ord")
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("track"), F.lit(True).alias("covered")).distinct()
    out = cases.join(known, "track", "left").withColumn("minutes", (F.col("end") - F.col("start")) / 60.0)
    focus = topics.focus_of(F.col("mentions"), F.col("minutes"), F.coalesce("covered", F.lit(False)), least=3, most_minutes=0.5)
    return out.withColumn("focus", focus)


@register("focused_topics", _FOCUS + " SELECT track, topic, mentions, round(minutes, 6) AS minutes, focus FROM g")
def focused_topics(spark, sf_dir):
    return _focus(spark, sf_dir).select("track", "topic", "mentions", F.round("minutes", 6).alias("minutes"), "focus")


@register("best_candidates", _FOCUS + ", r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY mentions DESC, track) AS n FROM g WHERE focus IN ('new', 'dispersed')) SELECT topic, track, mentions FROM r WHERE n = 1")
def best_candidates(spark, sf_dir):
    found = _focus(spark, sf_dir).where(F.col("focus").isin("new", "dispersed")).select("track", "topic", "mentions")
    return topics.best_candidates(found, ["track"]).select("topic", "track", "mentions")


@register("uncovered_documents", "SELECT source, lang, count(*) AS n, min(doc_id) AS first_doc FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1, 2")
def uncovered_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    left = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return left.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def _cue_lists() -> dict[str, str]:
    """SQL for what each class's patterns find in ``low``."""
    lists = {}
    for name, patterns in rules.ARTIFACT_SIGNALS:
        found = []
        for p in patterns:
            core = p.replace(".*", r"[^\n]*").replace(r"\w", r"[\p{L}\p{N}_]")
            head = rf"(?:^|{_EDGE})" if core.startswith(r"\b") else ""
            tail = rf"(?:{_EDGE}|$)" if core.endswith(r"\b") else ""
            core = core.removeprefix(r"\b").removesuffix(r"\b").replace(r"\b", "")
            found.append(f"trim(regexp_extract(low, {rules.quoted(f'(?s){head}({core}){tail}')}, 1))")
        lists[name] = f"list_filter([{', '.join(found)}], lambda x: x <> '')"
    return lists


def _artifact_sql() -> str:
    return ", ".join(f"len(list_distinct({found})) AS s_{name}" for name, found in _cue_lists().items())


_KINDS = [n for n, _ in rules.ARTIFACT_SIGNALS]


@register("classify_artifact", f"""WITH p AS (SELECT doc_id, lower(coalesce(text, '')) AS low, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\n'), lambda x: regexp_matches(trim(x), '^[$\\-+()\\d.,%\\s/:]+$') AND regexp_matches(x, '\\d'))) AS grid FROM documents),
s AS (SELECT doc_id, grid, {_artifact_sql()} FROM p),
x AS (SELECT doc_id, grid, s_excel + CASE WHEN grid >= 4 THEN least(grid // 3, 4) ELSE 0 END AS t_excel, {', '.join(f's_{k} AS t_{k}' for k in _KINDS[1:])} FROM s),
b AS (SELECT *, greatest({', '.join(f't_{k}' for k in _KINDS)}) AS best FROM x)
SELECT doc_id, CASE WHEN best = 0 THEN 'otro' {' '.join(f"WHEN t_{k} = best THEN '{k}'" for k in _KINDS)} END AS artifact, CAST(best AS INTEGER) AS score, CAST(grid AS INTEGER) AS grid FROM b""")
def classify_artifact(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", rules.artifact_of(F.col("text")).alias("a"), rules.grid_lines(F.col("text")).alias("grid"))
    return d.select("doc_id", "a.artifact", "a.score", "grid")


@register("artifact_cues", f"""WITH p AS (SELECT doc_id, lower(coalesce(text, '')) AS low, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\n'), lambda x: regexp_matches(trim(x), '^[$\\-+()\\d.,%\\s/:]+$') AND regexp_matches(x, '\\d'))) AS grid FROM documents),
l AS (SELECT doc_id, grid, {', '.join(f'{found} AS l_{name}' for name, found in _cue_lists().items())} FROM p),
c AS (SELECT doc_id, grid, {', '.join(f'list_filter(l_{k}, lambda x, i: list_position(l_{k}, x) = i) AS c_{k}' for k in _KINDS)} FROM l),
x AS (SELECT *, len(c_excel) + CASE WHEN grid >= 4 THEN least(grid // 3, 4) ELSE 0 END AS t_excel, {', '.join(f'len(c_{k}) AS t_{k}' for k in _KINDS[1:])} FROM c),
b AS (SELECT *, greatest({', '.join(f't_{k}' for k in _KINDS)}) AS best FROM x)
SELECT doc_id, array_to_string(CASE WHEN best = 0 THEN [] WHEN t_excel = best THEN list_concat(c_excel, CASE WHEN grid >= 4 THEN ['grilla numérica (~' || CAST(grid AS VARCHAR) || ' líneas)'] ELSE [] END)
  {' '.join(f"WHEN t_{k} = best THEN c_{k}" for k in _KINDS[1:])} END[1:8], '|') AS cues FROM b""")
def artifact_cues(spark, sf_dir):
    """What tells the class of a document: eight cues at most."""
    found = table(spark, sf_dir, "documents").select("doc_id", rules.artifact_of(F.col("text")).alias("a"))
    return found.select("doc_id", F.array_join("a.cues", "|").alias("cues"))


@register("detect_action", f"""SELECT doc_id, CASE {' '.join(f"WHEN {' OR '.join(_hit('text', x) for x in p)} THEN '{n}'" for n, p in rules.ACTIONS)}
  WHEN n_chars % 40 >= 25 THEN 'cambiar' WHEN n_chars % 10 / 10.0 >= 0.35 OR n_chars % 40 >= 6 THEN 'escribir' WHEN n_chars % 10 / 10.0 >= 0.15 THEN 'interactuar' ELSE 'revisar' END AS action FROM documents""")
def detect_action(spark, sf_dir):
    """The length stands for movement on the screen, which documents don't have."""
    change, activity = (F.col("n_chars") % 40).cast("double"), F.col("n_chars") % 10 / 10.0
    return table(spark, sf_dir, "documents").select("doc_id", rules.action_of(F.col("text"), change, activity).alias("action"))


@register("value_score", f"SELECT doc_id, round(CAST({' + '.join(f'CASE WHEN {_hit(chr(116) + chr(101) + chr(120) + chr(116), p)} THEN {w} ELSE 0 END' for p, w in rules.VALUE_CUES)} AS DOUBLE), 3) AS value FROM documents")
def value_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(rules.value_score(F.col("text")), 3).alias("value"))


@register("canonical_topic", "SELECT doc_id, CASE "
    + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {rules.quoted(w)})' for w in ws[:2])} THEN {rules.quoted(n)}" for n, ws in rules.CANONICAL_TOPICS) + " "
    + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {rules.quoted(w)})' for w in ws)} THEN {rules.quoted(n)}" for n, ws in reversed(rules.CANONICAL_TOPICS))
    + " END AS topic FROM documents")
def canonical_topic(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rules.canonical_topic(F.col("text")).alias("topic"))


def _theme_sql(theme) -> str:
    slug, _, _, artifacts, cues = theme
    hits = [_hit("text", p) for p in cues]
    bonus = f"CASE WHEN lang IN ({', '.join(map(rules.quoted, artifacts))}) THEN 1.5 ELSE 0 END" if artifacts else "0"
    return f"SELECT source, doc_id, '{slug}' AS slug, {' + '.join(f'CASE WHEN {h} THEN 2.0 ELSE 0 END' for h in hits)} + {bonus} + 0.2 * n_chars AS score FROM documents WHERE {' OR '.join(hits)}"


@register("present_themes", f"WITH s AS ({' UNION ALL '.join(_theme_sql(t) for t in SHOWN)}) SELECT source, slug, min(doc_id) AS start, max(doc_id) AS \"end\", count(*) AS moments, round(CAST(max(score) AS DOUBLE), 3) AS score FROM s GROUP BY 1, 2 HAVING count(*) >= 3")
def present_themes(spark, sf_dir):
    """Sources as tracks, doc_id as clock; the language and length stand for artifact and value."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "text", "lang", F.col("n_chars").cast("double").alias("v"))
    return topics.present_themes(d, ["source"], "doc_id", "text", "lang", "v", SHOWN).select("source", "slug", "start", "end", "moments", F.round("score", 3).alias("score"))


@register("moment_scores", f"""WITH m AS (SELECT source, doc_id, lang, n_chars, doc_id % 300 AS diff, doc_id % 7 / 100.0 AS skin, n_chars % 13 AS rms, {' + '.join(f"CASE WHEN {_hit('text', p)} THEN {w} ELSE 0 END" for p, w in rules.VALUE_CUES)} AS value FROM documents),
w AS (SELECT *, CASE lang WHEN 'en' THEN 8.0 WHEN 'de' THEN 6.0 ELSE 0.8 END AS base, coalesce(nullif(max(n_chars) OVER p, 0), 1) AS mo, coalesce(nullif(max(rms) OVER p, 0), 1e-9) AS mr, coalesce(max(CASE WHEN diff < 255 THEN diff END) OVER p, 1.0) AS md FROM m WINDOW p AS (PARTITION BY source))
SELECT source, doc_id, round((base + CASE WHEN lang IN ('en', 'de') THEN 0.8 * n_chars / mo ELSE 0 END + 0.4 * rms / mr + 0.2 * least(diff, md) / md + value) * CASE WHEN skin >= 0.045 THEN 0.05 ELSE 1 END, 6) AS score FROM w""")
def moment_scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "browser").when(F.col("lang") == "de", "code").otherwise("otro")
    m = d.select("source", "doc_id", kind.alias("artifact"), F.col("n_chars").cast("double").alias("ocr_len"), (F.col("n_chars") % 13).cast("double").alias("audio_rms"), (F.col("doc_id") % 300).cast("double").alias("scene_diff"), (F.col("doc_id") % 7 / 100.0).alias("skin"), F.col("text").alias("ocr_text"))
    return topics.moment_scores(m, ["source"]).select("source", "doc_id", F.round("score", 6).alias("score"))


@register("content_identity", "WITH h AS (SELECT doc_id, 'sha256:' || sha256(text) AS content_id FROM documents) SELECT content_id, count(*) AS copies, min(doc_id) AS first_doc FROM h GROUP BY 1")
def content_identity(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", entities.content_id(F.col("text")).alias("content_id"))
    return d.groupBy("content_id").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


@register("family_names", r"""WITH n AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[^:]*://', ''), '[?#].*$', '') || CASE page_id % 4 WHEN 0 THEN '_v2_final' WHEN 1 THEN ' copia' WHEN 2 THEN '-rev3' ELSE '' END AS name FROM pages),
s AS (SELECT page_id, lower(regexp_replace(regexp_replace(name, '^.*/', ''), '(.)\.[^.]*$', '\1')) AS stem FROM n)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(stem, '(?:[-_\s]*(?:v\d+|version\s*\d+|final[-_\s]*\d+|final|copy|copia|rev\d*))+[-_ ]*$', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS family FROM s""")
def family_names(spark, sf_dir):
    name = F.regexp_replace(F.regexp_replace("url", r"^[^:]*://", ""), r"[?#].*$", "")
    suffix = rules.lookup(F.col("page_id") % 4, {0: "_v2_final", 1: " copia", 2: "-rev3"}, "")
    return table(spark, sf_dir, "pages").select("page_id", T.family(F.concat(name, suffix)).alias("family"))


@register("classify_videos", r"""WITH k AS (SELECT 'p' || p_partkey AS video_id, lower(regexp_replace(p_name, '[^A-Za-z]+', '-', 'g')) AS fam, p_retailprice AS d, p_size AS version, p_partkey AS ord FROM part WHERE p_size <= 25),
n AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN 'p' || (p_partkey - p_partkey % 18) ELSE 'q' || p_partkey END AS video_id, p_partkey, lower(regexp_replace(p_name, '[^A-Za-z]+', '-', 'g')) AS fam, p_retailprice AS d FROM part WHERE p_size > 25),
kf AS (SELECT *, regexp_replace(fam, '^-+|-+$', '', 'g') AS f FROM k), nf AS (SELECT *, regexp_replace(fam, '^-+|-+$', '', 'g') AS f FROM n),
ex AS (SELECT DISTINCT video_id FROM kf),
pa AS (SELECT f, arg_max(video_id, CAST(version AS BIGINT) * 1000000000 - ord) AS parent, max(version) AS v FROM kf WHERE f <> '' GROUP BY 1),
li AS (SELECT nf.p_partkey, arg_min(kf.video_id, kf.ord) AS likely FROM nf JOIN kf USING (f) WHERE f <> '' AND nf.d <> 0 AND kf.d <> 0 AND abs(kf.d - nf.d) / greatest(kf.d, 1.0) <= 0.02 GROUP BY 1)
SELECT nf.p_partkey, CASE WHEN ex.video_id IS NOT NULL THEN 'EXACT_DUPLICATE' WHEN likely IS NOT NULL THEN 'LIKELY_DUPLICATE' WHEN parent IS NOT NULL THEN 'NEW_VERSION' ELSE 'NEW_VIDEO' END AS status,
  coalesce(ex.video_id, likely, parent) AS match, CASE WHEN ex.video_id IS NULL AND likely IS NULL AND parent IS NOT NULL THEN v + 1 ELSE 0 END AS suggested_version
FROM nf LEFT JOIN ex USING (video_id) LEFT JOIN pa USING (f) LEFT JOIN li USING (p_partkey)""")
def classify_videos(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.lower(F.regexp_replace("p_name", "[^A-Za-z]+", "-"))
    known = p.where("p_size <= 25").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("video_id"), name.alias("file_name"), F.col("p_retailprice").alias("duration_seconds"), F.col("p_size").alias("version"), F.col("p_partkey").alias("ord"))
    key = F.col("p_partkey")
    vid = F.when(key % 9 == 0, F.concat(F.lit("p"), (key - key % 18).cast("string"))).otherwise(F.concat(F.lit("q"), key.cast("string")))
    new = p.where("p_size > 25").select("p_partkey", vid.alias("video_id"), name.alias("file_name"), F.col("p_retailprice").alias("duration_seconds"))
    return entities.classify_videos(new, known).select("p_partkey", "status", "match", F.coalesce("suggested_version", F.lit(0)).alias("suggested_version"))


@register("token_overlap_match", r"""WITH a AS (SELECT page_id, list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(url, '^[^:]*://', ''), '/.*$', '')), '[^a-z0-9]+'), lambda x: x <> '')) AS lt FROM pages),
h AS (SELECT DISTINCT lower(regexp_replace(regexp_replace(url, '^[^:]*://', ''), '/.*$', '')) AS host FROM pages),
b AS (SELECT host, list_distinct(list_filter(regexp_split_to_array(regexp_replace(host, '\.[a-z]+$', ''), '[^a-z0-9]+'), lambda x: x <> '')) AS rt FROM h),
s AS (SELECT page_id, host, len(list_intersect(lt, rt)) + CASE WHEN len(list_filter(rt, lambda x: NOT list_contains(lt, x))) = 0 THEN len(rt) ELSE 0 END AS score FROM a, b),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, host) AS n FROM s WHERE score > 0)
SELECT page_id, host, CAST(score AS INTEGER) AS score FROM r WHERE n = 1""")
def token_overlap_match(spark, sf_dir):
    host = F.lower(F.regexp_replace(F.regexp_replace("url", r"^[^:]*://", ""), r"/.*$", ""))
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("name"))
    hosts = pages.select(F.col("name").alias("host")).distinct().withColumn("label", F.regexp_replace("host", r"\.[a-z]+$", ""))
    return entities.token_match(pages, hosts, "page_id", "name", "host", "label").select("page_id", "host", F.col("score").cast("int").alias("score"))


@register("merge_customers", """WITH new AS (SELECT c_custkey AS name, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment, c_acctbal AS balance FROM customer WHERE c_acctbal >= 0),
old AS (SELECT s_suppkey AS name, s_name AS segment, s_acctbal AS balance, '2020' AS registered, '2021' AS updated FROM supplier)
SELECT coalesce(n.name, o.name) AS name, coalesce(n.segment, o.segment) AS segment, coalesce(n.balance, o.balance) AS balance, coalesce(o.registered, CASE WHEN n.name IS NOT NULL THEN '2024' END) AS registered, CASE WHEN n.name IS NOT NULL THEN '2024' ELSE o.updated END AS updated
FROM new n FULL JOIN old o ON n.name = o.name""")
def merge_customers(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    new = c.where("c_acctbal >= 0").select(F.col("c_custkey").alias("name"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"), F.col("c_acctbal").alias("balance"))
    old = s.select(F.col("s_suppkey").alias("name"), F.col("s_name").alias("segment"), F.col("s_acctbal").alias("balance"), F.lit("2020").alias("registered"), F.lit("2021").alias("updated"))
    return entities.merge_by_name(old, new, "name", F.lit("2024"))


@register("quality_gate", """WITH g AS (SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_quantity > 45 THEN 'quantity' END, CASE WHEN l_discount > 0.09 THEN 'discount' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END], lambda x: x IS NOT NULL) AS bad, list_filter([CASE WHEN l_tax > 0.06 THEN 'tax' END], lambda x: x IS NOT NULL) AS odd FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN len(bad) > 0 THEN 'FAIL' WHEN len(odd) > 0 THEN 'WARN' ELSE 'PASS' END AS verdict, array_to_string(CASE WHEN len(bad) > 0 THEN bad ELSE odd END, ',') AS reasons FROM g""")
def quality_gate(spark, sf_dir):
    return _gated(spark, sf_dir).select("l_orderkey", "l_linenumber", "verdict", F.array_join("reasons", ",").alias("reasons"))


def _gated(spark, sf_dir):
    c = F.col
    bad = [(c("l_quantity") > 45, F.lit("quantity")), (c("l_discount") > 0.09, F.lit("discount")), (c("l_returnflag") == "R", F.lit("returned"))]
    return gate.verdicts(table(spark, sf_dir, "lineitem"), bad, [(c("l_tax") > 0.06, F.lit("tax"))])


@register("gate_summary", """WITH g AS (SELECT CASE WHEN l_quantity > 45 OR l_discount > 0.09 OR l_returnflag = 'R' THEN 2 WHEN l_tax > 0.06 THEN 1 ELSE 0 END AS r FROM lineitem)
SELECT ['PASS', 'WARN', 'FAIL'][max(r) + 1] AS verdict, count(*) FILTER (r = 0) AS n_pass, count(*) FILTER (r = 1) AS n_warn, count(*) FILTER (r = 2) AS n_fail, count(*) AS n FROM g""")
def gate_summary(spark, sf_dir):
    return gate.overall(_gated(spark, sf_dir))


@register("clock_strings", """WITH s AS (SELECT event_id, event_id * 7919 % 400000 / 4.0 AS x FROM events)
SELECT event_id, printf('%02d:%02d:%02d', CAST(floor(x / 3600) AS BIGINT), CAST(floor(x % 3600 / 60) AS BIGINT), CAST(floor(x) AS BIGINT) % 60) AS clock, CAST(floor(x) AS DOUBLE) AS seconds FROM s""")
def clock_strings(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7919 % 400000 / 4.0).alias("x"))
    e = e.withColumn("clock", clock.clock(F.col("x")))
    return e.select("event_id", "clock", clock.seconds_of(F.col("clock")).alias("seconds"))


@register("slugs", """SELECT doc_id, length(CASE WHEN s = '' THEN 'item' ELSE s END) AS n_chars, sha256(CASE WHEN s = '' THEN 'item' ELSE s END) AS slug_sha256 FROM (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents)""")
def slugs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.slug(F.col("text"), "item").alias("slug"))
    return d.select("doc_id", F.length("slug").cast("long").alias("n_chars"), F.sha2("slug", 256).alias("slug_sha256"))


_WHITE = r"[ \t\n\x0B\f\r]"


def _trimmed(column: str, signs: str) -> str:
    return f"regexp_replace({column}, '^[{signs}]+|[{signs}]+$', '', 'g')"


def _screen_sql() -> str:
    """Lines of every document in order, each word of a line tested by itself."""
    words = "list_filter(regexp_split_to_array({}, '" + _WHITE + "+'), lambda x: x <> '')"
    noise = r"(?i)^(archivo|inicio|insertar|ayuda|buscar|file|home|edit|view|\d{1,2}:\d{2}|[^\p{L}\p{N}_]+)$"
    bad = rf"(?i)ctrl?{_WHITE}*\+|\(ctr|@|\.(com|cl|net)(?:$|[^\p{{L}}\p{{N}}_])|^{_WHITE}*(esta|este|esto|updated?|new|nuevo|nueva|session|home|men[uú]){_WHITE}*$"
    known = ", ".join(map(rules.quoted, rules.UI_CHROME))
    upper = r"(regexp_matches(w, '\p{Lu}') AND w = upper(w))"
    pieces = f"list_transform(regexp_extract_all(w, '[{T._UPPER}][a-záéíóúñ]+'), lambda p: lower(p))"
    return rf"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\x0B\f\r\x{{85}}\x{{2028}}\x{{2029}}]')) AS raw, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\x0B\f\r\x{{85}}\x{{2028}}\x{{2029}}]'), 1) AS n FROM documents),
s AS (SELECT doc_id, n, array_to_string(each, ' ') AS s, each FROM (SELECT doc_id, n, {words.format('raw')} AS each FROM l)),
f AS (SELECT * FROM s WHERE length(s) BETWEEN 4 AND 34 AND len(each) BETWEEN 1 AND 4 AND NOT regexp_matches(s, '{noise}') AND regexp_matches(s, '[A-Za-zÁÉÍÓÚáéíóúÑñ]{{3}}')
  AND NOT regexp_matches(s, '{bad}') AND regexp_matches(s, '^[{T._LETTERS}0-9][{T._LETTERS}0-9 .&\-]*$') AND length(regexp_replace(s, '[^\p{{L}}]', '', 'g')) >= 4),
w AS (SELECT doc_id, n, s, unnest(list_transform(each, lambda x: {_trimmed('x', '.&/-')})) AS w FROM f),
t AS (SELECT doc_id, n, s, lower(w) IN ({known}) AS chrome, w <> '' AND NOT regexp_matches(w, '(?i)^(updated?|al|the|de|del|la|el|los|las|un|una|y|o|en)$') AND (regexp_matches(w, '^\p{{Lu}}') OR regexp_matches(w, '^[0-9]+$'))
  AND (length(w) >= 3 OR {upper}) AND len({pieces}) < 3 AND NOT (len({pieces}) >= 2 AND len(list_distinct({pieces})) < len({pieces})) AND (NOT {upper} OR regexp_matches(w, '^[{T._UPPER}]{{2,6}}[0-9]{{0,2}}$')) AS good FROM w),
h AS (SELECT doc_id, n, any_value(s) AS s FROM t GROUP BY 1, 2 HAVING bool_and(good) AND NOT bool_and(chrome))
SELECT d.doc_id, coalesce(b.s, '') AS screen FROM documents d LEFT JOIN (SELECT doc_id, arg_min(s, n) AS s FROM h GROUP BY 1) b ON b.doc_id = d.doc_id"""


@register("screen_titles", _screen_sql())
def screen_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.screen_title(F.col("text")).alias("screen"))


def _phrase_sql() -> str:
    out = "coalesce(text, '')"
    for pattern, by in (
        (r"(?i)\[por validar\]", ""), (r"\[[^\]]*\]\([^)]*\)", ""), (r"[`*_>#|]", " "), (_WHITE + r"+([,.;:])", r"\1"), (_WHITE + "+", " "),
        (r"^[ ·\-—:;,.]+|[ ·\-—:;,.]+$", ""),
    ):
        out = f"regexp_replace({out}, {rules.quoted(pattern)}, '{by}', 'g')"
    last = "coalesce(list_max(list_filter(range(1, 166), lambda i: {})), 0) - 1"
    return f"""WITH w AS (SELECT doc_id, {out} AS whole FROM documents), c AS (SELECT *, substring(whole, 1, 165) AS cut FROM w),
p AS (SELECT *, {last.format("substring(cut, i, 2) IN ('. ', ', ')")} AS stop, {last.format("substring(cut, i, 1) = ' '")} AS space FROM c),
k AS (SELECT *, CASE WHEN stop > 60 THEN substring(cut, 1, stop) WHEN space >= 0 THEN substring(cut, 1, space) ELSE cut END AS short FROM p),
e AS (SELECT doc_id, CASE WHEN length(whole) > 165 THEN {_trimmed('short', ' ,;:')} ELSE whole END AS kept FROM k)
SELECT doc_id, CASE WHEN kept = '' THEN '' ELSE upper(substring(kept, 1, 1)) || substring(kept, 2) || CASE WHEN regexp_matches(kept, '[.!?]$') THEN '' ELSE '.' END END AS phrase FROM e"""


@register("phrases", _phrase_sql())
def phrases(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.phrase(F.col("text"), first=T.capital).alias("phrase"))


_SIMILARITY = r"""WITH RECURSIVE
s AS (SELECT item_id, string_split(text, '. ') AS p, text FROM benchmark),
x AS (SELECT item_id, 0 AS f, lower(trim(p[1], E' \t\n\r')) AS t FROM s UNION ALL SELECT item_id, 1, lower(trim(text, E' \t\n\r')) FROM s),
y AS (SELECT item_id, 0 AS f, lower(trim(p[-1], E' \t\n\r')) AS t FROM s UNION ALL SELECT item_id, 1, lower(trim(text, E' \t\n\r')) FROM s),
xc AS (SELECT item_id AS c, f, i, substr(t, i, 1) AS ch FROM x, LATERAL (SELECT unnest(generate_series(1, length(t))) AS i)),
yc AS (SELECT item_id AS e, f, j, substr(t, j, 1) AS ch, length(t) AS n, count(*) OVER (PARTITION BY item_id, f, substr(t, j, 1)) AS often
  FROM y, LATERAL (SELECT unnest(generate_series(1, length(t))) AS j)),
-- Runs of equal characters along a diagonal, and in them those of characters that may begin a block.
cell AS (SELECT c, e, xc.f, i, i - j AS d, n, n < 200 OR often <= n // 100 + 1 AS ok FROM xc JOIN yc USING (f, ch)),
run AS (SELECT *, i - row_number() OVER (PARTITION BY c, e, f, d ORDER BY i) AS r FROM cell),
whole AS (SELECT c, e, f, d, n, min(i) AS s0, max(i) AS s1 FROM run GROUP BY c, e, f, d, n, r),
part AS (SELECT c, e, f, d, i - row_number() OVER (PARTITION BY c, e, f, d ORDER BY i) AS q, i FROM run WHERE ok AND n >= 200),
block AS (SELECT p.c, p.e, p.f, p.d, p0, p1, s0, s1, true AS ok FROM (SELECT c, e, f, d, min(i) AS p0, max(i) AS p1 FROM part GROUP BY c, e, f, d, q) p
    JOIN whole w ON p.c = w.c AND p.e = w.e AND p.f = w.f AND p.d = w.d AND p0 BETWEEN s0 AND s1
  UNION ALL SELECT c, e, f, d, s0, s1, s0, s1, n < 200 FROM whole),
-- A row is a block in a box, cut to it. The longest block of a box, the first in the one and then in the other text, grows by
-- any equal characters and splits the box; where none may begin one, equal characters at its corner count.
box AS (SELECT c, e, b.f, 1 AS a0, length(x.t) AS a1, 1 AS b0, length(y.t) AS b1, d, p0, p1, s0, s1, ok FROM block b JOIN x ON x.item_id = c AND x.f = b.f JOIN y ON y.item_id = e AND y.f = b.f
  UNION ALL SELECT c, e, f, a, z, b, w, d, greatest(p0, a, b + d), least(p1, z, w + d), s0, s1, ok FROM (
    SELECT c, e, f, d, p0, p1, s0, s1, ok, side, CASE side WHEN 0 THEN a0 ELSE hi + 1 END AS a, CASE side WHEN 0 THEN lo - 1 ELSE a1 END AS z,
      CASE side WHEN 0 THEN b0 ELSE hi - md + 1 END AS b, CASE side WHEN 0 THEN lo - md - 1 ELSE b1 END AS w
    FROM (SELECT *, greatest(m.s0, a0, b0 + m.d) AS lo, least(m.s1, a1, b1 + m.d) AS hi, m.d AS md FROM (
      SELECT *, arg_min({'s0': s0, 's1': s1, 'd': d}, CASE WHEN ok THEN (p0 - p1 - 1) * 100000000 + p0 * 10000 + p0 - d WHEN d = a0 - b0 AND p0 = a0 THEN 0 END)
        OVER (PARTITION BY c, e, f, a0, b0) AS m FROM box) WHERE m IS NOT NULL), (VALUES (0), (1)) v(side))
  WHERE a <= z AND b <= w AND greatest(p0, a, b + d) <= least(p1, z, w + d)),
best AS (SELECT c, e, f, a0, a1, b0, b1, arg_min({'s0': s0, 's1': s1, 'd': d}, CASE WHEN ok THEN (p0 - p1 - 1) * 100000000 + p0 * 10000 + p0 - d WHEN d = a0 - b0 AND p0 = a0 THEN 0 END) AS m FROM box GROUP BY ALL),
common AS (SELECT c, e, f, sum(least(m.s1, a1, b1 + m.d) - greatest(m.s0, a0, b0 + m.d) + 1) AS k FROM best WHERE m IS NOT NULL GROUP BY ALL),
ratio AS (SELECT x.item_id AS c, y.item_id AS e, f, coalesce(2.0 * k / (length(x.t) + length(y.t)), 0)::DOUBLE AS r FROM x JOIN y USING (f) LEFT JOIN common ON c = x.item_id AND e = y.item_id AND common.f = x.f),
score AS (SELECT c, e, (0.35::DOUBLE * max(r) FILTER (f = 0) + 0.3::DOUBLE * max(r) FILTER (f = 1)) / (0.35::DOUBLE + 0.3::DOUBLE) AS score FROM ratio GROUP BY ALL),
top AS (SELECT c, arg_min({'e': e, 'score': score}, {'s': -score, 'e': e}) AS m FROM score WHERE score > 0 GROUP BY c)
SELECT item_id AS cand_id, CASE WHEN m.score >= 0.92 THEN 'DUPLICATE' WHEN m.score >= 0.75 THEN 'EXISTING' WHEN m.score >= 0.55 THEN 'RELATED' ELSE 'NEW' END AS status,
  CASE WHEN m.score >= 0.55 THEN 'UC-' || CAST(m.e AS VARCHAR) END AS use_case_id, round(coalesce(m.score, 0), 9) AS score FROM benchmark LEFT JOIN top ON c = item_id"""


@register("use_case_similarity", _SIMILARITY)
def use_case_similarity(spark, sf_dir):
    """Benchmark items by their first sentences against the same items by their last, every pair."""
    b = table(spark, sf_dir, "benchmark")
    none = F.array().cast("array<string>")
    fields = lambda name, objective: [name.alias("name"), objective.alias("objective"), F.lit("").alias("actor"), F.lit("").alias("flow"), F.lit("").alias("trigger"), none.alias("functionalities")]
    sentences = F.split(F.col("text"), r"\. ")
    cand = b.select(F.col("item_id").alias("cand_id"), *fields(sentences[0], F.col("text")))
    store = b.select(F.concat(F.lit("UC-"), F.col("item_id").cast("string")).alias("use_case_id"), F.col("item_id").alias("ord"), *fields(F.reverse(sentences)[0], F.col("text")))
    return entities.match_use_cases(cand, store).withColumn("score", F.round("score", 9))
