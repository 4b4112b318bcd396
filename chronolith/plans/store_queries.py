"""Registered queries of identity, store, lifecycle, gate and clip operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.operators import entities, gate, reports, select, timeline, topics

from .catalog import register
from .common import SAMPLES_SQL, samples, segments, table


def _customers(spark, sf_dir):
    """customer as a store: use_case_id, name, objective, business_rules, version."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("UC-"), F.col("c_custkey").cast("string")).alias("use_case_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("objective"), F.array(F.lit("b"), F.col("c_mktsegment")).alias("business_rules"), F.when(F.col("c_custkey") % 2 == 0, 1).alias("version"))


_STORE = "WITH st AS (SELECT c_custkey, 'UC-' || CAST(c_custkey AS VARCHAR) AS use_case_id, c_name AS name, c_mktsegment AS objective, ['b', c_mktsegment] AS rules, CASE WHEN c_custkey % 2 = 0 THEN 1 END AS version FROM customer)"


def _changes(spark, sf_dir):
    c = _customers(spark, sf_dir).where(F.substring_index("use_case_id", "-", -1).cast("long") % 3 == 0)
    return c.select("use_case_id", F.lit("new").alias("reason"), F.lit(None).cast("string").alias("name"), F.concat(F.lit("more "), "objective").alias("objective"), F.array(F.lit("a"), F.lit("b")).alias("business_rules"))


@register("update_use_cases", _STORE + """ SELECT use_case_id, name, CASE WHEN c_custkey % 3 = 0 THEN 'more ' || objective ELSE objective END AS objective,
  CASE WHEN c_custkey % 3 = 0 THEN array_to_string(list_sort(list_distinct(['a', 'b', objective])), ',') ELSE array_to_string(rules, ',') END AS rules,
  CASE WHEN c_custkey % 3 = 0 THEN coalesce(version, 1) + 1 ELSE coalesce(version, 0) END AS version FROM st""")
def update_use_cases(spark, sf_dir):
    new, _ = entities.update_use_cases(_customers(spark, sf_dir), _changes(spark, sf_dir), F.lit("2024-01-01"))
    return new.select("use_case_id", "name", "objective", F.array_join("business_rules", ",").alias("rules"), F.coalesce("version", F.lit(0)).alias("version"))


@register("update_audit", _STORE + " SELECT '2024-01-01' AS date, 'UPDATED' AS action, use_case_id AS entity, 'new' AS reason, name AS name_before, objective AS objective_before FROM st WHERE c_custkey % 3 = 0")
def update_audit(spark, sf_dir):
    _, audit = entities.update_use_cases(_customers(spark, sf_dir), _changes(spark, sf_dir), F.lit("2024-01-01"))
    return audit.select("date", "action", "entity", "reason", F.get_json_object("previous", "$.name").alias("name_before"), F.get_json_object("previous", "$.objective").alias("objective_before"))


def _evidence(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    store = _customers(spark, sf_dir).where(F.substring_index("use_case_id", "-", -1).cast("long") % 5 != 0).withColumn("evidence", F.array(F.lit("first")))
    more = o.select(F.concat(F.lit("UC-"), F.col("o_custkey").cast("string")).alias("use_case_id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("item"))
    return entities.add_evidence(store, more)


@register("add_evidence", """SELECT 'UC-' || CAST(c_custkey AS VARCHAR) AS use_case_id, 'first' || coalesce((SELECT string_agg(',o' || CAST(o_orderkey AS VARCHAR), '' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') AS evidence FROM customer WHERE c_custkey % 5 <> 0""")
def add_evidence(spark, sf_dir):
    store, _ = _evidence(spark, sf_dir)
    return store.select("use_case_id", F.array_join("evidence", ",").alias("evidence"))


@register("evidence_left_over", "SELECT 'UC-' || CAST(o_custkey AS VARCHAR) AS use_case_id, o_orderkey AS ord FROM orders WHERE o_custkey % 5 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer)")
def evidence_left_over(spark, sf_dir):
    _, left = _evidence(spark, sf_dir)
    return left.select("use_case_id", "ord")


@register("upsert", "SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name FROM supplier")
def upsert(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return entities.upsert(old, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")), "key")


@register("audit_rows", "SELECT '2024-01-01' AS date, 'CREATED' AS action, c_name AS entity, 'row ' || CAST(c_custkey AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS previous FROM customer")
def audit_rows(spark, sf_dir):
    return entities.audit_of(table(spark, sf_dir, "customer"), "CREATED", "c_name", F.concat(F.lit("row "), F.col("c_custkey").cast("string")), F.lit("2024-01-01"))


@register("audit_history", "SELECT c_custkey AS entity, c_name AS reason FROM customer WHERE c_custkey = 7")
def audit_history(spark, sf_dir):
    return reports.history(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("reason")), 7)


@register("next_ids", "SELECT s_name AS name, printf('UC-%03d', row_number() OVER (ORDER BY s_suppkey) + (SELECT max(c_custkey) FROM customer)) AS use_case_id FROM supplier")
def next_ids(spark, sf_dir):
    new = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    return entities.next_ids(new, _customers(spark, sf_dir), "use_case_id", "UC", ["s_suppkey"]).select("name", "use_case_id")


@register("added_use_cases", """SELECT s_suppkey AS cand_id, CASE WHEN s_suppkey % 4 IN (0, 1) THEN 'UC-' || CAST(s_suppkey AS VARCHAR) ELSE
  printf('UC-%03d', (SELECT max(c_custkey) FROM customer) + row_number() OVER (PARTITION BY s_suppkey % 4 IN (0, 1) ORDER BY s_suppkey)) END AS use_case_id, s_suppkey % 4 NOT IN (0, 1) AS created FROM supplier""")
def added_use_cases(spark, sf_dir):
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cand_id"), "s_name")
    status = F.element_at(F.array(*map(F.lit, ("DUPLICATE", "EXISTING", "RELATED", "NEW"))), (F.col("cand_id") % 4).cast("int") + 1)
    matches = new.select("cand_id", status.alias("status"), F.when(F.col("cand_id") % 4 < 3, F.concat(F.lit("UC-"), F.col("cand_id").cast("string"))).alias("use_case_id"))
    fresh, evidence = reports.added_use_cases(new, matches, _customers(spark, sf_dir))
    return fresh.select("cand_id", "use_case_id", F.lit(True).alias("created")).union(evidence.select("cand_id", "use_case_id", F.lit(False)))


@register("register_videos", "SELECT CAST(p_partkey AS VARCHAR) AS video_id, p_name AS file_name, CASE WHEN p_partkey % 2 = 0 THEN 'old' ELSE 'new' END AS seen FROM part")
def register_videos(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("video_id"), F.col("p_name").alias("file_name"), "p_partkey")
    known = p.where("p_partkey % 2 = 0").drop("p_partkey").withColumn("seen", F.lit("old"))
    new = p.drop("p_partkey").withColumn("seen", F.lit("new"))
    return entities.register_videos(known, new.union(new))


@register("next_versions", """WITH f AS (SELECT p_brand, count(*) AS n, max(p_partkey) AS last FROM part GROUP BY 1)
SELECT p_brand, 'NEW_VERSION' AS status, CAST(last AS VARCHAR) AS match, CAST(last % 3 + 2 AS INTEGER) AS suggested_version FROM f""")
def next_versions(spark, sf_dir):
    name = F.concat(F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), F.lit("_v"), F.col("p_partkey").cast("string"), F.lit(".mp4"))
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("video_id"), name.alias("file_name"), F.lit(0.0).alias("duration_seconds"), (F.col("p_partkey") % 3 + 1).cast("int").alias("version"), F.col("p_partkey").alias("ord"))
    new = table(spark, sf_dir, "part").select("p_brand").distinct()
    new = new.select(F.concat(F.lit("x"), "p_brand").alias("video_id"), F.concat(F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), F.lit(" final.mp4")).alias("file_name"), F.lit(5.0).alias("duration_seconds"), "p_brand")
    return entities.classify_videos(new, known, latest_is_last=True).select("p_brand", "status", "match", "suggested_version")


@register("may_process", """SELECT o_orderkey, o_orderstatus AS status, NOT (o_orderstatus = 'F' AND o_custkey IN (SELECT s_suppkey FROM supplier)) AS process FROM orders""")
def may_process(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "EXACT_DUPLICATE").otherwise(F.col("o_orderstatus"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), F.col("o_custkey").alias("match"))
    claims = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("video"))
    out = reports.may_process(o, claims.union(claims))
    return out.select("o_orderkey", F.when(F.col("status") == "EXACT_DUPLICATE", "F").otherwise(F.col("status")).alias("status"), "process")


@register("deletable", """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN 'BLOCKED_NOT_REGISTERED' WHEN l_suppkey % 4 = 0 THEN 'BLOCKED_NOT_PROCESSED' WHEN l_linenumber > 5 THEN 'BLOCKED_NEW_CASES'
  WHEN l_returnflag = 'R' THEN 'SKIP_ABSENT' WHEN l_linestatus = 'O' THEN 'DRY_RUN' ELSE 'DELETE' END AS decision FROM lineitem""")
def deletable(spark, sf_dir):
    cases = F.when(F.col("l_linenumber") > 5, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    v = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") % 5 != 0).alias("registered"), (F.col("l_suppkey") % 4 != 0).alias("processed"), cases.alias("new_cases"),
        (F.col("l_returnflag") != "R").alias("present"), (F.col("l_linestatus") != "O").alias("confirmed"),
    )
    return entities.deletable(v).select("l_orderkey", "l_linenumber", "decision")


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(replace(replace(replace(lower({0}), 'grabación', ''), 'grabacion', ''), 'demo', ''), '[^a-z0-9]+'), lambda x: x <> ''))"


@register("most_specific", f"""WITH o AS (SELECT p_partkey, {_TOKENS.format("p_name || ' ' || p_type || ' ' || p_brand")} AS ot FROM part),
n AS (SELECT DISTINCT p_type AS source FROM part UNION SELECT DISTINCT p_type || ' ' || p_brand FROM part),
s AS (SELECT source, {_TOKENS.format("source")} AS st FROM n),
c AS (SELECT p_partkey, source, st FROM o JOIN s ON len(st) > 0 AND list_has_all(ot, st))
SELECT p_partkey, source FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.p_partkey = a.p_partkey AND len(b.st) > len(a.st) AND list_has_all(b.st, a.st))""")
def most_specific(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    names = p.select(F.col("p_type").alias("source")).union(p.select(F.concat_ws(" ", "p_type", "p_brand"))).distinct()
    outputs = p.select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("output"))
    return entities.most_specific(outputs, names.withColumn("name", F.col("source")), "p_partkey", "output", "source", "name")


@register("missing_outputs", """WITH p AS (SELECT *, CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN '-jira' ELSE '-xyz' END AS slug FROM part WHERE p_partkey % 7 <> 0)
SELECT 'Capsula-' || slug || '-01-02-2024.mp4' AS output, slug, CASE WHEN p_partkey % 2 = 0 THEN 'Jira / HDU' ELSE '(sin clasificar)' END AS topic, 'auto-descubierto' AS origin FROM p""")
def missing_outputs(spark, sf_dir):
    name = F.concat(F.lit("Capsula-"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "-jira").otherwise("-xyz"), F.lit("-01-02-2024.mp4")).alias("output")
    p = table(spark, sf_dir, "part")
    return entities.missing_outputs(p.where("p_partkey % 7 = 0").select(name).distinct(), p.select(name))


@register("covered_topics", "SELECT coalesce(t.topic, 'API / Mesa') AS topic, min_by(output, o) AS output FROM (SELECT c_mktsegment AS topic, c_name AS output, c_custkey AS o FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT NULL, c_name, c_custkey FROM customer WHERE c_custkey % 10 = 0) t GROUP BY 1")
def covered_topics(spark, sf_dir):
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    outputs = table(spark, sf_dir, "customer").select(F.when(k % 10 != 0, F.col("c_mktsegment")).otherwise(none).alias("topic"), F.lit("api-x").alias("slug"), F.col("c_name").alias("output"), k.alias("o"))
    lost = outputs.select(F.lit("(sin clasificar)").alias("topic"), "slug", "output", "o")
    return topics.covered_topics(outputs.union(lost), "o")


@register("discovery_matrix", """SELECT user_id, event_type AS topic, strftime(make_timestamp(CAST(min(seconds) - m AS BIGINT) * 1000000), '%H:%M:%S') AS "from", strftime(make_timestamp(CAST(min(seconds) - m + count(*) AS BIGINT) * 1000000), '%H:%M:%S') AS "to", count(*) AS mentions, count(*) > 2 AS asked, count(*) > 3 AS intended
FROM (SELECT user_id, event_type, epoch_us(ts) // 86400000000 * 0 + epoch_us(ts) // 1000000 % 80000 AS seconds, 0 AS m FROM events) GROUP BY user_id, event_type, m""")
def discovery_matrix(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("topic"), (F.unix_seconds(F.col("ts").cast("timestamp")) % 80000).alias("s"))
    cases = e.groupBy("user_id", "topic").agg(F.min("s").alias("start"), F.count(F.lit(1)).alias("mentions"))
    cases = cases.withColumn("end", F.col("start") + F.col("mentions"))
    cases = cases.withColumn("question", F.when(F.col("mentions") > 2, "q").otherwise("")).withColumn("intent", F.when(F.col("mentions") > 3, "i").otherwise(""))
    return reports.discovery_matrix(cases, ["user_id"])


@register("video_report", """WITH v AS (SELECT c_custkey AS video FROM customer),
k AS (SELECT o_custkey AS video, o_orderpriority AS topic, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE 'weak' END AS focus FROM orders),
m AS (SELECT o_custkey AS video, o_orderstatus AS output FROM orders WHERE o_orderkey % 3 = 0),
a AS (SELECT video, list_sort(list_distinct(list(topic))) AS t, coalesce(list_sort(list_distinct(list(topic) FILTER (focus = 'new'))), []) AS new_cases FROM k GROUP BY 1),
b AS (SELECT video, list_sort(list_distinct(list(output))) AS outputs, list_distinct(list('topic ' || output)) AS t FROM m GROUP BY 1)
SELECT v.video, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.t, []), coalesce(b.t, [])))), ',') AS objective, array_to_string(coalesce(outputs, []), ',') AS outputs, array_to_string(coalesce(new_cases, []), ',') AS new_cases,
  a.video IS NOT NULL OR b.video IS NOT NULL AS processed, (a.video IS NOT NULL OR b.video IS NOT NULL) AND len(coalesce(new_cases, [])) = 0 AS nothing_new FROM v LEFT JOIN a USING (video) LEFT JOIN b USING (video)""")
def video_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    videos = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video"))
    cases = o.select(F.col("o_custkey").alias("video"), F.col("o_orderpriority").alias("topic"), F.when(F.col("o_orderkey") % 4 == 0, "new").otherwise("weak").alias("focus"))
    claims = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("video"), F.col("o_orderstatus").alias("output"))
    outputs = o.select(F.col("o_orderstatus").alias("output")).distinct().withColumn("topic", F.concat(F.lit("topic "), "output"))
    out = reports.video_report(videos, cases, claims, outputs)
    return out.select("video", *[F.array_join(c, ",").alias(c) for c in ("objective", "outputs", "new_cases")], "processed", "nothing_new")


@register("verify_files", """WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag <> 'R' AS there, l_quantity * 8 AS s, CASE WHEN l_linenumber = 3 THEN 640 ELSE 1280 END AS w, CASE WHEN l_linenumber = 4 THEN 'vp9' ELSE 'h264' END AS v, CASE WHEN l_linenumber = 5 THEN NULL ELSE 'aac' END AS a, CASE WHEN l_linenumber = 6 THEN 2 ELSE 0 END AS p FROM lineitem),
f AS (SELECT *, NOT there OR s > 300 OR w <> 1280 OR v <> 'h264' OR a IS NULL OR p > 0 AS bad FROM c)
SELECT l_orderkey, l_linenumber, CASE WHEN bad THEN 'FAIL' WHEN s < 45 THEN 'WARN' ELSE 'PASS' END AS verdict,
  CASE WHEN NOT there THEN 1 WHEN bad THEN CAST(s > 300 AS INTEGER) + CAST(w <> 1280 AS INTEGER) + CAST(v <> 'h264' AS INTEGER) + CAST(a IS NULL AS INTEGER) + CAST(p > 0 AS INTEGER) WHEN s < 45 THEN 1 ELSE 0 END AS n_reasons FROM f""")
def verify_files(spark, sf_dir):
    n = F.col("l_linenumber")
    checks = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_returnflag") != "R").alias("exists"), (F.col("l_quantity") * 8).alias("seconds"), F.when(n == 3, 640).otherwise(1280).alias("width"), F.lit(720).alias("height"),
        F.when(n == 4, "vp9").otherwise("h264").alias("vcodec"), F.when(n != 5, "aac").alias("acodec"), F.when(n == 6, 2).otherwise(0).alias("people_samples"),
    )
    return gate.verify(checks).select("l_orderkey", "l_linenumber", "verdict", F.size("reasons").alias("n_reasons"))


@register("skin_summary", "SELECT l_orderkey, max(l_discount) AS skin_max, count(*) FILTER (l_discount >= 0.045) AS people_samples, count(*) AS samples FROM lineitem GROUP BY 1")
def skin_summary(spark, sf_dir):
    return gate.skin_summary(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_discount")


@register("rms", "SELECT l_suppkey, round(sqrt(avg(l_quantity * l_quantity)), 6) AS rms FROM lineitem GROUP BY 1")
def rms(spark, sf_dir):
    return gate.rms(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity").withColumn("rms", F.round("rms", 6))


_POOL = "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'teams' WHEN l_returnflag = 'A' THEN 'excel' ELSE 'otro' END AS artifact, l_discount AS skin FROM lineitem"


def _moments(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "R", "teams").when(F.col("l_returnflag") == "A", "excel").otherwise("otro")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("artifact"), F.col("l_discount").alias("skin"))


@register("screen_pool", f"""WITH c AS (SELECT * FROM ({_POOL}) WHERE artifact <> 'teams' AND skin < 0.045), k AS (SELECT *, bool_or(artifact = 'excel') OVER (PARTITION BY l_orderkey) AS screens FROM c)
SELECT l_orderkey, l_linenumber, artifact, skin FROM k WHERE NOT screens OR artifact = 'excel'""")
def screen_pool(spark, sf_dir):
    return topics.screen_pool(_moments(spark, sf_dir), ["l_orderkey"])


@register("people_moments", f"SELECT l_orderkey, l_linenumber, artifact = 'teams' OR skin >= 0.045 AS people FROM ({_POOL})")
def people_moments(spark, sf_dir):
    return _moments(spark, sf_dir).select("l_orderkey", "l_linenumber", topics.has_people().alias("people"))


@register("probes", "SELECT o_orderkey, CAST(o_custkey + unnest([0.0, 2.5, 5.0, 7.5, 10.0]) AS DOUBLE) AS probe FROM orders")
def probes(spark, sf_dir):
    return timeline.probes(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("s")), "s").select("o_orderkey", "probe")


@register("import_clock", f"WITH s AS ({SAMPLES_SQL}) SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS DOUBLE) ELSE t END AS t FROM s")
def import_clock(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("t", F.when(F.col("event_type") != "click", F.col("t")))
    return timeline.import_clock(s, ["user_id"], ["event_id"], "t").select("user_id", "event_id", "t")


@register("longest_phrase", """WITH i AS (SELECT DISTINCT conv_id AS track, unnest([0, 1]) AS k FROM conversations), s AS (SELECT conv_id AS track, turn AS ord, turn * 30.0 AS start, text FROM conversations),
r AS (SELECT i.track, k, text, row_number() OVER (PARTITION BY i.track, k ORDER BY length(text) DESC, ord, text) AS n FROM i JOIN s ON s.track = i.track AND start >= k * 60.0 - 1 AND start < k * 60.0 + 60.0)
SELECT track, k, text FROM r WHERE n = 1""")
def longest_phrase(spark, sf_dir):
    s = segments(spark, sf_dir)
    spans = s.select("track").distinct().withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("lo", F.col("k") * 60.0).withColumn("hi", F.col("lo") + 60.0)
    return timeline.longest_phrase(s, spans, ["track"], ["k"])


@register("clips", "WITH c AS (SELECT o_orderkey, o_custkey * 0.1 AS moment, CAST(5.0 AS DOUBLE) AS low, CAST(12 + o_orderkey % 40 AS DOUBLE) AS high FROM orders), s AS (SELECT *, least(greatest(low, moment - 0.6), greatest(low, high - 6.0)) AS start FROM c) SELECT o_orderkey, start, least(high, start + 6.0) AS \"end\" FROM s WHERE least(high, start + 6.0) - start >= 1.0")
def clips(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 0.1).alias("at"), (F.col("o_orderkey") % 40 + 12).cast("double").alias("high"))
    return select.clips(o, "at", F.lit(5.0), F.col("high")).select("o_orderkey", "start", "end")


@register("lengthened_clips", """WITH c AS (SELECT l_orderkey, l_linenumber, l_linenumber * 20.0 AS start, l_linenumber * 20.0 + l_quantity / 10 AS "end" FROM lineitem), w AS (SELECT *, sum("end" - start) OVER (PARTITION BY l_orderkey) AS have, count(*) OVER (PARTITION BY l_orderkey) AS n FROM c)
SELECT l_orderkey, l_linenumber, CAST(start AS DOUBLE) AS start, round(CASE WHEN have < 30 THEN start + least(14.0, 6.0 + (30 - have) / n) ELSE "end" END, 6) AS "end" FROM w""")
def lengthened_clips(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 20.0).alias("start"), (F.col("l_linenumber") * 20.0 + F.col("l_quantity") / 10).alias("end"))
    return select.lengthen(c, ["l_orderkey"], least=30.0, clip=6.0).withColumn("end", F.round("end", 6))


@register("fallback_clips", """WITH j AS (SELECT o_orderkey, unnest(range(1, 13)) AS j, CAST(20 + o_custkey AS DOUBLE) AS high FROM orders), s AS (SELECT *, greatest(2.0, least(2.0 + j * (high - 2.0) / 13, high - 6.0)) AS start FROM j)
SELECT o_orderkey, CAST(j AS INTEGER) AS j, start, least(high, start + 6.0) AS "end" FROM s""")
def fallback_clips(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + 20).cast("double").alias("high"))
    return select.fallback_clips(o, F.lit(2.0), F.col("high"), 6.0).select("o_orderkey", "j", "start", "end")


@register("manual_clips", """WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity + l_linenumber * 0.01 AS moment FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY moment) AS n FROM m)
SELECT l_orderkey, l_linenumber, greatest(0.0, least(moment, 34.0)) AS start, least(40.0, greatest(0.0, least(moment, 34.0)) + 6.0) AS "end" FROM r WHERE n <= 3""")
def manual_clips(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") + F.col("l_linenumber") * 0.01).alias("at"))
    return select.manual_clips(m, ["l_orderkey"], "at", F.lit(40.0), 6.0, 3).select("l_orderkey", "l_linenumber", "start", "end")


@register("nearest_clean", """WITH c AS (SELECT DISTINCT l_orderkey AS k, l_quantity * 3.0 AS at FROM lineitem), t AS (SELECT o_orderkey AS k, 60.0 AS clock, unnest(range(0, 81)) AS i FROM orders),
h AS (SELECT t.k, min_by(c.at, i) AS at FROM t JOIN c ON c.k = t.k AND c.at = 60.0 + CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * ceil(i / 2.0) * 3.0 GROUP BY 1) SELECT o_orderkey AS k, CAST(60.0 AS DOUBLE) AS clock, coalesce(h.at, 60.0) AS at FROM orders LEFT JOIN h ON h.k = o_orderkey""")
def nearest_clean(spark, sf_dir):
    marks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(60.0).alias("clock"))
    clean = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_quantity") * 3.0).alias("at"))
    return select.nearest_clean(marks, clean, ["k"], "clock")
