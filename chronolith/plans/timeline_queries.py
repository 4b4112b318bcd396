"""Registered queries of the timeline and selection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.operators import select, timeline

from .catalog import register
from .common import SAMPLES_SQL, samples, table

#: Thresholds for the events table: values are amounts, and a user's events are hours apart.
CHANGE, DEAD, DEAD_HOURS, TYPING, SHORT_HOURS = 40.0, 10.0, 24.0, 5.0, 6.0

_CHANGE_SQL = f"""s0 AS ({SAMPLES_SQL}),
s AS (SELECT *, coalesce(abs(value - lag(value) OVER w), 255.0) AS change, row_number() OVER w AS rn FROM s0 WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))"""
_STEPS_SQL = f"""WITH {_CHANGE_SQL},
m AS (SELECT *, (change >= {CHANGE} OR rn = 1) AS opens, sum(CASE WHEN change >= {CHANGE} OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS raw FROM s),
g AS (SELECT user_id, raw, min(t) AS start, max(t) AS lst, coalesce(max(CASE WHEN NOT opens THEN change END), 0.0) AS change,
  coalesce(avg(CASE WHEN NOT opens THEN CASE WHEN change >= {TYPING} THEN 1.0 ELSE 0.0 END END), 0.0) AS activity FROM m GROUP BY 1, 2),
e AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY user_id ORDER BY raw), lst + 1.0) AS "end" FROM g),
d AS (SELECT *, (change < {DEAD} AND activity < 0.15 AND greatest(0.0, "end" - start) >= {DEAD_HOURS}) AS dead FROM e),
j AS (SELECT *, (greatest(0.0, "end" - start) < {SHORT_HOURS} AND NOT dead AND NOT coalesce(lag(dead) OVER (PARTITION BY user_id ORDER BY raw), true)) AS joins FROM d),
i AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY raw ROWS UNBOUNDED PRECEDING) AS island FROM j),
steps AS (SELECT user_id, CAST(island AS INTEGER) AS "index", min(start) AS start, max("end") AS "end", arg_min(change, raw) AS change, arg_min(activity, raw) AS activity, arg_min(dead, raw) AS dead
  FROM i GROUP BY user_id, island)"""


def _changes(spark, sf_dir):
    return timeline.change_from_previous(samples(spark, sf_dir), ["user_id"], ["t", "event_id"], "value")


def _steps(spark, sf_dir):
    return timeline.steps(_changes(spark, sf_dir), ["user_id"], ["t", "event_id"], "t", sample_seconds=1.0, threshold=CHANGE, dead_change=DEAD, dead_seconds=DEAD_HOURS, typing=TYPING, min_step=SHORT_HOURS)


def _rounded(df, *columns):
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


@register("timeline_steps", _STEPS_SQL + """ SELECT user_id, "index", round(start, 6) AS start, round("end", 6) AS "end", round(change, 6) AS change, round(activity, 6) AS activity, dead FROM steps""")
def timeline_steps(spark, sf_dir):
    return _rounded(_steps(spark, sf_dir), "start", "end", "change", "activity")


@register("steps_in_range", _STEPS_SQL + f""", lo AS (SELECT user_id, min(start) AS a FROM steps GROUP BY 1)
SELECT user_id, "index", round(start, 6) AS start, round("end", 6) AS "end" FROM steps JOIN lo USING (user_id)
WHERE NOT dead AND "end" > a + 24 AND start < a + 480 AND greatest(0.0, "end" - start) >= 2.0""")
def steps_in_range(spark, sf_dir):
    """Useful steps within a window of each track's own first days."""
    from pyspark.sql import Window

    found = _steps(spark, sf_dir).withColumn("a", F.min("start").over(Window.partitionBy("user_id")))
    shifted = found.withColumn("start", F.col("start") - F.col("a")).withColumn("end", F.col("end") - F.col("a"))
    kept = timeline.useful_steps(shifted, 24.0, 480.0, 2.0)
    return kept.select("user_id", "index", F.round(F.col("start") + F.col("a"), 6).alias("start"), F.round(F.col("end") + F.col("a"), 6).alias("end"))


@register("scene_lag", f"WITH {_CHANGE_SQL} SELECT user_id, event_id, round(change, 6) AS change FROM s WHERE change >= {CHANGE}")
def scene_lag(spark, sf_dir):
    return timeline.scenes(_changes(spark, sf_dir), CHANGE).select("user_id", "event_id", F.round("change", 6).alias("change"))


@register("scene_anchor", f"""WITH s AS ({SAMPLES_SQL}),
l AS (SELECT user_id, list(struct_pack(t := t, id := event_id, v := value) ORDER BY t, event_id) AS a FROM s GROUP BY 1),
k AS (SELECT user_id, list_reduce(a, lambda acc, m: CASE WHEN len(acc) = 0 OR (len(acc) < 80 AND abs(m.v - acc[-1].v) >= {CHANGE}) THEN list_append(acc, m) ELSE acc END, a[1:0]) AS kept FROM l),
u AS (SELECT user_id, unnest(kept) AS m FROM k)
SELECT user_id, m.id AS event_id, round(m.v, 6) AS value FROM u""")
def scene_anchor(spark, sf_dir):
    kept = select.anchored(samples(spark, sf_dir), ["user_id"], ["t", "event_id"], "value", CHANGE)
    return kept.select("user_id", "event_id", F.round("value", 6).alias("value"))


@register("spread_min_gap", f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rk FROM ({SAMPLES_SQL})),
l AS (SELECT user_id, list(struct_pack(rk := rk, t := t, id := event_id) ORDER BY rk) AS a FROM s GROUP BY 1),
k AS (SELECT user_id, list_reduce(a, lambda acc, m: CASE WHEN len(acc) < 14 AND len(list_filter(acc, lambda x: abs(x.t - m.t) < 36.0)) = 0 THEN list_append(acc, m) ELSE acc END, a[1:0]) AS kept FROM l),
u AS (SELECT user_id, unnest(kept) AS m FROM k)
SELECT user_id, m.id AS event_id FROM u""")
def spread_min_gap(spark, sf_dir):
    s = samples(spark, sf_dir).select("user_id", "event_id", "t")
    return select.spread(s, ["user_id"], "t", [F.col("t"), F.col("event_id")], 36.0, 14).select("user_id", "event_id")


@register("topk_min_gap", f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rk FROM ({SAMPLES_SQL})),
l AS (SELECT user_id, list(struct_pack(rk := rk, t := t, id := event_id) ORDER BY rk) AS a FROM s GROUP BY 1),
one AS (SELECT user_id, a, list_reduce(a, lambda acc, m: CASE WHEN len(acc) < 12 AND len(list_filter(acc, lambda x: abs(x.t - m.t) < 60.0)) = 0 THEN list_append(acc, m) ELSE acc END, a[1:0]) AS k1 FROM l),
two AS (SELECT user_id, k1, list_reduce(list_concat(list_transform(k1, lambda x: x), a), lambda acc, m: CASE WHEN len(acc) < 12 AND len(list_filter(acc, lambda x: abs(x.t - m.t) < 24.0)) = 0 THEN list_append(acc, m) ELSE acc END, a[1:0]) AS k2 FROM one),
u AS (SELECT user_id, unnest(k2) AS m, generate_subscripts(k2, 1) AS pick FROM two)
SELECT user_id, m.id AS event_id, CAST(pick AS INTEGER) AS pick FROM u""")
def topk_min_gap(spark, sf_dir):
    s = samples(spark, sf_dir).select("user_id", "event_id", "t", "value")
    return select.top_with_gap(s, ["user_id"], "t", "value", ["event_id"], gap=60.0, clip=6.0, most=12).select("user_id", "event_id", "pick")


@register("even_pick", f"""WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS m FROM ({SAMPLES_SQL})),
p AS (SELECT DISTINCT user_id, CAST(floor(k * m / 7.0) AS BIGINT) AS i FROM (SELECT DISTINCT user_id, m FROM s), range(0, 7) r(k) WHERE m > 7)
SELECT user_id, event_id FROM s WHERE m <= 7 OR (user_id, i) IN (SELECT user_id, i FROM p)""")
def even_pick(spark, sf_dir):
    return select.even_picks(samples(spark, sf_dir), ["user_id"], ["t", "event_id"], 7).select("user_id", "event_id")


@register("bucket_argmax", _STEPS_SQL + """, b1 AS (SELECT *, count(*) OVER p AS m, min(start) OVER p AS t0, last_value("end") OVER (PARTITION BY user_id ORDER BY start, "index" ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS t1,
  round(3 * activity + 0.2 + least("end" - start, 30.0) / 60.0, 9) AS score FROM steps WINDOW p AS (PARTITION BY user_id)),
b2 AS (SELECT *, floor((start - t0) / greatest(1e-6, t1 - t0) * 5) AS bucket FROM b1),
b3 AS (SELECT *, (bucket BETWEEN 0 AND 4 AND row_number() OVER (PARTITION BY user_id, bucket ORDER BY score DESC, start, "index") = 1) AS best FROM b2),
b4 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY best DESC, CASE WHEN NOT best THEN activity END DESC NULLS LAST, start, "index") AS place FROM b3)
SELECT user_id, "index" FROM b4 WHERE m <= 5 OR place <= 5""")
def bucket_argmax(spark, sf_dir):
    score = F.round(3 * F.col("activity") + 0.2 + F.least(F.col("end") - F.col("start"), F.lit(30.0)) / 60.0, 9)
    return select.best_of_windows(_steps(spark, sf_dir), ["user_id"], "start", "end", score, F.col("activity"), 5, ["index"]).select("user_id", "index")


@register("budget_pack", _STEPS_SQL + """, l AS (SELECT user_id, list(struct_pack(i := "index", len := round("end" - start, 6)) ORDER BY "index") AS a FROM steps GROUP BY 1),
f AS (SELECT user_id, list_reduce(list_concat([struct_pack(i := CAST(-1 AS INTEGER), len := CAST(0.0 AS DOUBLE), used := CAST(0.0 AS DOUBLE), kept := CAST([] AS STRUCT(i INTEGER, taken DOUBLE)[]))],
    list_transform(a, lambda x: struct_pack(i := x.i, len := x.len, used := CAST(0.0 AS DOUBLE), kept := CAST([] AS STRUCT(i INTEGER, taken DOUBLE)[])))),
  lambda acc, m: CASE WHEN acc.used < 200.0 AND 200.0 - acc.used >= 3.0 AND least(24.0, 200.0 - acc.used, m.len) >= 3.0
    THEN struct_pack(i := m.i, len := m.len, used := acc.used + least(24.0, 200.0 - acc.used, m.len), kept := list_append(acc.kept, struct_pack(i := m.i, taken := least(24.0, 200.0 - acc.used, m.len)))) ELSE acc END) AS r FROM l),
u AS (SELECT user_id, unnest(r.kept) AS k FROM f)
SELECT user_id, k.i AS "index", round(k.taken, 6) AS taken FROM u""")
def budget_pack(spark, sf_dir):
    found = _steps(spark, sf_dir).withColumn("len", F.round(F.col("end") - F.col("start"), 6)).select("user_id", "index", "len")
    return select.pack(found, ["user_id"], ["index"], "len", per=24.0, budget=200.0).select("user_id", "index", F.round("taken", 6).alias("taken"))


@register("asof_nearest", f"""WITH s AS ({SAMPLES_SQL}), c AS (SELECT * FROM s WHERE event_type = 'click'), v AS (SELECT * FROM s WHERE event_type = 'view'),
p AS (SELECT c.user_id, c.event_id, v.event_id AS view_id, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(v.seconds - c.seconds), v.event_id) AS rn FROM c LEFT JOIN v USING (user_id))
SELECT user_id, event_id, view_id FROM p WHERE rn = 1""")
def asof_nearest(spark, sf_dir):
    s = samples(spark, sf_dir)
    left = s.where("event_type = 'click'").select("user_id", "event_id", "seconds")
    right = s.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("seconds").alias("at"))
    return timeline.nearest(left, right, ["user_id"], "seconds", "at", "view_id", ["view_id"]).select("user_id", "event_id", "view_id")


@register("range_join", f"""WITH s AS ({SAMPLES_SQL}), i AS (SELECT user_id, event_id AS buy_id, t - 12 AS a, t + 12 AS b FROM s WHERE event_type = 'purchase')
SELECT s.user_id, buy_id, event_id FROM s JOIN i ON s.user_id = i.user_id AND t BETWEEN a - 5 AND b + 5 WHERE event_type = 'click'""")
def range_join(spark, sf_dir):
    s = samples(spark, sf_dir)
    windows = s.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy_id"), (F.col("t") - 12).alias("a"), (F.col("t") + 12).alias("b"))
    points = s.where("event_type = 'click'").select("user_id", "event_id", "t")
    return timeline.within(points, windows, ["user_id"], "t", "a", "b", 5.0, 24.0).select("user_id", "buy_id", "event_id")


@register("ordered_union", f"""WITH s AS ({SAMPLES_SQL}), u AS (SELECT user_id, event_id, seconds, 0 AS r FROM s WHERE event_type = 'view' UNION ALL SELECT user_id, event_id, seconds, 1 FROM s WHERE event_type = 'error')
SELECT user_id, event_id, CASE r WHEN 0 THEN 'audio' ELSE 'visual' END AS source, CAST(row_number() OVER (PARTITION BY user_id ORDER BY seconds, r, event_id) AS INTEGER) AS place FROM u""")
def ordered_union(spark, sf_dir):
    from pyspark.sql import Window

    s = samples(spark, sf_dir).select(F.col("user_id").alias("track"), F.col("seconds").alias("ts"), F.col("event_id").alias("ord"), F.lit("").alias("text"), "event_type")
    merged = timeline.merged_timeline(s.where("event_type = 'view'"), s.where("event_type = 'error'"))
    place = F.row_number().over(Window.partitionBy("track").orderBy("ts", "rank", "ord"))
    return merged.select(F.col("track").alias("user_id"), F.col("ord").alias("event_id"), "source", place.alias("place"))


@register("item_offsets", "SELECT o_custkey, o_orderkey, round(coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 2) AS \"offset\" FROM orders")
def item_offsets(spark, sf_dir):
    out = timeline.offsets(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice")
    return out.select("o_custkey", "o_orderkey", F.round("offset", 2).alias("offset"))


@register("three_acts", """WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n,
  min(epoch_us(o_orderdate)) OVER (PARTITION BY o_custkey) AS a, max(epoch_us(o_orderdate)) OVER (PARTITION BY o_custkey) AS b FROM orders),
p AS (SELECT *, CASE WHEN (d - a) / greatest(1.0, b - a) < 1.0 / 3 THEN 0 WHEN (d - a) / greatest(1.0, b - a) < 2.0 / 3 THEN 1 ELSE 2 END AS place FROM o),
k AS (SELECT o_custkey, count(DISTINCT place) AS kinds FROM p GROUP BY 1)
SELECT o_custkey, o_orderkey, CAST(CASE WHEN n >= 3 AND kinds < 3 THEN least(2, floor(i / greatest(1, floor(n / 3)))) ELSE place END AS INTEGER) AS act FROM p JOIN k USING (o_custkey)""")
def three_acts(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    o = table(spark, sf_dir, "orders").withColumn("d", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    a, b = F.min("d").over(w), F.max("d").over(w)
    o = o.withColumn("p", (F.col("d") - a) / F.greatest(F.lit(1.0), (b - a).cast("double")))
    return timeline.acts(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("p")).select("o_custkey", "o_orderkey", "act")


@register("chapters", f"""WITH d AS (SELECT user_id, max(seconds) - min(seconds) AS len FROM ({SAMPLES_SQL}) GROUP BY 1),
k AS (SELECT *, CAST(greatest(1, least(6, floor(len / 720000.0 + 0.5))) AS INTEGER) AS n FROM d),
c AS (SELECT *, unnest(range(0, n)) AS c FROM k)
SELECT user_id, CAST(c AS INTEGER) AS chapter, round(c * (len / n), 3) AS start, round(CASE WHEN c < n - 1 THEN (c + 1) * (len / n) ELSE len END, 3) AS "end" FROM c""")
def chapters(spark, sf_dir):
    lengths = samples(spark, sf_dir).groupBy("user_id").agg((F.max("seconds") - F.min("seconds")).alias("len"))
    return timeline.chapters(lengths, "len", minutes=12_000.0).select("user_id", "chapter", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@register("novel_vectors", """WITH RECURSIVE v AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
r AS (
  SELECT label, CAST(1 AS BIGINT) AS n, [e] AS kept, [vec_id] AS ids FROM v WHERE n = 1
  UNION ALL
  SELECT r.label, v.n,
    CASE WHEN len(r.kept) < 20 AND len(list_filter(r.kept, lambda k: list_sum(list_transform(range(1, len(k) + 1), lambda i: abs(k[i] - v.e[i]))) / len(k) < 0.9)) = 0 THEN list_append(r.kept, v.e) ELSE r.kept END,
    CASE WHEN len(r.kept) < 20 AND len(list_filter(r.kept, lambda k: list_sum(list_transform(range(1, len(k) + 1), lambda i: abs(k[i] - v.e[i]))) / len(k) < 0.9)) = 0 THEN list_append(r.ids, v.vec_id) ELSE r.ids END
  FROM r JOIN v ON v.label = r.label AND v.n = r.n + 1)
SELECT label, unnest(ids) AS vec_id FROM r WHERE (label, n) IN (SELECT label, max(n) FROM v GROUP BY 1)""")
def novel_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return select.novel(v, ["label"], "vec_id", "embedding", 0.9, 20).select("label", "vec_id")


@register("window_people", f"""WITH s AS ({SAMPLES_SQL}), f AS (SELECT user_id, t, arg_min(value, event_id) AS value FROM s GROUP BY 1, 2),
w AS (SELECT user_id, event_id, t AS a FROM s WHERE event_type = 'purchase'),
p AS (SELECT user_id, event_id, a + k AS probe FROM w, (VALUES (CAST(0.0 AS DOUBLE)), (6.0), (12.0), (18.0), (24.0)) v(k))
SELECT p.user_id, p.event_id, round(max(f.value), 6) AS most FROM p ASOF LEFT JOIN f ON p.user_id = f.user_id AND p.probe <= f.t GROUP BY 1, 2""")
def window_people(spark, sf_dir):
    s = samples(spark, sf_dir)
    windows = s.where("event_type = 'purchase'").select("user_id", "event_id", F.col("t").alias("a"))
    found = timeline.most_at_probes(windows, s, ["user_id"], "a", "t", "event_id", "value", length=24.0, n=5)
    return found.select("user_id", "event_id", F.round("most", 6).alias("most"))


@register("candidates_in_window", f"WITH s AS ({SAMPLES_SQL}), m AS (SELECT user_id, min(t) AS a FROM s GROUP BY 1) SELECT user_id, event_id FROM s JOIN m USING (user_id) WHERE t >= a + 24.0 AND t < a + 240.0")
def candidates_in_window(spark, sf_dir):
    s = samples(spark, sf_dir)
    s = s.join(s.groupBy("user_id").agg(F.min("t").alias("a")), "user_id")
    return timeline.in_window(s, "t", F.col("a") + 24.0, F.col("a") + 240.0).select("user_id", "event_id")


@register("clip_budgets", f"WITH d AS (SELECT user_id, (max(seconds) - min(seconds)) / 10000.0 AS len FROM ({SAMPLES_SQL}) GROUP BY 1) SELECT user_id, CAST(greatest(1, floor(greatest(0.0, len - 6.4) / 6.0)) AS INTEGER) AS clips FROM d")
def clip_budgets(spark, sf_dir):
    lengths = samples(spark, sf_dir).groupBy("user_id").agg(((F.max("seconds") - F.min("seconds")) / 10000.0).alias("len"))
    return lengths.select("user_id", select.clip_budget(F.col("len")).alias("clips"))


@register("listed_names", "SELECT c_name AS name FROM customer UNION SELECT s_name FROM supplier UNION SELECT n_name FROM nation")
def listed_names(spark, sf_dir):
    return timeline.listed(*[table(spark, sf_dir, t).select(F.col(c).alias("name")) for t, c in (("customer", "c_name"), ("supplier", "s_name"), ("nation", "n_name"))])
