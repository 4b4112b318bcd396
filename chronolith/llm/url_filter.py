"""URL filters with redirect equivalence. Native: DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table
from .graph import connected_components

#: (action, host, path) of the production rule set.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.coalesce(F.when(at > 0, F.translate(host, _UP, _LOW)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def query_of(url: Column) -> Column:
    """The query with its ``?``, up to ``#`` or the end, empty if there is none; null or no ``://``: empty."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)), F.lit(""))


def _fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    inside = (host == rule_host) | host.endswith("." + rule_host)
    return inside & path.startswith(rule_path)


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, action) of the longest fitting rule; null where none fits. Equal lengths: allow first, then order."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow"))
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule_host, rule_path in reversed(ranked):
        fits = _fits(host, path, rule_host, rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def link_targets(html: Column) -> Column:
    """Array of addresses that a page names as its canonical form or redirects to.

    A tag ends at the next ``>`` and has no ``<``, so an unclosed one costs no more than its own length.
    """
    links = F.regexp_extract_all(html, F.lit(r"(?is)(<link\b[^<>]*+>)"), F.lit(1))
    canonical = F.filter(links, lambda x: x.rlike(r"(?is)\brel\s*=\s*[\"']?canonical\b"))
    canonical = F.transform(canonical, lambda x: F.regexp_extract(x, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    metas = F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^<>]*+>)"), F.lit(1))
    refresh = F.filter(metas, lambda x: x.rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"))
    refresh = F.transform(refresh, lambda x: F.regexp_extract(x, r"(?is)\burl\s*=\s*['\"]?([^\"'\s>;]+)", 1))
    return F.coalesce(F.filter(F.concat(canonical, refresh), lambda x: x != ""), F.array().cast("array<string>"))


def alias_key(url: Column) -> Column:
    """What makes two addresses the same one: host, path and query."""
    return F.concat(host_of(url), path_of(url), query_of(url))


def resolved(target: Column, host: Column, path: Column, query: Column) -> Column:
    """The address that a reference on the page at ``host``, ``path`` and ``query`` means, without its fragment if relative.

    Null for schemes without ``//``. Dot segments of relative references are taken out, the base path's among them.
    """
    given = F.regexp_extract(target, r"^([^?#]*)", 1)
    asked = F.regexp_extract(target, r"^[^?#]*(\?[^#]*)", 1)
    whole = F.when(given.startswith("/"), given).otherwise(F.concat(F.regexp_extract(path, r"^(.*/)", 1), given))
    parts = F.split(F.regexp_replace(whole, r"^/", ""), "/")
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x)))
    left = F.aggregate(parts, F.array().cast("array<string>"), step)
    left = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(left, F.array(F.lit("")))).otherwise(left)
    same = F.concat(path, F.when(asked == "", query).otherwise(asked))
    there = F.when(given == "", same).otherwise(F.concat(F.lit("/"), F.array_join(left, "/"), asked))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(host != "", F.concat(F.lit("http://"), host, there))
    )


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url, html).

    A rule that fits decides. Where none fits, addresses joined by redirects or canonical links (directly or through
    others) share decisions: blocked if any alias is blocked by a rule, unless an alias is allowed by a rule, as an
    explicit allow has precedence; allowed otherwise. ``redirects`` may give more edges, columns ``source`` and
    ``target`` (addresses). Links may be relative to the page's url; base elements aren't read.

    Null or malformed urls have empty host and path, fit no rule and alias nothing: allowed. Repeated rows are judged
    alike, each in its own row. Null html has no links. An empty table gives an empty result.

    An address is its host, path and query, so pages of one path told apart by their query are no aliases.

    Scale: the html is read once, for links; what follows has narrow rows. Pages without links don't enter the component
    search; all pages are joined with the aliases that are blocked, with an exchange on either side unless these are few.
    """
    base = pick(pages, "page_id", "url", "html").withColumn("url", F.col("url").cast("string"))
    base = base.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "query": query_of(F.col("url"))})
    rule, action = best_rule(F.col("host"), F.col("path"), rules)

    linked = base.select("host", "path", "query", F.explode(link_targets(F.col("html").cast("string"))).alias("target"))
    address = resolved(F.col("target"), F.col("host"), F.col("path"), F.col("query"))
    edges = linked.select(F.concat("host", "path", "query").alias("a"), alias_key(address).alias("b"))
    if redirects is not None:
        more = pick(redirects, "source", "target")
        edges = edges.union(more.select(alias_key(F.col("source")).alias("a"), alias_key(F.col("target")).alias("b")))
    edges = edges.where("a <> '' and b <> ''")

    labels = connected_components(edges)
    # An alias that is no page of the table still carries the decision of its address.
    where = F.regexp_extract("node", r"^([^/?#]*)", 1), F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1)
    _, node_action = best_rule(*where, rules)
    decided = labels.select("node", "label", node_action.alias("node_action"))
    groups = decided.groupBy("label").agg(
        F.max(F.when(F.col("node_action") == "allow", 1).otherwise(0)).alias("any_allow"),
        F.max(F.when(F.col("node_action") == "block", 1).otherwise(0)).alias("any_block"),
    )
    spread = labels.join(groups.where("any_block = 1 and any_allow = 0"), "label").select("node", F.lit(True).alias("alias_block"))
    judged = base.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"), F.concat("host", "path", "query").alias("node"))
    judged = judged.join(spread, "node", "left")
    verdict = F.coalesce("action", F.when(F.col("alias_block"), F.lit("block")), F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every page under RULES, with the links that the pages themselves give."""
    return judge_urls(table(spark, sf_dir, "pages"))


def _address_sql(column: str) -> tuple[str, str, str]:
    rest = f"CASE WHEN strpos({column}, '://') > 0 THEN substr({column}, strpos({column}, '://') + 3) ELSE '' END"
    host = f"coalesce(translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{_UP}', '{_LOW}'), '')"
    return host, f"coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '')", f"coalesce(regexp_extract({rest}, '^[^?#]*(\\?[^#]*)', 1), '')"


def _rule_sql(host: str, path: str, what: int, rules=RULES) -> str:
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow"))
    arms = [f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{(h + p, act)[what]}'" for act, h, p in ranked]
    return "CASE " + " ".join(arms) + " END"


_HOST, _PATH, _QUERY = _address_sql("url")
_TO = " || ".join(_address_sql("target"))
#: The path segments that stay, joined by /: a fold that goes up at two dots.
_FOLD = "list_reduce(list_prepend('', str_split(regexp_replace(whole, '^/', ''), '/')), lambda acc, x: CASE WHEN x = '.' THEN acc WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || x END)"
ORACLE = rf"""
WITH RECURSIVE p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS query, coalesce(html, '') AS html FROM pages),
t AS (
  SELECT host, path, query, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(html, '(?is)<link\b[^<>]*>'), lambda x: regexp_matches(x, '(?is)\brel\s*=\s*["'']?canonical\b')), lambda x: regexp_extract(x, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\b[^<>]*>'), lambda x: regexp_matches(x, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')), lambda x: regexp_extract(x, '(?is)\burl\s*=\s*[''"]?([^"''\s>;]+)', 1)))) AS raw
  FROM p),
g AS (SELECT *, regexp_extract(raw, '^([^?#]*)', 1) AS given, regexp_extract(raw, '^[^?#]*(\?[^#]*)', 1) AS asked FROM t WHERE raw <> ''),
w AS (SELECT *, CASE WHEN starts_with(given, '/') THEN given ELSE regexp_extract(path, '^(.*/)', 1) || given END AS whole FROM g),
f AS (SELECT *, {_FOLD} || CASE WHEN regexp_matches(whole, '(^|/)[.][.]?$') THEN '/' ELSE '' END AS folded FROM w),
u AS (
  SELECT host || path || query AS a,
    CASE WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN raw WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(raw, '//') THEN 'http:' || raw
      WHEN host <> '' AND given = '' THEN 'http://' || host || path || CASE WHEN asked = '' THEN query ELSE asked END
      WHEN host <> '' THEN 'http://' || host || folded || asked END AS target
  FROM f),
e AS (SELECT a, {_TO} AS b FROM u WHERE target IS NOT NULL),
ways AS (SELECT a, b FROM e WHERE a <> '' AND b <> '' AND a <> b UNION SELECT b, a FROM e WHERE a <> '' AND b <> '' AND a <> b),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, x.b FROM reach r JOIN ways x ON r.b = x.a),
node AS (SELECT DISTINCT a, b, regexp_extract(b, '^([^/?#]*)', 1) AS h, regexp_extract(b, '^[^/?#]*([^?#]*)', 1) AS q FROM (SELECT a, b FROM reach UNION SELECT a, a FROM ways)),
act AS (SELECT a, {_rule_sql("h", "q", 1)} AS act FROM node),
alias AS (SELECT a FROM act GROUP BY a HAVING bool_or(act = 'block') AND NOT coalesce(bool_or(act = 'allow'), false)),
r AS (SELECT page_id, host, path, host || path || query AS node, {_rule_sql("host", "path", 0)} AS rule, {_rule_sql("host", "path", 1)} AS own FROM p)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN node IN (SELECT a FROM alias) THEN 'block' END, 'allow') AS verdict FROM r
"""
