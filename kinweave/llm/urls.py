"""Operator 7, URL filters: allow and block rules that reach every alias of a page.

Explicit rules fit a host with its subdomains and a path prefix; the longest
wins. Redirect and canonical-link edges join URLs into equivalence classes by
distributed connected components. A URL without a rule of its own is allowed
if some alias is explicitly allowed, else blocked if some alias is blocked,
else allowed. Null or ``://``-less URLs have an empty host and path, fit no rule
and have no alias. Built-in functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import free_name, table
from kinweave.operators.components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path prefix)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: Query keys that name where a visitor came from, not what the page shows.
TRACKING = r"(?:utm_\w+|ref|fbclid|gclid)"
CANONICAL_LINK = r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""
REFRESH_LINK = r"""(?i)url\s*=\s*["']?([^"'\s>;]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://((?s:.*))$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=None) -> Column:
    """The longest fitting rule as struct(rule, verdict); null if none fits."""
    whens = [
        F.when((host == h) | host.endswith("." + h), F.when(path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))))
        for v, h, p in sorted(rules or RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    ]
    return F.coalesce(*whens, F.lit(None).cast("struct<rule:string,verdict:string>"))


def resolve(link: Column, base: Column) -> Column:
    """A link of a page as an absolute URL: null where it names no other page (null, empty, ``#x``, ``mailto:x``)."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.concat(F.regexp_extract(path, r"^(.*)/", 1), F.lit("/"))
    own, rest = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    full = F.when(link.startswith("/"), own).otherwise(F.concat(folder, own))
    steps = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.lit(1), F.size(acc) - 1))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    plain = F.array_join(F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), steps), "/")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), link)
        .when((link == "") | link.startswith("#") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | (origin == ""), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(F.regexp_extract(origin, "^([^:]*:)", 1), link))
        .when(link.startswith("?"), F.concat(origin, path, link))
        .otherwise(F.concat(origin, plain, rest))
    )


def canonical(url: Column) -> Column:
    """The address that tracking keys, fragments, scheme, www/m hosts and endings do not change."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(f"^{TRACKING}=")))
    host = F.regexp_replace(host, r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), r"(?<=.)/$", "")
    return F.when(host != "", F.concat(F.lit("https://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``src, dst`` edges: a URL to its canonical form, its declared canonical link and its redirect.

    Relative links are resolved against the page's URL. Null URLs and null pages give none.
    """
    head = F.substring_index(F.coalesce(F.col(html), F.lit("")), "</head>", 1)
    tag = lambda mark: F.regexp_extract(head, rf"(?i)<(?:link|meta)\b[^>]*{mark}[^>]*>", 0)
    told = lambda mark, pattern: F.when(F.lower(head).contains(mark), resolve(F.regexp_extract(tag(mark), pattern, 1), F.col(url)))
    links = pages.select(F.col(url).alias("src"), told("canonical", CANONICAL_LINK).alias("named"), told("refresh", REFRESH_LINK).alias("moved"))
    dst = F.explode(F.array(canonical(F.col("src")), canonical(F.col("named")), canonical(F.col("moved"))))
    edges = links.where(F.col("src").isNotNull()).select("src", dst.alias("dst"))
    return edges.where("dst is not null and src <> dst")


def judge_urls(urls: DataFrame, edges: DataFrame, rules=None, url: str = "url") -> DataFrame:
    """``host, path, rule, verdict`` of every row, beside its other columns.

    ``edges`` (``src, dst``) may name URLs that are not among the rows; their
    rules count for their aliases as well.
    """
    pure = lambda u: rule_of(*host_and_path(u), rules)
    labels = connected_components(edges)
    judged = labels.withColumn("v", pure(F.col("node"))["verdict"])
    classes = (
        judged.groupBy("component")
        .agg(F.max(F.col("v") == "allow").alias("allowed"), F.max(F.col("v") == "block").alias("blocked"))
        .where("allowed or blocked")
        .select("component", F.when(F.col("allowed"), "allow").otherwise("block").alias("_inherited"))
    )
    node, told = free_name(urls, "node"), free_name(urls, "inherited")
    inherited = labels.join(classes, "component").select(F.col("node").alias(node), F.col("_inherited").alias(told))
    host, path = host_and_path(F.col(url))
    rule = rule_of(host, path, rules)
    plain = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    joined = urls.join(inherited, urls[url] == inherited[node], "left")
    return joined.select(
        *[urls[c] for c in plain],
        host.alias("host"),
        path.alias("path"),
        rule["rule"].alias("rule"),
        F.coalesce(rule["verdict"], F.col(told), F.lit("allow")).alias("verdict"),
    )


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages.select("page_id", "url"), link_edges(pages)).select("page_id", "host", "path", "rule", "verdict")


_REST = "regexp_extract(coalesce({u}, ''), '^(?s:.*?)://((?s:.*))$', 1)"


def _sql_rule(host: str, path: str, part: int) -> str:
    rules = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    return "CASE " + " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{(h + p, v)[part]}'" for v, h, p in rules) + " END"


def _sql_canonical(u: str) -> str:
    rest = _REST.format(u=u)
    host = f"regexp_replace(translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '^(?:www|m)\\.', '')"
    path = f"regexp_replace(regexp_replace(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '\\.html?$', ''), '(.)/$', '\\1')"
    kept = f"list_sort(list_filter(string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^{TRACKING}=')))"
    return f"CASE WHEN {host} <> '' THEN 'https://' || {host} || {path} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END END"


def _sql_link(mark: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    tag = rf"regexp_extract(head, '(?i)<(?:link|meta)\b[^>]*{mark}[^>]*>', 0)"
    return f"SELECT url, regexp_extract({tag}, '{quoted}', 1) AS link FROM h WHERE contains(lower(head), '{mark}')"


#: Classes of a recursive walk over the edges, in both directions.
OP7_SQL = rf"""
WITH RECURSIVE h AS (SELECT url, string_split(coalesce(html, ''), '</head>')[1] AS head FROM pages WHERE url IS NOT NULL),
said AS ({_sql_link("canonical", CANONICAL_LINK)} UNION ALL {_sql_link("refresh", REFRESH_LINK)}),
based AS (SELECT url, link, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) AS origin,
                 regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path,
                 regexp_extract(link, '^([^?#]*)', 1) AS own, regexp_extract(link, '^[^?#]*(.*)$', 1) AS rest FROM said),
steps AS (SELECT *, list_transform(string_split(CASE WHEN starts_with(link, '/') THEN own ELSE regexp_extract(path, '^(.*)/', 1) || '/' || own END, '/'), lambda x: [x]) AS s FROM based),
resolved AS (SELECT url AS src, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN link
        WHEN link = '' OR starts_with(link, '#') OR regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.\-]*:') OR origin = '' THEN NULL
        WHEN starts_with(link, '//') THEN regexp_extract(origin, '^([^:]*:)', 1) || link
        WHEN starts_with(link, '?') THEN origin || path || link
        ELSE origin || array_to_string(list_reduce(s, lambda a, b: CASE WHEN b = ['..'] THEN a[1:greatest(1, len(a) - 1)] WHEN b = ['.'] THEN a ELSE a || b END), '/') || rest END AS target FROM steps),
edge AS (SELECT url AS src, {_sql_canonical("url")} AS dst FROM pages WHERE url IS NOT NULL
         UNION SELECT src, {_sql_canonical("target")} FROM resolved WHERE target IS NOT NULL),
e AS (SELECT src, dst FROM edge WHERE dst IS NOT NULL AND src <> dst UNION SELECT dst, src FROM edge WHERE dst IS NOT NULL AND src <> dst),
walk AS (SELECT src AS a, src AS b FROM e UNION SELECT walk.a, e.dst FROM walk JOIN e ON walk.b = e.src),
n AS (SELECT b, translate(regexp_extract({_REST.format(u="b")}, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract({_REST.format(u="b")}, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT DISTINCT b FROM walk)),
j AS (SELECT b, {_sql_rule("host", "path", 1)} AS v FROM n),
k AS (SELECT a, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS inherited FROM walk JOIN j USING (b) GROUP BY a),
p AS (SELECT page_id, url, translate(regexp_extract({_REST.format(u="url")}, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract({_REST.format(u="url")}, '^[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, {_sql_rule("host", "path", 0)} AS rule,
       coalesce({_sql_rule("host", "path", 1)}, inherited, 'allow') AS verdict
FROM p LEFT JOIN k ON p.url = k.a
"""
