"""URL filters by redirect equivalence (DataFrame functions only).

Every URL is judged by the longest rule that fits it. Redirect and canonical-link edges join the
URLs of one resource into a component; a URL without a rule of its own takes the decision of its
aliases: allow if one of them is explicitly allowed, else block if one is blocked, else allow.

Links are read outside comments; character references for ``& < > " ' / :`` are decoded; targets
relative to the scheme, the host, the folder or the page are resolved against the page's URL (a
``base`` element isn't followed), and dot segments are removed. A page whose URL holds no ``://``
has no place to resolve from and gives no edges.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
allowed; null html has no links; URLs and html of any length are read whole; of rules of one length
(equal ones; a host and path can't tie otherwise) allow wins; repeated rows are judged alike and
stay; an empty table gives no rows; columns other than page_id, url and html are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.common import UPPER, ascii_lower, components, load

#: (host, path, verdict) of the registered query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
REST = r"(?s)^.*?://(.*)$"
HOST, PATH = r"^([^/?#]*)", r"^[^/?#]*([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    rest = F.coalesce(F.regexp_extract(url, REST, 1), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, HOST, 1)), F.regexp_extract(rest, PATH, 1)


def rule_of(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule and rule_verdict to ``urls(url, host, path)``, which holds each URL once.

    A host meets the rules of its label suffixes in an equi-join, so rule lists of any size work:
    small ones are broadcast by Spark's own size check, large ones are shuffled.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = (
        urls.select("url", "path", F.explode(suffixes).alias("rule_host"))
        .join(rules, "rule_host")
        .where(F.startswith("path", F.col("rule_path")))
        .groupBy("url")
        .agg(F.max(F.struct(F.length("rule_host") + F.length("rule_path"), F.col("rule_verdict") == "allow", "rule_host", "rule_path", "rule_verdict")).alias("r"))
        .select("url", F.concat("r.rule_host", "r.rule_path").alias("rule"), F.col("r.rule_verdict").alias("rule_verdict"))
    )
    return urls.join(fits, "url", "left")


def resource(url: Column) -> Column:
    """The URL without its fragment, scheme and host lower-cased: a node of the alias graph."""
    bare = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(ascii_lower(head), F.substr(bare, F.length(head) + 1))


COMMENT = r"(?s)<!--.*?(?:-->|$)"
#: Inside of a tag. Possessive, so that Java's matcher loops over it instead of descending once a character.
INSIDE = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
LINK, MOVE = rf"(?i)<link\b{INSIDE}>", rf"(?i)<meta\b{INSIDE}>"
CANONICAL, REFRESH = r"(?i)\srel\s*=\s*[\"']?[^\"'>]*\bcanonical\b", r"(?i)\shttp-equiv\s*=\s*[\"']?\s*refresh\b"
HREF, TARGET = r"(?i)\shref\s*=\s*(?:[\"']\s*)?([^\"'\s>]+)", r"(?i)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"
# Character references that occur in URLs, as (pattern, character); & comes last.
REFERENCES = [("(?i)&(?:lt|#60|#x3c);", "<"), ("(?i)&(?:gt|#62|#x3e);", ">"), ("(?i)&(?:quot|#34|#x22);", '"'), ("(?i)&(?:apos|#39|#x27);", "'"), ("(?i)&(?:sol|#47|#x2f);", "/"), ("(?i)&(?:colon|#58|#x3a);", ":"), ("(?i)&(?:amp|#38|#x26);", "&")]
#: Scheme with its colon; scheme and host; the path up to its last slash; all but the query.
SCHEME, SITE, FOLDER, PLACE = r"^([^:/?#]*:)", r"(?s)^(.*?://[^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*/)", r"(?s)^([^?#]*)"


def _no_dots(url: Column) -> Column:
    """``url`` without the segments ``.`` and ``..`` of its path."""
    site = F.regexp_extract(url, SITE, 1)
    path = F.regexp_extract(F.substr(url, F.length(site) + 1), PLACE, 1)
    rest = F.substr(url, F.length(site) + F.length(path) + 1)
    steps = F.split(F.regexp_replace(path, r"/\.\.?$", "$0/"), "/")
    kept = F.aggregate(
        F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x)),
    )
    dotted = F.concat(site, F.lit("/"), F.array_join(kept, "/"), rest)
    return F.when(path.rlike(r"/\.\.?(/|$)"), dotted).otherwise(url)


def resolved(href: Column, url: Column) -> Column:
    """The target of a link of the page ``url``; null for an empty one and for schemes such as mailto."""
    site = F.regexp_extract(url, SITE, 1)
    folder = F.regexp_extract(url, FOLDER, 1)
    return _no_dots(
        F.when(href.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), href)
        .when(href.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), None)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(url, SCHEME, 1), href))
        .when(F.startswith(href, F.lit("/")), F.concat(site, href))
        .when(F.startswith(href, F.lit("?")), F.concat(F.regexp_extract(url, PLACE, 1), href))
        .when(F.startswith(href, F.lit("#")), url)
        .when(href != "", F.concat(site, F.when(folder == "", "/").otherwise(folder), href))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """``src, dst`` resources from canonical links and immediate-refresh redirects in the html."""
    html = F.regexp_replace("html", COMMENT, "")
    links = F.filter(F.regexp_extract_all(html, F.lit(LINK), 0), lambda t: t.rlike(CANONICAL))
    moves = F.filter(F.regexp_extract_all(html, F.lit(MOVE), 0), lambda t: t.rlike(REFRESH))
    hrefs = F.concat(F.transform(links, lambda t: F.regexp_extract(t, HREF, 1)), F.transform(moves, lambda t: F.regexp_extract(t, TARGET, 1)))
    href = F.col("href")
    for reference, mark in REFERENCES:
        href = F.regexp_replace(href, reference, mark)
    return (
        pages.where(F.col("html").isNotNull() & F.col("url").contains("://"))
        .select("url", F.explode(F.array_distinct(hrefs)).alias("href"))
        .select(resource(F.col("url")).alias("src"), resource(resolved(href, F.col("url"))).alias("dst"))
        .where("dst is not null")
    )


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Judges every row of ``pages(page_id, url, html)``.

    ``rules(rule_host, rule_path, rule_verdict)``; ``redirects(src, dst)`` are further URL pairs,
    such as those a crawler saw. Returns page_id, url, host, path, rule, verdict.
    """
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.where("src is not null and dst is not null").select(resource(F.col("src")), resource(F.col("dst"))))
    groups = components(edges)
    host, path = url_parts(F.col("url"))
    urls = pages.select("url").where("url is not null").distinct()
    judged = rule_of(urls.select("url", host.alias("host"), path.alias("path"), resource(F.col("url")).alias("node")), rules)
    # The other ends of links are aliases too, whether or not they are pages.
    ends = groups.select("component", F.col("node").alias("url"))
    ends = rule_of(ends.select("component", "url", *(c.alias(n) for c, n in zip(url_parts(F.col("url")), ("host", "path"), strict=True))), rules)
    shared = ends.groupBy("component").agg(F.max(F.col("rule_verdict") == "allow").alias("allowed"), F.max(F.col("rule_verdict") == "block").alias("blocked"))
    alias = groups.join(shared, "component").select("node", (F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False))).alias("alias_block"))
    judged = judged.join(alias, "node", "left").select("url", "rule", F.coalesce("rule_verdict", F.when(F.col("alias_block"), "block").otherwise("allow")).alias("verdict"))
    return pages.select("page_id", "url", host.alias("host"), path.alias("path")).join(judged, "url", "left").select("page_id", "url", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(load(spark, sf_dir, "pages"), rules_frame(spark, RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _resource_sql(url: str) -> str:
    bare = f"split_part({url}, '#', 1)"
    head = f"regexp_extract({bare}, '(?s)^(.*?://[^/?#]*)', 1)"
    return f"translate({head}, '{UPPER}', '{UPPER.lower()}') || substr({bare}, length({head}) + 1)"


_DECODED = "href"
for _reference, _mark in REFERENCES:
    _DECODED = f"regexp_replace({_DECODED}, {_sql(_reference)}, {_sql(_mark)}, 'g')"
#: The same for DuckDB, whose matcher knows no possessive forms and needs none.
_INSIDE = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
SQL = f"""
WITH RECURSIVE rules(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
parts AS (SELECT page_id, url, html, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
page AS (SELECT page_id, url, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
source AS (SELECT url, regexp_replace(html, {_sql(COMMENT)}, '', 'g') AS html FROM pages WHERE html IS NOT NULL AND contains(url, '://')),
raw AS (
    SELECT url, regexp_extract(t, {_sql(HREF)}, 1) AS href
    FROM (SELECT url, unnest(regexp_extract_all(html, {_sql(LINK.replace(INSIDE, _INSIDE))})) AS t FROM source) WHERE regexp_matches(t, {_sql(CANONICAL)})
    UNION SELECT url, regexp_extract(t, {_sql(TARGET)}, 1)
    FROM (SELECT url, unnest(regexp_extract_all(html, {_sql(MOVE.replace(INSIDE, _INSIDE))})) AS t FROM source) WHERE regexp_matches(t, {_sql(REFRESH)})),
plain AS (SELECT url, {_DECODED} AS href, regexp_extract(url, {_sql(SITE)}, 1) AS site, regexp_extract(url, {_sql(FOLDER)}, 1) AS folder FROM raw),
target AS (SELECT url, CASE
    WHEN regexp_matches(href, '(?i)^[a-z][a-z0-9+.-]*://') THEN href
    WHEN regexp_matches(href, '(?i)^[a-z][a-z0-9+.-]*:') OR href = '' THEN NULL
    WHEN starts_with(href, '//') THEN regexp_extract(url, {_sql(SCHEME)}, 1) || href
    WHEN starts_with(href, '/') THEN site || href
    WHEN starts_with(href, '?') THEN regexp_extract(url, {_sql(PLACE)}, 1) || href
    WHEN starts_with(href, '#') THEN url
    ELSE site || CASE WHEN folder = '' THEN '/' ELSE folder END || href END AS t FROM plain),
cut AS (SELECT url, t, site, path, substr(t, length(site) + length(path) + 1) AS rest FROM
    (SELECT url, t, regexp_extract(t, {_sql(SITE)}, 1) AS site, regexp_extract(substr(t, length(regexp_extract(t, {_sql(SITE)}, 1)) + 1), {_sql(PLACE)}, 1) AS path FROM target WHERE t IS NOT NULL)),
dotted AS (SELECT *, list_prepend(['']::VARCHAR[], list_transform(string_split(regexp_replace(path, '/\\.\\.?$', '\\0/'), '/')[2:], lambda x: [x])) AS steps FROM cut),
dst AS (SELECT url, CASE WHEN regexp_matches(path, '/\\.\\.?(/|$)')
    THEN site || array_to_string(list_reduce(steps, lambda a, x: CASE WHEN x[1] = '.' THEN a WHEN x[1] = '..' THEN a[:greatest(len(a) - 1, 1)] ELSE list_concat(a, x) END), '/') || rest ELSE t END AS t FROM dotted),
edge AS (SELECT {_resource_sql("url")} AS a, {_resource_sql("t")} AS b FROM dst),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
ends AS (SELECT b, translate(regexp_extract(b, '://([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host, regexp_extract(b, '://[^/?#]*([^?#]*)', 1) AS path FROM (SELECT DISTINCT b FROM reach)),
end_rule AS (SELECT b, arg_max(v, length(h) + length(p)) AS v FROM ends JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY b),
alias AS (SELECT a, bool_or(v = 'block') AND NOT bool_or(v = 'allow') AS blocked FROM reach JOIN end_rule USING (b) GROUP BY a),
own AS (SELECT host, path, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(v, length(h) + length(p)) AS v
    FROM (SELECT DISTINCT host, path FROM page) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, page.host, page.path, own.rule, coalesce(own.v, CASE WHEN alias.blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM page LEFT JOIN own ON page.host = own.host AND page.path = own.path LEFT JOIN alias ON alias.a = {_resource_sql("page.url")}
"""
