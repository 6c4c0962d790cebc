"""URL filters by rules, and by redirect equivalence where no rule decides.

Pages are aliases of each other if a redirect (``<meta http-equiv=refresh>``) or a canonical link
(``<link rel=canonical>``) joins them. Connected components over those edges are found without gathering
any of them; a component that holds a URL which a rule blocks, be it of a page or only an end of a link or
redirect, passes the block on to its pages without a rule of their own. A page that a rule allows stays
allowed, whatever its aliases, and an allowed page does not pass its allowance on.

A URL names a node by host, path and query: scheme, fragment, a trailing slash of the path and ``utm_`` query
parameters do not tell pages apart. Relative links are read against the page's host and folder; ``.`` and ``..``
segments are resolved first.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; null or
empty html has no links; repeated rows and several pages of one URL are one node and each give a
row; a table without links skips the components. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidspark.llm.common import materialize
from braidspark.llm.components import connected_components

#: (verdict, host, path prefix)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _once(value: Column, f) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def resolved(url: Column) -> Column:
    """The URL without ``.`` and ``..`` segments in its path (RFC 3986, 5.2.4)."""
    return _once(url, lambda u: F.when(u.rlike(r"/\.\.?([/?#]|$)"), _once(u, _without_dots)).otherwise(u))


def _without_dots(url: Column) -> Column:
    pattern = r"(?s)^(.*?://[^/?#]*)([^?#]*)(.*)$"
    top, path, rest = [F.regexp_extract(url, pattern, i) for i in (1, 2, 3)]
    segments = F.split(path, "/")  # the first is empty: a path starts with a slash
    kept = F.aggregate(
        F.slice(segments, 2, F.size(segments)),
        F.array().cast("array<string>"),
        lambda out, s: F.when(s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(s == ".", out).otherwise(F.concat(out, F.array(s))),
    )
    folder = F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(top, F.lit("/"), F.array_join(kept, "/"), folder, rest)).otherwise(url)


def node_of(url: Column) -> Column:
    """The name of a URL's node, null if it has no host."""
    return _once(resolved(url), _node)


def _node(url: Column) -> Column:
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.startswith("utm_") & (p != "")), "&")
    host = host_of(url)
    name = F.concat(host, F.regexp_replace(path_of(url), "/$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(host != "", name)


def _rule(rule: tuple[str, str, str], host: Column, path: Column) -> Column:
    return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule and rule_verdict: of the longest rule that fits, null if none does."""
    out = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    name = verdict = None
    for rule in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = _rule(rule, F.col("host"), F.col("path"))
        name = F.when(fits, rule[1] + rule[2]) if name is None else name.when(fits, rule[1] + rule[2])
        verdict = F.when(fits, rule[0]) if verdict is None else verdict.when(fits, rule[0])
    return out.withColumn("rule", name).withColumn("rule_verdict", verdict)


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, quoted or not; empty if there is none."""
    pattern = r"(?is)[\s\"'/]" + name + r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*[F.coalesce(F.regexp_extract(tag, pattern, i), F.lit("")) for i in (1, 2, 3)])


def _absolute(link: Column, url: Column) -> Column:
    """A link as found on a page, with a scheme and a host."""
    link = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    top = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:/[^/?#]*)*/)", 1)
    base = F.when(folder == "", F.concat(top, F.lit("/"))).otherwise(folder)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(top, link))
        .when(link != "", F.concat(base, link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """src, dst, src_url, dst_url: nodes that a canonical link or a redirect of a page joins, and the URLs that name them."""
    linked = pages.where(F.col("html").rlike("(?i)canonical|http-equiv"))
    tags = linked.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))
    canonical = F.lower(_attribute(F.col("tag"), "rel")).rlike(r"(^|\s)canonical(\s|$)") & F.lower("tag").startswith("<link")
    refresh = (F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh") & F.lower("tag").startswith("<meta")
    target = F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*['\"]?([^'\"]*)", 1)
    link = F.when(canonical, _attribute(F.col("tag"), "href")).when(refresh, target)
    found = tags.select("url", link.alias("link")).where(F.col("link") != "")
    return _edges(found.select(F.col("url").alias("src_url"), _absolute(F.col("link"), F.col("url")).alias("dst_url")))


def _edges(urls: DataFrame) -> DataFrame:
    """src, dst, src_url, dst_url of pairs of URLs (src_url, dst_url); two URLs of one node are an edge too."""
    urls = urls.select(resolved(F.col("src_url")).alias("src_url"), resolved(F.col("dst_url")).alias("dst_url"))
    edges = urls.select(node_of(F.col("src_url")).alias("src"), node_of(F.col("dst_url")).alias("dst"), "src_url", "dst_url")
    return edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src_url") != F.col("dst_url"))).distinct()


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, component of every row of pages (page_id, url, html).

    redirects: further edges (from_url, to_url), as a crawl's log has them.
    """
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(_edges(redirects.select(F.col("from_url").alias("src_url"), F.col("to_url").alias("dst_url"))))
    edges = materialize(edges, "alias-edges")
    # both ends of every edge are judged, also those that are no page
    ends = edges.select(F.col("src").alias("node"), F.col("src_url").alias("url")).unionByName(edges.select(F.col("dst").alias("node"), F.col("dst_url").alias("url")))
    seeds = with_rule(ends, rules).where(F.col("rule_verdict") == "block").select(F.col("node").alias("s_node")).distinct()
    joins = connected_components(edges.select("src", "dst"))
    alone = ends.select(F.col("node").alias("a_node")).distinct().join(joins, F.col("a_node") == F.col("node"), "left_anti")
    members = joins.unionByName(alone.select(F.col("a_node").alias("node"), F.col("a_node").alias("component")))
    members = materialize(members.select(F.col("node").alias("m_node"), F.col("component").alias("m_component")), "alias-members")
    judged = with_rule(pages.select("page_id", "url"), rules).withColumn("node", node_of(F.col("url")))
    # only pages that an edge touches join; a node's pages are split by Spark if they are many
    joined = judged.join(members, F.col("node") == F.col("m_node"), "left")
    by_page = joined.where((F.col("rule_verdict") == "block") & F.col("m_component").isNotNull()).select(F.col("m_component").alias("b_component"))
    by_end = members.join(seeds, F.col("m_node") == F.col("s_node"), "left_semi").select(F.col("m_component").alias("b_component"))
    blocked = by_page.unionByName(by_end).distinct()
    final = joined.join(blocked, F.col("m_component") == F.col("b_component"), "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("b_component").isNotNull(), "block"), F.lit("allow"))
    return final.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("m_component", "node").alias("component"))
