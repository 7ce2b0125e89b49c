"""URL filters with redirect equivalence.

A rule is an action and ``host/path``; it fits its host and all subdomains if the
url's path starts with the rule's path, and the longest rule wins. Pages that no
rule fits take the decision of their aliases: urls linked by canonical links
(``<link rel=canonical>``) and redirects (``<meta http-equiv=refresh>``, or a table
of redirects) form components, found by distributed connected components. In a
component an explicit allow, on any of its urls, goes before a block; a component
without either, and a page without aliases, is allowed.

Urls are one node if they are equal but for the scheme, the host's case and the
fragment. Defined cases: a null url or one without ``://`` has empty host and
path, no rule and no alias; null html has no links; repeated rows are each judged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.llm.common import written
from freightlens.llm.components import components

#: The rules of the query's contract, as (action, rule).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """host, path and query; null for a url that has no host."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))
    host = host_of(url)
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    return F.when(host != "", F.concat(host, path, query))


def _rule(host: Column, path: Column, rules: Sequence[tuple[str, str]], value: int) -> Column:
    """The longest fitting rule (``value`` 1) or its action (0), as one chain of conditions."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1])):
        at, _, rest = rule[1].partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule[value])).otherwise(out)
    return out


def _resolved(link: Column, url: Column) -> Column:
    """A link's target as an absolute url, relative to the page's url."""
    link = F.regexp_replace(F.trim(link), "&amp;", "&")
    scheme, site = F.regexp_extract(url, r"^(.*?)://", 1), F.regexp_extract(url, r"^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"^(.*?://[^/?#]*/(?:[^?#]*/)?)", 1)
    folder = F.when(folder == "", F.concat(site, F.lit("/"))).otherwise(folder)
    return (
        F.when(link == "", F.lit(None).cast("string"))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), link))
        .when(link.startswith("#"), F.lit(None).cast("string"))
        .otherwise(F.concat(folder, link))
    )


def _links(html: Column) -> Column:
    """The first canonical link and the first refresh target of a page, as an array."""
    tag = F.regexp_extract(html, r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)", 1)
    meta = F.regexp_extract(html, r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)", 1)
    href = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    to = r"(?is)\burl\s*=\s*['\"]?([^\"'>\s]+)"
    canonical = F.concat(*[F.regexp_extract(tag, href, i) for i in (1, 2, 3)])
    small = F.lower(html)
    return F.array(
        F.when(small.contains("canonical"), canonical), F.when(small.contains("refresh"), F.regexp_extract(meta, to, 1))
    )


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (u, v) between url nodes, from pages and an optional table (from_url, to_url)."""
    url = F.col(f"`{url_col}`")
    found = pages.select(url.alias("__url"), F.explode(_links(F.col(f"`{html_col}`"))).alias("__link"))
    found = found.filter("__link is not null and __link <> ''")
    edges = found.select(node_of(F.col("__url")).alias("u"), node_of(_resolved(F.col("__link"), F.col("__url"))).alias("v"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("from_url")).alias("u"), node_of(F.col("to_url")).alias("v")))
    return edges


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, component."""
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("__node"))
    host, path = F.col("host"), F.col("path")
    rows = rows.withColumns({"rule": _rule(host, path, rules, 1), "__own": _rule(host, path, rules, 0)})
    linked = written(components(alias_edges(pages, redirects, url_col, html_col)))
    at = F.concat(F.lit("any://"), F.col("node"))
    said = linked.select("node", "label", _rule(host_of(at), path_of(at), rules, 0).alias("__said"))
    # "allow" sorts before "block", so the smallest action is the one that goes first
    by_label = said.groupBy("label").agg(F.min("__said").alias("__class"))
    by_node = linked.join(by_label, "label").select(F.col("node").alias("__node"), F.col("label").alias("component"), "__class")
    out = rows.join(by_node, "__node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("__own", "__class", F.lit("allow")).alias("verdict"), "component")
