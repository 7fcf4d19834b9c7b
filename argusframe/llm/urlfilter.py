"""Operator 7 (DataFrame functions only): URL rules with redirect equivalence.

Urls are nodes; redirects, canonical and refresh links are edges, and nothing else is unless asked for. A rule decides a url it fits. In each connected component the
decisions of rules reach the aliases that no rule fits: allow if any member is explicitly allowed, else block if any is
blocked, else allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .components import connected_components

#: The rules of the registered query, as (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty for a null url or one without ://."""
    return F.coalesce(_lower_ascii(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty for a null url or one without ://."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does. A rule fits its host and all subdomains."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def alias_key(url: Column) -> Column:
    """The address that http or https, a www. or m. host, a final slash, .html, query and fragment often redirect to: a guess, not evidence."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    return F.concat(F.lit("//"), host, F.regexp_replace(path_of(url), r"(/|\.html?|/index\.html?)$", ""))


def link_targets(html: Column) -> Column:
    """Absolute urls that a page names as its canonical address or sends its readers to: array<string>."""
    tag = r"(?i)<(?:link|meta)\b[^>]*>"
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(tag), F.lit(0))
    is_link = lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b") | t.rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b")
    target = lambda t: F.regexp_extract(t, r"(?i)(?:href\s*=\s*[\"']?|url\s*=\s*'?)([a-z][a-z0-9+.-]*://[^\"'\s>]+)", 1)
    return F.filter(F.transform(F.filter(tags, is_link), target), lambda u: u != "")


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", guess_aliases: bool = False) -> DataFrame:
    """(id, host, path, rule, verdict, component): one row a page.

    Edges are redirects, a table (src, dst) of urls, and the canonical and refresh links in html_col. guess_aliases adds an
    edge from each url to alias_key(), for sites known to redirect so. A null url, and one without ://, has an empty host,
    no rule and no alias. Null ids and repeated pages are judged like any other. component is the least url of the group, the
    page's own where it has no alias. Urls are compared as whole texts, however long.

    Only urls that take part in an edge between different urls enter the components; a page is joined on its own url.
    """
    url = F.col(url_col)
    links = link_targets(F.col(html_col)) if html_col and html_col in pages.columns else F.array().cast("array<string>")
    base = materialise(pages.select(F.col(id_col).alias("id"), url.alias("url"), F.when(F.instr(url, "://") > 0, links).alias("links")), "url-pages")
    named = base.where(F.size("links") > 0).select(F.col("url").alias("src"), F.explode("links").alias("dst"))
    if redirects is not None:
        named = named.union(redirects.select("src", "dst"))
    if guess_aliases:
        every = base.where(F.instr("url", "://") > 0).select("url").union(named.select(F.explode(F.array("src", "dst")).alias("url"))).distinct()
        named = named.union(every.select("url", alias_key(F.col("url"))))
    edges = materialise(named.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct(), "url-edges")
    groups = materialise(connected_components(edges), "url-groups")
    said = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)
    rank = F.max(F.when(said["verdict"] == "allow", 2).when(said["verdict"] == "block", 1))
    # groups have no size bound; the maximum is taken before rows move
    ranks = groups.groupBy("component").agg(rank.alias("rank")).where("rank IS NOT NULL")
    reached = materialise(groups.join(ranks, "component", "left").select(F.col("node").alias("url"), "component", "rank"), "url-reached")
    for done in (edges, groups):
        discard(done)
    out = base.join(reached, "url", "left").withColumn("said", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules))
    verdict = F.coalesce(F.col("said.verdict"), F.when(F.col("rank") == 1, "block").otherwise("allow"))
    own = F.when(F.instr("url", "://") > 0, F.col("url"))
    return out.select(F.col("id").alias(id_col), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("said.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("component", own).alias("component"))
