"""URL filter with redirect equivalence, in DataFrame operations only.

A rule is a host and a path prefix; it fits its host and all subdomains, and the longest fitting rule decides. URLs that no
rule fits inherit the decision of their aliases: URLs are tied to a normal form (scheme, `www.` and `m.`, default ports, closing
slash, `.html`, fragments and tracking parameters aside), and normal forms to the targets of canonical links, refresh redirects and
given redirects. Components of that graph share decisions; an explicit allow in a component takes precedence over
any block in it, and without either the URL is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora.llm.common import stored
from tremora.operators.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path prefix, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""


def _rest(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def normal_form(url: Column) -> Column:
    """What all spellings of one address share; a text without `://` is its own normal form."""
    bare = F.regexp_replace(F.regexp_replace(host(url), ":(80|443)$", ""), "^(www|m)[.]", "")
    page = F.regexp_replace(path(url), "([.]html?|/+)$", "")
    query = F.regexp_extract(_rest(url), "^[^?#]*[?]([^#]*)", 1)
    kept = F.regexp_replace(F.regexp_replace(F.concat(F.lit("&"), query), "&(utm_[A-Za-z_]*|ref)=[^&]*", ""), "^&+", "")
    form = F.concat(F.lit("https://"), bare, page, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(F.instr(url, "://") > 0, form).otherwise(url)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """rules(r_host, r_path, r_verdict); of equal rules allow stays."""
    rows = [F.struct(F.lit(h).alias("r_host"), F.lit(p).alias("r_path"), F.lit(v).alias("r_verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows))).groupBy("r_host", "r_path").agg(F.min("r_verdict").alias("r_verdict"))


def fitted(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """`urls(url, host, path)` with rule and r_verdict of the longest fitting rule, null where none fits.

    A URL asks for the suffixes of its host, then for its path's prefixes of just those lengths that rules of that host have: two
    equi-joins, whatever the number of rules of one host.
    """
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    lengths = rules.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("_lengths"))
    asked = urls.select("url", "path", suffix.alias("r_host")).join(lengths, "r_host").withColumn("_n", F.explode("_lengths")).filter(F.col("_n") <= F.length("path"))
    asked = asked.withColumn("r_path", F.substring("path", F.lit(1), F.col("_n")))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"))
    best = asked.join(rules, ["r_host", "r_path"]).groupBy("url").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "r_verdict"), rank).alias("_best"))
    return urls.join(best, "url", "left").select(*urls.columns, "_best.rule", "_best.r_verdict")


def targets(pages: DataFrame) -> DataFrame:
    """(url, target) of canonical links and refresh redirects in `pages(url, html)`; relative ones belong to the page's host."""
    found = pages.filter(F.col("url").isNotNull() & F.col("html").rlike("(?i)canonical|refresh"))
    links = found.select("url", F.explode(F.array(F.regexp_extract("html", _CANONICAL, 1), F.regexp_extract("html", _REFRESH, 1))).alias("target"))
    absolute = F.when(F.col("target").startswith("/"), F.concat(F.lit("https://"), host(F.col("url")), F.col("target"))).otherwise(F.col("target"))
    return links.withColumn("target", absolute).filter(F.instr("target", "://") > 0).distinct()


def judged(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) for each row of `pages(page_id, url, html)`.

    `redirects(url, target)` adds edges. A null url and one without `://` have an empty host and path. A null url has no aliases and is
    allowed. Repeated rows are judged alike; an empty table gives no rows. URLs are told apart by 64-bit hashes within the graph.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    links = targets(pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "target")).filter("url IS NOT NULL AND target IS NOT NULL").distinct()
    links = stored(links, "url-links")
    urls = rows.select("url").unionByName(links.select(F.explode(F.array("url", "target")).alias("url"))).filter("url IS NOT NULL").distinct()
    named = fitted(urls.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")), rules)
    form = lambda c: F.xxhash64(F.lit("form"), normal_form(F.col(c)))
    named = stored(named.withColumns({"id": F.xxhash64(F.lit("url"), "url"), "form": form("url")}), "url-named")
    edges = named.select("id", "form").unionByName(links.select(form("url").alias("id"), form("target").alias("form")))
    members = connected_components(edges, "id", "form").withColumnsRenamed({"node": "id"})
    placed = named.join(members, "id")
    shared = placed.groupBy("component").agg(F.bool_or(F.col("r_verdict") == "allow").alias("allowed"), F.bool_or(F.col("r_verdict") == "block").alias("blocked"))
    inherited = F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    decided = placed.join(shared, "component").select(F.col("url").alias("_url"), "rule", F.coalesce("r_verdict", inherited).alias("verdict"))
    out = rows.join(decided, rows["url"] == decided["_url"], "left")
    return out.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
