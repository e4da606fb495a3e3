"""URL filters: rules by host and path, carried over redirect and canonical links. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.llm.common import connected_components, small_enough, stored


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; empty for a null or a url without ://."""
    return lowered(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty likewise."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_key(url: Column) -> Column:
    """Host, path and query: what names a page, whatever scheme and fragment."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.when(F.coalesce(url.contains("://"), F.lit(False)), F.concat(url_host(url), url_path(url), query))


def resolved(link: Column, base: Column) -> Column:
    """link as an absolute url, seen from base; null if it can't be one."""
    scheme, root = F.regexp_extract(base, r"(?s)^(.*?:)//", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), r"[^/]*$", "")
    link = F.trim(link)
    return (
        F.when(link.isNull() | (link == "") | link.startswith("#"), None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Edges (source, target) as url keys, from each page's canonical link and its refresh redirect."""
    value = lambda tag, name: F.regexp_replace(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1), "^[\"']|[\"']$", "")
    has = pages.where("url is not null and html is not null").where(F.col("html").rlike(r"(?i)canonical|refresh"))
    html = F.regexp_replace("html", r"(?s)<!--.*?-->", "")
    tags = has.select("url", F.explode(F.regexp_extract_all(html, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"))).alias("tag"))
    kinds = tags.select("url", F.lower("tag").startswith("<link").alias("is_link"), lowered(value(F.col("tag"), "rel")).alias("rel"), lowered(value(F.col("tag"), "http-equiv")).alias("equiv"), value(F.col("tag"), "href").alias("href"), value(F.col("tag"), "content").alias("content"))
    refresh = F.regexp_extract("content", r"(?is)\burl\s*=\s*['\"]?([^'\"]*)", 1)
    links = kinds.select("url", F.when(F.col("is_link") & F.col("rel").rlike(r"(^|\s)canonical(\s|$)"), F.col("href")).when(~F.col("is_link") & (F.col("equiv") == "refresh"), refresh).alias("link"))
    links = stored(links.where("link is not null and link <> ''").withColumn("link", F.regexp_replace("link", "&(amp|#38);", "&")))
    ends = links.select(url_key(F.col("url")).alias("source"), resolved(F.col("link"), F.col("url")).alias("to"))
    edges = ends.select("source", url_key(F.col("to")).alias("target"))
    return edges.where("source is not null and target is not null").distinct()


def judged(places: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule and ruled (allow, block or null) to places, by their columns host and path.

    A rule (host, path, action) fits its host and all subdomains if the path starts with the rule's. The longest wins,
    by host and path together; of two as long, allow wins. Hosts are judged once each; a common host is one row on the
    joined side, so its many pages can be split.
    """
    by_host = rules.select(lowered(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "action").where("rule_host is not null and action in ('allow', 'block')")
    each = F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), F.when(F.col("action") == "allow", 1).otherwise(0).alias("rank"), F.concat("rule_host", "rule_path").alias("rule"), "rule_path", "action")
    by_host = by_host.groupBy("rule_host").agg(F.collect_set(each).alias("rules"))
    hosts = places.select("host").distinct().where("host <> ''")
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = hosts.select("host", F.explode(ends).alias("rule_host")).join(small_enough(by_host, 10_000), "rule_host")
    fits = fits.groupBy("host").agg(F.flatten(F.collect_list("rules")).alias("rules"))
    out = places.join(small_enough(stored(fits), 100_000), "host", "left")
    best = F.array_max(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])))
    return out.withColumn("_best", best).withColumn("rule", F.col("_best.rule")).withColumn("ruled", F.col("_best.action")).drop("rules", "_best")


def filter_urls(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Verdict of each page: page_id, url, host, path, rule, verdict.

    pages: page_id, url, html; edges: (source, target) as url keys, by default those that the pages' html declares.
    A rule that fits the url itself decides. Else the url's class decides: all urls linked by redirects or canonical
    links, pages or not, each judged by the rules. One explicitly allowed member allows the class, else one blocked
    member blocks it, else it is allowed. Null or malformed urls have empty host and path and are allowed; urls and html
    are read whole, however long; repeated rows are judged alike; an empty table gives no rows, and without rules all are
    allowed. Of two rules as long as each other, allow wins. Other columns of pages, whatever their names, have no part.
    """
    places = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), url_key(F.col("url")).alias("_key"))
    own = judged(places, rules)
    edges = page_links(pages) if edges is None else edges.toDF("source", "target")
    members = connected_components(edges).select(F.col("node").alias("_key"), "component")
    as_url = F.concat(F.lit("x://"), F.col("_key"))
    known = judged(members.select("_key", "component", url_host(as_url).alias("host"), url_path(as_url).alias("path")), rules)
    decided = known.where("ruled is not null").groupBy("component").agg(F.min("ruled").alias("carried"))
    carried = members.join(decided, "component").select("_key", "carried")
    out = own.join(carried, "_key", "left")
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce("ruled", "carried", F.lit("allow")).alias("verdict"))
