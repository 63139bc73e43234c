"""URL block and allow rules, carried over redirect and canonical-link aliases (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import connected_components, quoted

#: (verdict, host, path prefix)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: So many rules at most are written into the plan as conditions; more are a table that is joined.
MAX_INLINE_RULES = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
NODE = r"(?s)^([^/?]*)([^?]*)"
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*(?:canonical\b|"[^">]*\bcanonical\b|'[^'>]*\bcanonical\b))[^>]*\bhref\s*=\s*(?:"([^">]*)"|'([^'>]*)'|([^"'\s>]+))[^>]*"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*(?:"([^">]*)"|'([^'>]*)'|([^"'\s>]+))[^>]*"""
# Fixed values of HTML: character references that URLs hold.
REFERENCES = (("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#47;", "/"), ("&#x2f;", "/"), ("&#x2F;", "/"), ("&#61;", "="), ("&#x3d;", "="), ("&#x3D;", "="), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))
RULE = "struct<n:int,first:int,rule:string,verdict:string>"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def node_of(url: Column) -> Column:
    """What a link names: host, path and query, without scheme and fragment. Null where there is no host."""
    return F.nullif(F.concat(host_of(url), path_of(url), F.regexp_extract(F.coalesce(url, F.lit("")), URL, 3)), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest of a few rules that fits, as struct(n, rule, verdict), else null. Equal lengths: allow first, then by code point."""
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h) + len(p)).alias("n"), F.lit(int(v == "allow")).alias("first"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast(RULE)


def with_rule(urls: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Adds `best`, the longest rule that fits columns host and path, by the order of best_rule().

    A table of rules (verdict, host, path), or a list too long for a plan, is joined: every different host and path asks under each of its
    host's suffixes, and what fits is reduced to one rule before it goes back to the rows. Spark broadcasts the rules by its own size check.
    Rules with a null part fit nothing; a rule's host is compared in lower case A-Z, like any.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= MAX_INLINE_RULES:
            return urls.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
        rules = urls.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    table = rules.select(F.translate("host", UPPER, LOWER).alias("h_"), F.col("path").alias("p_"), F.col("verdict").alias("v_")).where("h_ is not null and p_ is not null and v_ is not null").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    asked = urls.select("host", "path").distinct().withColumn("h_", F.explode(suffixes))
    rule = F.struct((F.char_length("h_") + F.char_length("p_")).alias("n"), (F.col("v_") == "allow").cast("int").alias("first"), F.concat("h_", "p_").alias("rule"), F.col("v_").alias("verdict"))
    fits = asked.join(table, "h_").where(F.col("path").startswith(F.col("p_"))).groupBy("host", "path").agg(F.max(rule).alias("best"))
    fits = fits.select(F.col("host").alias("host_"), F.col("path").alias("path_"), "best")
    return urls.join(fits, (F.col("host") == F.col("host_")) & (F.col("path") == F.col("path_")), "left").drop("host_", "path_")


def resolved(to: Column, url: Column) -> Column:
    """A link's target as an absolute URL: as it is, or against the scheme, host, path and directory of the page's url, dots in paths resolved."""
    host, path = host_of(url), path_of(url)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    near = F.when(to.startswith("//"), F.concat(F.lit("http:"), to)).when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.startswith("/"), F.concat(F.lit("http://"), host, to))
    near = near.when(to.startswith("?"), F.concat(F.lit("http://"), host, path, to)).when(~to.rlike(r"^(?:#|[A-Za-z][A-Za-z0-9+.-]*:|$)"), F.concat(F.lit("http://"), host, folder, to))
    there = path_of(near)
    keep = lambda out, x: F.when(x == "..", F.when(F.size(out) > 1, F.slice(out, 1, F.size(out) - 1)).otherwise(out)).when(x == ".", out).otherwise(F.concat(out, F.array(x)))
    parts = F.split(there, "/")
    walked = F.aggregate(parts, F.array().cast("array<string>"), keep, lambda out: F.array_join(out, "/"))
    plain = F.when(there.rlike(r"/\.\.?$"), F.concat(F.rtrim(walked, F.lit("/")), F.lit("/"))).otherwise(walked)
    return F.when(there.rlike(r"(?s)/\.\.?(/|$)"), F.concat(F.lit("http://"), host_of(near), plain, F.regexp_extract(near, URL, 3))).otherwise(near)


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Alias edges (a, b) that pages state: all their canonical links and refresh redirects. Character references in targets are decoded, relative
    targets resolve against the page's url (a `base` element is not read)."""
    html, url = quoted(html_col), quoted(url_col)

    def targets(pattern: str) -> Column:
        found = F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
        return F.transform(found, lambda tag: F.trim(F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])))

    def decoded(x: Column) -> Column:
        for written, meant in REFERENCES:
            x = F.replace(x, F.lit(written), F.lit(meant))
        return F.trim(x)

    said = pages.where(html.rlike(r"(?i)canonical|http-equiv"))
    named = said.select(url.alias("url_"), F.explode(F.concat(targets(CANONICAL), targets(REFRESH))).alias("to_")).where(host_of(F.col("url_")) != "")
    return named.select(node_of(F.col("url_")).alias("a"), node_of(resolved(decoded(F.col("to_")), F.col("url_"))).alias("b")).where("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """Verdict for every page: (id, host, path, rule, verdict, component).

    `rules` are (verdict, host, path) in a list or a table of those columns. A page's own longest rule decides. Without one, its aliases do:
    URLs joined by redirects (a table of `from_url`, `to_url`) and canonical links form connected components, found by distributed star
    contraction. An alias that is explicitly allowed keeps the component allowed; else one that is blocked blocks it; else the page is allowed.
    Targets that no page of the table has are judged by the rules too. Only linked URLs take part in the component
    step, so its cost follows the number of links.

    Null urls and urls without :// have an empty host and path, fit no rule and are allowed; null and empty html states no links. Repeated rows
    are judged alike, once each. An empty table gives no rows. Columns besides the named ones are not read, so their names can't clash.
    """
    url = quoted(url_col)
    base = pages.select(quoted(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    base = with_rule(base, rules)
    edges = [] if html_col is None else [links(pages, url_col, html_col)]
    if redirects is not None:
        edges.append(redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")))
    component, own = F.lit(None).cast("string"), F.lit(None).cast("string")
    if edges:
        both = edges[0] if len(edges) == 1 else edges[0].union(edges[1])
        parts = connected_components(both)
        named = parts.select("*", F.regexp_extract("node", NODE, 1).alias("host"), F.regexp_extract("node", NODE, 2).alias("path"))
        said = with_rule(named, rules).withColumn("v", F.col("best.verdict"))
        verdicts = said.groupBy("component").agg(F.when(F.bool_or(F.col("v") == "allow"), "allow").when(F.bool_or(F.col("v") == "block"), "block").alias("inherited"))
        aliases = parts.join(verdicts, "component").withColumnRenamed("node", "node_")
        base = base.join(aliases, F.col("node") == F.col("node_"), "left")
        component, own = F.col("component"), F.col("inherited")
    return base.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", own, F.lit("allow")).alias("verdict"), component.alias("component"))
