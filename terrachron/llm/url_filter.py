"""URL block and allow rules, carried to redirect and canonical-link aliases by connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrachron.llm.components import components
from terrachron.llm.shared import columns_free, settle, small

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Attribute order varies, so the element is found first and its target in it.
HIDDEN = r"(?is)<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)"
BASE = r"""(?is)<base\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*['"]?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty without."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """What names a resource: host, path and query, without scheme and fragment; null if it has no host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(F.substring(rest, 1, 1) == "/", rest).otherwise(F.concat(F.lit("/"), rest))))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(length, verdict, rule) of the longest rule that fits, or null; allow goes before block on a tie."""
    fits = [
        F.when(((host == F.lit(h)) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h) + len(p)).alias("length"), F.lit(v == "allow").alias("allow"), F.lit(v).alias("verdict"), F.lit(h + p).alias("rule")))
        for v, h, p in rules
    ]
    return F.greatest(*fits, *fits) if fits else F.lit(None).cast("struct<length:int,allow:boolean,verdict:string,rule:string>")


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, best) of the distinct ``urls`` (host, path) that a rule of the table ``rules`` (verdict, host, path) fits.

    Each url is joined under the suffixes of its host with the path lengths that rules of that host have, and under
    these prefixes of its path with the rules: equal keys only, so the number of rules doesn't enter the plan.
    """
    rules = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("_h"), F.coalesce("path", F.lit("")).alias("_p"), "verdict").distinct()
    lengths = settle(rules.select("_h", F.length("_p").alias("_n")).distinct())
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = urls.select("host", "path").where("host <> ''").distinct().select("host", "path", F.explode(suffixes).alias("_h"))
    each = each.join(small(lengths, lengths.count(), 200_000), "_h").where(F.col("_n") <= F.length("path")).withColumn("_p", F.expr("left(path, _n)"))
    best = F.struct((F.length("_h") + F.length("_p")).alias("length"), (F.col("verdict") == "allow").alias("allow"), "verdict", F.concat("_h", "_p").alias("rule"))
    return each.join(rules, ["_h", "_p"]).groupBy("host", "path").agg(F.max(best).alias("best"))


def without_dots(path: Column) -> Column:
    """A path without its segments ``.`` and ``..``."""
    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.expr("cast(array() as array<string>)"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.array_append(acc, x)))
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    return F.when(path.contains("/."), F.concat(F.array_join(kept, "/"), ends)).otherwise(path)


def resolved(target: Column, base: Column) -> Column:
    """``target`` as a whole url, seen from the page ``base``; null for fragments, and for schemes without a host."""
    host, path = host_of(base), path_of(base)
    folder = F.regexp_extract(path, "^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    query = F.regexp_extract(target, r"([?#].*)$", 1)
    own = F.regexp_replace(target, r"[?#].*$", "")
    at = lambda p: F.concat(F.lit("http://"), host, without_dots(p), query)
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(F.lit("http:"), target)).when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:|^#"), None)
        .when(target.startswith("/"), at(own)).when(target.startswith("?"), F.concat(F.lit("http://"), host, path, target)).otherwise(at(F.concat(folder, own)))
    )


def link_edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(a, b): a page and what its canonical links and refreshes lead to, as nodes; not those in comments and scripts."""
    maybe = pages.where(F.lower(html).contains("canonical") | F.lower(html).contains("refresh")).select(F.col(url).alias("u"), F.regexp_replace(html, HIDDEN, " ").alias("text"))
    found = F.concat(F.regexp_extract_all("text", F.lit(CANONICAL), 1), F.regexp_extract_all("text", F.lit(REFRESH), 1))
    each = maybe.where(host_of(F.col("u")) != "").select("u", F.regexp_extract("text", BASE, 1).alias("base"), F.explode(found).alias("t")).withColumn("t", F.regexp_replace("t", "&amp;", "&"))
    base = F.when(F.col("base") != "", resolved(F.col("base"), F.col("u"))).otherwise(F.col("u"))
    return each.select(node_of(F.col("u")).alias("a"), node_of(resolved(F.col("t"), F.coalesce(base, "u"))).alias("b"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame | None = None, redirects: DataFrame | None = None, *, url: str = "url", html: str | None = "html", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; own columns of these names are replaced.

    ``rules`` are (verdict, host, path prefix), a short list or a table of any size with the columns verdict, host and
    path, which is joined. The longest that fits decides; allow goes before block on a tie. URLs without a rule take their alias
    class's decision: the connected component over ``redirects`` (from_url, to_url) and, with ``html``, canonical links
    and refreshes (all of a page, relative ones included). A class is blocked if one of its URLs is blocked by a rule and none is explicitly allowed; a URL's
    own rule always goes first. Others get ``default``. Rows are kept one to one, null and repeated URLs included; null
    URLs have an empty host and path and no aliases.
    """
    rules = RULES if rules is None else rules
    data = pages.select(*(c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")))
    edges = [link_edges(data, url, html)] if html and html in data.columns else []
    if redirects is not None:
        edges.append(redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")))
    names = dict(zip(("best", "node", "alias"), columns_free(data, "best", "node", "alias")))
    keep = [c for c in data.columns if c != html]
    out = data.select(*keep).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    table = isinstance(rules, DataFrame)

    def judged(df: DataFrame, name: str) -> DataFrame:
        """``df`` with the best rule of its host and path as column ``name``."""
        if not table:
            return df.withColumn(name, best_rule(F.col("host"), F.col("path"), rules))
        found = ruled(df, rules).select(F.col("host").alias("_rh"), F.col("path").alias("_rp"), F.col("best").alias(name))
        return df.join(found, (F.col("host") == F.col("_rh")) & (F.col("path") == F.col("_rp")), "left").drop("_rh", "_rp")

    out = judged(out, names["best"])
    alias = F.lit(None).cast("string")
    if edges:
        both = edges[0]
        for e in edges[1:]:
            both = both.unionAll(e)
        both = settle(both.where("a <> b").distinct())
        if not both.isEmpty():
            nodes = settle(components(both))
            as_url = F.concat(F.lit("x://"), F.col("node"))
            marks = judged(nodes.withColumns({"host": host_of(as_url), "path": path_of(as_url)}), "best").groupBy("component").agg(F.max(F.col("best.verdict") == "block").alias("blocked"), F.max(F.col("best.verdict") == "allow").alias("allowed"))
            marks = marks.where("blocked AND NOT allowed").select("component")
            aliases = settle(nodes.join(marks, "component").select(F.col("node").alias(names["alias"])))
            out = out.withColumn(names["node"], node_of(F.col(url)))
            out = out.join(small(aliases, aliases.count()), F.col(names["node"]) == F.col(names["alias"]), "left").drop(names["node"])
            alias = F.when(F.col(names["alias"]).isNotNull(), F.lit("block"))
    best = F.col(names["best"])
    return out.select(*keep, "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], alias, F.lit(default)).alias("verdict"))
