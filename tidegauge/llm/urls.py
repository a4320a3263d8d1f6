"""URL filters with verdicts that follow redirects and canonical links, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.graph import connected_components
from tidegauge.llm.shared import cut, lower_az

#: Rules are compiled into one expression, so their number is bounded.
MOST_RULES = 1000
#: (verdict, host and path prefix)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_az(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """What names a page: host, path and query, without scheme and fragment; null without `://`."""
    return F.when(url.contains("://"), F.concat(host_of(url), F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1)))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; allow before block if two are equally long; null if none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[0]))
    nothing = F.lit(None).cast("struct<rule:string,verdict:string>")

    def step(rest: Column, r: tuple[str, str]) -> Column:
        h, p = r[1].split("/", 1)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        return F.when(fits, F.struct(F.lit(r[1]).alias("rule"), F.lit(r[0]).alias("verdict"))).otherwise(rest)

    return reduce(step, reversed(ordered), nothing)


def resolved(url: Column, to: Column) -> Column:
    """The url that a link in the page at url names. `.` and `..` in paths are resolved for relative targets; targets of other schemes (`mailto:`) name nothing."""
    root, path = F.concat(F.lit("http://"), host_of(url)), path_of(url)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    parts = F.split(F.concat(folder, F.regexp_extract(to, r"^([^?#]*)", 1)), "/")
    up = lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))).when(x == ".", out).otherwise(F.concat(out, F.array(x)))
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    below = F.concat(F.array_join(F.aggregate(F.slice(parts, 2, 1_000_000), F.array(F.lit("")), up), "/"), ends, F.regexp_extract(to, r"^[^?#]*(.*)", 1))
    full = F.when(to.startswith("//"), F.concat(F.lit("http:"), to)).when(to.startswith("/"), F.concat(root, to)).when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), to)
    return full.when(to.startswith("?"), F.concat(root, path, to)).when(to.startswith("#"), url).otherwise(F.concat(root, below))


def links_of(pages: DataFrame) -> DataFrame:
    """(a, b): from each page's address to what its canonical link, and a refresh to another url, name. All such tags count; relative targets resolve against the page's url (see resolved)."""
    attr = r"[^>]*?\s{name}\s*=\s*[\"']?{value}"
    link = r"(?is)<link\b(?=" + attr.format(name="rel", value=r"canonical\b") + r")" + attr.format(name="href", value=r"([^\"'\s>]+)")
    meta = r"(?is)<meta\b(?=" + attr.format(name="http-equiv", value=r"refresh\b") + r")[^>]*?\surl\s*=\s*'?([^\"'\s>;]+)".replace(r"\surl", r"[\s;\"']url")
    # most pages have neither; a plain substring test spares them the expression
    html = F.col("html")
    some = pages.where(F.lower(html).contains("canonical") | F.lower(html).contains("refresh"))
    found = some.select("url", F.explode(F.concat(F.regexp_extract_all(html, F.lit(link), F.lit(1)), F.regexp_extract_all(html, F.lit(meta), F.lit(1)))).alias("to")).where("to <> ''")
    return found.select(address(F.col("url")).alias("a"), address(resolved(F.col("url"), F.col("to"))).alias("b")).where("a is not null and b is not null and a <> b")


def url_filter(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, component) of every row of pages (page_id, url, html).

    edges: (a, b) urls, redirects from a crawl's log, besides the canonical links and refreshes in
    html. Pages that these join, in whatever direction and over however many steps, form one
    component. A rule that fits a page decides it, so an explicit allow always holds. A page
    without a rule is blocked if any address of its component, fetched or only linked to, is
    blocked by a rule, and is allowed otherwise.

    Null url, or one without `://`: host and path empty, no rule, allow. Null html: no links.
    Repeated rows: each is judged. Empty table: empty result. Other columns are ignored.
    """
    url = F.col("url")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), address(url).alias("address"))
    judged = judged.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    links = links_of(pages)
    if edges is not None:
        links = links.unionByName(edges.select(address(F.col("a")).alias("a"), address(F.col("b")).alias("b")))
    names = cut(connected_components(links), "aliases")
    full = F.concat(F.lit("x://"), F.col("node"))
    own = rule_of(host_of(full), path_of(full), rules)
    blocked = names.where(own["verdict"] == "block").select("component").distinct()
    # aliases are of pages with links only; the far larger rest of the pages meets them in one join
    fate = names.join(blocked.withColumn("blocked", F.lit(True)), "component", "left").select(F.col("node").alias("address"), "component", "blocked")
    # pages without an address are nobody's alias: they stay out of the join, where they would all be one key
    out = judged.where("address is not null").join(fate, "address", "left")
    out = out.unionByName(judged.where("address is null"), allowMissingColumns=True)
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "component")
