"""URL rules, and redirect equivalence: a block reaches every alias of a blocked address. DataFrame operations only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from .graph import components

#: (host, path, verdict), fixed by the query's contract.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def url_host(url: Column) -> Column:
    """Between the first '://' and '/', '?', '#' or the end, A-Z lower-cased; null or no '://': empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """From the host's end to '?', '#' or the end; null or no '://': empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none; equally long ones: the first in byte order.

    A rule fits its host and all subdomains, if the path starts with the rule's. ``rules`` is a list of at most a few
    thousand; the hosts' suffixes are looked up in it, so a row costs its number of labels, not the number of rules.
    """
    by_host: dict[str, list[tuple[str, str]]] = {}
    for h, p, v in rules:
        by_host.setdefault(h, []).append((p, v))
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    of = F.create_map(
        *[x for h, ps in by_host.items() for x in (F.lit(h), F.array(*[F.struct(F.lit(p).alias("p"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for p, v in ps]))]
    )
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.flatten(F.filter(F.transform(suffixes, lambda s: of[s]), lambda x: x.isNotNull())), lambda r: path.startswith(r["p"]))
    best = F.element_at(F.array_sort(F.transform(fits, lambda r: F.struct((-F.length(r["rule"])).alias("o"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))), 1)
    return F.when((host != "") & (F.size(fits) > 0), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) addresses: a page and the target of its canonical link, or of a redirect by meta refresh.

    Targets may be absolute, without a scheme (//host/path) or relative to the host (/path); others are ignored.
    """
    html = F.col(html_col)
    tag = lambda pattern: F.regexp_extract(html, pattern, 0)
    link = F.regexp_extract(tag(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    fresh = F.regexp_extract(tag(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    host = url_host(F.col(url_col))
    dst = F.regexp_replace("dst", "&amp;", "&")
    return (
        pages.filter(html.isNotNull() & F.col(url_col).isNotNull() & (F.contains(F.lower(html), F.lit("canonical")) | F.contains(F.lower(html), F.lit("refresh"))))
        .select(F.col(url_col).alias("src"), host.alias("host"), F.explode(F.array(link, fresh)).alias("dst"))
        .select(
            "src",
            F.when(F.contains(dst, F.lit("://")), dst).when(dst.startswith("//"), F.concat(F.lit("http:"), dst)).when(dst.startswith("/"), F.concat(F.lit("http://"), "host", dst)).alias("dst"),
        )
        .filter("dst is not null")
    )


def judge_urls(pages: DataFrame, edges: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, alias_of (the least address that redirects tie to it; null without any).

    An address is host + path: scheme, query and fragment name no other one. Redirects and canonical links, given by
    ``edges`` (src, dst urls), are taken as an equivalence. A page that a rule fits has that rule's verdict. Any other
    takes its aliases': allow if a rule allows one of them, else block if a rule blocks one, else allow. Urls that are
    null or without '://' have empty host and path, no rule and no aliases: allow. Repeated pages are judged alike.
    """
    address = lambda u: F.concat(url_host(u), url_path(u))
    judged = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    judged = judged.withColumn("own", matched_rule(F.col("host"), F.col("path"), rules)).withColumn("node", F.concat("host", "path"))
    links = edges.select(address(F.col("src")).alias("a"), address(F.col("dst")).alias("b")).filter("a <> '' and b <> ''")
    members = components(links)
    slash = F.expr("case when instr(node, '/') = 0 then length(node) + 1 else instr(node, '/') end")
    own = matched_rule(F.substring("node", F.lit(1), slash - 1), F.expr("substring(node, case when instr(node, '/') = 0 then length(node) + 1 else instr(node, '/') end)"), rules)["verdict"]
    spread = members.groupBy("component").agg(F.max(F.when(own == "allow", 2).when(own == "block", 1).otherwise(0)).alias("v"))
    of = members.join(spread, "component").select("node", F.col("component").alias("alias_of"), "v")
    return judged.join(of, "node", "left").select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", F.when(F.col("v") == 1, "block").otherwise("allow")).alias("verdict"), "alias_of"
    )
