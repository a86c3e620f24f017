"""URL filters with redirect equivalence, in DataFrame operations only.

A page's own verdict comes from host and path rules (longest fitting rule).  Pages without a rule
take the decision of their aliases: redirects (meta refresh) and canonical links are edges between
URLs, distributed connected components join aliases, and a component with a blocked member and no
explicitly allowed one is blocked (an explicit allow anywhere in it wins).

Targets are resolved against the page's URL, with HTML entities replaced.

Defined cases: a null or relative page URL has an empty host and path, fits no rule, has no alias and is
allowed; null html gives no edges; repeated rows are judged alike; links to URLs outside the table
still join their aliases; an empty table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import let, stored, table

#: Fixed values: (host suffix, path prefix, verdict) of the rules to apply.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule (host and path text together; ties: allow) that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow"))
    out = None
    for h, p, verdict in ordered:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def same_page(url: Column) -> Column:
    """An alias node: the URL without its fragment, host in lower case; null for a relative URL."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.when(head == "", F.lit(None).cast("string")).otherwise(F.concat(F.translate(head, UPPER, LOWER), F.substr(bare, F.length(head) + 1)))


def unescaped(value: Column) -> Column:
    """value with its HTML character references (numeric, or named with a semicolon) replaced."""
    import json
    from html.entities import html5

    # One literal that the optimizer turns into the map; a call for each of the names would take seconds to plan.
    names = F.from_json(F.lit(json.dumps({"&" + k: v for k, v in html5.items() if k.endswith(";")})), "map<string,string>")

    def plain(token: Column) -> Column:
        digits = F.regexp_extract(token, r"^&#[xX]?([0-9a-fA-F]+);", 1)
        code = F.when(token.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
        known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(token.startswith("&#") & known, char).otherwise(F.coalesce(F.element_at(names, token), token))

    tokens = F.regexp_extract_all(value, F.lit(r"(?s)&#[0-9]{1,8};|&#[xX][0-9a-fA-F]{1,6};|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&"), F.lit(0))
    return F.when(value.contains("&"), F.array_join(F.transform(tokens, plain), "")).otherwise(value)


def resolved(target: Column, page: Column) -> Column:
    """The absolute URL that target means on a page (RFC 3986), without fragment; page is absolute."""
    bare, base = F.regexp_replace(target, r"(?s)#.*$", ""), F.regexp_replace(page, r"(?s)[?#].*$", "")
    scheme, origin = F.regexp_extract(base, r"(?s)^(.*?:)//", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/]*)", 1)
    path = F.substr(base, F.length(origin) + 1)
    full = F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), F.regexp_extract(path, r"(?s)^/?(.*/)?", 1), bare))
    steps = F.split(F.regexp_extract(full, r"(?s)^/([^?]*)", 1), "/")
    last = F.element_at(steps, -1).isin(".", "..")
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(x == ".", out).otherwise(F.concat(out, F.array(x))))
    tidy = F.concat(origin, F.lit("/"), F.array_join(kept, "/"), F.when(last & (F.size(kept) > 0), "/").otherwise(""), F.regexp_extract(full, r"(?s)(\?.*)$", 1))
    return (F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), bare).when(bare.startswith("//"), F.concat(scheme, bare))
            .when(bare == "", F.regexp_replace(page, r"(?s)#.*$", "")).when(bare.startswith("?"), F.concat(base, bare)).otherwise(tidy))


def alias_links(pages: DataFrame) -> DataFrame:
    """(a, b): the page's URL and the URL, resolved against it, that it names as canonical or refreshes to."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))

    def target(tag: Column) -> Column:
        def value(name: str) -> Column:
            found = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
            return F.trim(unescaped(F.concat(*[F.regexp_extract(tag, found, k) for k in (1, 2, 3)])))

        canonical = F.array_contains(F.split(F.lower(value("rel")), r"\s+"), "canonical")
        refresh = F.lower(value("http-equiv")) == "refresh"
        url = F.regexp_extract(value("content"), r"(?is)url\s*=\s*[\"']?\s*([^\"'>\s]+)", 1)
        href = F.regexp_extract(value("href"), r"^([^\"'>\s]*)", 1)
        return F.when(canonical, href).when(refresh, url)

    has = F.col("html").rlike(r"(?i)canonical|http-equiv")
    found = pages.where("url is not null and html is not null").where(has).where(same_page(F.col("url")).isNotNull()).select("url", F.explode(F.transform(tags, target)).alias("to"))
    found = found.where("to != ''")
    return found.select(same_page(F.col("url")).alias("a"), same_page(resolved(F.col("to"), F.col("url"))).alias("b")).where("a is not null and b is not null and a != b")


def judged(pages: DataFrame, links: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict, decided_by (rule, alias or default)."""
    own = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.withColumn("hit", best_rule(F.col("host"), F.col("path"), rules))
    links = stored((links if links is not None else alias_links(pages)).select("a", "b"))
    if links.isEmpty():
        spread = F.lit(None).cast("string")
        out = own.withColumn("spread", spread)
    else:
        nodes = stored(components(links))
        # Decisions of every alias URL, in the table or only linked to.
        mark = best_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
        by_root = nodes.withColumn("v", mark).groupBy("root").agg(F.max((F.col("v") == "allow").cast("int")).alias("yes"), F.max((F.col("v") == "block").cast("int")).alias("no"))
        verdict = F.when(F.col("yes") == 1, "allow").when(F.col("no") == 1, "block")
        alias = nodes.join(by_root, "root").select(F.col("node").alias("at"), verdict.alias("spread"))
        out = own.withColumn("at", same_page(F.col("url"))).join(alias, "at", "left")
    final = F.coalesce(F.col("hit.verdict"), F.col("spread"), F.lit("allow"))
    by = F.when(F.col("hit").isNotNull(), "rule").when(F.col("spread").isNotNull(), "alias").otherwise("default")
    return out.select("page_id", "url", "host", "path", F.col("hit.rule").alias("rule"), final.alias("verdict"), by.alias("decided_by"))


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


#: The tables hold no redirect or canonical link, which tests/llm plants; the oracle states rules and default.
ORACLE = r"""
with u as (
  select page_id,
         case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages),
s as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r as (select * from (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(h, p, v)),
hit as (
  select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v
  from s join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select s.page_id, host, path, rule, coalesce(v, 'allow') as verdict from s left join hit using (page_id)
"""
