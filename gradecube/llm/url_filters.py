"""Operator 9: empirical-Bayes host reputation beside a short list of url rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rule, verdict; the part before the first slash is a host, the rest a path prefix.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Public suffixes of two labels.
TWO_LABEL_SUFFIXES = "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.jp ne.jp or.jp co.nz co.za com.br com.mx com.cn com.tr co.in co.kr".split()
#: A host goes when the lower bound of its share of bad pages is over BLOCK_OVER; Z standard deviations below the mean.
BLOCK_OVER, Z = 0.5, 1.6448536269514722
LEAST_K, MOST_K = 1.0, 10000.0
#: Hosts with more than this share of the pages, so fewer than its inverse, are joined by broadcast, the others by shuffle.
HOT_SHARE = 1 / 4096


def parts_sql(url: str = "url") -> dict[str, str]:
    """Host, path, reputation host, registered domain and suffix as SQL that Spark and DuckDB both take."""
    return {
        "host": rf"coalesce(translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')",
        "path": rf"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')",
        "site": "regexp_replace(regexp_replace(replace(replace(host, chr(10), ''), chr(13), ''), '^.*@', ''), ':[0-9]*$', '')",
        "suffix": "CASE WHEN regexp_like(site, '^[0-9.]*$') OR site LIKE '[%' THEN '' WHEN regexp_extract(site, '([^.]*[.][^.]*)$', 1) IN ("
        + ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
        + ") THEN regexp_extract(site, '([^.]*[.][^.]*)$', 1) ELSE regexp_extract(site, '([^.]*)$', 1) END",
        "domain": "CASE WHEN suffix = '' OR site = suffix THEN site ELSE concat(regexp_extract(substr(site, 1, length(site) - length(suffix) - 1), '([^.]*)$', 1), '.', suffix) END",
    }


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, _, prefix = name.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def shrunk(children: DataFrame, parents: DataFrame, key: str, parent: str) -> DataFrame:
    """children (key, parent, n, bad and others) with the posterior a, b of each, under a beta prior around its parent's mean without the child's own outcomes.

    The prior's weight comes from the moments of all children about their parents: it is large where they
    differ no more than binomial noise would have them.
    """
    up = parents.select(parent, F.col("a").alias("pa"), F.col("b").alias("pb"))
    c = children.join(up, parent).withColumn("prior", (F.col("pa") - F.col("bad")) / (F.col("pa") + F.col("pb") - F.col("n"))).drop("pa", "pb")
    p = F.col("bad") / F.nullif(F.col("n"), F.lit(0))
    noise = F.col("prior") * (1 - F.col("prior"))
    sums = c.agg(
        F.coalesce(F.sum(F.col("n") * (p - F.col("prior")) * (p - F.col("prior"))), F.lit(0.0)),
        F.coalesce(F.sum(F.when(F.col("n") > 0, noise)), F.lit(0.0)),
        F.coalesce(F.sum(F.col("n")), F.lit(0)).cast("double"),
        F.coalesce(F.avg(noise), F.lit(0.0)),
    )
    s, e, t, v = sums.first()
    k = max(LEAST_K, min(MOST_K, v / ((s - e) / t) - 1)) if t and (s - e) / t > 0 else MOST_K
    a, b = F.lit(k) * F.col("prior") + F.col("bad"), F.lit(k) * (1 - F.col("prior")) + F.col("n") - F.col("bad")
    return c.select(*children.columns, a.alias("a"), b.alias("b")).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))


def url_filter(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] | None = None, block_over: float = BLOCK_OVER) -> DataFrame:
    """Verdict on each page's url.

    pages: page_id, url; labels: doc_id, quality, toxic, where doc_id is the labelled page's page_id and a page is
    bad if its quality is 0 or it is toxic; null labels count as no outcome. A null url or one without "://" has
    empty host and path and shares the reputation of the empty host. A page labelled twice has both outcomes.
    Without labels the prior is one half and nothing is blocked by reputation. Repeated rows each give a row.
    Returns page_id, host, path, rule, verdict, bound (lower bound of the host's share of bad pages).
    """
    sql = parts_sql()
    p = pages.select("page_id", "url").select("page_id", F.expr(sql["host"]).alias("host"), F.expr(sql["path"]).alias("path"))
    bad = F.when(F.col("quality").isNull() & F.col("toxic").isNull(), None).otherwise((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1))
    known = labels.select(F.col("doc_id").alias("page_id"), bad.cast("long").alias("bad"))
    seen = p.join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("*").alias("pages"))
    hosts = stored(seen.withColumn("site", F.expr(sql["site"])).withColumn("suffix", F.expr(sql["suffix"])).withColumn("domain", F.expr(sql["domain"])).drop("site"))
    total = lambda d, *keys: d.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = stored(total(hosts, "domain", "suffix"))
    suffixes = stored(total(domains, "suffix").withColumn("root", F.lit(0)))
    root = total(suffixes, "root").select("root", (F.col("bad") + 1.0).alias("a"), (F.col("n") - F.col("bad") + 1.0).alias("b"))
    suffixes = stored(shrunk(suffixes, root, "suffix", "root"))
    domains = stored(shrunk(domains, suffixes, "domain", "suffix"))
    hosts = shrunk(hosts, domains, "host", "domain")
    total_ab = F.col("a") + F.col("b")
    bound = F.col("mean") - Z * F.sqrt(F.col("a") * F.col("b") / (total_ab * total_ab * (total_ab + 1)))
    hosts = stored(hosts.select("host", "pages", F.greatest(F.lit(0.0), bound).alias("bound")))
    rule, says = rule_of(F.col("host"), F.col("path"), rules or RULES)
    limit = HOT_SHARE * (hosts.agg(F.sum("pages")).first()[0] or 0)
    hot = F.broadcast(hosts.where(F.col("pages") > limit).select("host", "bound"))  # fewer than 1 / HOT_SHARE rows
    cold = hosts.where(F.col("pages") <= limit).select("host", "bound")
    out = p.join(hot, "host").unionByName(p.join(hot, "host", "left_anti").join(cold, "host"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, F.when(F.col("bound") > block_over, "block").otherwise("allow")).alias("verdict"), F.round("bound", 6).alias("bound"))


def _oracle() -> str:
    sql = {k: v.replace("regexp_like(", "regexp_matches(") for k, v in parts_sql().items()}
    rule = "NULL"
    says = "NULL"
    for name, verdict in sorted(RULES, key=lambda r: (len(r[0]), r[0])):
        at, _, prefix = name.partition("/")
        fits = f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{prefix}')"
        rule, says = f"CASE WHEN {fits} THEN '{name}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{verdict}' ELSE {says} END"

    def level(name: str, kids: str, parent: str, key: str, up: str) -> str:
        return f"""{name}_c AS (SELECT c.{key}, c.{up}, c.n, c.bad, (p.a - c.bad) / (p.a + p.b - c.n) AS prior FROM {kids} c JOIN {parent} p USING ({up})),
{name}_s AS (SELECT coalesce(sum(n * (bad / nullif(n, 0) - prior) * (bad / nullif(n, 0) - prior)), 0) AS s, coalesce(sum(CASE WHEN n > 0 THEN prior * (1 - prior) END), 0) AS e, coalesce(sum(n), 0)::DOUBLE AS t, coalesce(avg(prior * (1 - prior)), 0) AS v FROM {name}_c),
{name}_k AS (SELECT greatest({LEAST_K}, least({MOST_K}, coalesce(CASE WHEN (s - e) / nullif(t, 0) > 0 THEN v / ((s - e) / nullif(t, 0)) - 1 END, {MOST_K}))) AS k FROM {name}_s),
{name} AS (SELECT {key}, {up}, k * prior + bad AS a, k * (1 - prior) + n - bad AS b, (k * prior + bad) / (k + n) AS mean FROM {name}_c, {name}_k)"""

    return rf"""
WITH p AS (SELECT page_id, {sql["host"]} AS host, {sql["path"]} AS path FROM pages),
lab AS (SELECT doc_id AS page_id, CASE WHEN quality IS NULL AND toxic IS NULL THEN NULL ELSE (coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1)::INT END AS bad FROM labels),
seen AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM p LEFT JOIN lab USING (page_id) GROUP BY host),
h1 AS (SELECT *, {sql["site"]} AS site FROM seen),
h2 AS (SELECT *, {sql["suffix"]} AS suffix FROM h1),
hs AS (SELECT *, {sql["domain"]} AS domain FROM h2),
ds AS (SELECT domain, suffix, 0 AS root, sum(n) AS n, sum(bad) AS bad FROM hs GROUP BY 1, 2),
ss AS (SELECT suffix, root, sum(n) AS n, sum(bad) AS bad FROM ds GROUP BY 1, 2),
rt AS (SELECT root, sum(bad) + 1.0::DOUBLE AS a, sum(n) - sum(bad) + 1.0::DOUBLE AS b FROM ss GROUP BY 1),
{level("sx", "ss", "rt", "suffix", "root")},
{level("dx", "ds", "sx", "domain", "suffix")},
{level("hx", "hs", "dx", "host", "domain")}
SELECT page_id, host, path, {rule} AS rule,
       coalesce({says}, CASE WHEN greatest(0.0, mean - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) > {BLOCK_OVER} THEN 'block' ELSE 'allow' END) AS verdict,
       round(greatest(0.0, mean - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))), 6) AS bound
FROM p JOIN hx USING (host)
"""


ORACLE = _oracle()
