"""URL filters whose decisions spread over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import table

#: (verdict, host, path prefix)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules become one expression; more are joined by host.
INLINE = 64


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host from the first :// up to /, ?, # or the end, A-Z lower-cased; the path then up to ?, # or the end."""
    parts = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(parts(1), UPPER, LOWER), parts(2)


def without_dots(path: Column) -> Column:
    """A path that starts with /, its segments . and .. carried out."""
    step = lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x))
    # a dot segment at the end leaves a /
    parts = F.split(F.regexp_replace(F.substring(path, 2, 1 << 30), r"(?s)(\A|/)(\.\.?)\z", "$1$2/"), "/")
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def resolved(target: Column, base: Column) -> Column:
    """The url that a link names on the page at base (RFC 3986), as it is if it has a scheme and ://.

    Null for a fragment of the page itself, other schemes (mailto:), and relative targets where base has no ://."""
    of = lambda k: F.regexp_extract(base, r"(?s)\A([^:/?#]+):(//[^/?#]*)([^?#]*)", k)
    path, rest = (F.regexp_extract(target, r"(?s)\A([^?#]*)(.*)", k) for k in (1, 2))
    folder = F.concat(F.when(of(3) == "", "/").otherwise(F.regexp_extract(of(3), r"(?s)\A(.*/)", 1)), path)
    inner = F.when(F.startswith(target, F.lit("?")), of(3)).when(F.startswith(target, F.lit("/")), without_dots(path)).otherwise(without_dots(folder))
    return (
        F.when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"\A(#|[A-Za-z][A-Za-z0-9+.-]*:|\z)") | (of(1) == ""), F.lit(None))
        .when(F.startswith(target, F.lit("//")), F.concat(of(1), F.lit(":"), target))
        .otherwise(F.concat(of(1), F.lit(":"), of(2), inner, rest))
    )


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) of the canonical links and the refresh redirects that pages declare, relative ones resolved against the page's url (a <base> tag is not read)."""
    html = F.col(html_col)
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), 0)
    tag = pages.where(F.col(url_col).isNotNull() & (F.contains(html, F.lit("anonical")) | F.contains(html, F.lit("efresh")) | F.contains(html, F.lit("CANONICAL")) | F.contains(html, F.lit("EFRESH"))))
    tag = tag.select(F.col(url_col).alias("src"), F.explode(tags).alias("tag"))
    canonical = F.when(F.col("tag").rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b"), F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.when(F.col("tag").rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract("tag", r"(?is)\burl\s*=\s*['\"]?([^\"'\s>;]+)", 1))
    return tag.select("src", resolved(F.coalesce(canonical, refresh), F.col("src")).alias("dst")).where("dst is not null")


def apply_rules(df: DataFrame, rules: tuple[tuple[str, str, str], ...] | DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """Adds rule and rule_verdict of the longest rule that fits, null without one; of equally long ones the first in order of text.

    A few rules become one CASE from the longest down, without a shuffle. A large table of rules (verdict, host, path) is
    joined by the host and its parent domains; rows are then grouped again, so no rule list has to fit into memory.
    """
    if isinstance(rules, DataFrame):
        some = rules.limit(INLINE + 1).collect()
        if len(some) <= INLINE:
            rules = tuple((r["verdict"], r["host"], r["path"]) for r in some)
    if not isinstance(rules, DataFrame):
        fits = lambda h, p: ((F.col(host) == h) | F.endswith(F.col(host), F.lit("." + h))) & F.startswith(F.col(path), F.lit(p))
        found = F.lit(None).cast("struct<rule:string,verdict:string>")
        for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
            found = F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
        return df.withColumn("_r", found).withColumns({"rule": F.col("_r.rule"), "rule_verdict": F.col("_r.verdict")}).drop("_r")
    r = rules.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("verdict").alias("_v"))
    keys = df.select(host, path).where(F.length(host) > 0).distinct()
    labels = F.split(F.col(host), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hit = keys.withColumn("_h", F.explode(parents)).join(r, "_h").where(F.startswith(F.col(path), F.col("_p")))
    text = F.concat("_h", "_p")
    best = hit.groupBy(host, path).agg(F.min(F.struct((-F.length(text)).alias("n"), text.alias("rule"), F.col("_v").alias("verdict"))).alias("_b"))
    best = best.select(F.col(host).alias("_bh"), F.col(path).alias("_bp"), F.col("_b.rule").alias("rule"), F.col("_b.verdict").alias("rule_verdict"))
    return df.join(best, (F.col(host) == F.col("_bh")) & (F.col(path) == F.col("_bp")), "left").drop("_bh", "_bp")


def url_filter(
    pages: DataFrame, rules: tuple[tuple[str, str, str], ...] | DataFrame = RULES, redirects: DataFrame | None = None, *,
    id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", default: str = "allow",
) -> DataFrame:
    """One row per page: id, url, host, path, rule, verdict, alias_group (null where nothing is linked).

    redirects: (src, dst) besides the links that pages declare. Urls that these connect are aliases. A page's own rule decides.
    Without one, its aliases do, linked urls that are no page among them: if a rule allows any it is allowed, else if a rule
    blocks any it is blocked, else `default`. Null urls and urls without :// have an empty host and path; null ones are on their own.
    Rows that repeat an id or a url are judged each, equal urls alike. A tie of two rules of one length goes to the first in order of text.
    Of other columns of pages none is read, whatever its name. Very long pages are searched whole for links; an empty table gives no rows.
    """
    host, path = split_url(F.col(url_col))
    p = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host.alias("host"), path.alias("path"))
    p = apply_rules(p, rules)
    edges = links(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        more = redirects.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
        edges = more if edges is None else edges.union(more)
    if edges is not None:
        edges = table(edges, "links")
    if edges is None or edges.isEmpty():
        group = p.withColumns({"alias_group": F.lit(None).cast("string"), "_g": F.lit(None).cast("string")})
    else:
        members = table(components(edges, "src", "dst"), "aliases")
        h, q = split_url(F.col("node"))
        judged = apply_rules(members.select("node", "component", h.alias("host"), q.alias("path")), rules)
        verdict = F.when(F.max(F.when(F.col("rule_verdict") == "allow", 1)) == 1, "allow").when(F.max(F.when(F.col("rule_verdict") == "block", 1)) == 1, "block")
        decided = judged.groupBy("component").agg(verdict.alias("_g"))
        of = members.join(decided, "component").select(F.col("node").alias("_node"), F.col("component").alias("alias_group"), "_g")
        group = p.join(of, F.col("_url") == F.col("_node"), "left").drop("_node")
    return group.select(
        F.col("_id").alias(id_col), F.col("_url").alias(url_col), "host", "path", "rule", F.coalesce("rule_verdict", "_g", F.lit(default)).alias("verdict"), "alias_group"
    )


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def chains(pages: DataFrame) -> DataFrame:
    """(src, dst) of made-up redirects: each page to the one of the next id, five pages a chain."""
    to = pages.select((F.col("page_id") - 1).alias("_p"), F.col("url").alias("dst"))
    return pages.where("page_id % 5 != 4").join(to, F.col("page_id") == F.col("_p")).select(F.col("url").alias("src"), "dst")


def url_redirect_chains(spark, sf_dir: str) -> DataFrame:
    """The pages declare no links, so this query gives the filter redirects between them: decisions then spread over chains of aliases."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter(pages, redirects=chains(pages)).select("page_id", "host", "path", "rule", "verdict", "alias_group")


_PARTS = r"""u AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
b AS (SELECT u.page_id, u.url, u.host, u.path, r.h || r.p AS rule, r.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.h || r.p) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))"""
#: No page of the tables declares an alias, so rules alone decide there.
OP9_SQL = f"WITH {_PARTS} SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM b WHERE k = 1"
CHAINS_SQL = f"""
WITH RECURSIVE {_PARTS},
l AS (SELECT x.url AS src, y.url AS dst FROM pages x JOIN pages y ON y.page_id = x.page_id + 1 WHERE x.page_id % 5 <> 4 AND x.url <> y.url),
e AS (SELECT src AS a, dst AS b FROM l UNION SELECT dst, src FROM l),
reach(n, m) AS (SELECT a, a FROM e UNION SELECT reach.n, e.b FROM reach JOIN e ON reach.m = e.a),
one AS (SELECT url, max(verdict) AS verdict FROM b WHERE k = 1 GROUP BY url),
g AS (SELECT n, min(m) AS alias_group, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' END AS verdict FROM reach JOIN one ON m = url GROUP BY n)
SELECT page_id, host, path, rule, coalesce(b.verdict, g.verdict, 'allow') AS verdict, alias_group FROM b LEFT JOIN g ON b.url = g.n WHERE k = 1
"""
