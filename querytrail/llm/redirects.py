"""Operator 8: URL rules whose block decisions spread over redirect and canonical links."""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .components import components
from .tables import read


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


# The rules of the registered query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
# Rules are part of the plan as a literal, so their number is bounded.
MOST_RULES = 10_000

LINK_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
CANONICAL = r"(?is)^<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = (r"(?is)^<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)"
           r"[^>]*\bcontent\s*=\s*[^>]*?\burl\s*=\s*[\"']?([^\"'\s>;]+)")


def url_parts(df: DataFrame, url: str, prefix: str = "") -> DataFrame:
    """``df`` with ``host``, ``path`` and ``node`` of a url column.

    ``node`` is the identity of a page: host, path and query; scheme and fragment do not
    matter. It is NULL where the url has no host, so that such pages are nobody's alias. Each
    step is a projection of its own, so nothing is computed twice.
    """
    rest, host, path = f"{prefix}__rest", f"{prefix}host", f"{prefix}path"
    at = F.instr(url, "://")
    cut = df.withColumn(rest, F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url)))
                        .otherwise(""))
    cut = cut.withColumn(rest, F.coalesce(rest, F.lit("")))
    parts = cut.withColumns({
        host: F.translate(F.regexp_extract(rest, "^[^/?#]*", 0),
                          ascii_uppercase, ascii_lowercase),
        path: F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})
    query = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)
    return parts.withColumn(f"{prefix}node", F.when(F.col(host) != "", F.concat(
        host, F.when(F.col(path) == "", "/").otherwise(F.col(path)), query))).drop(rest)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule for a host (or a parent domain) and path as a struct, else NULL.

    Of rules of one length that fit, one that allows goes before one that blocks.
    Host suffixes are looked up in a literal map, one look-up per label of the host.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} can be part of a plan")
    kind = "array<struct<size:int,allows:boolean,rule:string,path:string,verdict:string>>"
    by_host: dict[str, list[Rule]] = {}
    for rule in rules:
        by_host.setdefault(rule.host.lower(), []).append(rule)
    entries = []
    for name, own in by_host.items():
        entries += [F.lit(name), F.array(*[F.struct(
            F.lit(len(r.host) + len(r.path)).alias("size"),
            F.lit(r.verdict == "allow").alias("allows"), F.lit(name + r.path).alias("rule"),
            F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict")) for r in own])]
    if not entries:
        return F.lit(None).cast(kind)[0]
    table = F.create_map(*entries)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.transform(suffixes, lambda s: F.coalesce(
        F.try_element_at(table, s), F.array().cast(kind))))
    fitting = F.filter(found, lambda r: path.startswith(r["path"]))
    return F.try_element_at(F.sort_array(fitting, asc=False), F.lit(1))


def resolved(link: Column, url: Column, host: Column, path: Column) -> Column:
    """A link as written on a page as a whole url; NULL where it leads to no page."""
    scheme = F.coalesce(F.nullif(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1),
                                 F.lit("")), F.lit("http"))
    folder = F.regexp_replace(path, "[^/]*$", "")
    return (F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(scheme, F.lit("://"), host, link))
            .when(link.rlike("^([A-Za-z][A-Za-z0-9+.-]*:|#)"), F.lit(None).cast("string"))
            .otherwise(F.concat(scheme, F.lit("://"), host,
                                F.when(folder == "", "/").otherwise(folder), link)))


def page_links(pages: DataFrame) -> DataFrame:
    """``a, b``: nodes joined by a canonical link or an immediate refresh found in the html."""
    tags = (pages.where(F.col("html").rlike(r"(?i)canonical|refresh"))
            .select("url", F.explode(F.regexp_extract_all("html", F.lit(LINK_TAG), F.lit(0)))
                    .alias("tag")))
    target = F.coalesce(F.nullif(F.regexp_extract("tag", CANONICAL, 1), F.lit("")),
                        F.nullif(F.regexp_extract("tag", REFRESH, 1), F.lit("")))
    links = url_parts(tags.select("url", target.alias("link")).where("link is not null"), "url")
    whole = links.select(F.col("node").alias("a"), resolved(
        F.col("link"), F.col("url"), F.col("host"), F.col("path")).alias("to"))
    return url_parts(whole, "to").select("a", F.col("node").alias("b"))


def redirect_verdicts(pages: DataFrame, rules: Sequence[Rule] = RULES,
                      redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, decided_by`` for every page.

    A page's own rule decides. A page without one takes the decision of its aliases: all urls
    that redirects, canonical links and refreshes connect with its url, in either direction
    and over any number of steps. An alias allowed by a rule allows it; otherwise a blocked
    alias blocks it; otherwise it is allowed. ``decided_by`` says which: rule, alias or default.

    ``redirects`` holds further edges as urls ``src, dst``. Only urls with an edge enter the
    component search; the pages themselves are joined to the decided urls alone, of which
    there is one row each, so a url shared by a third of the pages may be split in the join.

    A NULL url, and one without ``://``, has empty host and path, fits no rule and has no
    alias. Repeated pages get the same answer each. Empty tables give no rows. Extra columns
    are ignored.
    """
    edges = page_links(pages)
    if redirects is not None:
        given = url_parts(url_parts(redirects.select("src", "dst"), "src", "a_"), "dst", "b_")
        edges = edges.union(given.select("a_node", "b_node"))
    roots = components(stored(edges.where("a is not null and b is not null").distinct()))

    def ruled(df: DataFrame) -> DataFrame:
        return df.withColumn("own", matching_rule(F.col("host"), F.col("path"), rules))

    nodes = roots.select("root", F.concat(F.lit("http://"), F.col("node")).alias("url"))
    known = stored(ruled(url_parts(nodes, "url")).select(
        "node", "root", F.col("own")["verdict"].alias("verdict")))
    decisions = known.where("verdict is not null").groupBy("root").agg(
        F.min("verdict").alias("alias_verdict"))  # allow sorts before block
    by_node = known.select("node", "root").join(decisions, "root").select("node", "alias_verdict")

    judged = ruled(url_parts(pages.select("page_id", "url"), "url"))
    own, alias = F.col("own")["verdict"], F.col("alias_verdict")
    return judged.join(by_node, "node", "left").select(
        "page_id", "host", "path", F.col("own")["rule"].alias("rule"),
        F.coalesce(own, alias, F.lit("allow")).alias("verdict"),
        F.when(own.isNotNull(), "rule").when(alias.isNotNull(), "alias")
        .otherwise("default").alias("decided_by"))


def op8_redirect_equivalence(spark: SparkSession, folder: str) -> DataFrame:
    """Every page judged by the five fixed rules and its aliases."""
    return redirect_verdicts(read(spark, folder, "pages"))
