"""URL rules whose block decisions reach the aliases of a url.

Everything here is built from column functions and joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusquery.functions.binding import let
from corpusquery.llm.components import connected_components
from corpusquery.plans.joins import join_by_size, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Rules are a constant of the plan.
MAX_RULES = 10_000

LINK_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
# The value of an attribute, in quotes of either kind or in none.
VALUE = r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
CANONICAL = r"(?i)(?:^|\s)canonical(?:\s|$)"
REFRESH = r"(?i)^\s*refresh\s*$"
REFRESH_URL = r"(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*(.*)$"
# A scheme that is not followed by a host.
OTHER_SCHEME = r"(?i)^[a-z][a-z0-9+.-]*:(?!//)"


def _rest(url: Column) -> Column:
    """What follows the first ``://``, empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    """Host with A-Z lower-cased; port and user stay part of it.  Null gives an empty host."""
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """Path without query and fragment.  Null gives an empty path."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """A url without scheme and fragment, its host lower-cased; null without ``://``."""

    def lowered(rest: Column) -> Column:
        host = F.translate(F.regexp_extract(rest, r"^([^/?]*)", 1), UPPER, LOWER)
        return F.concat(host, F.regexp_extract(rest, r"(?s)^[^/?]*(.*)$", 1))

    return F.when(
        F.instr(url, "://") > 0, let(F.substring_index(_rest(url), "#", 1), lowered)
    )


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """``struct(length, allows, rule, action)`` of the longest fitting rule, or null.

    ``rules`` are pairs of action (``allow`` or ``block``) and ``host/path``.  A
    rule fits its host and every subdomain when the path starts with the rule's.
    Of rules of one length an allowing one wins.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} can be part of a plan")
    if not rules:
        return F.lit(None).cast("struct<length:int,allows:int,rule:string,action:string>")
    by_host: dict[str, list[Column]] = {}
    for action, rule in rules:
        if action not in ("allow", "block") or "/" not in rule:
            raise ValueError(f"not a rule: {action} {rule}")
        name, _, tail = rule.partition("/")
        by_host.setdefault(name.lower(), []).append(
            F.struct(
                F.lit(len(rule)).alias("length"),
                F.lit(int(action == "allow")).alias("allows"),
                F.lit(rule).alias("rule"),
                F.lit(action).alias("action"),
                F.lit("/" + tail).alias("prefix"),
            )
        )
    table = F.create_map(*[x for name, own in by_host.items() for x in (F.lit(name), F.array(*own))])

    def longest(labels: Column) -> Column:
        hosts = F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
        )
        known = F.filter(hosts, lambda h: h.isin(*by_host))
        fitting = F.filter(
            F.flatten(F.transform(known, lambda h: table[h])), lambda r: F.startswith(path, r["prefix"])
        )
        return F.array_max(
            F.transform(fitting, lambda r: F.struct(r["length"], r["allows"], r["rule"], r["action"]))
        )

    return let(F.split(host, r"\.", -1), longest)


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag, with ``&amp;`` decoded; empty without it."""
    pattern = rf"(?is)\s{name}{VALUE}"
    value = F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])
    return F.regexp_replace(value, r"(?i)&(?:amp|#0*38|#x0*26);", "&")


def _without_dots(path: Column) -> Column:
    """A path whose ``.`` and ``..`` segments are followed."""

    def step(done: Column, segment: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(segment == "..", up).when(segment == ".", done).otherwise(F.concat(done, F.array(segment)))

    def followed(segments: Column) -> Column:
        ends_open = F.element_at(segments, -1).isin(".", "..")
        # The first segment is the empty one before the leading slash and stays.
        start = F.slice(segments, 1, 1)
        done = F.aggregate(F.slice(segments, 2, F.size(segments)), start, step)
        return F.concat(F.array_join(done, "/"), F.when(ends_open, F.lit("/")).otherwise(F.lit("")))

    plain = ~path.contains("/.")
    return F.when(plain, path).otherwise(let(F.split(path, "/", -1), followed))


def resolved(target: Column, url: Column) -> Column:
    """The url that a link on the page ``url`` leads to; null for schemes without a host.

    ``//host/x`` takes the scheme of the page, ``/x`` its host as well, ``?x`` its
    path too, and other relative targets its folder.
    """
    scheme = F.substring_index(url, "://", 1)
    origin = F.concat(scheme, F.lit("://"), url_host(url))

    def complete(t: Column) -> Column:
        path, rest = (F.regexp_extract(t, p, 1) for p in (r"(?s)^([^?#]*)", r"(?s)^[^?#]*(.*)$"))
        folder = F.regexp_extract(url_path(url), r"(?s)^(.*/)", 1)
        folder = F.when(folder == "", F.lit("/")).otherwise(folder)
        return (
            F.when(t.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), t)
            .when(F.startswith(t, F.lit("//")), F.concat(scheme, F.lit(":"), t))
            .when(t.rlike(OTHER_SCHEME) | (t == ""), None)
            .when(path == "", F.concat(origin, url_path(url), rest))
            .when(F.startswith(t, F.lit("/")), F.concat(origin, _without_dots(path), rest))
            .otherwise(F.concat(origin, _without_dots(F.concat(folder, path)), rest))
        )

    return let(F.trim(target), complete)


def page_links(pages: DataFrame) -> DataFrame:
    """``(url, target)`` of canonical links and immediate redirects declared in ``html``.

    Attributes may stand in quotes or not, and targets may be relative to the
    page; those of schemes without a host are null.
    """
    tags = F.regexp_extract_all("html", F.lit(LINK_TAG), F.lit(0))
    named = pages.where(
        F.col("url").contains("://")
        & (F.col("html").rlike(r"(?i)\bcanonical\b") | F.col("html").rlike(r"(?i)\brefresh\b"))
    ).select("url", F.explode(tags).alias("tag"))
    tag = F.col("tag")
    refresh = F.regexp_extract(_attribute(tag, "content"), REFRESH_URL, 1)
    # The url of a refresh may have quotes of its own.
    refresh = F.regexp_replace(refresh, r"(?s)^([\"'])(.*?)(?:\1.*)?$", "$2")
    target = F.when(_attribute(tag, "rel").rlike(CANONICAL), _attribute(tag, "href")).when(
        _attribute(tag, "http-equiv").rlike(REFRESH), refresh
    )
    return named.select("url", resolved(target, F.col("url")).alias("target"))


def blocked_aliases(links: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``(alias)``: keys of all urls in a component of ``links`` that a rule blocks in part.

    ``links`` has ``url`` and ``target``.  Targets are judged by the rules even
    where no page has that url.
    """
    edges = links.select(alias_key(F.col("url")).alias("a"), alias_key(F.col("target")).alias("b"))
    nodes = materialize(connected_components(edges), "aliases")
    # A key starts with its host, so the key itself can be judged.
    url = F.concat(F.lit("x://"), F.col("node"))
    rule = matching_rule(url_host(url), url_path(url), rules)
    bad = nodes.where(rule["action"] == "block").select("component").distinct()
    return nodes.join(bad, "component", "left_semi").select(F.col("node").alias("alias"))


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]], links: DataFrame | None = None
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` (allow or block) to pages ``(url, ...)``.

    The url's own longest rule decides; an explicit allow is therefore never
    overruled by an alias.  A url without a rule is blocked if any url that is
    equivalent to it is blocked by a rule.  Equivalence is the connected
    component over ``links`` (``url``, ``target``: redirects and canonical
    links), by default those declared in ``html``.  Everything else is allowed.

    A null url, or one without ``://``, has an empty host and path, no rule and
    is allowed.  Repeated rows are judged alike and all returned; further
    columns stay, but those named like a result are replaced.
    """
    links = page_links(pages) if links is None else links
    aliases = blocked_aliases(links, rules).withColumn("blocked", F.lit(True))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    # The caller's columns travel as one, so their names meet no others here.  A
    # url that very many pages share is spread by the short ones of them.
    short = [c for c in kept if dict(pages.dtypes)[c] in ("bigint", "int", "string") and c.lower() != "html"]
    named = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("own"),
        F.xxhash64(*[F.col(f"`{c}`") for c in short]).alias("mix"),
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
        alias_key(F.col("url")).alias("alias"),
    )
    ruled = named.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    joined = join_by_size(ruled, aliases, ["alias"], "left", spread_by=["mix"])
    method = F.when(F.col("blocked"), "block").otherwise("allow")
    return joined.select(
        *[F.col("own").getField(c).alias(c) for c in kept],
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.action"), method).alias("verdict"),
    )
