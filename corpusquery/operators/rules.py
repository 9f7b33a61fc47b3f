"""Rule expansion and selection of repositories by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusquery.functions.text import repo_parts, url_host
from corpusquery.plans.joins import join_by_size, materialize
from corpusquery.sources.rules import NESTED_KINDS

DEFAULT_HOST = "github.com"

# Kinds whose rules can leave archived repositories or forks out, and select
# by topic.
ARCHIVE_KINDS = ("github", "gitlab", "gitea")
FORK_KINDS = ("github", "gitea")
TOPIC_KINDS = ("github", "gitea")


def _names(column: Column) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def _one(column: Column) -> Column:
    """A singular field as a list; an empty one adds nothing."""
    return F.filter(F.array(column), lambda x: x.isNotNull() & (x != ""))


def expand_rules(nested: DataFrame) -> DataFrame:
    """One rule per owner from nested rules.

    Organisations come first: the list, the single field, then discovered
    names; users follow in the same way.  Names that an include list does not
    hold or an exclude list does are dropped, duplicates are kept.  Rules of
    other kinds give one row each and rules without a host none.
    """
    g = lambda name: F.col("github")[name]
    include, exclude = _names(g("include")), _names(g("exclude"))
    allowed = lambda x: (
        (F.size(include) == 0) | F.array_contains(include, x)
    ) & ~F.array_contains(exclude, x)
    orgs = F.concat(_names(g("orgs")), _one(g("org")), _names(g("discovered")))
    users = F.concat(_names(g("users")), _one(g("user")))
    owner = lambda x, is_org: F.struct(
        F.when(F.lit(is_org), x).otherwise(F.lit("")).alias("org"),
        F.when(F.lit(is_org), F.lit("")).otherwise(x).alias("user"),
    )
    owners = F.concat(
        F.transform(F.filter(orgs, allowed), lambda x: owner(x, True)),
        F.transform(F.filter(users, allowed), lambda x: owner(x, False)),
    )
    single = F.array(
        F.struct(
            F.coalesce(F.col("gitea")["org"], F.lit("")).alias("org"),
            F.coalesce(F.col("gitea")["user"], F.lit("")).alias("user"),
        )
    )
    kind = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in NESTED_KINDS])
    spread = nested.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        "*",
        F.posexplode_outer(F.when(F.col("kind") == "github", owners).otherwise(single)).alias(
            "owner_pos", "owner"
        ),
    ).where(F.col("owner").isNotNull())

    def field(name: str, default, *kinds: str) -> Column:
        """The field of the host struct in use; field names are fixed, never user text."""
        cases = " ".join(f"WHEN '{k}' THEN {k}.{name}" for k in kinds)
        return F.coalesce(F.expr(f"CASE kind {cases} END"), default)

    empty, off, none = F.lit(""), F.lit(False), F.array().cast("array<string>")
    archived = field("archived", off, *ARCHIVE_KINDS)
    return spread.select(
        "rule_pos",
        "owner_pos",
        "kind",
        field("url", empty, *NESTED_KINDS).alias("url"),
        F.col("owner.org").alias("org"),
        F.col("owner.user").alias("user"),
        field("project", empty, "bitbucket_server").alias("project"),
        field("project_type", empty, "bitbucket_server").alias("project_type"),
        field("disable_tls", off, "bitbucket_server").alias("disable_tls"),
        field("name", empty, *NESTED_KINDS).alias("name"),
        F.coalesce(
            field("exclude_repos", F.lit(None), *ARCHIVE_KINDS),
            field("exclude", empty, "gerrit", "bitbucket_server", "gitiles", "cgit"),
        ).alias("exclude"),
        field("topics", none, *TOPIC_KINDS).alias("topics"),
        field("exclude_topics", none, *TOPIC_KINDS).alias("exclude_topics"),
        field("visibility", none, "github").alias("visibility"),
        (F.col("kind").isin(*ARCHIVE_KINDS) & ~archived).alias("no_archived"),
        field("forks", off, *FORK_KINDS).alias("forks"),
        field("only_public", off, "gitlab").alias("only_public"),
        field("exclude_user_repos", off, "gitlab").alias("exclude_user_repos"),
        field("active", off, "gerrit").alias("active"),
        field("fetch_meta_config", off, "gerrit").alias("fetch_meta_config"),
        field("repo_name_format", empty, "gerrit").alias("repo_name_format"),
        field(
            "keep_deleted", off, "github", "gitlab", "gitea", "gerrit", "bitbucket_server"
        ).alias("keep_deleted"),
    )


def rule_host(kind: Column, url: Column) -> Column:
    """Host a rule applies to; the default host may leave its URL out."""
    return F.when((kind == "github") & (url == ""), F.lit(DEFAULT_HOST)).otherwise(url_host(url))


def _admits() -> Column:
    """All clauses of a rule on a repository; a clause that is empty is off."""
    text_on = lambda c: F.col(c) != ""
    kind = F.col("kind")
    # An attribute that a repository does not state is false.
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return (
        (~text_on("r_name") | F.rlike(F.col("name"), F.col("r_name")))
        & (~text_on("r_exclude") | ~F.rlike(F.col("name"), F.col("r_exclude")))
        & (~F.col("no_archived") | ~flag("archived"))
        & (~kind.isin(*FORK_KINDS) | F.col("r_forks") | ~flag("fork"))
        & (~F.col("only_public") | flag("public"))
        & (~F.col("exclude_user_repos") | ~flag("user_owned"))
        & (~F.col("r_active") | flag("active"))
        & ((F.size("r_visibility") == 0) | F.array_contains("r_visibility", F.col("visibility")))
        & topic_admits(F.col("topics"), F.col("r_topics"), F.col("exclude_topics"))
    )


def topic_admits(topics: Column, include: Column, exclude: Column) -> Column:
    """Any included topic, when some are listed, and no excluded one."""
    return ((F.size(include) == 0) | F.arrays_overlap(topics, include)) & ~F.arrays_overlap(
        topics, exclude
    )


def select_repos(repos: DataFrame, rules: DataFrame) -> DataFrame:
    """Repositories that each rule mirrors: ``(rule_pos, repo, keep_deleted)``.

    A rule names a host and often an owner, which makes this an equi-join with
    the regular expressions and flags as a residual filter.  Rules without an
    owner take every repository of their host.
    """
    owner = F.coalesce(
        F.when(F.col("user") != "", F.col("user")), F.when(F.col("org") != "", F.col("org"))
    )
    prepared = materialize(rules.select(
        "rule_pos",
        "kind",
        rule_host(F.col("kind"), F.col("url")).alias("host"),
        owner.alias("owner"),
        F.col("name").alias("r_name"),
        F.col("exclude").alias("r_exclude"),
        F.col("topics").alias("r_topics"),
        "exclude_topics",
        F.col("visibility").alias("r_visibility"),
        "no_archived",
        F.col("forks").alias("r_forks"),
        "only_public",
        "exclude_user_repos",
        F.col("active").alias("r_active"),
        "keep_deleted",
    ), "rules")
    by_owner = join_by_size(
        repos, prepared.where(F.col("owner").isNotNull()), ["host", "owner"], "inner", ["repo"]
    )
    by_host = join_by_size(
        repos, prepared.where(F.col("owner").isNull()).drop("owner"), ["host"], "inner", ["repo"]
    )
    return by_owner.unionByName(by_host).where(_admits()).select("rule_pos", "repo", "keep_deleted")


def filter_owners(owners: DataFrame, include: DataFrame, exclude: DataFrame, include_on: bool) -> DataFrame:
    """Keep owners in ``include`` (when it is in use) and not in ``exclude``."""
    kept = owners
    if include_on:
        kept = join_by_size(kept, include.select("owner").distinct(), ["owner"], "left_semi", kept.columns)
    return join_by_size(kept, exclude.select("owner").distinct(), ["owner"], "left_anti", kept.columns)


def match_first_rule(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """First GitHub rule, in rule order, whose organisation or user owns the repository.

    Requests ``(request_id, repo)`` that match no rule are kept as failed with
    the reason.  Rules are reduced to the first one per owner before the join,
    so no request fans out.
    """
    # Error texts.
    invalid = F.format_string('invalid repo path "%s": expected host/owner/name', F.col("repo"))
    missing = F.format_string('no mirror config found for "%s"', F.col("repo"))
    # Only organisations and users of this kind are owners here.
    hub = rules.where(F.col("kind") == "github")
    first = (
        hub.select(
            "rule_pos",
            F.explode(F.array(F.coalesce("org", F.lit("")), F.coalesce("user", F.lit("")))).alias("owner"),
        )
        .where(F.col("owner") != "")
        .groupBy("owner")
        .agg(F.min("rule_pos").alias("rule_pos"))
    )
    parsed = requests.withColumn("p", repo_parts(F.col("repo"))).select(
        "request_id",
        "repo",
        F.col("p.valid").alias("valid"),
        F.when(F.col("p.valid"), F.col("p.owner")).alias("owner"),
        F.when(F.col("p.valid"), F.col("p.name")).alias("name"),
    )
    joined = join_by_size(parsed, first, ["owner"], "left", spread_by=["request_id"])
    matched = F.col("rule_pos").isNotNull()
    return joined.select(
        "request_id",
        "repo",
        "rule_pos",
        F.when(matched, F.concat(F.lit("^"), "name", F.lit("$"))).alias("scoped_name"),
        F.when(~matched, F.lit("failed")).alias("status"),
        F.when(~F.col("valid"), invalid).when(~matched, missing).alias("error"),
    )


def first_per_key(df: DataFrame, key: str, order: str, condition: Column | None = None) -> DataFrame:
    """First row per key among those that meet a condition.

    Spark keeps one row per key and partition before the shuffle.
    """
    eligible = df if condition is None else df.where(condition)
    rank = F.row_number().over(W.partitionBy(key).orderBy(order))
    return eligible.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")
