"""The corpus views that the registered queries run on, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusquery.functions.text import url_host
from corpusquery.operators.symbols import SymbolRule
from corpusquery.plans.partitioning import spread
from corpusquery.sources.rules import NESTED_KINDS, struct_ddl


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(table(spark, sf_dir, "documents"))


def spread_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files`` for work that is heavy per byte, on all cores."""
    return as_files(spread(table(spark, sf_dir, "documents")))


def as_files(documents: DataFrame) -> DataFrame:
    """Documents as files of the repository named by their source."""
    return documents.select(
        F.col("source").alias("repo"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("HEAD"), F.lit("master")))
        .otherwise(F.array(F.lit("HEAD")))
        .alias("branches"),
        F.col("lang").alias("language"),
        F.col("text").alias("content"),
    )


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source with attributes derived from its number."""
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("repo")).distinct()
    number = F.regexp_extract("repo", r"(\d+)$", 1).cast("bigint")
    return names.select("repo", number.alias("id")).select(
        "repo",
        "id",
        (F.col("id") % 5 == 0).alias("archived"),
        (F.col("id") % 3 == 0).alias("fork"),
        (F.col("id") % 2 == 0).alias("public"),
        F.concat(
            F.array(F.concat(F.lit("t"), (F.col("id") % 4).cast("string"))),
            F.when(F.col("id") % 3 == 0, F.array(F.lit("attic"))).otherwise(
                F.array().cast("array<string>")
            ),
        ).alias("topics"),
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as files of the repository named by their host."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        url_host(F.col("url")).alias("repo"),
        F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.array(F.lit("HEAD")).alias("branches"),
        F.lit("html").alias("language"),
        F.col("html").alias("content"),
    )


def turn_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as files of the repository named by the conversation."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("repo"),
        F.concat(F.col("turn").cast("string"), F.lit("."), F.col("role")).alias("path"),
        F.array(F.lit("HEAD")).alias("branches"),
        F.col("role").alias("language"),
        F.col("text").alias("content"),
    )


HTML_RULES = [
    SymbolRule("html", "title", "<title>", "[^<]+", "</title>"),
    SymbolRule("html", "heading", "<h[1-6]>", "[^<]+", "</h[1-6]>", parent_kind="title"),
]


def batch_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


EVENT_STATUS = {
    "signup": "pending",
    "view": "running",
    "click": "running",
    "purchase": "completed",
    "error": "failed",
}


def as_task_events(events: DataFrame) -> DataFrame:
    """User events read as status updates of one task per user."""
    status = F.lit(None).cast("string")
    for kind, name in EVENT_STATUS.items():
        status = F.when(F.col("event_type") == kind, name).otherwise(status)
    return events.select(
        F.col("user_id").cast("string").alias("id"),
        F.col("event_id").alias("seq"),
        status.alias("status"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        "ts",
    )


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_task_events(table(spark, sf_dir, "events"))


def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier index: some documents missing, some with another content."""
    return _entries(table(spark, sf_dir, "documents").where(F.col("doc_id") % 10 != 0))


def complete_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all documents."""
    return _entries(table(spark, sf_dir, "documents"))


def _entries(d: DataFrame) -> DataFrame:
    return d.select(
        F.col("source").alias("repo"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("source")).alias("source"),
        (F.col("doc_id") % 8).alias("shard"),
        F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.sha2("text", 256)).alias("content_sha"),
        F.octet_length("text").cast("bigint").alias("index_bytes"),
    )


def current_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as it is now: some documents were deleted."""
    d = table(spark, sf_dir, "documents").where(F.col("doc_id") % 13 != 0)
    return d.select(
        F.col("source").alias("repo"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.sha2("text", 256).alias("content_sha"),
    )


def earlier_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus at an earlier time: four sources have changed since, one is new and one was deleted."""
    d = table(spark, sf_dir, "documents")
    source, n = F.col("source"), F.col("doc_id")
    changed = source.isin("src1", "src4") & (n % 3 == 0)
    missing = (source == "src2") | ((source == "src5") & (n % 4 == 0))
    rows = d.where(~missing).select(
        source.alias("repo"),
        F.concat("lang", F.lit("/"), n.cast("string"), F.lit(".txt")).alias("path"),
        F.when(changed, "old").otherwise(F.sha2("text", 256)).alias("content_sha"),
    )
    gone = d.where(source == "src7").select(F.lit("gone").alias("repo"), n.cast("string").alias("path"), F.lit("x").alias("content_sha"))
    return rows.unionByName(gone)


def all_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.sha2("text", 256).alias("content_sha"),
    )


def live_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.where(F.col("source") != "src3").select("source").distinct()


def hosted_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a hosted repository ``host/owner/name`` with attributes."""
    p = table(spark, sf_dir, "pages")
    location = r"^[a-z]+://([^/?#]+)/([^/?#]+)/([^/?#]+)"
    n = F.col("page_id")
    return p.select(
        n.alias("id"),
        F.regexp_extract("url", location, 1).alias("host"),
        F.regexp_extract("url", location, 2).alias("owner"),
        F.regexp_extract("url", location, 3).alias("name"),
        (n % 5 == 0).alias("archived"),
        (n % 3 == 0).alias("fork"),
        (n % 2 == 0).alias("public"),
        (n % 7 != 0).alias("active"),
        (n % 6 == 0).alias("user_owned"),
        F.element_at(
            F.array(F.lit("public"), F.lit("private"), F.lit("internal")), (n % 3 + 1).cast("int")
        ).alias("visibility"),
        F.concat(
            F.array(F.concat(F.lit("t"), (n % 4).cast("string"))),
            F.when(n % 9 == 0, F.array(F.lit("attic"))).otherwise(
                F.array().cast("array<string>")
            ),
        ).alias("topics"),
    ).withColumn("repo", F.concat_ws("/", "host", "owner", "name"))


def flat_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat rule per page, with the fields of its kind of host; every fifth names none."""
    n, url = F.col("id"), F.concat(F.lit("https://"), F.col("host"), F.lit("/api"))
    on = lambda k, value: F.when(n % 5 == k, value)
    rule = F.struct(
        on(0, F.col("owner")).alias("GithubOrg"),
        F.when(n % 10 == 0, url).alias("GitHubURL"),
        on(1, url).alias("GitLabURL"),
        on(2, url).alias("GiteaURL"),
        on(2, F.col("owner")).alias("GiteaUser"),
        on(3, url).alias("GerritApiURL"),
        F.concat(F.lit("rule"), n.cast("string")).alias("Name"),
        F.when(n % 3 == 0, F.lit("^old")).alias("Exclude"),
        F.when(n % 2 == 0, n % 4 == 0).alias("NoArchived"),
        (n % 3 == 1).alias("KeepDeleted"),
    )
    return hosted_repos(spark, sf_dir).select(n.alias("rule_pos"), rule.alias("rule"))


def nested_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested rule per page: its host, an owner and varied filters."""
    return _rules(hosted_repos(spark, sf_dir).select(F.col("id").alias("rule_pos"), "host", "owner"))


def owner_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested rule per host and owner, at the place of their first page."""
    hosted = hosted_repos(spark, sf_dir)
    return _rules(hosted.groupBy("host", "owner").agg(F.min("id").alias("rule_pos")))


def _rules(p: DataFrame) -> DataFrame:
    n = F.col("rule_pos")
    url = F.concat(F.lit("https://"), F.col("host"), F.lit(":8443/api"))
    on = lambda k: n % 5 == k
    empty = F.array().cast("array<string>")
    name = F.when(n % 4 == 0, "[02468]$").otherwise("")
    exclude = F.when(n % 3 == 0, "^1").otherwise("")
    topics = F.when(n % 4 == 1, F.array(F.lit("t1"), F.lit("t2"))).otherwise(empty)
    no_topics = F.when(n % 2 == 0, F.array(F.lit("attic"))).otherwise(empty)
    github = F.struct(
        F.col("owner").alias("org"),
        F.array(F.lit("en"), F.lit("de")).alias("orgs"),
        F.concat(F.lit("user"), n.cast("string")).alias("user"),
        F.array(F.lit("fr")).alias("users"),
        F.when(n % 2 == 0, F.array(F.lit("es"), F.lit("en"))).otherwise(empty).alias("discovered"),
        url.alias("url"),
        name.alias("name"),
        exclude.alias("exclude_repos"),
        topics.alias("topics"),
        no_topics.alias("exclude_topics"),
        F.when(n % 7 == 0, F.array(F.lit("private"), F.lit("internal"))).otherwise(empty).alias("visibility"),
        F.when(n % 4 == 0, F.array(F.lit("en"), F.lit("es"), F.lit("fr"))).otherwise(empty).alias("include"),
        F.when(n % 3 == 0, F.array(F.lit("de"))).otherwise(empty).alias("exclude"),
        (n % 2 == 0).alias("archived"),
        (n % 4 < 2).alias("forks"),
        (n % 3 == 1).alias("keep_deleted"),
    )
    gitlab = F.struct(
        url.alias("url"),
        name.alias("name"),
        exclude.alias("exclude_repos"),
        (n % 2 == 0).alias("only_public"),
        (n % 4 < 2).alias("exclude_user_repos"),
        (n % 3 == 0).alias("archived"),
        (n % 3 == 1).alias("keep_deleted"),
    )
    gitea = F.struct(
        url.alias("url"),
        F.col("owner").alias("org"),
        F.lit("").alias("user"),
        name.alias("name"),
        exclude.alias("exclude_repos"),
        topics.alias("topics"),
        no_topics.alias("exclude_topics"),
        (n % 2 == 0).alias("archived"),
        (n % 4 < 2).alias("forks"),
        (n % 3 == 1).alias("keep_deleted"),
    )
    gerrit = F.struct(
        url.alias("url"),
        name.alias("name"),
        exclude.alias("exclude"),
        (n % 2 == 0).alias("active"),
        F.lit(False).alias("fetch_meta_config"),
        F.lit("").alias("repo_name_format"),
        (n % 3 == 1).alias("keep_deleted"),
    )
    cgit = F.struct(url.alias("url"), name.alias("name"), exclude.alias("exclude"))
    kinds = {"github": (0, github), "gitlab": (1, gitlab), "gitea": (2, gitea), "gerrit": (3, gerrit), "cgit": (4, cgit)}
    columns = []
    for kind, ddl in NESTED_KINDS.items():
        if kind in kinds:
            k, value = kinds[kind]
            columns.append(F.when(on(k), value.cast(struct_ddl(ddl))).alias(kind))
        else:
            columns.append(F.lit(None).cast(struct_ddl(ddl)).alias(kind))
    return p.select("rule_pos", *columns)
