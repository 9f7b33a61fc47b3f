"""Rule tables: which repositories of a code host belong to the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field names of the flat rule format.
FLAT_TEXT_FIELDS = [
    "GithubUser", "GithubOrg", "BitBucketServerProject", "GitHubURL",
    "GitilesURL", "CGitURL", "BitBucketServerURL", "GiteaURL", "GiteaUser",
    "GiteaOrg", "CredentialPath", "ProjectType", "Name", "Exclude",
    "GitLabURL", "GerritApiURL", "GerritRepoNameFormat",
]
FLAT_FLAG_FIELDS = [
    "DisableTLS", "OnlyPublic", "Active", "NoArchived", "KeepDeleted",
    "GerritFetchMetaConfig", "ExcludeUserRepos", "Forks",
]
FLAT_LIST_FIELDS = ["Topics", "ExcludeTopics", "Visibility"]

# Fields of the nested rule format per host kind.  Credentials
# are left out; ``discovered`` holds owner names found by an earlier step.
NESTED_KINDS = {
    "github": "org string, orgs array<string>, user string, users array<string>, "
    "discovered array<string>, url string, name string, exclude_repos string, "
    "topics array<string>, exclude_topics array<string>, visibility array<string>, "
    "include array<string>, exclude array<string>, archived boolean, forks boolean, "
    "keep_deleted boolean",
    "gitlab": "url string, name string, exclude_repos string, only_public boolean, "
    "exclude_user_repos boolean, archived boolean, keep_deleted boolean",
    "gitea": "url string, org string, user string, name string, exclude_repos string, "
    "topics array<string>, exclude_topics array<string>, archived boolean, "
    "forks boolean, keep_deleted boolean",
    "gerrit": "url string, name string, exclude string, active boolean, "
    "fetch_meta_config boolean, repo_name_format string, keep_deleted boolean",
    "bitbucket_server": "url string, project string, project_type string, "
    "disable_tls boolean, name string, exclude string, keep_deleted boolean",
    "gitiles": "url string, name string, exclude string",
    "cgit": "url string, name string, exclude string",
}

def flat_schema() -> T.StructType:
    return T.StructType(
        [T.StructField(n, T.StringType()) for n in FLAT_TEXT_FIELDS]
        + [T.StructField(n, T.BooleanType()) for n in FLAT_FLAG_FIELDS]
        + [T.StructField(n, T.ArrayType(T.StringType())) for n in FLAT_LIST_FIELDS]
    )


def struct_ddl(fields: str) -> str:
    """``a string, b boolean`` as a struct type."""
    return "struct<" + ",".join(f.strip().replace(" ", ":", 1) for f in fields.split(", ")) + ">"


def nested_schema() -> str:
    kinds = ", ".join(f"{kind} {struct_ddl(fields)}" for kind, fields in NESTED_KINDS.items())
    return f"rule_pos bigint, {kinds}"


def read_flat_rules(spark: SparkSession, path: str) -> DataFrame:
    """Flat rules as written, a JSON array of objects; bad JSON fails the query."""
    return (
        spark.read.schema(flat_schema())
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .json(path)
    )


def read_nested_rules(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Nested rules with one of seven host structs set, an array or one per line (S3)."""
    return (
        spark.read.schema(nested_schema())
        .option("multiLine", not lines)
        .option("mode", "FAILFAST")
        .json(path)
    )


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def flat_rules(flat: DataFrame) -> DataFrame:
    """Common rule table from flat rules with a ``rule_pos`` column.

    The first host field that is set decides the kind; a rule without any is
    ignored.
    """
    is_set = lambda *names: _any_set(names)
    kind = (
        F.when(is_set("GitHubURL", "GithubUser", "GithubOrg"), "github")
        .when(is_set("GitilesURL"), "gitiles")
        .when(is_set("CGitURL"), "cgit")
        .when(is_set("BitBucketServerURL"), "bitbucket_server")
        .when(is_set("GitLabURL"), "gitlab")
        .when(is_set("GerritApiURL"), "gerrit")
        .when(is_set("GiteaURL"), "gitea")
    )
    of_kind = lambda names: F.coalesce(
        *[F.when(F.col("kind") == k, _text(n)) for k, n in names.items()], F.lit("")
    )
    url = of_kind(
        {
            "github": "GitHubURL", "gitiles": "GitilesURL", "cgit": "CGitURL",
            "bitbucket_server": "BitBucketServerURL", "gitlab": "GitLabURL",
            "gerrit": "GerritApiURL", "gitea": "GiteaURL",
        }
    )
    user = of_kind({"github": "GithubUser", "gitea": "GiteaUser"})
    org = of_kind({"github": "GithubOrg", "gitea": "GiteaOrg"})
    return (
        flat.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(
            "rule_pos",
            "kind",
            url.alias("url"),
            org.alias("org"),
            user.alias("user"),
            _text("BitBucketServerProject").alias("project"),
            _text("ProjectType").alias("project_type"),
            _flag("DisableTLS").alias("disable_tls"),
            _text("Name").alias("name"),
            _text("Exclude").alias("exclude"),
            _list("Topics").alias("topics"),
            _list("ExcludeTopics").alias("exclude_topics"),
            _list("Visibility").alias("visibility"),
            _flag("NoArchived").alias("no_archived"),
            _flag("Forks").alias("forks"),
            _flag("OnlyPublic").alias("only_public"),
            _flag("ExcludeUserRepos").alias("exclude_user_repos"),
            _flag("Active").alias("active"),
            _flag("GerritFetchMetaConfig").alias("fetch_meta_config"),
            _text("GerritRepoNameFormat").alias("repo_name_format"),
            _flag("KeepDeleted").alias("keep_deleted"),
        )
    )


def _any_set(names: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for name in names:
        found = found | (_text(name) != "")
    return found
