"""Rule reading, expansion and selection of repositories."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusquery.operators import rules
from corpusquery.plans import joins
from corpusquery.sources.rules import flat_rules, nested_schema, read_flat_rules, read_nested_rules


def nested(spark, *entries):
    rows = [json.dumps({"rule_pos": i, **e}) for i, e in enumerate(entries)]
    df = spark.createDataFrame([(r,) for r in rows], "j string")
    return df.select(F.from_json("j", nested_schema()).alias("r")).select("r.*")


# For each kind of host, fields as they may be written and what they become.
KINDS = {
    "github": ({"user": "ada", "url": "https://hub.test/api", "archived": True}, {"user": "ada", "org": "", "no_archived": False}),
    "gitlab": ({"url": "https://lab.test", "only_public": True}, {"only_public": True, "exclude_user_repos": False}),
    "gitea": ({"org": "crew", "forks": True, "keep_deleted": True}, {"org": "crew", "forks": True, "keep_deleted": True}),
    "gerrit": ({"url": "https://review.test", "fetch_meta_config": True}, {"fetch_meta_config": True, "active": False}),
    "bitbucket_server": ({"project": "PRJ", "disable_tls": True}, {"project": "PRJ", "disable_tls": True}),
    "gitiles": ({"name": "^kernel/", "exclude": "sample$"}, {"name": "^kernel/", "exclude": "sample$"}),
    "cgit": ({"url": "https://c.test/cgit"}, {"url": "https://c.test/cgit", "name": ""}),
}


def test_every_kind_of_host(spark):
    entries = [{kind: fields} for kind, (fields, _) in KINDS.items()]
    # An entry without a host is skipped and does not move the numbers of the others.
    rows = rules.expand_rules(nested(spark, {}, *entries, {})).orderBy("rule_pos").collect()
    assert [(r.rule_pos, r.kind) for r in rows] == list(enumerate(KINDS, 1))
    for row, (_, expected) in zip(rows, KINDS.values()):
        assert {k: row[k] for k in expected} == expected


def random_owners(chance):
    pool = ["ants", "bees", "cats", "dogs", "elks"]
    some = lambda: [chance.choice(pool) for _ in range(chance.randint(0, 3))]
    entry = {"orgs": some(), "users": some(), "discovered": some(), "include": chance.choice([[], some()]), "exclude": some()[:1]}
    for field in ("org", "user"):
        if chance.random() < 0.5:
            entry[field] = chance.choice([*pool, ""])
    return {k: v for k, v in entry.items() if v or chance.random() < 0.5}


def test_owner_expansion_against_plain_lists(spark):
    """Organisations: plural, singular, discovered; then users; inclusion before exclusion."""
    chance = random.Random(12)
    entries = [random_owners(chance) for _ in range(60)]
    expected = []
    for i, e in enumerate(entries):
        owners = [("org", o) for o in [*e.get("orgs", []), e.get("org"), *e.get("discovered", [])] if o]
        owners += [("user", u) for u in [*e.get("users", []), e.get("user")] if u]
        admitted = [(k, o) for k, o in owners if not e.get("include") or o in e["include"]]
        expected += [(i, k, o) for k, o in admitted if o not in e.get("exclude", [])]
    expanded = rules.expand_rules(nested(spark, *[{"github": e} for e in entries]))
    got = [
        (r.rule_pos, "org" if r.org else "user", r.org or r.user)
        for r in expanded.orderBy("rule_pos", "owner_pos").collect()
    ]
    assert got == expected and len(got) > 60


def test_read_flat_rules(spark, tmp_path):
    """The first host field that is set decides; several files are several parts of the table."""
    parts = [
        [{"GiteaUser": "bo", "GiteaURL": "https://tea.test", "Topics": ["x"], "Name": "n2"}, {"Exclude": "^", "Name": "n9"}],
        [{"CGitURL": "https://c.test", "KeepDeleted": True, "Name": "n1"}],
        [],
    ]
    for k, part in enumerate(parts):
        (tmp_path / f"part{k}.json").write_text(json.dumps(part, indent=1))
    raw = read_flat_rules(spark, str(tmp_path))
    assert raw.count() == 3
    numbered = raw.withColumn("rule_pos", F.substring("Name", 2, 9).cast("bigint"))
    got = flat_rules(numbered).orderBy("rule_pos").collect()
    assert [(r.rule_pos, r.kind, r.url, r.user, r.topics, r.keep_deleted) for r in got] == [
        (1, "cgit", "https://c.test", "", [], True), (2, "gitea", "https://tea.test", "bo", ["x"], False),
    ]
    (tmp_path / "part3.json").write_text(json.dumps(parts[0])[:-4])
    with pytest.raises(Exception):
        read_flat_rules(spark, str(tmp_path)).collect()


def test_read_nested_rules(spark, tmp_path):
    path = tmp_path / "nested.json"
    path.write_text(json.dumps([{"rule_pos": 4, "gitea": {"org": "crew", "exclude_topics": ["toy"]}}]))
    row = rules.expand_rules(read_nested_rules(spark, str(path))).first()
    assert (row.rule_pos, row.org, row.exclude_topics, row.topics) == (4, "crew", ["toy"], [])


REPO_DDL = (
    "host string, owner string, name string, archived boolean, fork boolean, public boolean, "
    "active boolean, user_owned boolean, visibility string, topics array<string>"
)


@pytest.fixture(scope="module")
def hosted(spark):
    rows = [
        ("github.com", "o", "service-a", False, False, True, True, False, "public", ["production"]),
        ("github.com", "o", "service-old", True, False, True, True, False, "public", []),
        ("github.com", "o", "legacy-b", False, True, False, True, False, "private", ["deprecated"]),
        ("github.com", "p", "service-c", False, False, True, True, False, "internal", []),
        ("gitlab.example.com", "u", "mine", False, True, False, True, True, "private", []),
        ("gitlab.example.com", "g", "team", True, False, True, True, False, "public", []),
        ("gerrit.example.com", "", "platform/x", False, False, True, False, False, "public", []),
        ("gerrit.example.com", "", "platform/y-test", False, False, True, True, False, "public", []),
    ]
    return spark.createDataFrame(rows, REPO_DDL).withColumn("repo", F.concat_ws("/", "host", "owner", "name"))


SELECTIONS = [
    ({"github": {"org": "o"}}, {"service-a"}),
    ({"github": {"org": "o", "archived": True, "forks": True}}, {"service-a", "service-old", "legacy-b"}),
    ({"github": {"org": "o", "forks": True, "exclude_repos": "^legacy-.*"}}, {"service-a"}),
    ({"github": {"org": "o", "archived": True, "name": "old$"}}, {"service-old"}),
    ({"github": {"org": "o", "archived": True, "topics": ["production", "x"]}}, {"service-a"}),
    ({"github": {"org": "o", "forks": True, "exclude_topics": ["deprecated"]}}, {"service-a"}),
    ({"github": {"org": "o", "forks": True, "visibility": ["private", "internal"]}}, {"legacy-b"}),
    ({"github": {"user": "p"}}, {"service-c"}),
    ({"gitlab": {"url": "https://gitlab.example.com/api/v4/"}}, {"mine"}),
    ({"gitlab": {"url": "https://gitlab.example.com", "archived": True, "exclude_user_repos": True}}, {"team"}),
    ({"gitlab": {"url": "https://gitlab.example.com", "archived": True, "only_public": True}}, {"team"}),
    ({"gerrit": {"url": "https://gerrit.example.com:8443"}}, {"platform/x", "platform/y-test"}),
    ({"gerrit": {"url": "https://gerrit.example.com", "active": True}}, {"platform/y-test"}),
    ({"gerrit": {"url": "https://gerrit.example.com", "exclude": ".*-test$"}}, {"platform/x"}),
]


@pytest.mark.parametrize("limit", [None, 0])
def test_select_repos(spark, hosted, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", limit)
    picked = rules.select_repos(hosted, rules.expand_rules(nested(spark, *[e for e, _ in SELECTIONS])))
    got = {i: set() for i in range(len(SELECTIONS))}
    for r in picked.collect():
        got[r.rule_pos].add(r.repo.split("/", 2)[2])
    assert got == {i: expected for i, (_, expected) in enumerate(SELECTIONS)}


def test_first_rule(spark):
    table = rules.expand_rules(
        nested(spark, {"gitlab": {"url": "https://x"}}, {"github": {"orgs": ["o", "p"]}}, {"github": {"user": "o"}})
    )
    requests = spark.createDataFrame(
        [(1, "any.host/o/name"), (2, "github.com/p/a/b"), (3, "github.com/none/x"), (4, "short")],
        "request_id int, repo string",
    )
    got = {r.request_id: (r.rule_pos, r.scoped_name, r.status, r.error)
           for r in rules.match_first_rule(requests, table).collect()}
    assert got == {
        1: (1, "^name$", None, None),
        2: (1, "^a/b$", None, None),
        3: (None, None, "failed", 'no mirror config found for "github.com/none/x"'),
        4: (None, None, "failed", 'invalid repo path "short": expected host/owner/name'),
    }


def test_first_per_host(spark):
    df = spark.createDataFrame(
        [(0, "github.com", "A"), (1, "github.com", "A"), (2, "ghe.example.com", "A"),
         (3, "gitlab.example.com", "B"), (4, "android.googlesource.com", "")],
        "pos int, host string, value string",
    )
    kept = rules.first_per_key(df, "host", "pos", F.col("value") != "")
    assert [r.pos for r in kept.orderBy("pos").collect()] == [0, 2, 3]
    # One row per key is kept before the shuffle and one after it.
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_filter_owners(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "owner string")
    got = lambda *a: sorted(r.owner for r in rules.filter_owners(*a).collect())
    assert got(names("a", "b", "c", "c"), names("a", "c"), names("a"), True) == ["c", "c"]
    assert got(names("a", "b", "c"), names("a"), names("b"), False) == ["a", "c"]
