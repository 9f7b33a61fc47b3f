import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusquery.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


FILE_DDL = (
    "repo string, path string, language string, branches array<string>, "
    "archived boolean, fork boolean, public boolean, content string"
)

MINI = [
    ("droid/app", "src/Main.java", "java", ["HEAD", "master"], False, False, True,
     "class Needle {\n  path file stream;\n}"),
    ("droid/app", "src/a.c", "c", ["HEAD"], False, False, True, "int needle; /* thread */"),
    ("google/go", "x.py", "python", ["HEAD", "master"], False, True, False,
     "class needle:\n  phone = 1\n  hay = 2"),
    ("lib/go", "y.py", "python", ["HEAD"], True, False, True,
     "foo then bar\nPath file Stream\nphone"),
    ("lib/go", "z.txt", "text", ["dev"], True, False, True, "Path File\nStream"),
]


@pytest.fixture(scope="session")
def mini(spark):
    return spark.createDataFrame(MINI, FILE_DDL).cache()


@pytest.fixture(scope="session")
def mini_repos(spark):
    rows = [
        ("droid/app", False, False, True),
        ("google/go", False, True, False),
        ("lib/go", True, False, True),
        ("empty/go", False, False, True),
    ]
    return spark.createDataFrame(rows, "repo string, archived boolean, fork boolean, public boolean").cache()


@pytest.fixture()
def text_file(spark):
    """One-file corpus from a text."""

    def make(*texts, repo="r"):
        rows = [(repo, f"f{i}", "text", ["HEAD"], t) for i, t in enumerate(texts)]
        return spark.createDataFrame(
            rows, "repo string, path string, language string, branches array<string>, content string"
        )

    return make
