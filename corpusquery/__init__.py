"""Search and analysis of large file collections as PySpark DataFrames."""

from corpusquery.plans.predicates import (
    archived,
    branch,
    case_sensitive,
    fork,
    lang,
    path,
    phrase,
    public,
    regex,
    repo,
    sym,
    term,
)
from corpusquery.operators.search import envelope, list_repos, search, search_lines
from corpusquery.session import build_session, shared_dir
from corpusquery.sources.corpus import get_file, get_files, read_corpus

__all__ = [
    "archived", "branch", "case_sensitive", "fork", "lang", "path", "phrase",
    "public", "regex", "repo", "sym", "term", "search", "search_lines",
    "list_repos", "envelope", "build_session", "shared_dir", "read_corpus",
    "get_file", "get_files",
]
