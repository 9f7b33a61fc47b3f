"""Composable search predicates.

A predicate is a small tree of atoms joined by ``&``, ``|`` and ``~``.  It is
turned into one boolean ``Column`` over a row of files, so Catalyst sees an
ordinary filter.  The tree itself is needed for three decisions that a bare
``Column`` cannot answer: whether only repository atoms occur, which symbol
atoms need a join, and which atoms mark lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusquery.functions.patterns import (
    flagged,
    has_upper,
    pattern_has_upper,
    quoted,
)
from corpusquery.functions.folding import fold
from corpusquery.plans.gram_query import Demand, all_of, any_of, literal_demand, pattern_demand


class Predicate:
    """Base of all predicates."""

    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)

    def children(self) -> tuple[Predicate, ...]:
        return ()

    def atoms(self) -> Iterator[Predicate]:
        """Leaves of the tree."""
        below = self.children()
        if not below:
            yield self
        for child in below:
            yield from child.atoms()

    def positive(self, negated: bool = False) -> Iterator[Predicate]:
        """Atoms under an even number of negations."""
        below = self.children()
        if not below and not negated:
            yield self
        for child in below:
            yield from child.positive(negated)

    def line_atoms(self) -> list[ContentAtom]:
        """Content atoms that select lines, each once."""
        return list(dict.fromkeys(a for a in self.positive() if isinstance(a, ContentAtom)))

    def symbol_atoms(self) -> list[Symbol]:
        """Symbol atoms that select lines, each once."""
        return list(dict.fromkeys(a for a in self.positive() if isinstance(a, Symbol)))

    def column(self) -> Column:
        """The predicate as a boolean column over one file row."""
        raise NotImplementedError


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...]

    def children(self):
        return self.parts

    def column(self):
        result = self.parts[0].column()
        for part in self.parts[1:]:
            result = result & part.column()
        return result


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...]

    def children(self):
        return self.parts

    def column(self):
        result = self.parts[0].column()
        for part in self.parts[1:]:
            result = result | part.column()
        return result


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate

    def children(self):
        return (self.part,)

    def positive(self, negated=False):
        yield from self.part.positive(not negated)

    def column(self):
        # Absent values never match, so their negation does.
        return ~F.coalesce(self.part.column(), F.lit(False))


class ContentAtom(Predicate):
    """An atom that looks into the text of a file."""

    case: bool | None

    def line_column(self, line: Column) -> Column:
        raise NotImplementedError

    def line_pattern(self) -> str:
        raise NotImplementedError

    def count_column(self, content: Column, lines: Column) -> Column:
        """Number of matches inside the lines of a file."""
        raise NotImplementedError


@dataclass(frozen=True)
class Term(ContentAtom):
    """Literal text (F1-F4).  ``case=None`` means smart case."""

    text: str
    case: bool | None = None

    def __post_init__(self):
        if not self.text:
            raise ValueError("a term needs some text")

    @property
    def sensitive(self) -> bool:
        return has_upper(self.text) if self.case is None else self.case

    def _needle(self) -> Column:
        # Folded by Spark, so that both sides use the same case mapping.
        return F.lit(self.text) if self.sensitive else fold(F.lit(self.text))

    def _hay(self, text: Column) -> Column:
        return text if self.sensitive else fold(text)

    def line_column(self, line):
        return F.contains(self._hay(line), self._needle())

    def column(self):
        return self.line_column(F.col("content"))

    def line_pattern(self):
        return flagged(quoted(self.text), self.sensitive)

    def count_column(self, content, lines):
        if "\n" in self.text:
            return F.lit(0).cast("bigint")
        hay, needle = self._hay(content), self._needle()
        removed = F.octet_length(hay) - F.octet_length(F.replace(hay, needle, F.lit("")))
        return (removed / F.octet_length(needle)).cast("bigint")


@dataclass(frozen=True)
class Regex(ContentAtom):
    """Regular expression on the text (F5), smart case by default."""

    pattern: str
    case: bool | None = None

    def __post_init__(self):
        if not self.pattern:
            raise ValueError("a regular expression needs a pattern")

    @property
    def sensitive(self) -> bool:
        return pattern_has_upper(self.pattern) if self.case is None else self.case

    def line_pattern(self):
        return flagged(self.pattern, self.sensitive)

    def line_column(self, line):
        return F.rlike(line, F.lit(self.line_pattern()))

    def column(self):
        return self.line_column(F.col("content"))

    def count_column(self, content, lines):
        found = lambda line: F.size(
            F.filter(
                F.regexp_extract_all(line, F.lit(self.line_pattern()), F.lit(0)),
                lambda m: m != "",
            )
        )
        return F.aggregate(
            lines, F.lit(0).cast("bigint"), lambda acc, line: acc + found(line)
        )


@dataclass(frozen=True)
class NamePattern(Predicate):
    """Regular expression on a name column: repository (F10) or path."""

    field: str
    pattern: str

    def column(self):
        regex = flagged(self.pattern, pattern_has_upper(self.pattern))
        return F.rlike(F.col(self.field), F.lit(regex))


@dataclass(frozen=True)
class Language(Predicate):
    """Language of the file, ignoring case."""

    name: str

    def column(self):
        return F.lower(F.col("language")) == F.lower(F.lit(self.name))


@dataclass(frozen=True)
class Symbol(Predicate):
    """A symbol definition whose name contains a text (F13), smart case.

    ``operators.search`` joins the lines of such definitions onto the files,
    in a column that is null for files without any.
    """

    text: str

    def name_column(self) -> Column:
        return Term(self.text).line_column(F.col("sym"))

    def hits(self) -> str:
        return "symbol_hits_" + "".join(f"{b:02x}" for b in self.text.encode())

    def column(self):
        return F.col(self.hits()).isNotNull()


@dataclass(frozen=True)
class Branch(Predicate):
    """A branch whose name contains a text (F17); ``exact`` compares whole names."""

    name: str
    exact: bool = False

    def column(self):
        if self.exact:
            return F.array_contains(F.col("branches"), self.name)
        return F.exists(F.col("branches"), lambda b: F.contains(b, F.lit(self.name)))


@dataclass(frozen=True)
class RepoFlag(Predicate):
    """Repository attribute."""

    name: str
    value: bool

    def column(self):
        # An attribute that a repository does not state is false.
        flag = F.coalesce(F.col(self.name), F.lit(False))
        return flag if self.value else ~flag


def term(text: str, case: bool | None = None) -> Term:
    return Term(text, case)


def phrase(text: str, case: bool | None = None) -> Term:
    """Exact text including blanks; the same atom as ``term``."""
    return Term(text, case)


def regex(pattern: str, case: bool | None = None) -> Regex:
    return Regex(pattern, case)


def repo(pattern: str) -> NamePattern:
    return NamePattern("repo", pattern)


def path(pattern: str) -> NamePattern:
    return NamePattern("path", pattern)


def lang(name: str) -> Language:
    return Language(name)


def sym(text: str) -> Symbol:
    return Symbol(text)


def branch(name: str) -> Branch:
    """Branch filter; the name ``HEAD`` stands for the default branch."""
    return Branch(name, exact=name == "HEAD")


def archived(value: bool) -> RepoFlag:
    return RepoFlag("archived", value)


def fork(value: bool) -> RepoFlag:
    return RepoFlag("fork", value)


def public(value: bool) -> RepoFlag:
    return RepoFlag("public", value)


def case_sensitive(predicate: Predicate) -> Predicate:
    """Make every content atom case-sensitive (F2)."""
    if isinstance(predicate, ContentAtom):
        return replace(predicate, case=True)
    if isinstance(predicate, Not):
        return Not(case_sensitive(predicate.part))
    if isinstance(predicate, (And, Or)):
        return type(predicate)(tuple(case_sensitive(p) for p in predicate.parts))
    return predicate


def is_repo_only(predicate: Predicate) -> bool:
    """Do all atoms filter on the repository name (F19)?"""
    return all(isinstance(a, NamePattern) and a.field == "repo" for a in predicate.atoms())


def required_terms(predicate: Predicate, n: int = 3) -> Demand | None:
    """The literals of at least ``n`` folded characters that a matching file contains.

    ``None`` means that the predicate puts no such demand on files, so an n-gram
    index cannot narrow the search.
    """
    if isinstance(predicate, Term):
        return literal_demand(predicate.text, n)
    if isinstance(predicate, Regex):
        return pattern_demand(predicate.pattern, n)
    if isinstance(predicate, Or):
        return any_of([required_terms(p, n) for p in predicate.parts])
    if isinstance(predicate, And):
        return all_of([required_terms(p, n) for p in predicate.parts])
    return None
