"""Languages and symbol definitions from rule tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusquery.functions.binding import let, let2, running
from corpusquery.functions.patterns import flagged
from corpusquery.functions.text import fragments, split_lines
from corpusquery.operators.lines import FILE


def path_extension(path: Column) -> Column:
    """Lower-case extension of the last path segment, empty without a dot."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def detect_language(files: DataFrame, extensions: dict[str, str], unknown: str = "") -> DataFrame:
    """Set ``language`` from the extension of the path.

    ``extensions`` is configuration of fixed size, so it is a safe broadcast.
    """
    spark = files.sparkSession
    table = spark.createDataFrame(
        sorted((k.lower(), v) for k, v in extensions.items()), "_ext string, _language string"
    )
    return (
        files.withColumn("_ext", path_extension(F.col("path")))
        .join(F.broadcast(table), "_ext", "left")
        .withColumn("language", F.coalesce("_language", F.lit(unknown)))
        .drop("_ext", "_language")
    )


@dataclass(frozen=True)
class SymbolRule:
    """How a kind of symbol is written in a language.

    The three patterns, without groups of their own, match the text before the
    name, the name and the text after it.  ``parent_kind`` names the kind that
    encloses it: the nearest such symbol above in the same file.
    """

    language: str
    kind: str
    before: str
    name: str
    after: str = ""
    parent_kind: str | None = None

    def pattern(self) -> str:
        return flagged(f"({self.before})({self.name}){self.after}", True)


def extract_symbols(files: DataFrame, rules: list[SymbolRule]) -> DataFrame:
    """Symbol definitions ``(repo, path, line_no, pos, sym, kind, parent, parent_kind, off, len)``.

    Rules are configuration and become literals, so each pattern is compiled
    once.  ``pos`` numbers the symbols of a line; ``off`` and ``len`` are the
    bytes of the name in its line.  All symbols of a file are found within its
    row, and a running fold over them carries the last one of each kind, so that
    parents need no shuffle.
    """
    by_language: dict[str, list[SymbolRule]] = {}
    for rule in rules:
        by_language.setdefault(rule.language.lower(), []).append(rule)
    language = F.lower("language")

    def chosen(value_of: Callable[[list[SymbolRule]], Column]) -> Column:
        column = None
        for name, group in sorted(by_language.items()):
            condition, value = language == name, value_of(group)
            column = F.when(condition, value) if column is None else column.when(condition, value)
        return column

    def of_line(line: Column) -> Column:
        return chosen(lambda group: F.concat(*[_names_of(rule, line) for rule in group]))

    def of_file(lines: Column) -> Column:
        numbered = F.transform(lines, lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line")))
        # Most lines define nothing and are passed over by one look.
        some = F.filter(numbered, lambda x: x["line"].rlike(_any_rule(rules)))
        found = F.transform(
            some,
            lambda x: F.transform(
                of_line(x["line"]), lambda s, p: F.struct(x["line_no"].alias("line_no"), (p + 1).alias("pos"), s.alias("s"))
            ),
        )
        return F.flatten(found)

    kinds = sorted({r.parent_kind for r in rules if r.parent_kind})

    def with_parents(symbols: Column) -> Column:
        fields = {kind: f"k{n}" for n, kind in enumerate(kinds)}

        def last_of(s: Column) -> Column:
            return F.struct(*[F.when(s["s"]["kind"] == kind, s["s"]["sym"]).alias(f) for kind, f in fields.items()])

        def later(a: Column, b: Column) -> Column:
            return F.struct(*[F.coalesce(b[f], a[f]).alias(f) for f in fields.values()])

        nothing = F.struct(*[F.lit(None).cast("string").alias(f) for f in fields.values()])

        def parented(above: Column) -> Column:
            def one(s: Column, k: Column) -> Column:
                parent = F.lit(None).cast("string")
                for kind, f in fields.items():
                    parent = F.when(s["s"]["wants"] == kind, F.get(above, k - 1)[f]).otherwise(parent)
                return F.struct(*[s[c].alias(c) for c in ("line_no", "pos", "s")], parent.alias("parent"))

            return F.transform(symbols, one)

        return let(running(F.transform(symbols, last_of), later, nothing), parented)

    found = let(split_lines(F.col("content")), of_file)
    if kinds:
        found = let(found, lambda symbols: F.when(F.size(symbols) > 0, with_parents(symbols)))
    rows = (
        files.where(language.isin(sorted(by_language)))
        .select(*FILE, F.explode_outer(found).alias("x"))
        .where(F.col("x").isNotNull())
    )
    parent = F.col("x.parent") if kinds else F.lit(None).cast("string")
    return rows.select(
        *FILE, "x.line_no", "x.pos", "x.s.sym", "x.s.kind",
        parent.alias("parent"),
        F.when(parent.isNotNull(), F.col("x.s.wants")).alias("parent_kind"),
        "x.s.off", "x.s.len",
    )


def _any_rule(rules: list[SymbolRule]) -> str:
    return "|".join(f"(?:{rule.pattern()})" for rule in rules)


def _names_of(rule: SymbolRule, line: Column) -> Column:
    regex = F.lit(rule.pattern())
    part = lambda group: F.regexp_extract_all(line, regex, F.lit(group))

    def names(leads: Column, found: Column, spans: Column) -> Column:
        return F.transform(
            found,
            lambda name, k: F.struct(
                name.alias("sym"),
                F.lit(rule.kind).alias("kind"),
                F.lit(rule.parent_kind).cast("string").alias("wants"),
                (spans[k]["off"] + F.octet_length(leads[k])).alias("off"),
                F.octet_length(name).alias("len"),
            ),
        )

    return let2(part(1), part(2), lambda leads, found: let(
        fragments(line, rule.pattern()), lambda spans: names(leads, found, spans)
    ))
