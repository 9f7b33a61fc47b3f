"""Further columns of any name stay as they are."""

import pytest

from corpusquery.llm.decontaminate import contamination, decontaminate
from corpusquery.llm.jaccard_join import one_per_group, similarity_classes
from corpusquery.llm.language_id import identify_languages
from corpusquery.llm.license_scan import scan_licenses
from corpusquery.llm.line_dedup import deduplicate_lines, drop_recurring_lines
from corpusquery.llm.line_rules import clean_documents, line_quality

# Names that helping columns of some operator have, or had.
NAMES = [
    "own", "kept", "row", "row2", "name", "name2", "units", "label", "set_key", "key", "mix", "alias", "document",
    "_row", "_label", "_units", "_items", "_spans", "_n_words", "_q", "_p", "_rule", "evidence", "a", "b", "x", "id", "quality",
]
TEXT = " ".join(f"word{i % 40} goes number {i}." for i in range(30))


@pytest.fixture(scope="module")
def docs(spark):
    ddl = "doc_id long, Text string, " + ", ".join(f"{n} int" for n in NAMES)
    rows = [(i, t, *range(len(NAMES))) for i, t in enumerate([TEXT, "other " + TEXT, None])]
    return spark.createDataFrame(rows, ddl)


@pytest.mark.parametrize(
    "operator",
    [
        line_quality,
        clean_documents,
        drop_recurring_lines,
        deduplicate_lines,
        similarity_classes,
        one_per_group,
        scan_licenses,
        lambda d: contamination(d, d.limit(0).selectExpr("doc_id AS item_id", "text")),
        lambda d: decontaminate(d, d.limit(0).selectExpr("doc_id AS item_id", "text")),
        lambda d: identify_languages(
            d.selectExpr("doc_id AS page_id", "'http://h.net/' AS url", "text AS html", *NAMES),
            d.selectExpr("doc_id", "text", "'en' AS lang"),
        ),
    ],
    ids=["rules", "clean", "lines", "dedup", "classes", "one", "licenses", "overlap", "decontaminate", "languages"],
)
def test_columns_stay(docs, operator):
    out = operator(docs)
    names = [n for n in NAMES if not (n == "kept" and "n_symbols" in out.columns)]
    rows = out.select(*[f"`{n}`" for n in names]).collect()
    assert rows
    assert all(tuple(r) == tuple(NAMES.index(n) for n in names) for r in rows)
