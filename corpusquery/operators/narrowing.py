"""Which files a predicate may match, told by the n-gram index."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpusquery.functions.folding import fold_text
from corpusquery.operators.blocks import GRAM, GramIndex, files_with
from corpusquery.operators.lines import FILE
from corpusquery.plans.joins import join_by_size, materialize
from corpusquery.plans.predicates import Predicate, required_terms


def text_grams(text: str, n: int = GRAM) -> list[str]:
    """Grams of one literal of a predicate (a driver-side string)."""
    folded = fold_text(text)
    return sorted({folded[i : i + n] for i in range(len(folded) - n + 1)})


def predicate_candidates(index: GramIndex, predicate: Predicate) -> DataFrame | None:
    """Keys of files that may satisfy a predicate, from the index alone.

    The grams are literals, so the scan of a stored index is pruned by them; the
    demand is then tested as a tree, run by run, on sorted numbers.  ``None``
    means that the predicate cannot be narrowed and all files are candidates.
    """
    demand = required_terms(predicate, index.n)
    if demand is None:
        return None
    return files_with(index, demand, {t: text_grams(t, index.n) for t in demand.literals()})


def demanded_grams(predicate: Predicate, n: int = GRAM) -> list[str]:
    """Grams of all literals that a predicate demands."""
    demand = required_terms(predicate, n)
    return [] if demand is None else sorted({g for t in demand.literals() for g in text_grams(t, n)})


def narrow_files(files: DataFrame, index: GramIndex, predicate: Predicate) -> DataFrame:
    """Files worth verifying; hand the result to any search operator."""
    keys = predicate_candidates(index, predicate)
    if keys is None:
        return files
    return join_by_size(files, materialize(keys, "candidates"), FILE, "left_semi")
