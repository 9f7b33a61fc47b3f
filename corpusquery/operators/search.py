"""Search over a files table: filtering, ranking, modes and envelope."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusquery.functions.text import file_key, split_lines
from corpusquery.operators.blocks import GramIndex
from corpusquery.operators.lines import FILE, range_rows, ranges_map, with_matches
from corpusquery.operators.narrowing import narrow_files
from corpusquery.plans.joins import join_by_size, materialize
from corpusquery.plans.predicates import (
    And,
    Predicate,
    RepoFlag,
    Symbol,
    is_repo_only,
)

DEFAULT_LIMIT = 50

# A capped ranking holds one short row per file and is broadcast up to here.
MAX_BROADCAST_CAP = 10_000


def effective_limit(limit: int | None) -> int | None:
    """0 asks for the default, ``None`` for no cap."""
    return DEFAULT_LIMIT if limit == 0 else limit


def attach_repos(files: DataFrame, repos: DataFrame, columns: list[str], how: str = "left") -> DataFrame:
    """Put repository attributes onto files.

    One repository may own a large share of the files, so the join never
    relies on the repository alone as its partitioning.
    """
    return join_by_size(files, repos.select("repo", *columns), ["repo"], how, spread_by=FILE)


def symbol_hits(symbols: DataFrame, atom: Symbol) -> DataFrame:
    """Per file, the lines that define such a symbol and where its name stands."""
    info = F.struct("sym", "kind", "parent", "parent_kind").alias("symbol")
    per_line = (
        symbols.where(atom.name_column())
        .groupBy(*FILE, "line_no")
        .agg(F.array_sort(F.collect_list(F.struct("off", "len", info))).alias("fragments"))
    )
    per_file = per_line.groupBy(*FILE).agg(
        F.array_sort(F.collect_list(F.struct("line_no", "fragments"))).alias(atom.hits())
    )
    return materialize(per_file, "symbol-hits")


def hits_of(predicate: Predicate, symbols: DataFrame | None) -> dict[Symbol, DataFrame]:
    """The hits of every symbol atom, each computed once."""
    atoms = sorted({a for a in predicate.atoms() if isinstance(a, Symbol)}, key=lambda a: a.text)
    if atoms and symbols is None:
        raise ValueError("symbol atoms need the symbols table")
    return {a: symbol_hits(symbols, a) for a in atoms}


def _conjuncts(predicate: Predicate) -> list[Predicate]:
    if isinstance(predicate, And):
        return [c for part in predicate.parts for c in _conjuncts(part)]
    return [predicate]


def matching_files(
    files: DataFrame,
    predicate: Predicate,
    repos: DataFrame | None = None,
    symbols: DataFrame | None = None,
) -> DataFrame:
    """Rows of ``files`` that satisfy the predicate, with their columns unchanged."""
    return find_files(files, predicate, repos, symbols).select(*files.columns)


def find_files(
    files: DataFrame,
    predicate: Predicate,
    repos: DataFrame | None = None,
    symbols: DataFrame | None = None,
    hits: dict[Symbol, DataFrame] | None = None,
) -> DataFrame:
    """Matching files together with the symbol hits of the predicate.

    Conjuncts that need no other table run first, next to the scan.  A symbol
    conjunct becomes an inner join that drops other files; symbol atoms
    elsewhere, under an ``or`` or a negation, are outer joins whose column is
    tested for null (J9).  ``hits`` are those of the atoms if they are known.
    """
    hits = hits_of(predicate, symbols) if hits is None else hits
    local, joined, required = [], [], []
    for conjunct in _conjuncts(predicate):
        atoms = list(conjunct.atoms())
        if isinstance(conjunct, Symbol):
            required.append(conjunct)
        elif any(
            isinstance(a, Symbol) or (isinstance(a, RepoFlag) and a.name not in files.columns)
            for a in atoms
        ):
            joined.append(conjunct)
        else:
            local.append(conjunct)

    found = files
    for conjunct in local:
        found = found.where(conjunct.column())
    for atom in dict.fromkeys(required):
        found = join_by_size(found, hits[atom], FILE, "inner")

    atoms = {a for c in joined for a in c.atoms()}
    flags = sorted({a.name for a in atoms if isinstance(a, RepoFlag)} - set(found.columns))
    if flags:
        if repos is None:
            raise ValueError(f"repository attributes need the repos table: {flags}")
        found = attach_repos(found, repos, flags)
    for atom in sorted((a for a in atoms if isinstance(a, Symbol)), key=lambda a: a.text):
        if atom.hits() not in found.columns:
            found = join_by_size(found, hits[atom], FILE, "left")
    for conjunct in joined:
        found = found.where(conjunct.column())
    return found.drop(*flags)


def score_column(predicate: Predicate, columns: list[str]) -> Column:
    """Relevance of a file: matches of all positive content and symbol atoms (L3)."""
    content = F.col("content")
    total = F.lit(0).cast("bigint")
    for atom in predicate.line_atoms():
        total = total + atom.count_column(content, split_lines(content))
    for atom in predicate.symbol_atoms():
        if atom.hits() in columns:
            per_line = F.transform(F.col(atom.hits()), lambda s: F.size(s["fragments"]))
            count = F.aggregate(per_line, F.lit(0), lambda a, b: a + b)
            total = total + F.coalesce(count, F.lit(0))
    return total


def score_files(found: DataFrame, predicate: Predicate, *keep: str) -> DataFrame:
    """Keys and scores, with other columns on request; the content goes no further."""
    return found.select(*FILE, score_column(predicate, found.columns).alias("score"), *keep)


def best_first() -> list:
    """Total order of results, so that a cap is reproducible."""
    return [F.desc("score"), F.asc("repo"), F.asc("path")]


def top_files(scored: DataFrame, limit: int | None = 0) -> DataFrame:
    """Best files by score (L1).  Each task keeps at most ``limit`` short rows."""
    cap = effective_limit(limit)
    return scored if cap is None else scored.orderBy(*best_first()).limit(cap)


# Where a row of a file table lies: its data file and its place in it.
PLACE = ["_data_file", "_row"]


def with_places(files: DataFrame) -> DataFrame | None:
    """Files with the place that their rows were read from, or ``None`` where a source does not tell."""
    known = files._jdf.queryExecution().analyzed().metadataOutput().toString()
    if "_metadata" not in known:
        return None
    try:
        return files.withColumns({"_data_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    except AnalysisException:  # formats without numbers of rows
        return None


def fetch(files: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``files`` at the places of few kept rows; only their data files are opened."""
    places = kept.select("_data_file").distinct().collect()
    near = with_places(files.where(F.col("_metadata.file_path").isin([r["_data_file"] for r in places])))
    return near.join(F.broadcast(kept.drop(*FILE)), PLACE).drop(*PLACE)


def search_lines(
    files: DataFrame,
    predicate: Predicate,
    *,
    repos: DataFrame | None = None,
    symbols: DataFrame | None = None,
    index: GramIndex | None = None,
    limit: int | None = 0,
    context: int = 0,
) -> DataFrame:
    """Matching files with their matching lines: the general result table.

    With a cap, ranking runs on keys and scores, and lines, fragments and
    context are computed for the kept files only.  Where the source tells the
    place of a row, ranking carries it and only the data files of kept rows are
    opened again.  Without a cap, everything is done in a single pass over the
    files.  With an ``index`` of the files only those are read that it cannot
    rule out.
    """
    hits = hits_of(predicate, symbols)
    cap = effective_limit(limit)
    near = lambda df: df if index is None else narrow_files(df, index, predicate)
    if cap is None:
        found = find_files(near(files), predicate, repos, hits=hits)
        return with_matches(found.withColumn("score", score_column(predicate, found.columns)), predicate, context)
    placed = with_places(files) if cap <= MAX_BROADCAST_CAP else None
    found = find_files(near(files if placed is None else placed), predicate, repos, hits=hits)
    kept = top_files(score_files(found, predicate, *([] if placed is None else PLACE)), cap)
    if placed is None:
        # The cap itself bounds this side.
        scored = files.join(F.broadcast(kept) if cap <= MAX_BROADCAST_CAP else kept, FILE)
    else:
        kept = materialize(kept, "kept")
        scored = fetch(files, kept)
    # The hits of kept files only, however many there are in all.
    for atom in predicate.symbol_atoms():
        own = hits[atom].join(kept.select(*FILE), FILE, "left_semi")
        scored = scored.join(own, FILE, "left")
    return with_matches(scored, predicate, context)


def list_repos(
    files: DataFrame,
    predicate: Predicate,
    repos: DataFrame | None = None,
    symbols: DataFrame | None = None,
) -> DataFrame:
    """Repositories with a match, never capped (A5).

    A predicate on repository names alone is answered from ``repos`` and reads
    no file, so repositories without files are listed too.
    """
    if repos is not None and is_repo_only(predicate):
        return repos.where(predicate.column()).select("repo").distinct().orderBy("repo")
    return (
        matching_files(files, predicate, repos, symbols).select("repo").distinct().orderBy("repo")
    )


def list_files(scored: DataFrame, separator: str = ":") -> DataFrame:
    """Files mode: distinct names in byte order (A3, A4)."""
    return (
        scored.select(file_key(F.col("repo"), F.col("path"), separator).alias("file"))
        .distinct()
        .orderBy("file")
    )


def search(
    files: DataFrame,
    predicate: Predicate,
    *,
    repos: DataFrame | None = None,
    symbols: DataFrame | None = None,
    index: GramIndex | None = None,
    mode: str = "lines",
    limit: int | None = 0,
    context: int = 0,
) -> DataFrame:
    """Search in one of the three output modes.

    With an ``index`` of the files only those are read that it cannot rule out;
    the result is the same.  ``lines`` gives ``(repo, path, range, text)`` rows, or repositories when
    the predicate only names repositories; ``files`` gives names; ``repos``
    gives repositories and ignores the cap.
    """
    if mode not in ("lines", "files", "repos"):
        raise ValueError(f"unknown output mode {mode!r}")
    if mode == "repos" or (mode == "lines" and is_repo_only(predicate)):
        if index is not None and not (repos is not None and is_repo_only(predicate)):
            files = narrow_files(files, index, predicate)
        return list_repos(files, predicate, repos, symbols)
    if mode == "files":
        if index is not None:
            files = narrow_files(files, index, predicate)
        found = find_files(files, predicate, repos, symbols)
        return list_files(top_files(score_files(found, predicate), limit))
    return range_rows(
        search_lines(
            files, predicate, repos=repos, symbols=symbols, index=index, limit=limit, context=context
        )
    )


def envelope(matching: DataFrame, limit: int | None = 0) -> DataFrame:
    """Totals of a capped search from one count (A1)."""
    cap = effective_limit(limit)
    total = F.count(F.lit(1))
    returned = total if cap is None else F.least(total, F.lit(cap).cast("bigint"))
    return matching.agg(total.alias("total_matches"), returned.alias("returned")).withColumn(
        "truncated", F.col("total_matches") > F.col("returned")
    )


def envelope_of(shown: DataFrame, total: int = 0) -> DataFrame:
    """Envelope of results already at hand; an unknown total (0) counts as returned."""
    known = F.lit(total).cast("bigint")
    return (
        shown.agg(F.count(F.lit(1)).alias("returned"))
        .select(
            F.when(known == 0, F.col("returned")).otherwise(known).alias("total_matches"),
            "returned",
        )
        .withColumn("truncated", F.col("total_matches") > F.col("returned"))
    )


def result_json(matched: DataFrame, total: int, limit: int) -> DataFrame:
    """One JSON document with the envelope and the lines of the best ``limit`` files.

    Without a score the first files by name are shown.

    Only a capped result fits into one document; uncapped results are written
    as one row per file (``sources.sinks``).
    """
    order = best_first() if "score" in matched.columns else [F.col("repo"), F.col("path")]
    shown = materialize(matched.orderBy(*order).limit(limit), "shown")
    # Names that render alike are one key; the first file of a key stands for it.
    per_file = ranges_map(shown).groupBy("file").agg(F.min_by("ranges", F.to_json("ranges")).alias("ranges"))
    body = per_file.agg(
        F.map_from_entries(F.collect_list(F.struct("file", "ranges"))).alias("results")
    )
    head = envelope_of(shown, total)
    return head.select(
        F.to_json(
            F.struct(
                "total_matches", "returned", "truncated", body.select("results").scalar().alias("results")
            )
        ).alias("json")
    )
