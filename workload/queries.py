"""One registered query per operator, each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusquery import (
    archived,
    branch,
    case_sensitive,
    fork,
    get_file,
    get_files,
    read_corpus,
    lang,
    path,
    phrase,
    public,
    regex,
    repo,
    search,
    search_lines,
    shared_dir,
    sym,
    term,
)
from corpusquery.functions.text import repo_parts, slice_lines, url_host
from corpusquery.operators import blocks, bm25, index, lifecycle, lines, positions, repos, results, rollup, rules, symbols
from corpusquery.operators.search import (
    attach_repos,
    envelope,
    find_files,
    list_files,
    matching_files,
    result_json,
    score_files,
    top_files,
)
from corpusquery.plans.joins import materialize
from corpusquery.plans.predicates import Predicate
from corpusquery.sources.corpus import write_tree
from corpusquery.sources.rules import flat_rules, read_flat_rules, read_nested_rules
from corpusquery.sources.sinks import read_entries, read_postings, read_symbols, write_entries, write_symbols
from corpusquery.streaming import jobs
from workload import views as v

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def scored(spark: SparkSession, sf: str, predicate: Predicate) -> DataFrame:
    """Matching files with their score, the plainest form of a search."""
    found = matching_files(v.files(spark, sf), predicate, v.repos(spark, sf))
    return score_files(found, predicate)


# Predicates ---------------------------------------------------------------


@query
def search_term_ci(spark, sf):
    return scored(spark, sf, term("license"))


@query
def search_term_cs(spark, sf):
    return scored(spark, sf, term("License"))


@query
def search_case_yes(spark, sf):
    return scored(spark, sf, case_sensitive(term("the") & term("license")))


@query
def search_phrase(spark, sf):
    return scored(spark, sf, phrase("the Apache License"))


@query
def search_regex(spark, sf):
    return scored(spark, sf, regex(r"^(re|ver)[a-z]+ under \w+"))


@query
def search_and(spark, sf):
    return scored(spark, sf, term("license") & term("version"))


@query
def search_or(spark, sf):
    return scored(spark, sf, term("apache") | term("mit"))


@query
def search_not(spark, sf):
    return scored(spark, sf, term("license") & ~term("Apache"))


@query
def search_not_group(spark, sf):
    return scored(spark, sf, ~(term("Licensed") & term("Version")) & term("under"))


@query
def filter_repo(spark, sf):
    return scored(spark, sf, term("under") & repo("SRC1".lower()) & ~repo("src1[0-4]$"))


@query
def filter_path(spark, sf):
    return scored(spark, sf, term("the") & path(r"^(en|de)/.*[05]\.txt$") & ~path("de/1"))


@query
def filter_lang(spark, sf):
    return scored(spark, sf, term("der") & lang("DE"))


@query
def filter_branch(spark, sf):
    return scored(spark, sf, term("license") & branch("mast"))


@query
def filter_branch_head(spark, sf):
    return scored(spark, sf, term("license") & branch("HEAD"))


@query
def filter_flags(spark, sf):
    return scored(spark, sf, term("the") & archived(False) & fork(False) & public(True))


@query
def filter_flags_or(spark, sf):
    return scored(spark, sf, term("license") | (archived(True) & lang("fr") & term("étion")))


@query
def filter_symbol(spark, sf):
    pages = v.page_files(spark, sf)
    predicate = sym("the") & term("article")
    defs = symbols.extract_symbols(pages, v.HTML_RULES)
    return score_files(find_files(pages, predicate, symbols=defs), predicate)


@query
def filter_symbol_stored(spark, sf):
    """The same from a stored table of symbols, through its distinct names."""
    base = shared_dir(spark, "symbols")
    write_symbols(symbols.extract_symbols(v.page_files(spark, sf), v.HTML_RULES), base)
    predicate = sym("the") & term("article")
    defs = read_symbols(spark, base, "the")
    return score_files(find_files(v.page_files(spark, sf), predicate, symbols=defs), predicate)


@query
def filter_symbol_or(spark, sf):
    """A symbol atom under ``or`` and ``not``, which a semi-join cannot express."""
    pages = v.page_files(spark, sf)
    predicate = (sym("The") | term("étion")) & ~sym("ouon")
    defs = symbols.extract_symbols(pages, v.HTML_RULES)
    return score_files(find_files(pages, predicate, symbols=defs), predicate)


@query
def symbol_lines(spark, sf):
    """Lines of symbol definitions with the details of each symbol."""
    pages = v.page_files(spark, sf)
    defs = symbols.extract_symbols(pages, v.HTML_RULES)
    found = search_lines(pages, sym("the"), symbols=defs, limit=None)
    return lines.fragment_rows(found).select("repo", "path", "line_no", "off", "len", "symbol.*")


@query
def search_turns(spark, sf):
    """Second corpus: conversation turns."""
    predicate = regex(r"\bthe[a-z]*\b") & ~term("und") & lang("assistant")
    return score_files(matching_files(v.turn_files(spark, sf), predicate), predicate)


# Modes ----------------------------------------------------------------------


@query
def mode_lines(spark, sf):
    return search(v.spread_files(spark, sf), term("license") | regex("thh?e[rn]"), limit=None)


@query
def mode_lines_capped(spark, sf):
    return search(v.files(spark, sf), term("the"), limit=0)


@query
def mode_lines_fetched(spark, sf):
    """A capped search in a stored corpus of many data files; few of them are opened again."""
    base = shared_dir(spark, "corpus")
    v.files(spark, sf).repartitionByRange(32, "repo", "path").write.parquet(f"{base}/files")
    return search(spark.read.parquet(f"{base}/files"), term("apache"), limit=5)


@query
def mode_lines_repo_only(spark, sf):
    return search(
        v.files(spark, sf), repo("src1") & ~repo("src1[0-4]$"), repos=v.repos(spark, sf)
    )


@query
def mode_files(spark, sf):
    return search(v.files(spark, sf), term("the"), mode="files", limit=100)


@query
def mode_paths(spark, sf):
    return list_files(scored(spark, sf, term("version")), "/")


@query
def mode_repos(spark, sf):
    return search(v.files(spark, sf), term("apache"), mode="repos", limit=1)


@query
def lines_map(spark, sf):
    """Lines mode as a map per file, flattened to rows for comparison."""
    found = search_lines(v.files(spark, sf), term("license"), limit=None)
    return lines.ranges_map(found).select("file", F.explode("ranges").alias("range", "text"))


@query
def search_envelope(spark, sf):
    return envelope(matching_files(v.files(spark, sf), term("the")), limit=0)


# Lines ----------------------------------------------------------------------


@query
def file_lines(spark, sf):
    return lines.lines(v.files(spark, sf))


def _matched(spark, sf, predicate, context=0):
    return search_lines(v.files(spark, sf), predicate, limit=None, context=context)


@query
def line_matches(spark, sf):
    found = _matched(spark, sf, term("étion") | term("Licensed"))
    return lines.match_rows(found).select("repo", "path", "line_no", "line")


@query
def columns(spark, sf):
    found = _matched(spark, sf, term("étion"))
    return lines.match_rows(found).select("repo", "path", "line_no", "col")


@query
def fragments(spark, sf):
    found = lines.fragment_rows(_matched(spark, sf, term("étion") | regex("on[a-z]*é")))
    return found.select("repo", "path", "line_no", "off", "len")


@query
def context(spark, sf):
    return lines.context_rows(_matched(spark, sf, term("license"), context=2))


@query
def context_from_lines(spark, sf):
    """The same context found from line rows by equi-join."""
    all_lines = lines.lines(v.files(spark, sf))
    hits = all_lines.where(F.contains(F.lower("line"), F.lit("license")))
    return lines.context_by_window(all_lines, hits, 2)


@query
def line_ranges(spark, sf):
    return lines.range_rows(_matched(spark, sf, term("les")))


@query
def line_ranges_window(spark, sf):
    """Ranges from line rows by window."""
    all_lines = lines.lines(v.files(spark, sf))
    return lines.ranges_by_window(all_lines.where(F.contains(F.lower("line"), F.lit("les"))))


@query
def gap_rows(spark, sf):
    return lines.render_rows(_matched(spark, sf, term("version"), context=1), context=1)


@query
def render_text(spark, sf):
    rows = lines.render_rows(_matched(spark, sf, term("Apache"), context=1), context=1)
    return lines.render_text(rows, columns=True)


@query
def chunks(spark, sf):
    predicate = term("les")
    found = matching_files(v.files(spark, sf), predicate)
    return lines.chunk_rows(found, predicate, context=1)


@query
def chunks_window(spark, sf):
    """Merged windows by the general interval operator."""
    all_lines = lines.lines(v.files(spark, sf))
    hits = all_lines.where(F.contains(F.lower("line"), F.lit("les")))
    spans = hits.select(
        "repo", "path", (F.col("line_no") - 1).alias("first_line"), (F.col("line_no") + 1).alias("last_line")
    )
    return lines.merge_intervals(spans, lines.FILE, "first_line", "last_line")


@query
def vimgrep(spark, sf):
    return lines.vimgrep_rows(_matched(spark, sf, term("étion")))


@query
def highlight(spark, sf):
    return lines.highlighted_rows(_matched(spark, sf, term("étion")), "[[", "]]")


@query
def snippet(spark, sf):
    return lines.snippet_rows(_matched(spark, sf, term("étion")), width=20)


@query
def sliced_lines(spark, sf):
    files = v.files(spark, sf)
    return files.select("repo", "path", slice_lines(F.col("content"), 1, 3).alias("content"))


# Ranking, caps, statistics ----------------------------------------------------


@query
def top_files_by_score(spark, sf):
    return top_files(scored(spark, sf, term("tion")), 25)


@query
def top_files_bm25(spark, sf):
    """The best files for some words by BM25, from a word index."""
    built = bm25.build_word_index(v.spread_files(spark, sf))
    return bm25.top_files_bm25(built, ["license", "Apache", "the", "des"], limit=30)


@query
def total_cap(spark, sf):
    return results.total_cap(scored(spark, sf, term("the")), 20000)


@query
def total_cap_by_name(spark, sf):
    """A search by name has no matches in contents, and keeps its files."""
    return results.total_cap(scored(spark, sf, path("^de/")), 10)


@query
def per_repo_match_cap(spark, sf):
    return results.per_repo_match_cap(scored(spark, sf, term("the")), 400)


@query
def per_repo_cap(spark, sf):
    return results.per_repo_cap(scored(spark, sf, term("the")), 3)


@query
def duplicates(spark, sf):
    predicate = term("the") | term("un")
    found = results.content_hash(matching_files(v.files(spark, sf), predicate))
    ranked = score_files(found, predicate, "content_sha")
    return results.mark_duplicates(ranked).select("repo", "path", "score", "duplicate_of")


@query
def search_stats(spark, sf):
    return results.search_stats(scored(spark, sf, term("the") & term("tion")))


@query
def search_cost(spark, sf):
    predicate = (term("License") | term("version")) & term("under")
    return index.search_cost(v.files(spark, sf), gram_index(spark, sf), predicate, limit=10)


# Repositories -----------------------------------------------------------------


@query
def repo_stats(spark, sf):
    return repos.repo_stats(v.files(spark, sf), v.complete_entries(spark, sf))


@query
def corpus_totals(spark, sf):
    return repos.corpus_totals(v.files(spark, sf))


@query
def repo_map(spark, sf):
    keyed = repos.repo_map(v.repos(spark, sf), repos.repo_stats(v.files(spark, sf)))
    return keyed.select("id", "entry.*")


@query
def repo_map_latest(spark, sf):
    """Pages of one host and path as entries of one id; the last page counts."""
    hosted = v.hosted_repos(spark, sf)
    number = F.pmod(F.col("id"), F.lit(50)).alias("id")
    listed = hosted.select(number, F.concat_ws("/", "repo", F.col("id").cast("string")).alias("repo"), F.col("id").alias("at"))
    stats = repos.repo_stats(
        v.table(spark, sf, "pages").select(
            F.concat_ws("/", F.regexp_extract("url", r"^[a-z]+://([^?#]+)", 1), F.col("page_id").cast("string")).alias("repo"),
            F.lit("index").alias("path"),
            F.col("html").alias("content"),
        )
    )
    return repos.repo_map(listed, stats, "at").select("id", "entry.*")


@query
def repo_order_size(spark, sf):
    return repos.order_repos(repos.repo_stats(v.files(spark, sf)), "revsize")


@query
def repo_attributes(spark, sf):
    """Repository attributes on files (J2), counted per flag."""
    joined = attach_repos(
        v.files(spark, sf).select("repo", "path"), v.repos(spark, sf), ["archived", "fork", "public"]
    )
    return joined.groupBy("archived", "fork", "public").agg(F.count(F.lit(1)).alias("n_files"))


@query
def repo_listing(spark, sf):
    """The repository list with its statistics, newest first."""
    files, entries = v.files(spark, sf), v.complete_entries(spark, sf)
    attributes = v.repos(spark, sf).withColumn("topics", F.array_join("topics", ","))
    listing = repos.repo_listing(attributes, repos.repo_stats(files, entries))
    return repos.order_repos(listing, "revram")


# Rules ------------------------------------------------------------------------


@query
def expand_rules(spark, sf):
    expanded = rules.expand_rules(v.nested_rules(spark, sf))
    listed = lambda c: F.array_join(c, ",").alias(c)
    return expanded.select(
        "rule_pos", F.col("owner_pos").cast("bigint").alias("owner_pos"), "kind", "url", "org", "user",
        "name", "exclude", listed("topics"), listed("exclude_topics"), listed("visibility"),
        "no_archived", "forks", "only_public", "exclude_user_repos", "active", "keep_deleted",
    )


@query
def select_repos(spark, sf):
    expanded = rules.expand_rules(v.owner_rules(spark, sf))
    hosted = v.hosted_repos(spark, sf)
    return rules.select_repos(hosted, expanded).groupBy("rule_pos", "repo", "keep_deleted").agg(
        F.count(F.lit(1)).alias("times")
    )


@query
def topic_filter(spark, sf):
    r = v.repos(spark, sf)
    keep = rules.topic_admits(
        F.col("topics"), F.array(F.lit("t1"), F.lit("t2")), F.array(F.lit("attic"))
    )
    return r.where(keep).select("repo", "id")


@query
def owner_filter(spark, sf):
    hosted = v.hosted_repos(spark, sf)
    owners = hosted.select(F.col("host").alias("owner"), "repo")
    include = hosted.where(~F.col("archived")).select(F.col("host").alias("owner"))
    exclude = hosted.where(~F.col("active")).select(F.col("host").alias("owner"))
    return rules.filter_owners(owners, include, exclude, include_on=True)


@query
def first_rule(spark, sf):
    n = F.col("page_id")
    requests = v.table(spark, sf, "pages").select(
        n.alias("request_id"),
        F.when(n % 5 == 0, url_host(F.col("url")))
        .when(n % 7 == 0, F.concat(F.lit("git.example.com/nobody/"), n.cast("string")))
        .otherwise(F.regexp_extract("url", r"^[a-z]+://([^?#]+)", 1))
        .alias("repo"),
    )
    return rules.match_first_rule(requests, rules.expand_rules(v.nested_rules(spark, sf)))


@query
def first_per_host(spark, sf):
    p = v.table(spark, sf, "pages").select(
        "page_id",
        url_host(F.col("url")).alias("host"),
        F.when(F.col("page_id") % 4 == 0, "").otherwise(F.sha2("html", 256)).alias("value"),
    )
    return rules.first_per_key(p, "host", "page_id", F.col("value") != "")


@query
def repo_name_parts(spark, sf):
    p = v.table(spark, sf, "pages")
    name = F.when(
        F.col("page_id") % 5 == 0, url_host(F.col("url"))
    ).otherwise(F.regexp_extract("url", r"^[a-z]+://([^?#]+)", 1))
    return p.select("page_id", repo_parts(name).alias("p")).select("page_id", "p.*")


@query
def url_hosts(spark, sf):
    p = v.table(spark, sf, "pages")
    with_port = F.regexp_replace("url", r"^([a-z]+://[^/?#]+)", "$1:8443")
    return p.select("page_id", url_host(with_port).alias("host"))


# Index --------------------------------------------------------------------------


def gram_index(spark, sf):
    """The n-gram index, written once and then read, as a search does."""
    return blocks.build_gram_index(v.spread_files(spark, sf))


@query
def ngram_postings(spark, sf):
    """Posting list lengths: every posting is counted."""
    return index.posting_lists(index.ngram_postings(v.spread_files(spark, sf)))


@query
def index_blocks(spark, sf):
    """All postings, read back from the blocks of the index."""
    return blocks.decoded(gram_index(spark, sf))


@query
def candidates(spark, sf):
    return index.candidates(gram_index(spark, sf), v.batch_queries(spark, sf))


@query
def candidates_positional(spark, sf):
    """Candidates of whole texts whose first and last grams stand at the right distance."""
    files, asked = v.spread_files(spark, sf), v.batch_queries(spark, sf)
    found = materialize(index.candidates(gram_index(spark, sf), asked), "candidates")
    return positions.candidates_positional(found, positions.build_position_index(files), asked)


@query
def search_batch(spark, sf):
    return index.search_batch(v.spread_files(spark, sf), v.batch_queries(spark, sf))


@query
def search_batch_anchored(spark, sf):
    """A long query list: every conversation turn, or its first sentence, is looked for in the documents."""
    first = F.element_at(F.split("text", r"[.?!]\s*"), 1)
    # A document with the whole turn has its first sentence too, so the turn itself is asked where that is empty.
    turns = v.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.when(first != "", first).otherwise(F.col("text")).alias("text"),
    )
    return index.search_batch(v.spread_files(spark, sf), turns)


@query
def search_batch_sentences(spark, sf):
    """Every sentence of every turn is looked for in the documents."""
    turns = v.table(spark, sf, "conversations")
    sentences = turns.select("conv_id", "turn", F.posexplode(F.split("text", r"[.?!]\s*")).alias("pos", "text"))
    number = (F.col("conv_id") * 1000 + F.col("turn")) * 1000 + F.col("pos")
    asked = sentences.select(number.alias("query_id"), "text")
    found = index.search_batch(v.spread_files(spark, sf), asked, counted=True)
    return found.groupBy("query_id").agg(F.sum("n_files").alias("n_files"))


@query
def search_narrowed(spark, sf):
    """Search that reads only the candidates of the n-gram index."""
    files = v.files(spark, sf)
    predicate = term("apache") & (term("License") | term("version"))
    narrowed = index.narrow_files(files, gram_index(spark, sf), predicate)
    return score_files(matching_files(narrowed, predicate), predicate)


@query
def search_regex_narrowed(spark, sf):
    """A regular expression searched through the index by the literals in it."""
    files = v.files(spark, sf)
    predicate = regex(r"Licensed under .*Version \d") | regex(r"Released? under the MIT.+")
    narrowed = index.narrow_files(files, gram_index(spark, sf), predicate)
    return score_files(matching_files(narrowed, predicate), predicate)


ALTERNATIVES = r"(apache|mit|bsd)[- ]licen[sc]ed?|(released|licensed) under (the )?(MIT|Apache)"


@query
def search_regex_alternatives(spark, sf):
    """A regular expression without any literal that all its matches share."""
    predicate = regex(ALTERNATIVES, case=False)
    narrowed = index.narrow_files(v.files(spark, sf), gram_index(spark, sf), predicate)
    return score_files(matching_files(narrowed, predicate), predicate)


@query
def search_indexed(spark, sf):
    """The result lines of a search that goes through the index."""
    predicate = regex("licen[sc]e") & ~term("apache")
    return search(v.files(spark, sf), predicate, index=gram_index(spark, sf), limit=20)


@query
def repo_flags_missing(spark, sf):
    """Files of repositories without attributes count as not archived."""
    known = v.repos(spark, sf).where(F.col("id") % 4 != 0)
    found = matching_files(v.files(spark, sf), archived(False) & ~fork(True), known)
    return found.groupBy("repo").agg(F.count(F.lit(1)).alias("n_files"))


@query
def stored_corpus(spark, sf):
    """The documents written as a corpus table and read back with all file columns."""
    base = shared_dir(spark, "corpus")
    v.files(spark, sf).drop("branches", "language").write.parquet(f"{base}/files")
    files = read_corpus(spark, f"{base}/files")
    return files.select(
        "repo", "path", F.array_join("branches", ",").alias("branches"), "language", F.sha2("content", 256).alias("sha")
    )


@query
def tree_corpus(spark, sf):
    """The documents written as single files and read back as a tree."""
    base = shared_dir(spark, "tree")
    write_tree(v.spread_files(spark, sf), base).collect()
    files = read_corpus(spark, base, fmt="tree", repo_depth=1)
    return files.select("repo", "path", F.sha2("content", 256).alias("sha"))


@query
def stored_rules(spark, sf):
    """Nested rules written as JSON lines, read back and expanded."""
    base = shared_dir(spark, "rules")
    v.nested_rules(spark, sf).write.json(f"{base}/rules")
    return rules.expand_rules(read_nested_rules(spark, f"{base}/rules", lines=True)).select(
        "rule_pos", F.col("owner_pos").cast("bigint").alias("owner_pos"), "kind", "url", "org", "user"
    )


@query
def stored_flat_rules(spark, sf):
    """Flat rules written as JSON arrays, read back and brought to the common form."""
    base = shared_dir(spark, "flat-rules")
    arrays = v.flat_rules(spark, sf).groupBy(F.pmod("rule_pos", F.lit(16)).alias("part")).agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("rule_pos", "rule")))["rule"]).alias("json")
    )
    arrays.write.partitionBy("part").text(f"{base}/rules")
    flat = read_flat_rules(spark, f"{base}/rules/*")
    # The number of a rule is in its name.
    numbered = flat.withColumn("rule_pos", F.regexp_extract("Name", r"(\d+)$", 1).cast("bigint"))
    return flat_rules(numbered).select(
        "rule_pos", "kind", "url", "org", "user", "name", "exclude", "no_archived", "keep_deleted"
    )


@query
def result_document(spark, sf):
    """The JSON document of a capped search, parsed back into its ranges."""
    predicate = term("license")
    matching = matching_files(v.files(spark, sf), predicate)
    found = search_lines(v.files(spark, sf), predicate, limit=20)
    total = envelope(matching, 20).first()["total_matches"]
    schema = "total_matches bigint, returned bigint, truncated boolean, results map<string, map<string, string>>"
    parsed = result_json(found, total, 20).select(F.from_json("json", schema).alias("d")).select("d.*")
    files = parsed.select("total_matches", "returned", "truncated", F.explode("results").alias("file", "ranges"))
    return files.select("total_matches", "returned", "truncated", "file", F.explode("ranges").alias("range", "text"))


@query
def index_diff(spark, sf):
    diff = index.index_diff(v.current_hashes(spark, sf), v.index_entries(spark, sf))
    return diff.select("repo", "path", "status")


@query
def index_diff_rolled(spark, sf):
    """Changes between two stored listings, with equal repositories left out by their digests."""
    base = shared_dir(spark, "listings")
    sides = []
    for name, listing in (("new", v.all_hashes(spark, sf)), ("old", v.earlier_hashes(spark, sf))):
        listing.write.partitionBy("repo").parquet(f"{base}/{name}")
        stored = spark.read.parquet(f"{base}/{name}")
        rollup.roll_up(stored).write.parquet(f"{base}/{name}-rollup")
        sides.append((stored, spark.read.parquet(f"{base}/{name}-rollup")))
    (new, new_rollup), (old, old_rollup) = sides
    diff = rollup.index_diff_rolled(new, old, new_rollup, old_rollup)
    return diff.select("repo", "path", "status", "new_sha", "old_sha")


@query
def orphan_entries(spark, sf):
    found = index.orphan_entries(v.index_entries(spark, sf), v.live_sources(spark, sf))
    return found.select("repo", "path", "shard", "source")


@query
def orphan_shards(spark, sf):
    return index.orphan_shards(v.index_entries(spark, sf), v.live_sources(spark, sf))


@query
def surviving_entries(spark, sf):
    kept = index.surviving_entries(v.index_entries(spark, sf), v.live_sources(spark, sf))
    return kept.select("repo", "path", "shard")


@query
def prune_deleted(spark, sf):
    mirrored = v.repos(spark, sf).select("repo", "id", (F.col("id") % 4 == 0).alias("keep_deleted"))
    upstream = v.files(spark, sf).where(F.contains("content", F.lit("Apache"))).select("repo")
    return index.prune_deleted(mirrored, upstream)


# Languages and symbols ------------------------------------------------------------


@query
def detect_language(spark, sf):
    d = v.table(spark, sf, "documents").select(
        F.col("source").alias("repo"),
        F.concat(F.col("doc_id").cast("string"), F.lit("."), F.upper("lang")).alias("path"),
    )
    names = {"en": "English", "fr": "French", "de": "German"}
    return symbols.detect_language(d, names, "unknown")


@query
def symbol_definitions(spark, sf):
    return symbols.extract_symbols(v.page_files(spark, sf), v.HTML_RULES)


# Single files ---------------------------------------------------------------------


@query
def get_one_file(spark, sf):
    return get_file(v.files(spark, sf), "src1", "en/1.txt")


@query
def get_many_files(spark, sf):
    keys = v.files(spark, sf).where(F.contains("content", F.lit("License"))).select("repo", "path")
    return get_files(v.files(spark, sf), keys).select("repo", "path", F.sha2("content", 256).alias("sha"))


# Lifecycle and streams --------------------------------------------------------------

NOW = datetime(2024, 1, 30, 12, 0, 0, tzinfo=timezone.utc)


@query
def retain_recent(spark, sf):
    events = v.table(spark, sf, "events")
    return lifecycle.retain(events, "ts", timedelta(hours=72), NOW).select("event_id", "ts", "user_id")


@query
def latest_status(spark, sf):
    return lifecycle.latest_status(v.task_events(spark, sf))


@query
def evict_finished(spark, sf):
    return lifecycle.evict_finished(lifecycle.latest_status(v.task_events(spark, sf)), cap=100)


@query
def keep_finished(spark, sf):
    return lifecycle.evict_finished(lifecycle.latest_status(v.task_events(spark, sf)), cap=10**9)


def _feed(spark, sf, name, files_per_batch=1000):
    """A table as a feed of its files, whether it is one file or a folder of them."""
    schema = v.table(spark, sf, name).schema
    # Spark takes the path of a stream for a folder unless it is a pattern.
    return jobs.read_feed(spark, f"{sf}/{name}[.]parquet", schema, files_per_batch=files_per_batch)


@query
def stream_latest_status(spark, sf):
    base = shared_dir(spark, "status")
    events = v.as_task_events(_feed(spark, sf, "events"))
    jobs.stream_latest_status(events, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return jobs.read_latest_status(spark, f"{base}/out")


@query
def stream_search(spark, sf):
    base = shared_dir(spark, "search")
    files = v.as_files(_feed(spark, sf, "documents"))
    jobs.stream_search(files, term("license"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("repo", "path", "line_no", "col", "line")


def _in_batches(spark, sf, name, column, parts=3):
    """A table as a feed of that many batches, one after the other by a number."""
    rows, base = v.table(spark, sf, name), shared_dir(spark, f"feed-{name}")
    bounds = rows.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    low, high = bounds["low"] or 0, bounds["high"] or 0
    for k in range(parts):
        begin, end = (low + (high + 1 - low) * i // parts for i in (k, k + 1))
        part = rows.where((F.col(column) >= begin) & (F.col(column) < end))
        part.coalesce(1).write.mode("append").parquet(base)
    return jobs.read_feed(spark, base, rows.schema, files_per_batch=1)


@query
def stream_retention(spark, sf):
    """Three batches while time goes on; rows of earlier ones expire."""
    base = shared_dir(spark, "retention")
    jobs.stream_retention(
        _in_batches(spark, sf, "events", "event_id"), "ts", f"{base}/out", f"{base}/checkpoint",
        now=lambda batch: NOW - timedelta(hours=20 * (2 - min(batch, 2))),
    ).awaitTermination()
    return jobs.read_retained(spark, f"{base}/out").select("event_id", "ts", "user_id")


@query
def stream_eviction(spark, sf):
    """The task table after three batches, each of which overflows it."""
    base = shared_dir(spark, "eviction")
    events = v.as_task_events(_in_batches(spark, sf, "events", "event_id"))
    jobs.stream_eviction(events, f"{base}/out", f"{base}/checkpoint", cap=100).awaitTermination()
    return jobs.read_latest_status(spark, f"{base}/out")


@query
def stream_index(spark, sf):
    """Entries of an index built from a feed, with its posting count per file."""
    base = shared_dir(spark, "index")
    files = v.as_files(_feed(spark, sf, "documents")).withColumns(
        {"source": F.col("repo"), "shard": F.pmod(F.octet_length("content"), F.lit(8)).cast("bigint")}
    )
    jobs.stream_index(files, f"{base}/index", f"{base}/checkpoint").awaitTermination()
    grams = read_postings(spark, f"{base}/index").groupBy("repo", "path").agg(
        F.count(F.lit(1)).alias("n_grams")
    )
    entries = read_entries(spark, f"{base}/index").select(
        "repo", "path", "source", "shard", "content_sha", "n_bytes"
    )
    return entries.join(grams, ["repo", "path"], "left").fillna({"n_grams": 0})


@query
def stream_orphan_sweep(spark, sf):
    base = shared_dir(spark, "sweep")
    files = v.files(spark, sf).select(
        "*", F.col("repo").alias("source"), F.pmod(F.octet_length("content"), F.lit(64)).cast("bigint").alias("shard")
    )
    write_entries(files, f"{base}/index")
    # All documents are one listing, and its last row is that of one document, so they come in one batch.
    live = _feed(spark, sf, "documents", files_per_batch=2**31 - 1).where((F.col("source") != "src3") | (F.col("doc_id") == 0)).select(
        F.lit("all").alias("listing"),
        F.when(F.col("source") != "src3", F.col("source")).alias("source"),
        (F.col("doc_id") == 0).alias("last"),
    )
    jobs.stream_orphan_sweep(live, f"{base}/index", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("shard")
