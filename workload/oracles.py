"""The registered queries again, as SQL over the given tables."""

from __future__ import annotations

FILES = """files AS (
  SELECT source AS repo, concat(lang, '/', doc_id, '.txt') AS path, lang AS language,
         text AS content, doc_id,
         CASE WHEN doc_id % 2 = 0 THEN ['HEAD', 'master'] ELSE ['HEAD'] END AS branches
  FROM documents)"""

REPOS = """repos AS (
  SELECT repo, id, id % 5 = 0 AS archived, id % 3 = 0 AS fork, id % 2 = 0 AS public,
         list_concat(['t' || (id % 4)], CASE WHEN id % 3 = 0 THEN ['attic'] ELSE [] END) AS topics
  FROM (SELECT DISTINCT source AS repo,
               CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS id FROM documents))"""

PAGE_FILES = """files AS (
  SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS repo,
         concat(page_id, '.html') AS path, 'html' AS language, html AS content
  FROM pages)"""

TURN_FILES = """files AS (
  SELECT CAST(conv_id AS VARCHAR) AS repo, concat(turn, '.', role) AS path, role AS language,
         text AS content FROM conversations)"""

# A final newline ends the last line.
LINES = """lines AS (
  SELECT repo, path, unnest(l) AS line, CAST(generate_subscripts(l, 1) AS INTEGER) AS line_no,
         CAST(len(l) AS INTEGER) AS total
  FROM (SELECT repo, path, string_split(
          CASE WHEN length(content) > 1 AND ends_with(content, chr(10))
               THEN left(content, length(content) - 1) ELSE content END, chr(10)) AS l
        FROM files))"""

GRAMS_OF = """list_distinct(list_transform(range(1, len({chars}) - 1),
                 lambda i: {chars}[i] || {chars}[i + 1] || {chars}[i + 2]))"""


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ", ".join(ctes) + "\n" + body


def has(needle: str, column: str = "content") -> str:
    """Smart-case containment of a literal."""
    if any(c.isupper() for c in needle):
        return f"contains({column}, '{needle}')"
    return f"contains(lower({column}), '{needle}')"


def hits(needle: str, sensitive: bool | None = None) -> str:
    """Number of occurrences of a literal in a file."""
    if sensitive is None:
        sensitive = any(c.isupper() for c in needle)
    hay = "content" if sensitive else "lower(content)"
    return f"((strlen({hay}) - strlen(replace({hay}, '{needle}', ''))) // strlen('{needle}'))"


def line_hits(pattern: str) -> str:
    """Number of matches of a pattern inside the lines of a file."""
    return (
        "CAST(list_sum(list_transform(string_split(content, chr(10)), "
        f"lambda x: len(regexp_extract_all(x, '{pattern}')))) AS BIGINT)"
    )


ALTERNATIVES = "(?:apache|mit|bsd)[- ]licen[sc]ed?|(?:released|licensed) under (?:the )?(?:MIT|Apache)"


def found(where: str, score: str, ctes: list[str] | None = None, join: str = "") -> str:
    return with_(
        ctes or [FILES],
        f"SELECT files.repo, files.path, CAST({score} AS BIGINT) AS score FROM files {join} WHERE {where}",
    )


def fragments_cte(name: str, pattern: str) -> str:
    """Matches of a pattern with byte and character positions."""
    return f"""{name} AS (
  SELECT repo, path, line_no, line, m[i] AS hit,
         CAST(list_sum(list_transform(p[1:i], lambda x: strlen(x)))
              + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: strlen(x))), 0) AS INTEGER) AS off,
         CAST(strlen(m[i]) AS INTEGER) AS len,
         CAST(list_sum(list_transform(p[1:i], lambda x: length(x)))
              + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS chars,
         i
  FROM (SELECT repo, path, line_no, line, string_split_regex(line, '{pattern}') AS p,
               regexp_extract_all(line, '{pattern}') AS m
        FROM lines WHERE regexp_matches(line, '{pattern}')) t,
       LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i) u)"""


def ranges(source: str, key: str = "repo, path") -> str:
    """Gaps and islands over line numbers."""
    return f"""
SELECT {key},
       CASE WHEN min(line_no) = max(line_no) THEN CAST(min(line_no) AS VARCHAR)
            ELSE concat(min(line_no), '-', max(line_no)) END AS range,
       string_agg(line, chr(10) ORDER BY line_no) AS text
FROM (SELECT *, sum(brk) OVER (PARTITION BY repo, path ORDER BY line_no
                               ROWS UNBOUNDED PRECEDING) AS island
      FROM (SELECT *, CASE WHEN line_no = lag(line_no) OVER (PARTITION BY repo, path ORDER BY line_no) + 1
                           THEN 0 ELSE 1 END AS brk FROM {source}) b) i
GROUP BY repo, path, island"""


def around(needle: str, context: int) -> list[str]:
    """CTEs: matching lines, and for each the lines around it."""
    return [
        FILES,
        LINES,
        f"hit AS (SELECT * FROM lines WHERE {has(needle, 'line')})",
        f"""near AS (
  SELECT h.repo, h.path, h.line_no AS match_line, l.line_no, l.line
  FROM hit h JOIN lines l ON l.repo = h.repo AND l.path = h.path
       AND l.line_no BETWEEN h.line_no - {context} AND h.line_no + {context})""",
    ]


CONTEXT = with_(
    around("license", 2),
    """SELECT repo, path, match_line, line_no,
       CASE WHEN line_no < match_line THEN 'before' ELSE 'after' END AS side, line
FROM near WHERE line_no <> match_line""",
)


def rendered(needle: str) -> list[str]:
    """CTEs ending in ``rows``: rendered lines with one line of context."""
    pattern = needle if any(c.isupper() for c in needle) else f"(?i){needle}"
    return around(needle, 1) + [
        """ends AS (
  SELECT repo, path, line_no AS match_line, greatest(line_no - 1, 1) AS first,
         least(line_no + 1, total) AS last FROM hit)""",
        """gaps AS (
  SELECT repo, path, match_line FROM (
    SELECT *, lag(last) OVER (PARTITION BY repo, path ORDER BY match_line) AS before FROM ends) g
  WHERE first > before + 1)""",
        f"""parts AS (
  SELECT repo, path, match_line, -1 AS sub, 'separator' AS kind, NULL AS line_no, NULL AS col, '--' AS text
  FROM gaps
  UNION ALL
  SELECT repo, path, match_line, line_no, CASE WHEN line_no = match_line THEN 'match' ELSE 'context' END,
         line_no,
         CASE WHEN line_no = match_line THEN strlen(string_split_regex(line, '{pattern}')[1]) + 1 END,
         line FROM near)""",
        """rows AS (
  SELECT repo, path,
         CAST(row_number() OVER (PARTITION BY repo, path ORDER BY match_line, sub) AS INTEGER) AS seq,
         kind, CAST(line_no AS INTEGER) AS line_no, CAST(col AS INTEGER) AS col, text FROM parts)""",
    ]


CHUNKED = [
    FILES,
    LINES,
    f"hit AS (SELECT * FROM lines WHERE {has('les', 'line')})",
    """marked AS (
  SELECT *, CASE WHEN line_no - 1 <= lag(line_no) OVER w + 2 THEN 0 ELSE 1 END AS brk
  FROM hit WINDOW w AS (PARTITION BY repo, path ORDER BY line_no))""",
    """grouped AS (
  SELECT *, sum(brk) OVER (PARTITION BY repo, path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS island
  FROM marked)""",
    """spans AS (
  SELECT repo, path, min(line_no) - 1 AS lo, max(line_no) + 1 AS hi, any_value(total) AS total,
         CAST(count(*) AS INTEGER) AS n_matches FROM grouped GROUP BY repo, path, island)""",
]

GRAM_FILES = f"""gram_files AS (
  SELECT repo, path, content, {GRAMS_OF.format(chars='chars')} AS grams
  FROM (SELECT repo, path, content, string_split(lower(content), '') AS chars FROM files) c)"""

HOSTED = """hosted AS (
  SELECT page_id AS id,
         regexp_extract(url, '^[a-z]+://([^/?#]+)/([^/?#]+)/([^/?#]+)', 1) AS host,
         regexp_extract(url, '^[a-z]+://([^/?#]+)/([^/?#]+)/([^/?#]+)', 2) AS owner,
         regexp_extract(url, '^[a-z]+://([^/?#]+)/([^/?#]+)/([^/?#]+)', 3) AS name,
         concat_ws('/', host, owner, name) AS repo,
         id % 5 = 0 AS archived, id % 3 = 0 AS fork, id % 2 = 0 AS public, id % 7 <> 0 AS active,
         id % 6 = 0 AS user_owned, ['public', 'private', 'internal'][id % 3 + 1] AS visibility,
         list_concat(['t' || (id % 4)], CASE WHEN id % 9 = 0 THEN ['attic'] ELSE [] END) AS topics
  FROM pages)"""

EXPANDED = """rule_places AS (SELECT id, host, owner FROM hosted),
base AS (
  SELECT id AS n, host, owner, concat('https://', host, ':8443/api') AS url, id % 5 AS k,
         CASE WHEN id % 4 = 0 THEN '[02468]$' ELSE '' END AS name,
         CASE WHEN id % 3 = 0 THEN '^1' ELSE '' END AS exclude,
         CASE WHEN id % 4 = 1 THEN ['t1', 't2'] ELSE [] END AS topics,
         CASE WHEN id % 2 = 0 THEN ['attic'] ELSE [] END AS exclude_topics,
         CASE WHEN id % 7 = 0 THEN ['private', 'internal'] ELSE [] END AS visibility,
         CASE WHEN id % 4 = 0 THEN ['en', 'es', 'fr'] ELSE [] END AS incl,
         CASE WHEN id % 3 = 0 THEN ['de'] ELSE [] END AS excl
  FROM rule_places),
owners AS (
  SELECT n, list_filter(list_concat(
      list_transform(list_concat(['en', 'de'], [owner], CASE WHEN n % 2 = 0 THEN ['es', 'en'] ELSE [] END),
                     lambda x: {'org': x, 'usr': ''}),
      list_transform(['fr', 'user' || n], lambda x: {'org': '', 'usr': x})),
    lambda o: (len(incl) = 0 OR list_contains(incl, o.org || o.usr))
              AND NOT list_contains(excl, o.org || o.usr)) AS found
  FROM base WHERE k = 0),
spread AS (
  SELECT n, unnest(found) AS o, generate_subscripts(found, 1) - 1 AS owner_pos FROM owners
  UNION ALL
  SELECT n, {'org': CASE WHEN k = 2 THEN owner ELSE '' END, 'usr': ''}, 0 FROM base WHERE k <> 0),
expanded AS (
  SELECT n AS rule_pos, CAST(owner_pos AS BIGINT) AS owner_pos,
         ['github', 'gitlab', 'gitea', 'gerrit', 'cgit'][k + 1] AS kind, url, o.org AS org, o.usr AS "user",
         name, exclude,
         CASE WHEN k IN (0, 2) THEN topics ELSE [] END AS topics,
         CASE WHEN k IN (0, 2) THEN exclude_topics ELSE [] END AS exclude_topics,
         CASE WHEN k = 0 THEN visibility ELSE [] END AS visibility,
         (k IN (0, 2) AND n % 2 <> 0) OR (k = 1 AND n % 3 <> 0) AS no_archived,
         k IN (0, 2) AND n % 4 < 2 AS forks,
         k = 1 AND n % 2 = 0 AS only_public,
         k = 1 AND n % 4 < 2 AS exclude_user_repos,
         k = 3 AND n % 2 = 0 AS active,
         k <> 4 AND n % 3 = 1 AS keep_deleted,
         host AS rule_host
  FROM spread JOIN base USING (n))"""

OWNER_EXPANDED = EXPANDED.replace(
    "SELECT id, host, owner FROM hosted)", "SELECT min(id) AS id, host, owner FROM hosted GROUP BY host, owner)"
)

ALL_ENTRIES = """entries AS (
  SELECT source AS repo, doc_id % 8 AS shard, strlen(text) AS index_bytes FROM documents)"""

ENTRIES = """entries AS (
  SELECT source AS repo, concat(lang, '/', doc_id, '.txt') AS path,
         CASE WHEN doc_id % 11 = 0 THEN '' ELSE source END AS source, doc_id % 8 AS shard,
         CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha256(text) END AS content_sha,
         strlen(text) AS index_bytes
  FROM documents WHERE doc_id % 10 <> 0),
live AS (SELECT DISTINCT source FROM documents WHERE source <> 'src3'),
orphans AS (SELECT * FROM entries WHERE source <> '' AND source NOT IN (SELECT source FROM live))"""

TASKS = """tasks AS (
  SELECT id, status, error, ts FROM (
    SELECT CAST(user_id AS VARCHAR) AS id,
           CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running'
                WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed'
                WHEN 'error' THEN 'failed' END AS status,
           CASE WHEN event_type = 'error' THEN props END AS error, ts,
           row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM events) e WHERE rn = 1)"""


TASK_EVENTS_BATCHED = """task_events AS (
  SELECT CAST(user_id AS VARCHAR) AS id, event_id AS seq,
         CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running'
              WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status,
         CASE WHEN event_type = 'error' THEN props END AS error, ts,
         CASE WHEN event_id >= low + (high + 1 - low) * 2 // 3 THEN 2
              WHEN event_id >= low + (high + 1 - low) // 3 THEN 1 ELSE 0 END AS batch
  FROM events, (SELECT min(event_id) AS low, max(event_id) AS high FROM events) b)"""


def batch_of_tasks(k: int) -> str:
    """The task table after a batch of events: last states, without finished ones when there are too many."""
    columns = "id, status, error, ts, seq"
    before = f"SELECT {columns} FROM table{k - 1} UNION ALL " if k else ""
    return f"""merged{k} AS (
  SELECT {columns} FROM ({before}SELECT {columns} FROM task_events WHERE batch = {k}) u
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) = 1),
table{k} AS (
  SELECT * FROM merged{k}
  WHERE status NOT IN ('completed', 'failed') OR (SELECT count(*) FROM merged{k}) <= 100)"""


def symbol_cte(kind: str, opening: str, closing: str) -> str:
    """Symbols of one rule: name, byte offset in the line and order."""
    pattern = f"{opening}[^<]+{closing}"
    return f"""
  SELECT repo, path, line_no, '{kind}' AS kind, i,
         regexp_extract(m[i], '{opening}([^<]+){closing}', 1) AS sym,
         CAST(list_sum(list_transform(p[1:i], lambda x: strlen(x)))
              + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: strlen(x))), 0)
              + strlen(regexp_extract(m[i], '^{opening}')) AS INTEGER) AS off
  FROM (SELECT repo, path, line_no, string_split_regex(line, '{pattern}') AS p,
               regexp_extract_all(line, '{pattern}') AS m
        FROM lines WHERE regexp_matches(line, '{pattern}')) t,
       LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i) u"""


SYMBOLS = f"""found AS ({symbol_cte('title', '<title>', '</title>')}
  UNION ALL {symbol_cte('heading', '<h[1-6]>', '</h[1-6]>')}),
numbered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY repo, path, line_no
                                    ORDER BY kind = 'heading', i) AS INTEGER) AS pos FROM found),
symbols AS (
  SELECT repo, path, line_no, pos, sym, kind,
         CASE WHEN kind = 'heading' THEN
           last_value(CASE WHEN kind = 'title' THEN sym END IGNORE NULLS) OVER (
             PARTITION BY repo, path ORDER BY line_no, pos
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent,
         off, CAST(strlen(sym) AS INTEGER) AS len
  FROM numbered)"""


def literal_grams(*words: str) -> list[str]:
    return sorted({w[i : i + 3] for w in words for i in range(len(w) - 2)})


def all_grams(*words: str) -> str:
    return "(" + " AND ".join(f"contains(lower(content), '{g}')" for g in literal_grams(*words)) + ")"


COST_GRAMS = " + ".join(
    f"CAST(contains(lower(content), '{g}') AS BIGINT)"
    for g in literal_grams("license", "version", "under")
)
COST_CANDIDATE = f"({all_grams('license', 'under')} OR {all_grams('version', 'under')})"
COST_MATCH = f"(({has('License')} OR {has('version')}) AND {has('under')})"

RETAINED = """SELECT event_id, ts, user_id FROM events
WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 72 HOUR"""

MATCHED_LINES = f"""SELECT repo, path, line_no, CAST(1 + strlen(string_split_regex(line, '(?i)license')[1]) AS INTEGER) AS col, line
FROM lines WHERE {has('license', 'line')}"""

ETION = "(?i)étion"

ORACLES: dict[str, str] = {
    "search_term_ci": found(has("license"), hits("license")),
    "search_term_cs": found(has("License"), hits("License")),
    "search_case_yes": found(
        "contains(content, 'the') AND contains(content, 'license')",
        hits("the", True) + " + " + hits("license", True),
    ),
    "search_phrase": found(has("the Apache License"), hits("the Apache License")),
    "search_regex": found(
        r"regexp_matches(content, '(?im)^(re|ver)[a-z]+ under \w+')",
        line_hits(r"(?i)^(re|ver)[a-z]+ under \w+"),
    ),
    "search_and": found(
        f"{has('license')} AND {has('version')}", f"{hits('license')} + {hits('version')}"
    ),
    "search_or": found(f"{has('apache')} OR {has('mit')}", f"{hits('apache')} + {hits('mit')}"),
    "search_not": found(f"{has('license')} AND NOT {has('Apache')}", hits("license")),
    "search_not_group": found(
        f"NOT ({has('Licensed')} AND {has('Version')}) AND {has('under')}", hits("under")
    ),
    "filter_repo": found(
        f"{has('under')} AND regexp_matches(repo, '(?i)src1') AND NOT regexp_matches(repo, '(?i)src1[0-4]$')",
        hits("under"),
    ),
    "filter_path": found(
        rf"{has('the')} AND regexp_matches(path, '(?i)^(en|de)/.*[05]\.txt$') AND NOT contains(path, 'de/1')",
        hits("the"),
    ),
    "filter_lang": found(f"{has('der')} AND lower(language) = 'de'", hits("der")),
    "filter_branch": found(
        f"{has('license')} AND len(list_filter(branches, lambda b: contains(b, 'mast'))) > 0",
        hits("license"),
    ),
    "filter_branch_head": found(
        f"{has('license')} AND list_contains(branches, 'HEAD')", hits("license")
    ),
    "filter_flags": found(
        f"{has('the')} AND NOT archived AND NOT fork AND public",
        hits("the"),
        [FILES, REPOS],
        "JOIN repos ON repos.repo = files.repo",
    ),
    "filter_flags_or": found(
        f"{has('license')} OR (archived AND language = 'fr' AND {has('étion')})",
        f"{hits('license')} + {hits('étion')}",
        [FILES, REPOS],
        "JOIN repos ON repos.repo = files.repo",
    ),
    "filter_symbol": found(
        f"""{has('article')} AND EXISTS (SELECT 1 FROM symbols s WHERE s.repo = files.repo
        AND s.path = files.path AND {has('the', 's.sym')})""",
        hits("article") + f""" + (SELECT count(*) FROM symbols s WHERE s.repo = files.repo
        AND s.path = files.path AND {has('the', 's.sym')})""",
        [PAGE_FILES, LINES, SYMBOLS],
    ),
    "filter_symbol_stored": found(
        f"""{has('article')} AND EXISTS (SELECT 1 FROM symbols s WHERE s.repo = files.repo
        AND s.path = files.path AND {has('the', 's.sym')})""",
        hits("article") + f""" + (SELECT count(*) FROM symbols s WHERE s.repo = files.repo
        AND s.path = files.path AND {has('the', 's.sym')})""",
        [PAGE_FILES, LINES, SYMBOLS],
    ),
    "filter_symbol_or": found(
        f"""(EXISTS (SELECT 1 FROM symbols s WHERE s.repo = files.repo AND s.path = files.path
             AND {has('The', 's.sym')}) OR {has('étion')})
        AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.repo = files.repo AND s.path = files.path
             AND {has('ouon', 's.sym')})""",
        hits("étion") + f""" + (SELECT count(*) FROM symbols s WHERE s.repo = files.repo
        AND s.path = files.path AND {has('The', 's.sym')})""",
        [PAGE_FILES, LINES, SYMBOLS],
    ),
    "symbol_lines": with_(
        [PAGE_FILES, LINES, SYMBOLS],
        f"""SELECT repo, path, line_no, off, len, sym, kind, parent,
       CASE WHEN parent IS NOT NULL THEN 'title' END AS parent_kind
FROM symbols WHERE {has('the', 'sym')}""",
    ),
    "search_turns": found(
        rf"regexp_matches(content, '(?im)\bthe[a-z]*\b') AND NOT {has('und')} AND language = 'assistant'",
        line_hits(r"(?i)\bthe[a-z]*\b"),
        [TURN_FILES],
    ),
    "mode_lines": with_(
        [
            FILES,
            LINES,
            f"hit AS (SELECT * FROM lines WHERE {has('license', 'line')} OR regexp_matches(line, '(?i)thh?e[rn]'))",
        ],
        ranges("hit"),
    ),
    "mode_lines_capped": with_(
        [
            FILES,
            LINES,
            f"top AS (SELECT repo, path FROM files WHERE {has('the')} ORDER BY {hits('the')} DESC, repo, path LIMIT 50)",
            f"hit AS (SELECT * FROM lines JOIN top USING (repo, path) WHERE {has('the', 'line')})",
        ],
        ranges("hit"),
    ),
    "mode_lines_fetched": with_(
        [
            FILES,
            LINES,
            f"top AS (SELECT repo, path FROM files WHERE {has('apache')} ORDER BY {hits('apache')} DESC, repo, path LIMIT 5)",
            f"hit AS (SELECT * FROM lines JOIN top USING (repo, path) WHERE {has('apache', 'line')})",
        ],
        ranges("hit"),
    ),
    "result_document": with_(
        [
            FILES,
            LINES,
            f"totals AS (SELECT count(*) AS total_matches FROM files WHERE {has('license')})",
            f"top AS (SELECT repo, path FROM files WHERE {has('license')} ORDER BY {hits('license')} DESC, repo, path LIMIT 20)",
            f"hit AS (SELECT * FROM lines JOIN top USING (repo, path) WHERE {has('license', 'line')})",
            f"shown AS ({ranges('hit')})",
        ],
        """SELECT total_matches, least(total_matches, 20) AS returned, total_matches > 20 AS truncated,
       concat(repo, ':', path) AS file, range, text FROM shown, totals""",
    ),
    "mode_lines_repo_only": with_(
        [REPOS],
        "SELECT repo FROM repos WHERE regexp_matches(repo, '(?i)src1') AND NOT regexp_matches(repo, '(?i)src1[0-4]$')",
    ),
    "mode_files": with_(
        [FILES],
        f"""SELECT DISTINCT concat(repo, ':', path) AS file FROM (
  SELECT repo, path FROM files WHERE {has('the')} ORDER BY {hits('the')} DESC, repo, path LIMIT 100) t""",
    ),
    "mode_paths": with_(
        [FILES], f"SELECT DISTINCT concat(repo, '/', path) AS file FROM files WHERE {has('version')}"
    ),
    "mode_repos": with_([FILES], f"SELECT DISTINCT repo FROM files WHERE {has('apache')}"),
    "lines_map": with_(
        [FILES, LINES, f"hit AS (SELECT * FROM lines WHERE {has('license', 'line')})"],
        ranges("hit", "concat(repo, ':', path) AS file"),
    ),
    "search_envelope": with_(
        [FILES],
        f"""SELECT count(*) AS total_matches, least(count(*), 50) AS returned, count(*) > 50 AS truncated
FROM files WHERE {has('the')}""",
    ),
    "file_lines": with_([FILES, LINES], "SELECT repo, path, line_no, line FROM lines"),
    "line_matches": with_(
        [FILES, LINES],
        f"SELECT repo, path, line_no, line FROM lines WHERE {has('étion', 'line')} OR {has('Licensed', 'line')}",
    ),
    "columns": with_(
        [FILES, LINES],
        f"""SELECT repo, path, line_no, CAST(strlen(string_split_regex(line, '{ETION}')[1]) + 1 AS INTEGER) AS col
FROM lines WHERE {has('étion', 'line')}""",
    ),
    "fragments": with_(
        [FILES, LINES, fragments_cte("a", ETION), fragments_cte("b", "(?i)on[a-z]*é")],
        """SELECT repo, path, line_no, off, len FROM a
UNION ALL SELECT repo, path, line_no, off, len FROM b""",
    ),
    "context": CONTEXT,
    "context_from_lines": CONTEXT,
    "line_ranges": with_(
        [FILES, LINES, f"hit AS (SELECT * FROM lines WHERE {has('les', 'line')})"], ranges("hit")
    ),
    "line_ranges_window": with_(
        [FILES, LINES, f"hit AS (SELECT * FROM lines WHERE {has('les', 'line')})"], ranges("hit")
    ),
    "gap_rows": with_(rendered("version"), "SELECT * FROM rows"),
    "render_text": with_(
        rendered("Apache"),
        """SELECT repo, path, seq,
       CASE kind WHEN 'match' THEN concat(repo, '/', path, ':', line_no, ':', col, ':', text)
                 WHEN 'context' THEN concat(repo, '/', path, '-', line_no, '-', text)
                 ELSE text END AS output FROM rows""",
    ),
    "chunks": with_(
        CHUNKED,
        """SELECT s.repo, s.path, greatest(lo, 1) AS first_line, least(hi, s.total) AS last_line, n_matches,
       string_agg(line, chr(10) ORDER BY line_no) AS text
FROM spans s JOIN lines l ON l.repo = s.repo AND l.path = s.path AND l.line_no BETWEEN lo AND hi
GROUP BY s.repo, s.path, lo, hi, s.total, n_matches""",
    ),
    "chunks_window": with_(
        CHUNKED, "SELECT repo, path, lo AS first_line, hi AS last_line FROM spans"
    ),
    "vimgrep": with_(
        [FILES, LINES],
        f"""SELECT repo, path, line_no, concat(repo, '/', path, ':', line_no, ':',
       strlen(string_split_regex(line, '{ETION}')[1]) + 1, ':', line) AS output
FROM lines WHERE {has('étion', 'line')}""",
    ),
    "highlight": with_(
        [FILES, LINES],
        rf"""SELECT repo, path, line_no, regexp_replace(line, '{ETION}', '[[\0]]', 'g') AS line
FROM lines WHERE {has('étion', 'line')}""",
    ),
    "snippet": with_(
        [FILES, LINES, fragments_cte("a", ETION)],
        """SELECT repo, path, line_no, off, right(left(line, chars), 20) AS pre, hit,
       left(substr(line, chars + length(hit) + 1), 20) AS post FROM a""",
    ),
    "sliced_lines": with_(
        [FILES],
        """SELECT repo, path,
       CASE WHEN len(l) <= 1 THEN ''
            ELSE array_to_string(l[2:4], chr(10)) || CASE WHEN len(l) > 4 THEN chr(10) ELSE '' END
       END AS content
FROM (SELECT repo, path, string_split(content, chr(10)) AS l FROM files) s""",
    ),
    "top_files_by_score": with_(
        [FILES],
        f"""SELECT repo, path, CAST({hits('tion')} AS BIGINT) AS score FROM files WHERE {has('tion')}
ORDER BY score DESC, repo, path LIMIT 25""",
    ),
    "top_files_bm25": with_(
        [
            FILES,
            "w AS (SELECT repo, path, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS ws FROM files)",
            "totals AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS average FROM w)",
            """tf AS (SELECT repo, path, len(ws) AS size, term, len(list_filter(ws, lambda x: x = term)) AS tf
  FROM w, (VALUES ('license'), ('apache'), ('the'), ('des')) t(term))""",
            "df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term)",
        ],
        """SELECT repo, path, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
              / (tf + 1.2 * (1 - 0.75 + 0.75 * size / average))), 6) AS score
FROM tf JOIN df USING (term), totals WHERE tf > 0 GROUP BY repo, path ORDER BY score DESC, repo, path LIMIT 30""",
    ),
    "total_cap": with_(
        [FILES],
        f"""SELECT * FROM (
  SELECT repo, path, score, CAST(sum(score) OVER (ORDER BY score DESC, repo, path
         ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_matches
  FROM (SELECT repo, path, CAST({hits('the')} AS BIGINT) AS score FROM files WHERE {has('the')}) s) r
WHERE running_matches - score < 20000""",
    ),
    "total_cap_by_name": with_(
        [FILES],
        """SELECT repo, path, CAST(0 AS BIGINT) AS score, CAST(NULL AS BIGINT) AS running_matches
FROM files WHERE regexp_matches(path, '^de/')""",
    ),
    "per_repo_match_cap": with_(
        [FILES],
        f"""SELECT repo, path, score FROM (
  SELECT repo, path, score, sum(score) OVER (PARTITION BY repo ORDER BY score DESC, repo, path
         ROWS UNBOUNDED PRECEDING) AS running
  FROM (SELECT repo, path, CAST({hits('the')} AS BIGINT) AS score FROM files WHERE {has('the')}) s) r
WHERE running - score < 400""",
    ),
    "per_repo_cap": with_(
        [FILES],
        f"""SELECT * FROM (
  SELECT repo, path, score,
         CAST(row_number() OVER (PARTITION BY repo ORDER BY score DESC, repo, path) AS INTEGER) AS rank_in_repo
  FROM (SELECT repo, path, CAST({hits('the')} AS BIGINT) AS score FROM files WHERE {has('the')}) s) r
WHERE rank_in_repo <= 3""",
    ),
    "duplicates": with_(
        [FILES],
        f"""SELECT repo, path, score,
       CASE WHEN first = concat(repo, ':', path) THEN NULL ELSE first END AS duplicate_of
FROM (SELECT repo, path, score, first_value(concat(repo, ':', path)) OVER (
               PARTITION BY content ORDER BY score DESC, repo, path) AS first
      FROM (SELECT repo, path, content, CAST({hits('the')} + {hits('un')} AS BIGINT) AS score
            FROM files WHERE {has('the')} OR {has('un')}) s) d""",
    ),
    "search_stats": with_(
        [FILES],
        f"""SELECT count(*) AS file_count, CAST(sum({hits('the')} + {hits('tion')}) AS BIGINT) AS match_count
FROM files WHERE {has('the')} AND {has('tion')}""",
    ),
    "search_cost": with_(
        [FILES],
        f"""SELECT CAST(sum({COST_GRAMS}) AS BIGINT) AS ngram_matches,
       count(*) FILTER ({COST_CANDIDATE}) AS files_considered,
       count(*) FILTER ({COST_CANDIDATE}) AS files_loaded,
       CAST(coalesce(sum(strlen(content)) FILTER ({COST_CANDIDATE}), 0) AS BIGINT) AS content_bytes_loaded,
       count(*) FILTER ({COST_MATCH}) AS file_count,
       greatest(count(*) FILTER ({COST_MATCH}) - 10, 0) AS files_skipped
FROM files""",
    ),
    "repo_stats": with_(
        [FILES, ALL_ENTRIES],
        """SELECT f.repo, f.documents, f.content_bytes, coalesce(e.shards, 0) AS shards,
       coalesce(e.index_bytes, 0) AS index_bytes
FROM (SELECT repo, count(*) AS documents, CAST(sum(strlen(content)) AS BIGINT) AS content_bytes
      FROM files GROUP BY repo) f
LEFT JOIN (SELECT repo, count(DISTINCT shard) AS shards, CAST(sum(index_bytes) AS BIGINT) AS index_bytes
           FROM entries GROUP BY repo) e ON e.repo = f.repo""",
    ),
    "repo_listing": with_(
        [FILES, REPOS, ALL_ENTRIES],
        """SELECT r.repo, r.id, r.archived, r.fork, r.public, array_to_string(r.topics, ',') AS topics, f.documents, f.content_bytes,
       coalesce(e.shards, 0) AS shards, coalesce(e.index_bytes, 0) AS index_bytes
FROM repos r
JOIN (SELECT repo, count(*) AS documents, CAST(sum(strlen(content)) AS BIGINT) AS content_bytes
      FROM files GROUP BY repo) f ON f.repo = r.repo
LEFT JOIN (SELECT repo, count(DISTINCT shard) AS shards, CAST(sum(index_bytes) AS BIGINT) AS index_bytes
           FROM entries GROUP BY repo) e ON e.repo = r.repo""",
    ),
    "corpus_totals": """SELECT count(DISTINCT source) AS repos, count(*) AS documents,
       CAST(sum(strlen(text)) AS BIGINT) AS content_bytes FROM documents""",
    "repo_map": with_(
        [FILES, REPOS],
        """SELECT id, repo, count(*) AS documents, CAST(sum(strlen(content)) AS BIGINT) AS content_bytes
FROM files JOIN repos USING (repo) GROUP BY id, repo""",
    ),
    "repo_map_latest": with_(
        [HOSTED],
        """SELECT id % 50 AS id, concat(repo, '/', id) AS repo, coalesce(documents, 0) AS documents,
       coalesce(content_bytes, 0) AS content_bytes
FROM hosted LEFT JOIN (
  SELECT concat(regexp_extract(url, '^[a-z]+://([^?#]+)', 1), '/', page_id) AS place,
         1::BIGINT AS documents, strlen(html)::BIGINT AS content_bytes FROM pages) p ON p.place = concat(repo, '/', id)
QUALIFY row_number() OVER (PARTITION BY id % 50 ORDER BY id DESC) = 1""",
    ),
    "repo_order_size": with_(
        [FILES],
        """SELECT repo, count(*) AS documents, CAST(sum(strlen(content)) AS BIGINT) AS content_bytes
FROM files GROUP BY repo ORDER BY content_bytes DESC, repo""",
    ),
    "repo_attributes": with_(
        [FILES, REPOS],
        """SELECT archived, fork, public, count(*) AS n_files FROM files JOIN repos USING (repo)
GROUP BY archived, fork, public""",
    ),
    "expand_rules": with_(
        [HOSTED, EXPANDED],
        """SELECT rule_pos, owner_pos, kind, url, org, "user", name, exclude,
       array_to_string(topics, ',') AS topics, array_to_string(exclude_topics, ',') AS exclude_topics,
       array_to_string(visibility, ',') AS visibility, no_archived, forks, only_public,
       exclude_user_repos, active, keep_deleted FROM expanded""",
    ),
    "select_repos": with_(
        [HOSTED, OWNER_EXPANDED],
        """SELECT e.rule_pos, h.repo, e.keep_deleted, count(*) AS times
FROM expanded e JOIN hosted h ON h.host = e.rule_host
WHERE (e.org || e."user" = '' OR h.owner = e.org || e."user")
  AND (e.name = '' OR regexp_matches(h.name, e.name))
  AND (e.exclude = '' OR NOT regexp_matches(h.name, e.exclude))
  AND NOT (e.no_archived AND h.archived)
  AND NOT (e.kind IN ('github', 'gitea') AND NOT e.forks AND h.fork)
  AND NOT (e.only_public AND NOT h.public)
  AND NOT (e.exclude_user_repos AND h.user_owned)
  AND NOT (e.active AND NOT h.active)
  AND (len(e.visibility) = 0 OR list_contains(e.visibility, h.visibility))
  AND (len(e.topics) = 0 OR list_has_any(h.topics, e.topics))
  AND NOT list_has_any(h.topics, e.exclude_topics)
GROUP BY e.rule_pos, h.repo, e.keep_deleted""",
    ),
    "topic_filter": with_(
        [REPOS],
        """SELECT repo, id FROM repos WHERE list_has_any(topics, ['t1', 't2'])
AND NOT list_contains(topics, 'attic')""",
    ),
    "owner_filter": with_(
        [HOSTED],
        """SELECT host AS owner, repo FROM hosted
WHERE host IN (SELECT host FROM hosted WHERE NOT archived)
  AND host NOT IN (SELECT host FROM hosted WHERE NOT active)""",
    ),
    "first_rule": with_(
        [
            HOSTED,
            EXPANDED,
            r"""requests AS (
  SELECT page_id AS request_id,
         CASE WHEN page_id % 5 = 0 THEN regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)
              WHEN page_id % 7 = 0 THEN concat('git.example.com/nobody/', page_id)
              ELSE regexp_extract(url, '^[a-z]+://([^?#]+)', 1) END AS repo
  FROM pages)""",
            """parsed AS (
  SELECT *, repo LIKE '%/%/%' AS valid, string_split(repo, '/')[2] AS owner,
         array_to_string(string_split(repo, '/')[3:], '/') AS name FROM requests)""",
            """ruled AS (
  SELECT p.*, CASE WHEN valid THEN (
      SELECT min(rule_pos) FROM expanded e
      WHERE e.kind = 'github' AND (e.org = p.owner OR e."user" = p.owner)) END AS rule_pos
  FROM parsed p)""",
        ],
        """SELECT request_id, repo, rule_pos,
       CASE WHEN rule_pos IS NOT NULL THEN concat('^', name, '$') END AS scoped_name,
       CASE WHEN rule_pos IS NULL THEN 'failed' END AS status,
       CASE WHEN NOT valid THEN concat('invalid repo path "', repo, '": expected host/owner/name')
            WHEN rule_pos IS NULL THEN concat('no mirror config found for "', repo, '"') END AS error
FROM ruled""",
    ),
    "first_per_host": """SELECT page_id, host, value FROM (
  SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rn FROM (
    SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host,
           CASE WHEN page_id % 4 = 0 THEN '' ELSE sha256(html) END AS value FROM pages) p
  WHERE value <> '') r WHERE rn = 1""",
    "repo_name_parts": r"""SELECT page_id, len(string_split(r, '/')) >= 3 AS valid, string_split(r, '/')[1] AS host,
       string_split(r, '/')[2] AS owner,
       CASE WHEN len(string_split(r, '/')) >= 3 THEN array_to_string(string_split(r, '/')[3:], '/') END AS name
FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)
                           ELSE regexp_extract(url, '^[a-z]+://([^?#]+)', 1) END AS r FROM pages) p""",
    "url_hosts": "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages",
    "ngram_postings": with_(
        [FILES, GRAM_FILES],
        "SELECT gram, count(*) AS n_files FROM (SELECT unnest(grams) AS gram FROM gram_files) g GROUP BY gram",
    ),
    "index_blocks": with_(
        [FILES, GRAM_FILES], "SELECT unnest(grams) AS gram, repo, path FROM gram_files"
    ),
    "candidates": with_(
        [
            FILES,
            GRAM_FILES,
            f"""asked AS (SELECT item_id AS query_id, {GRAMS_OF.format(chars='chars')} AS wanted
  FROM (SELECT item_id, string_split(lower(text), '') AS chars FROM benchmark) b)""",
        ],
        """SELECT query_id, repo, path FROM gram_files, asked
WHERE len(wanted) > 0 AND list_has_all(grams, wanted)""",
    ),
    "candidates_positional": with_(
        [
            FILES,
            GRAM_FILES,
            f"""asked AS (SELECT item_id AS query_id, q, {GRAMS_OF.format(chars='chars')} AS wanted
  FROM (SELECT item_id, lower(text) AS q, string_split(lower(text), '') AS chars FROM benchmark) b)""",
            """met AS (SELECT query_id, q, repo, path FROM gram_files, asked
  WHERE len(wanted) > 0 AND list_has_all(grams, wanted))""",
        ],
        # A text between its first and last gram, cut out of the file, is as long as it should be.
        """SELECT DISTINCT query_id, repo, path FROM (
  SELECT query_id, repo, path, q, c, unnest(range(1, len(c) - length(q) + 2)) AS i
  FROM (SELECT query_id, repo, path, q, string_split(lower(content), '') AS c
        FROM met JOIN files USING (repo, path)) f) p
WHERE c[i] || c[i + 1] || c[i + 2] = left(q, 3)
  AND c[i + length(q) - 3] || c[i + length(q) - 2] || c[i + length(q) - 1] = right(q, 3)""",
    ),
    "search_batch": with_(
        [FILES],
        """SELECT item_id AS query_id, repo, path FROM files, benchmark
WHERE text <> '' AND contains(content, text)""",
    ),
    "search_batch_anchored": with_(
        [FILES],
        r"""SELECT query_id, repo, path FROM files, (
  SELECT conv_id * 1000 + turn AS query_id, string_split_regex(text, '[.?!]\s*')[1] AS q, text AS whole
  FROM conversations) t
WHERE (q <> '' AND contains(content, q)) OR (whole <> '' AND contains(content, whole))""",
    ),
    "search_batch_sentences": with_(
        [FILES],
        r"""SELECT query_id, count(*) AS n_files FROM files, (
  SELECT (conv_id * 1000 + turn) * 1000 + i - 1 AS query_id, parts[i] AS q
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT conv_id, turn, string_split_regex(text, '[.?!]\s*') AS parts FROM conversations) s) p) t
WHERE q <> '' AND contains(content, q) GROUP BY query_id""",
    ),
    "search_narrowed": found(
        f"{has('apache')} AND ({has('License')} OR {has('version')})",
        f"{hits('apache')} + {hits('License')} + {hits('version')}",
    ),
    "search_regex_narrowed": found(
        r"regexp_matches(content, 'Licensed under .*Version \d') OR regexp_matches(content, 'Released? under the MIT.+')",
        line_hits(r"Licensed under .*Version \d") + " + " + line_hits("Released? under the MIT.+"),
    ),
    "search_regex_alternatives": found(
        f"regexp_matches(content, '(?i){ALTERNATIVES}')",
        line_hits(f"(?i){ALTERNATIVES}"),
    ),
    "search_indexed": with_(
        [
            FILES,
            LINES,
            f"""top AS (SELECT repo, path FROM files
  WHERE regexp_matches(content, '(?i)licen[sc]e') AND NOT {has('apache')}
  ORDER BY {line_hits('(?i)licen[sc]e')} DESC, repo, path LIMIT 20)""",
            "hit AS (SELECT * FROM lines JOIN top USING (repo, path) WHERE regexp_matches(line, '(?i)licen[sc]e'))",
        ],
        ranges("hit"),
    ),
    "repo_flags_missing": with_(
        [FILES, REPOS],
        """SELECT f.repo, count(*) AS n_files FROM files f
LEFT JOIN (SELECT * FROM repos WHERE id % 4 <> 0) r ON r.repo = f.repo
WHERE NOT coalesce(r.archived, FALSE) AND NOT coalesce(r.fork, FALSE) GROUP BY f.repo""",
    ),
    "stored_corpus": with_(
        [FILES], "SELECT repo, path, 'HEAD' AS branches, '' AS language, sha256(content) AS sha FROM files"
    ),
    "tree_corpus": with_([FILES], "SELECT repo, path, sha256(coalesce(content, '')) AS sha FROM files"),
    "stored_rules": with_(
        [HOSTED, EXPANDED], """SELECT rule_pos, owner_pos, kind, url, org, "user" FROM expanded"""
    ),
    "stored_flat_rules": with_(
        [HOSTED],
        """SELECT * FROM (
  SELECT id AS rule_pos,
         CASE WHEN id % 10 = 0 OR (id % 5 = 0 AND owner <> '') THEN 'github'
              WHEN id % 5 = 1 THEN 'gitlab' WHEN id % 5 = 2 THEN 'gitea' WHEN id % 5 = 3 THEN 'gerrit' END AS kind,
         CASE WHEN id % 10 = 0 OR id % 5 IN (1, 2, 3) THEN concat('https://', host, '/api') ELSE '' END AS url,
         CASE WHEN id % 5 = 0 THEN owner ELSE '' END AS org, CASE WHEN id % 5 = 2 THEN owner ELSE '' END AS "user",
         'rule' || id AS name, CASE WHEN id % 3 = 0 THEN '^old' ELSE '' END AS exclude,
         id % 4 = 0 AS no_archived, id % 3 = 1 AS keep_deleted
  FROM hosted) r WHERE kind IS NOT NULL""",
    ),
    "index_diff": with_(
        [ENTRIES],
        """SELECT coalesce(c.repo, e.repo) AS repo, coalesce(c.path, e.path) AS path,
       CASE WHEN e.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'deleted'
            WHEN c.content_sha = e.content_sha THEN 'same' ELSE 'changed' END AS status
FROM (SELECT source AS repo, concat(lang, '/', doc_id, '.txt') AS path, sha256(text) AS content_sha
      FROM documents WHERE doc_id % 13 <> 0) c
FULL JOIN entries e ON e.repo = c.repo AND e.path = c.path""",
    ),
    "index_diff_rolled": """WITH new AS (
  SELECT source AS repo, concat(lang, '/', doc_id, '.txt') AS path, sha256(text) AS sha FROM documents),
old AS (
  SELECT source AS repo, concat(lang, '/', doc_id, '.txt') AS path,
         CASE WHEN source IN ('src1', 'src4') AND doc_id % 3 = 0 THEN 'old' ELSE sha256(text) END AS sha
  FROM documents WHERE source <> 'src2' AND NOT (source = 'src5' AND doc_id % 4 = 0)
  UNION ALL SELECT 'gone', CAST(doc_id AS VARCHAR), 'x' FROM documents WHERE source = 'src7')
SELECT repo, path,
       CASE WHEN old.sha IS NULL THEN 'new' WHEN new.sha IS NULL THEN 'deleted' ELSE 'changed' END AS status,
       new.sha AS new_sha, old.sha AS old_sha
FROM new FULL JOIN old USING (repo, path) WHERE new.sha IS DISTINCT FROM old.sha""",
    "orphan_entries": with_([ENTRIES], "SELECT repo, path, shard, source FROM orphans"),
    "orphan_shards": with_([ENTRIES], "SELECT DISTINCT shard FROM orphans"),
    "surviving_entries": with_(
        [ENTRIES],
        "SELECT repo, path, shard FROM entries WHERE shard NOT IN (SELECT shard FROM orphans)",
    ),
    "prune_deleted": with_(
        [FILES, REPOS],
        """SELECT repo, id, id % 4 = 0 AS keep_deleted FROM repos WHERE id % 4 <> 0
AND repo NOT IN (SELECT repo FROM files WHERE contains(content, 'Apache'))""",
    ),
    "detect_language": """SELECT source AS repo, concat(doc_id, '.', upper(lang)) AS path,
       CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German'
            ELSE 'unknown' END AS language FROM documents""",
    "symbol_definitions": with_(
        [PAGE_FILES, LINES, SYMBOLS],
        """SELECT *, CASE WHEN parent IS NOT NULL THEN 'title' END AS parent_kind FROM symbols""",
    ),
    "get_one_file": with_(
        [FILES], "SELECT repo, path, content FROM files WHERE repo = 'src1' AND path = 'en/1.txt'"
    ),
    "get_many_files": with_(
        [FILES],
        "SELECT repo, path, sha256(content) AS sha FROM files WHERE contains(content, 'License')",
    ),
    "retain_recent": RETAINED,
    "latest_status": with_([TASKS], "SELECT * FROM tasks"),
    "evict_finished": with_(
        [TASKS],
        """SELECT * FROM tasks WHERE status NOT IN ('completed', 'failed')
OR (SELECT count(*) FROM tasks) <= 100""",
    ),
    "keep_finished": with_([TASKS], "SELECT * FROM tasks"),
    "stream_latest_status": with_([TASKS], "SELECT * FROM tasks"),
    "stream_search": with_([FILES, LINES], MATCHED_LINES),
    "stream_retention": RETAINED,
    "stream_eviction": with_(
        [TASK_EVENTS_BATCHED, *(batch_of_tasks(k) for k in range(3))], "SELECT id, status, error, ts FROM table2"
    ),
    "stream_index": with_(
        [FILES, GRAM_FILES],
        """SELECT repo, path, repo AS source, strlen(content) % 8 AS shard, sha256(content) AS content_sha,
       strlen(content) AS n_bytes, len(grams) AS n_grams FROM gram_files""",
    ),
    "stream_orphan_sweep": "SELECT DISTINCT strlen(text) % 64 AS shard FROM documents WHERE source = 'src3'",
}
