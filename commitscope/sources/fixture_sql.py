"""DuckDB twins of the fixture recipes and of the parsing steps.

The driver's correctness check runs our oracle SQL in DuckDB against the raw
driver tables.  Each oracle therefore starts from these CTEs, which rebuild
the derived corpora byte for byte (verified against the Spark recipes in
``tests/test_oracle.py``).  These strings are test oracles only; no job runs
them.
"""

from __future__ import annotations

from .fixtures import BLANK_DIFF, BLANK_ID_BASE, CJK, FIXTURE_DATE, FIXTURE_PATHS, FIXTURE_USERS, JUNK_PREFIX, \
    LOG_POS_BASE
from ..functions.js import JS_WS_CHARS


def sql_str(text: str) -> str:
    """A DuckDB string expression for ``text`` (control characters via chr)."""
    parts, buf = [], ""
    for ch in text:
        if ch == "'" or ch.isprintable() and ord(ch) < 0x80:
            buf += "''" if ch == "'" else ch
        else:
            if buf:
                parts.append(f"'{buf}'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
    if buf or not parts:
        parts.append(f"'{buf}'")
    return "(" + " || ".join(parts) + ")"


NL = "chr(10)"
WS_SET = sql_str(JS_WS_CHARS)
_PATHS = "[" + ", ".join(f"'{p}'" for p in FIXTURE_PATHS) + "]"

COMMITS_CTE = f"""
fx_docs AS (
  SELECT doc_id, doc_id // 8 AS commit_id,
         replace({_PATHS}[1 + doc_id % 12], '#', CAST(doc_id AS VARCHAR)) AS path,
         string_split(text, {NL}) AS lines, doc_id % 7 AS kind
  FROM documents
),
fx_seg AS (
  SELECT doc_id, commit_id,
    'diff --git a/' || a_path || ' b/' || path || {NL} ||
    CASE kind WHEN 0 THEN 'new file mode 100644' || {NL}
              WHEN 1 THEN 'deleted file mode 100644' || {NL}
              WHEN 2 THEN 'similarity index 90%' || {NL} || 'rename from ' || a_path || {NL}
                          || 'rename to ' || path || {NL}
              ELSE '' END ||
    'index 1111111..2222222' || {NL} || '--- a/' || a_path || {NL} || '+++ b/' || path || {NL} ||
    '@@ -' || CAST(doc_id % 50 + 1 AS VARCHAR) || ',' || CAST(len(lines) AS VARCHAR) ||
    ' +' || CAST(doc_id % 40 + 1 AS VARCHAR) || ',' || CAST(len(lines) AS VARCHAR) || ' @@' || {NL} ||
    array_to_string(list_transform(lines, lambda x, i: [' ', '+', '-'][1 + (doc_id + i - 1) % 3] || x), {NL})
    || {NL} AS seg
  FROM (SELECT *, CASE WHEN kind = 2 THEN 'old/' || path ELSE path END AS a_path FROM fx_docs)
),
commits AS (
  SELECT 'repo-' || CAST(commit_id % 10 AS VARCHAR) AS repo, commit_id,
         CASE WHEN commit_id % 5 = 4 THEN {sql_str(JUNK_PREFIX)} || body ELSE body END AS raw_diff
  FROM (SELECT commit_id, string_agg(seg, '' ORDER BY doc_id) AS body FROM fx_seg GROUP BY commit_id)
  UNION ALL
  SELECT 'blank-' || CAST(n_nationkey % 10 AS VARCHAR), CAST({BLANK_ID_BASE} + n_nationkey AS BIGINT),
         {sql_str(BLANK_DIFF)}
  FROM nation
)"""

# OP-01 + OP-04 + OP-05: non-blank snapshots split into file changes.  DuckDB
# has no look-ahead, so split on newline + header and re-attach both.
FILE_PARSE_CTE = f"""
fc_pieces AS (
  SELECT repo, commit_id, string_split({NL} || raw_diff, {NL} || 'diff --git ') AS p
  FROM commits WHERE trim(raw_diff, {WS_SET}) <> ''
),
fc_segs AS (
  SELECT repo, commit_id,
    list_filter(list_transform(p[2:], lambda x, i: 'diff --git ' || x ||
                               CASE WHEN i < len(p) - 1 THEN {NL} ELSE '' END),
                lambda s: regexp_matches(s, '^diff --git a/.+ b/.+\\n')) AS segs
  FROM fc_pieces
),
fc_rows AS (
  SELECT repo, commit_id, CAST(generate_subscripts(segs, 1) - 1 AS INTEGER) AS file_seq,
         unnest(segs) AS diff
  FROM fc_segs
),
file_changes AS (
  SELECT repo, commit_id, file_seq,
    rtrim(regexp_extract(diff, '^diff --git a/.+ b/(.+)\\n', 1), {WS_SET}) AS path,
    CASE WHEN regexp_matches(diff, '(?m)^new file mode') THEN 'added'
         WHEN regexp_matches(diff, '(?m)^deleted file mode') THEN 'deleted'
         WHEN regexp_matches(diff, '(?m)^rename ') THEN 'renamed'
         ELSE 'modified' END AS change_type,
    diff
  FROM fc_rows
)"""
FILE_CHANGES_CTE = COMMITS_CTE + "," + FILE_PARSE_CTE


def count_lines_sql(diff: str, sign: str) -> str:
    """OP-09 in DuckDB: lines starting with ``sign`` but not with it three times."""
    return (f"CAST(len(list_filter(string_split({diff}, {NL}), lambda l: starts_with(l, '{sign}') "
            f"AND NOT starts_with(l, '{sign * 3}'))) AS BIGINT)")


# Fixed values (OP-13): exact dependency-manifest names, test folder names,
# config-tool name patterns, config and docs extensions.
from ..operators.paths import (CONFIG_EXTS, CONFIG_NAME_PREFIXES, DEPS_NAMES, DOCS_DIRS, DOCS_EXTS,
                               SCRIPT_SUFFIX, TEST_DIRS)


def _in_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def classify_sql(path: str) -> str:
    """Columns name/ext/parts then group_key, group_type, label (OP-13)."""
    return f"""
  SELECT *,
    CASE WHEN deps THEN 'deps' WHEN test THEN 'test' WHEN config THEN 'config' WHEN docs THEN 'docs'
         WHEN len(parts) > 1 THEN 'source:' || parts[1] ELSE 'misc' END AS group_key,
    CASE WHEN deps THEN 'deps' WHEN test THEN 'test' WHEN config THEN 'config' WHEN docs THEN 'docs'
         WHEN len(parts) > 1 THEN 'source' ELSE 'misc' END AS group_type,
    CASE WHEN deps THEN 'deps' WHEN test THEN 'test' WHEN config THEN 'config' WHEN docs THEN 'docs'
         WHEN len(parts) > 1 THEN 'source: ' || parts[1] || '/' ELSE 'misc' END AS label
  FROM (
    SELECT *,
      list_contains({_in_list(DEPS_NAMES)}, cl_name) AS deps,
      (regexp_matches(cl_name, '\\.(test|spec){SCRIPT_SUFFIX}$')
        OR len(list_intersect(parts, {_in_list(TEST_DIRS)})) > 0) AS test,
      (regexp_matches(cl_name, '\\.(config|rc){SCRIPT_SUFFIX}$') OR starts_with(cl_name, '.env')
        OR list_contains({_in_list(CONFIG_EXTS)}, cl_ext)
        OR list_bool_or(list_transform({_in_list(CONFIG_NAME_PREFIXES)}, lambda p: starts_with(cl_name, p)))) AS config,
      (list_contains({_in_list(DOCS_EXTS)}, cl_ext) OR list_contains({_in_list(DOCS_DIRS)}, parts[1])) AS docs
    FROM (
      SELECT *, CASE WHEN cl_name = '..' THEN ''
                     ELSE lower(regexp_extract(cl_name, '^.+(\\.[^.]*)$', 1)) END AS cl_ext
      FROM (SELECT *, regexp_extract({path}, '([^/]*)/*$', 1) AS cl_name,
                      string_split({path}, '/') AS parts FROM {{src}})
    )
  )"""


LOG_CTE = f"""
commit_log AS (
  SELECT 'repo-' || CAST(doc_id % 4 AS VARCHAR) AS repo, md5(CAST(doc_id AS VARCHAR)) AS hash,
    CASE WHEN lang = 'es' THEN translate(subj, 'aeiou', '{CJK * 5}') ELSE subj END AS subject,
    'Author ' || source AS author,
    CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END || '@example.org' AS email,
    '{FIXTURE_DATE}' AS date, doc_id % 11 = 0 AS is_merge,
    CAST({LOG_POS_BASE} - doc_id AS BIGINT) AS log_pos
  FROM (SELECT *, replace(text, {NL}, ' ') AS subj FROM documents)
),
users AS (
  SELECT * FROM (VALUES {", ".join(f"('{r}', '  {u}@Example.org ')" for r, u in FIXTURE_USERS)})
    AS t(repo, email)
)"""

from .fixtures import REQUEST_LANGUAGES, REQUEST_MODELS, REQUEST_PROMPT  # noqa: E402

REQUESTS_CTE = f"""
requests AS (
  SELECT repo, commit_id, commit_id AS seq,
    CASE WHEN commit_id % 5 <> 0 THEN 'regenerate' ELSE 'ready' END AS kind,
    CASE WHEN commit_id % 5 <> 0 THEN commit_id % 3 <> 0 END AS conventional,
    CASE WHEN commit_id % 5 <> 0 THEN {_in_list(REQUEST_LANGUAGES)}[1 + commit_id % 7] END AS language,
    CASE WHEN commit_id % 5 <> 0 AND commit_id % 4 <> 0
         THEN {_in_list(REQUEST_MODELS)}[1 + commit_id % 3] END AS model,
    CASE WHEN commit_id % 5 <> 0 AND commit_id % 6 = 1 THEN '{REQUEST_PROMPT}' END AS prompt
  FROM commits
),
option_updates AS (
  SELECT 'repo-' || CAST(n_nationkey % 10 AS VARCHAR) AS repo, CAST(n_nationkey AS BIGINT) AS seq,
    CASE WHEN n_nationkey % 3 <> 0 THEN n_regionkey % 2 = 0 END AS conventional,
    CASE n_nationkey % 4 WHEN 0 THEN 'zh' WHEN 2 THEN 'en' WHEN 3 THEN 'auto' END AS language
  FROM nation
)"""

# OP-18 in SQL: the detected language per user repo.
DETECT_CTE = """
scanned AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY repo ORDER BY log_pos, hash) AS rn
    FROM commit_log WHERE NOT is_merge) WHERE rn <= 50
),
mine AS (
  SELECT * FROM (
    SELECT s.*, row_number() OVER (PARTITION BY s.repo ORDER BY s.log_pos, s.hash) AS rn2
    FROM scanned s JOIN users u ON s.repo = u.repo AND lower(s.email) = lower(trim(u.email, """ + \
    WS_SET + """))) WHERE rn2 <= 20
),
stats AS (
  SELECT repo, count(*) AS subjects,
    sum(length(subject)) AS text_len,
    sum(length(regexp_replace(subject, '[\\x00-\\x7F]', '', 'g'))) AS non_ascii
  FROM mine GROUP BY repo
),
detected AS (
  SELECT u.repo, CAST(coalesce(s.subjects, 0) AS BIGINT) AS subjects,
    CAST(coalesce(s.text_len, 0) AS BIGINT) AS text_len,
    CAST(coalesce(s.non_ascii, 0) AS BIGINT) AS non_ascii,
    CASE WHEN coalesce(s.text_len, 0) > 0 AND coalesce(s.non_ascii, 0) * 5 > s.text_len
         THEN 'zh' ELSE 'en' END AS language
  FROM (SELECT DISTINCT repo FROM users) u LEFT JOIN stats s ON u.repo = s.repo
)"""

from .fixtures import MODEL_FAMILIES, MODEL_VENDORS  # noqa: E402

MODELS_CTE = f"""
models AS (
  SELECT CAST(n.n_regionkey AS INTEGER) AS catalog_id, 'model-' || CAST(s.s_suppkey AS VARCHAR) AS id,
    CASE WHEN s.s_suppkey % 5 = 0 THEN '' ELSE s.s_name END AS name,
    CASE WHEN n.n_regionkey = 2 THEN {_in_list(MODEL_VENDORS[1:])}[1 + s.s_suppkey % 2]
         ELSE {_in_list(MODEL_VENDORS)}[1 + s.s_suppkey % 3] END AS vendor,
    CASE WHEN n.n_regionkey = 1 THEN {_in_list(MODEL_FAMILIES[1:3])}[1 + s.s_suppkey % 2]
         ELSE {_in_list(MODEL_FAMILIES)}[1 + s.s_suppkey % 4] END AS family,
    CAST(s.s_suppkey AS INTEGER) AS cat_pos
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
)"""

RESPONSES_CTE = """
conv_t AS (
  SELECT CAST(conv_id * 10 + turn AS BIGINT) AS request_id,
    replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'),
            chr(10), ' ') AS t
  FROM conversations
),
responses AS (
  SELECT request_id, CASE request_id % 7
    WHEN 0 THEN '{"message": "  ' || t || '  ", "reason": "' || t || '"}'
    WHEN 1 THEN '```json' || chr(10) || '{"message": "' || t || '", "reason": "because"}' || chr(10) || '```'
    WHEN 2 THEN 'Here is the answer:' || chr(10) || '{"message": "' || t || '", "reason": "why"}' || chr(10) || 'Done.'
    WHEN 3 THEN '{"message": 42, "reason": "' || t || '"}'
    WHEN 4 THEN '{"message": "' || t || '"}'
    WHEN 5 THEN t
    ELSE '[{"message": "' || t || '", "reason": "r"}]' END AS raw
  FROM conv_t
),
array_responses AS (
  SELECT request_id, CAST(2 + request_id % 2 AS INTEGER) AS expected, CASE request_id % 5
    WHEN 0 THEN '[' || i1 || ', ' || i2 || ']'
    WHEN 1 THEN '```json' || chr(10) || '[' || i1 || ', ' || i2 || ', ' || i3 || ']' || chr(10) || '```'
    WHEN 2 THEN 'Result:' || chr(10) || '[' || i1 || ', ' || i2 || ']' || chr(10) || 'end'
    WHEN 3 THEN '[' || i1 || ', {"message": "x"}]'
    ELSE '[' || i1 || ', ' || i2 || ']' || '  trailing' END AS raw
  FROM (SELECT request_id, '{"message": "' || t || '", "reason": "r1"}' AS i1,
               '{"message": "' || t || '", "reason": "r2"}' AS i2,
               '{"message": "' || t || '", "reason": "r3"}' AS i3 FROM conv_t)
)"""


def strip_fences_sql(raw: str) -> str:
    """OP-26 in DuckDB (regexp_replace without 'g' replaces the first match)."""
    return (f"trim(regexp_replace(regexp_replace({raw}, '(?m)^```(?:json)?\\s*', ''), "
            f"'(?m)\\s*```\\s*$', ''), {WS_SET})")

CANDIDATE_EVENTS_CTE = """
candidate_events AS (
  SELECT user_id AS session, event_id AS seq,
    CASE event_type WHEN 'signup' THEN 'ADD_CANDIDATE' WHEN 'click' THEN 'TOGGLE_CANDIDATE'
      WHEN 'view' THEN 'UPDATE_CANDIDATE_MESSAGE'
      WHEN 'error' THEN CASE WHEN event_id % 4 = 0 THEN 'SET_LOADING' WHEN event_id % 4 = 1 THEN 'SET_MODELS'
                             WHEN event_id % 8 = 3 THEN 'SET_PROMPT' WHEN event_id % 8 = 7 THEN 'SET_COMMIT_HISTORY'
                             ELSE 'ERROR' END
      WHEN 'purchase' THEN ['COMMITTED', 'SET_STAGED_FILES', 'SET_SETTINGS', 'REORDER_CANDIDATES', 'UPDATE_SETTING',
                            'DONE'][1 + event_id % 6]
    END AS type,
    CASE WHEN event_type IN ('signup', 'click', 'view') THEN 'c' || CAST(event_id % 5 AS VARCHAR) END AS id,
    CASE WHEN event_type = 'signup' THEN 'add ' || CAST(event_id AS VARCHAR)
         WHEN event_type = 'view' THEN props
         WHEN event_type = 'error' AND event_id % 8 = 3 THEN 'prompt ' || CAST(event_id AS VARCHAR)
         WHEN event_type = 'error' AND event_id % 4 = 2 THEN
           CASE WHEN event_id % 8 = 2 THEN '' ELSE 'failed ' || CAST(event_id AS VARCHAR) END
    END AS message,
    CASE WHEN event_type = 'signup' THEN 'why ' || CAST(event_id AS VARCHAR) END AS reason,
    CASE WHEN event_type = 'signup' THEN
           ['src/c' || CAST(event_id % 5 AS VARCHAR) || '.ts',
            'tests/c' || CAST(event_id % 5 AS VARCHAR) || '_' || CAST(event_id AS VARCHAR) || '.ts']
         WHEN event_type = 'purchase' AND event_id % 6 = 1 THEN ['staged/' || CAST(event_id AS VARCHAR)] END AS files,
    CASE WHEN event_type = 'purchase' AND event_id % 6 = 0 THEN CAST(event_id % 3 + 1 AS INTEGER) END AS count,
    CASE WHEN event_type = 'purchase' AND event_id % 6 = 3 THEN
      [{'id': 'c' || CAST((event_id + 1) % 5 AS VARCHAR), 'message': 'r' || CAST(event_id AS VARCHAR),
        'reason': 'moved ' || CAST(event_id AS VARCHAR),
        'files': ['src/c' || CAST((event_id + 1) % 5 AS VARCHAR) || '.ts',
                  'tests/c' || CAST((event_id + 1) % 5 AS VARCHAR) || '_' || CAST(event_id AS VARCHAR) || '.ts'],
        'checked': true},
       {'id': 'c' || CAST((event_id + 2) % 5 AS VARCHAR), 'message': 'r' || CAST(event_id AS VARCHAR),
        'reason': 'moved ' || CAST(event_id AS VARCHAR),
        'files': ['src/c' || CAST((event_id + 2) % 5 AS VARCHAR) || '.ts',
                  'tests/c' || CAST((event_id + 2) % 5 AS VARCHAR) || '_' || CAST(event_id AS VARCHAR) || '.ts'],
        'checked': false}]
    END AS payload
  FROM events
),
edits AS (
  SELECT user_id AS session, 'c' || CAST(event_id % 5 AS VARCHAR) AS id, event_id AS seq,
    CASE WHEN event_id % 3 = 0 THEN '   ' ELSE '  edit ' || CAST(event_id AS VARCHAR) || ' ' END AS message
  FROM events WHERE event_type = 'view'
)"""

FOLD_CTE = """
status AS (
  SELECT session,
    coalesce(arg_max(type = 'SET_LOADING', seq) FILTER (WHERE type IN ('SET_LOADING', 'DONE', 'ERROR')), false)
      AS generating,
    arg_max_null(CASE WHEN type = 'ERROR' THEN message END, seq) FILTER (WHERE type IN ('SET_LOADING', 'ERROR'))
      AS error,
    arg_max_null(CASE WHEN type = 'COMMITTED' THEN count END, seq) FILTER (WHERE type IN ('SET_LOADING', 'COMMITTED'))
      AS success_count,
    max(CASE WHEN type = 'SET_STAGED_FILES' THEN true END) IS NULL AS staged_loading,
    max(seq) FILTER (WHERE type IN ('SET_LOADING', 'COMMITTED', 'REORDER_CANDIDATES')) AS base_seq
  FROM candidate_events GROUP BY session
),
ev AS (
  SELECT e.*, s.base_seq, e.seq > coalesce(s.base_seq, -1) AS after
  FROM candidate_events e JOIN status s ON e.session = s.session
),
entries AS (
  SELECT session, seq AS entry_seq, 0 AS sub_pos, id, message AS m0, true AS c0, 0 AS kind, reason, files
  FROM ev WHERE type = 'ADD_CANDIDATE' AND after
  UNION ALL
  SELECT session, seq AS entry_seq, CAST(generate_subscripts(payload, 1) - 1 AS INTEGER) AS sub_pos,
    unnest(payload).id AS id, unnest(payload).message AS m0, coalesce(unnest(payload).checked, false) AS c0,
    0 AS kind, unnest(payload).reason AS reason, unnest(payload).files AS files
  FROM ev WHERE type = 'REORDER_CANDIDATES' AND seq = base_seq
  UNION ALL
  SELECT session, seq AS entry_seq, 0 AS sub_pos, id,
    CASE WHEN type = 'UPDATE_CANDIDATE_MESSAGE' THEN message END AS m0, CAST(NULL AS BOOLEAN) AS c0,
    CASE WHEN type = 'TOGGLE_CANDIDATE' THEN 1 ELSE 2 END AS kind, NULL AS reason, NULL AS files
  FROM ev WHERE type IN ('TOGGLE_CANDIDATE', 'UPDATE_CANDIDATE_MESSAGE') AND after
),
folded AS (
  SELECT *,
    sum(CASE WHEN kind = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session, id)
    - sum(CASE WHEN kind = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session, id ORDER BY entry_seq, kind, sub_pos
                                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS toggles_after,
    last_value(CASE WHEN kind = 2 THEN m0 END IGNORE NULLS) OVER (
      PARTITION BY session, id ORDER BY entry_seq, kind, sub_pos
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS edit_after
  FROM entries
),
final_list AS (
  SELECT session, entry_seq, sub_pos, id, coalesce(edit_after, m0) AS message,
    c0 <> (toggles_after % 2 = 1) AS checked, reason, files,
    CAST(row_number() OVER (PARTITION BY session ORDER BY entry_seq, sub_pos) - 1 AS INTEGER) AS list_pos
  FROM folded WHERE kind = 0
)"""
