"""Registered queries: one Spark job per operator of the inventory, each
reading the driver tables (or corpora Spark derives from them), plus the
matching DuckDB oracle SQL used by the correctness check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keep_where
from .functions.js import is_blank
from .session import ensure_checkpoint_dir
from .operators import churn, diffs, paths
from .sources import fixture_sql as fx
from .sources.fixtures import load_commits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return deco


def _file_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    fc = diffs.split_file_changes(load_commits(spark, sf_dir))
    return churn.file_churn(paths.classify_paths(fc))


_CLASSIFY_ONLY = """
classified AS (""" + fx.classify_sql("path").replace("{src}", "file_changes") + """),
churned AS (
  SELECT *, """ + fx.count_lines_sql("diff", "+") + """ AS additions,
            """ + fx.count_lines_sql("diff", "-") + """ AS deletions
  FROM classified
)"""
_CLASSIFIED = fx.FILE_CHANGES_CTE + "," + _CLASSIFY_ONLY


# ---------------------------------------------------------------------------
# Step 1: files, additions and deletions per repo and group type (flagship)
# ---------------------------------------------------------------------------

@register("churn_by_group", f"""
WITH {_CLASSIFIED}
SELECT repo, group_type, CAST(count(*) AS BIGINT) AS files,
       CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions
FROM churned GROUP BY repo, group_type
""")
def churn_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-01, 04, 05, 13, 09, 10."""
    return churn.churn_totals(_file_churn(spark, sf_dir), ["repo", "group_type"])


@register("change_types", f"""
WITH {_CLASSIFIED}
SELECT change_type, CAST(count(*) AS BIGINT) AS files,
       CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions
FROM churned GROUP BY change_type
""")
def change_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-05 + OP-10 keyed by change type."""
    return churn.churn_totals(_file_churn(spark, sf_dir), ["change_type"])


# ---------------------------------------------------------------------------
# Step 2: lines, numbering, bars, groups, lookup, relative paths
# ---------------------------------------------------------------------------

def _file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.split_file_changes(load_commits(spark, sf_dir))


_LINES = fx.FILE_CHANGES_CTE + """,
raw_lines AS (
  SELECT repo, commit_id, file_seq, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS pos,
         unnest(ls) AS raw
  FROM (SELECT repo, commit_id, file_seq, string_split(diff, chr(10)) AS ls
        FROM file_changes WHERE length(diff) > 0)
),
kinds AS (
  SELECT *, CASE WHEN starts_with(raw, '@@') THEN 'hunk'
      WHEN starts_with(raw, 'diff ') OR starts_with(raw, 'index ') OR starts_with(raw, '--- ')
        OR starts_with(raw, '+++ ') OR starts_with(raw, 'new file') OR starts_with(raw, 'deleted file')
        OR starts_with(raw, 'similarity') OR starts_with(raw, 'rename') OR starts_with(raw, chr(92))
        THEN 'meta'
      WHEN starts_with(raw, '+') THEN 'add' WHEN starts_with(raw, '-') THEN 'del' ELSE 'ctx' END AS kind
  FROM raw_lines
),
diff_lines AS (
  SELECT repo, commit_id, file_seq, pos, kind,
    CASE kind WHEN 'add' THEN '+' WHEN 'del' THEN '-' WHEN 'ctx' THEN ' ' ELSE '' END AS sign,
    CASE WHEN kind IN ('add', 'del') OR (kind = 'ctx' AND starts_with(raw, ' ')) THEN substr(raw, 2)
         ELSE raw END AS text,
    raw
  FROM kinds
)"""


@register("line_kinds", f"""
WITH {_LINES}
SELECT kind, sign, CAST(count(*) AS BIGINT) AS lines,
       CAST(sum(length(text)) AS BIGINT) AS text_chars,
       CAST(count(*) FILTER (WHERE text = '') AS BIGINT) AS empty_lines
FROM diff_lines GROUP BY kind, sign
""")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-07: lines per kind; the empty piece after the final newline is ctx."""
    from .operators import lines
    dl = lines.explode_lines(_file_changes(spark, sf_dir))
    return (dl.groupBy("kind", "sign")
            .agg(F.count(F.lit(1)).alias("lines"),
                 F.sum(F.length("text")).cast("long").alias("text_chars"),
                 F.count(F.when(F.col("text") == "", 1)).alias("empty_lines")))


@register("line_numbers", f"""
WITH {_LINES},
marked AS (
  SELECT *,
    kind = 'hunk' AND regexp_matches(raw, '@@ -(\\d+)(?:,\\d+)? \\+(\\d+)(?:,\\d+)? @@') AS valid,
    CAST(kind IN ('ctx', 'del') AS BIGINT) AS adv_old,
    CAST(kind IN ('ctx', 'add') AS BIGINT) AS adv_new
  FROM diff_lines
),
hunked AS (
  SELECT *, sum(CAST(valid AS BIGINT)) OVER (PARTITION BY repo, commit_id, file_seq ORDER BY pos
                                             ROWS UNBOUNDED PRECEDING) AS hid
  FROM marked
),
bases AS (
  SELECT *,
    first_value(CASE WHEN valid THEN CAST(regexp_extract(raw, '@@ -(\\d+)(?:,\\d+)? \\+(\\d+)(?:,\\d+)? @@', 1) AS BIGINT) END)
      OVER (PARTITION BY repo, commit_id, file_seq, hid ORDER BY pos ROWS UNBOUNDED PRECEDING) AS a,
    first_value(CASE WHEN valid THEN CAST(regexp_extract(raw, '@@ -(\\d+)(?:,\\d+)? \\+(\\d+)(?:,\\d+)? @@', 2) AS BIGINT) END)
      OVER (PARTITION BY repo, commit_id, file_seq, hid ORDER BY pos ROWS UNBOUNDED PRECEDING) AS b,
    coalesce(sum(adv_old) OVER (PARTITION BY repo, commit_id, file_seq, hid ORDER BY pos
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_old,
    coalesce(sum(adv_new) OVER (PARTITION BY repo, commit_id, file_seq, hid ORDER BY pos
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_new
  FROM hunked
)
SELECT repo, commit_id, file_seq, pos, kind, sign, text,
  CASE WHEN kind IN ('ctx', 'del') THEN CAST(coalesce(a, 0) + before_old AS BIGINT) END AS old_n,
  CASE WHEN kind IN ('ctx', 'add') THEN CAST(coalesce(b, 0) + before_new AS BIGINT) END AS new_n
FROM bases
""")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-07 + OP-08: every diff line with its old/new number."""
    from .operators import lines
    return lines.number_lines(_file_changes(spark, sf_dir)).select("repo", "commit_id", "file_seq", "pos", "kind", "sign",
                                         "text", "old_n", "new_n")


@register("churn_bars", f"""
WITH {_CLASSIFIED},
ratios AS (
  SELECT *, CASE WHEN additions + deletions > 0 THEN additions / (additions + deletions) ELSE 0.0 END
            AS add_ratio FROM churned
)
SELECT repo, commit_id, file_seq, path,
  CASE change_type WHEN 'added' THEN 'A' WHEN 'deleted' THEN 'D' WHEN 'renamed' THEN 'R' ELSE 'M' END
    AS status,
  additions, deletions, add_ratio, CAST(floor(add_ratio * 10 + 0.5) AS INTEGER) AS filled,
  CASE WHEN additions + deletions > 0
       THEN repeat('+', CAST(floor(add_ratio * 10 + 0.5) AS INTEGER))
            || repeat('-', 10 - CAST(floor(add_ratio * 10 + 0.5) AS INTEGER))
       ELSE repeat('.', 10) END AS bar
FROM ratios
""")
def churn_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-09, 11, 12: per-file counts, add ratio, 10-segment bar, status letter."""
    df = churn.churn_bars(churn.file_churn(_file_changes(spark, sf_dir)))
    return df.select("repo", "commit_id", "file_seq", "path",
                     churn.status_letter("change_type").alias("status"),
                     "additions", "deletions", "add_ratio", "filled", "bar")


@register("file_groups", f"""
WITH {_CLASSIFIED},
g AS (
  SELECT repo, commit_id, group_key, group_type, label, min(file_seq) AS first_seq,
         CAST(count(*) AS INTEGER) AS n_files,
         string_agg(path || ' (' || change_type || ')', chr(10) ORDER BY file_seq) AS file_list
  FROM classified GROUP BY repo, commit_id, group_key, group_type, label
)
SELECT repo, commit_id,
  CAST(row_number() OVER (PARTITION BY repo, commit_id ORDER BY first_seq) - 1 AS INTEGER) AS group_ord,
  group_key, group_type, label, n_files, file_list
FROM g
""")
def file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-13 + OP-14: groups per snapshot in first-seen order, files in input order."""
    return _shown_groups(paths.group_files_in_row(diffs.parse_files(load_commits(spark, sf_dir))))


def _shown_groups(grouped: DataFrame) -> DataFrame:
    return grouped.select(
        "repo", "commit_id", "group_ord", "group_key", "group_type", "label",
        F.size("files").alias("n_files"),
        F.array_join(F.transform("files", lambda f: F.concat(f["path"], F.lit(" ("),
                                                               f["change_type"], F.lit(")"))), "\n")
        .alias("file_list"))


@register("diff_lookup", f"""
WITH {fx.FILE_CHANGES_CTE},
wanted AS (
  SELECT DISTINCT repo, path FROM file_changes
  UNION ALL SELECT DISTINCT repo, 'no/such/file.txt' FROM file_changes
),
hits AS (SELECT f.* FROM file_changes f SEMI JOIN wanted w ON f.repo = w.repo AND f.path = w.path)
SELECT repo, path, arg_max(commit_id, (commit_id, file_seq)) AS commit_id,
       arg_max(file_seq, (commit_id, file_seq)) AS file_seq,
       md5(arg_max(diff, (commit_id, file_seq))) AS diff_md5
FROM hits GROUP BY repo, path
""")
def diff_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-06: latest diff of every path of a repo (plus a path that does not
    exist, which yields no row); duplicates resolve to the last one."""
    fc = _file_changes(spark, sf_dir)
    wanted = (fc.select("repo", "path").distinct()
              .unionByName(fc.select("repo", F.lit("no/such/file.txt").alias("path")).distinct()))
    out = diffs.lookup_diffs(fc, wanted, keys=("repo", "path"), order=("commit_id", "file_seq"))
    return out.select("repo", "path", "commit_id", "file_seq", F.md5("diff").alias("diff_md5"))


@register("relativized", f"""
WITH {fx.FILE_CHANGES_CTE},
abs AS (
  SELECT repo, commit_id, file_seq, '/home/dev/' || repo AS root,
    CASE file_seq % 3 WHEN 0 THEN '/home/dev/' || repo || '/' || path
                      WHEN 1 THEN '/mnt/home/dev/' || repo || '/' || path
                      ELSE replace('/home/dev/' || repo || '/' || path, '/', chr(92)) END AS abs_path
  FROM file_changes
)
SELECT repo, commit_id, file_seq, abs_path,
  replace(CASE WHEN strpos(abs_path, root || '/') > 0
               THEN substr(abs_path, 1, strpos(abs_path, root || '/') - 1)
                    || substr(abs_path, strpos(abs_path, root || '/') + length(root) + 1)
               ELSE abs_path END, chr(92), '/') AS rel_path
FROM abs
""")
def relativized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-15: first occurrence of root + '/' removed, backslashes to slashes."""
    fc = _file_changes(spark, sf_dir)
    root = F.concat(F.lit("/home/dev/"), F.col("repo"))
    full = F.concat(root, F.lit("/"), F.col("path"))
    abs_path = (F.when(F.col("file_seq") % 3 == 0, full)
                .when(F.col("file_seq") % 3 == 1, F.concat(F.lit("/mnt"), full))
                .otherwise(F.replace(full, F.lit("/"), F.lit("\\"))))
    df = fc.select("repo", "commit_id", "file_seq", root.alias("root"), abs_path.alias("abs_path"))
    return paths.relativize(df, "abs_path", "root").drop("root")


# ---------------------------------------------------------------------------
# Step 3: logs, history, language, options
# ---------------------------------------------------------------------------

from .operators import history, settings  # noqa: E402
from .sources import readers  # noqa: E402
from .sources.fixtures import (load_commit_log, option_updates_from_nation,  # noqa: E402
                               requests_from_commits, table, users_table)


@register("log_records", f"""
WITH {fx.LOG_CTE},
lines AS (
  SELECT repo, log_pos,
    CASE WHEN starts_with(hash, '0') THEN hash || chr(31) || subject || chr(31) || author
         ELSE hash || chr(31) || subject || chr(31) || author || chr(31) || date || chr(31) || 'extra'
    END AS line
  FROM commit_log
),
f AS (SELECT *, string_split(line, chr(31)) AS parts FROM lines)
SELECT repo, log_pos, CASE WHEN len(parts) >= 4 THEN 'ok' ELSE 'rejected' END AS status,
  CASE WHEN len(parts) >= 4 THEN parts[1] END AS hash,
  CASE WHEN len(parts) >= 4 THEN parts[2] END AS subject,
  CASE WHEN len(parts) >= 4 THEN parts[3] END AS author,
  CASE WHEN len(parts) >= 4 THEN parts[4] END AS date
FROM f
""")
def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-02 record layout: fields 1-4 used, short records quarantined."""
    log = load_commit_log(spark, sf_dir)
    full = F.concat_ws(readers.RECORD_SEP, "hash", "subject", "author", "date", F.lit("extra"))
    short = F.concat_ws(readers.RECORD_SEP, "hash", "subject", "author")
    lines = log.select("repo", "log_pos",
                       F.when(F.col("hash").startswith("0"), short).otherwise(full).alias("line"))
    return readers.log_records(lines).select("repo", "log_pos", "status", "hash", "subject", "author", "date")


@register("log_author_subject", f"""
WITH {fx.LOG_CTE},
lines AS (
  SELECT repo, log_pos,
    CASE WHEN log_pos % 9 = 0 THEN email || ' ' || subject
         ELSE email || chr(9) || subject || CASE WHEN log_pos % 2 = 0 THEN chr(9) || 'tail' ELSE '' END
    END AS line
  FROM commit_log
)
SELECT repo, log_pos, substr(line, 1, strpos(line, chr(9)) - 1) AS email,
       substr(line, strpos(line, chr(9)) + 1) AS subject
FROM lines WHERE strpos(line, chr(9)) > 0
""")
def log_author_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-02 tab layout: split at the first tab; no tab, no row."""
    log = load_commit_log(spark, sf_dir)
    line = (F.when(F.col("log_pos") % 9 == 0, F.concat_ws(" ", "email", "subject"))
            .otherwise(F.concat(F.col("email"), F.lit("\t"), F.col("subject"),
                                F.when(F.col("log_pos") % 2 == 0, F.lit("\ttail")).otherwise(F.lit("")))))
    return readers.parse_author_subject(log.select("repo", "log_pos", line.alias("line")))


@register("recent_commits", f"""
WITH {fx.LOG_CTE}
SELECT repo, log_pos, substr(hash, 1, 8) AS short_hash, subject AS message, author,
       substr(date, 1, 16) AS short_date
FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY log_pos, hash) AS rn
      FROM commit_log WHERE NOT is_merge)
WHERE rn <= 20
""")
def recent_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-16 + OP-17: newest 20 non-merge entries per repo, display form."""
    return history.recent_commits(load_commit_log(spark, sf_dir))


@register("history_counts", f"""
WITH {fx.LOG_CTE}
SELECT repo, count(*) AS history_entries
FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY log_pos, hash) AS rn
      FROM commit_log WHERE NOT is_merge)
WHERE rn <= 20 GROUP BY repo
""")
def history_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-37 (history): entries in each repo's recent-history list."""
    return history.history_counts(history.recent_commits(load_commit_log(spark, sf_dir)))


@register("author_language", f"""
WITH {fx.LOG_CTE}, {fx.DETECT_CTE}
SELECT repo, subjects, text_len, non_ascii, language FROM detected
""")
def author_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-18: zh / en per repo from the current user's recent subjects."""
    return history.detect_language(load_commit_log(spark, sf_dir), users_table(spark))


_RESOLVED_CTE = f"""{fx.COMMITS_CTE}, {fx.LOG_CTE}, {fx.DETECT_CTE}, {fx.REQUESTS_CTE},
stored AS (
  SELECT repo,
    arg_max(conventional, seq) FILTER (WHERE conventional IS NOT NULL) AS stored_conventional,
    arg_max(language, seq) FILTER (WHERE language IS NOT NULL) AS stored_language
  FROM option_updates GROUP BY repo
),
sess AS (
  SELECT *, nullif(last_value(CASE WHEN kind = 'regenerate' AND (language IS NULL OR language <> 'auto')
                                   THEN coalesce(language, '') END IGNORE NULLS)
              OVER (PARTITION BY repo ORDER BY seq ROWS UNBOUNDED PRECEDING), '') AS session_language
  FROM requests
),
eff AS (
  SELECT q.repo, q.commit_id, q.seq, q.kind,
    CASE WHEN q.kind = 'regenerate' THEN q.conventional ELSE coalesce(s.stored_conventional, true) END
      AS conventional,
    CASE WHEN q.kind = 'regenerate' THEN q.language
         ELSE coalesce(q.session_language, s.stored_language, 'en') END AS language,
    CASE WHEN q.kind = 'regenerate' THEN q.model END AS model,
    CASE WHEN q.kind = 'regenerate' THEN q.prompt END AS prompt,
    q.session_language
  FROM sess q LEFT JOIN stored s ON q.repo = s.repo
),
resolved AS (
SELECT e.*, CASE WHEN e.language = 'auto' THEN coalesce(d.language, 'en') ELSE e.language END
              AS resolved_language,
  CASE WHEN (CASE WHEN e.language = 'auto' THEN coalesce(d.language, 'en') ELSE e.language END) = 'zh'
       THEN 'zh' ELSE 'en' END AS prompt_language
FROM eff e LEFT JOIN detected d ON e.repo = d.repo
)"""


@register("resolved_settings", f"""
WITH {_RESOLVED_CTE}
SELECT * FROM resolved
""")
def resolved_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-19 + OP-20: effective options of every request, ``auto`` resolved."""
    commits = load_commits(spark, sf_dir)
    reqs = requests_from_commits(commits)
    stored = settings.stored_settings(option_updates_from_nation(table(spark, sf_dir, "nation")))
    eff = settings.resolve_settings(reqs, stored)
    detected = history.detect_language(load_commit_log(spark, sf_dir), users_table(spark))
    out = history.resolve_language(eff, detected)
    return out.select("repo", "commit_id", "seq", "kind", "conventional", "language", "model", "prompt",
                      "session_language", "resolved_language", "prompt_language")


# ---------------------------------------------------------------------------
# Step 4: prompts and model choice
# ---------------------------------------------------------------------------

from .operators import inference, prompts  # noqa: E402
from .sources.fixtures import models_from_suppliers  # noqa: E402


def _with_prompt_context(snapshots: DataFrame, spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    """Snapshots with their resolved options (a few short columns per
    snapshot) and, last, their repository's history: one row per repository,
    never a copy per request."""
    options = resolved_settings(spark, sf_dir).select(
        "repo", "commit_id", "conventional", "prompt_language", "prompt", "model")
    hist = prompts.history_text(load_commit_log(spark, sf_dir))
    return snapshots.join(options, ["repo", "commit_id"], how).join(hist, "repo", "left")


def _snapshot_groups(commits: DataFrame) -> DataFrame:
    """(repo, commit_id, groups) for every snapshot with at least one group."""
    grouped = paths.with_groups(diffs.parse_files(commits))
    return keep_where(grouped, F.size("groups") > 0)


def _q(s: str) -> str:
    return fx.sql_str(s)


def _rules_sql(n: str | None) -> str:
    style = (f"CASE WHEN conventional THEN {_q(prompts.STYLE_CONVENTIONAL)} "
             f"ELSE {_q(prompts.STYLE_PLAIN)} END")
    lang = f"CASE WHEN prompt_language = 'zh' THEN {_q(prompts.LANG_ZH)} ELSE {_q(prompts.LANG_EN)} END"
    items = [style, lang, _q(prompts.LENGTH_RULE), _q(prompts.REASON_RULE),
             _q(prompts.JSON_ALL if n else prompts.JSON_ONE)]
    if n:
        items.append(f"'The array holds exactly ' || CAST({n} AS VARCHAR) || "
                     f"' item(s): one per group, in the order the groups appear.'")
    items.append(_q(prompts.HISTORY_RULE))
    return " || chr(10) || ".join(f"'{i}. ' || {x}" for i, x in enumerate(items, start=1))


def _head_sql(task: str, n: str | None) -> str:
    return (f"{_q(prompts.ROLE + chr(10) + task + chr(10) + chr(10) + 'Rules:' + chr(10))} || "
            f"{_rules_sql(n)} || CASE WHEN length(coalesce(history, '')) > 0 "
            f"THEN {_q(chr(10) + chr(10) + prompts.HISTORY_HEAD + chr(10))} || history ELSE '' END")


_TAIL_SQL = (f"CASE WHEN length(coalesce(prompt, '')) > 0 THEN "
             f"{_q(chr(10) + chr(10) + prompts.USER_HEAD + chr(10))} || prompt ELSE '' END")

_PROMPT_CTE = f"""{_RESOLVED_CTE},
{fx.FILE_PARSE_CTE.strip()},
{_CLASSIFY_ONLY.strip()},
grp AS (
  SELECT repo, commit_id, group_key, label, min(file_seq) AS first_seq,
    string_agg('* ' || change_type || ': ' || path, chr(10) ORDER BY file_seq) AS file_list,
    string_agg(diff, chr(10) ORDER BY file_seq) AS diffs
  FROM classified GROUP BY repo, commit_id, group_key, label
),
sections AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY repo, commit_id ORDER BY first_seq) - 1 AS INTEGER)
              AS group_ord,
    '{prompts.PART}' || label || chr(10) || '{prompts.PATHS}' || chr(10) || file_list || chr(10) || chr(10) ||
    '{prompts.PATCH}' || chr(10) || '{prompts.FENCE}' || chr(10) || diffs || chr(10) || '{prompts.FENCE}' AS section
  FROM grp
),
hist AS (
  SELECT repo, string_agg('  - ' || subject, chr(10) ORDER BY log_pos) AS history
  FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY log_pos, hash) AS rn
        FROM commit_log WHERE NOT is_merge) WHERE rn <= 20
  GROUP BY repo
),
ctx AS (
  SELECT r.repo, r.commit_id, r.conventional, r.prompt_language, r.prompt, r.model, h.history
  FROM resolved r LEFT JOIN hist h ON r.repo = h.repo
)"""


@register("group_prompts", f"""
WITH {_PROMPT_CTE},
p AS (
  SELECT s.repo, s.commit_id, s.group_ord,
    {_head_sql(prompts.TASK_ONE, None)} || chr(10) || chr(10) || s.section || chr(10) || chr(10) ||
    {_q(prompts.SHAPE_ONE)} || {_TAIL_SQL} AS prompt_text
  FROM sections s JOIN ctx c ON s.repo = c.repo AND s.commit_id = c.commit_id
)
SELECT repo, commit_id, group_ord, CAST(length(prompt_text) AS INTEGER) AS prompt_chars,
       md5(prompt_text) AS prompt_md5
FROM p
""")
def group_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-21: one prompt per file group (md5 and length reported)."""
    # join the context once per snapshot, then explode the groups
    snap = _with_prompt_context(_snapshot_groups(load_commits(spark, sf_dir)), spark, sf_dir)
    ctx_cols = ["conventional", "prompt_language", "prompt", "history"]
    rows = (snap.select("repo", "commit_id", *ctx_cols, F.explode_outer("groups").alias("g"))
            .filter("g IS NOT NULL")
            .select("repo", "commit_id", *ctx_cols, "g.group_ord", "g.label", "g.files"))
    out = prompts.group_prompts(rows)
    return out.select("repo", "commit_id", "group_ord",
                      F.length("prompt_text").alias("prompt_chars"), F.md5("prompt_text").alias("prompt_md5"))


_BATCH_SQL = f"""
batch AS (
  SELECT s.repo, s.commit_id, CAST(count(*) AS INTEGER) AS n_groups,
    string_agg(chr(10) || chr(10) || '---' || chr(10) || s.section, '' ORDER BY s.group_ord) AS body,
    any_value(c.conventional) AS conventional, any_value(c.prompt_language) AS prompt_language,
    any_value(c.prompt) AS prompt, any_value(c.history) AS history, any_value(c.model) AS model
  FROM sections s JOIN ctx c ON s.repo = c.repo AND s.commit_id = c.commit_id
  GROUP BY s.repo, s.commit_id
),
batch_prompts AS (
  SELECT repo, commit_id, n_groups, model,
    {_head_sql(prompts.TASK_ALL, "n_groups")} || body ||
    {_q(chr(10) + chr(10) + prompts.SHAPE_ALL[0])} || CAST(n_groups AS VARCHAR) || {_q(prompts.SHAPE_ALL[1])} ||
    {_TAIL_SQL} AS prompt_text
  FROM batch
)"""


@register("batch_prompts", f"""
WITH {_PROMPT_CTE}, {_BATCH_SQL}
SELECT repo, commit_id, n_groups, CAST(length(prompt_text) AS INTEGER) AS prompt_chars,
       md5(prompt_text) AS prompt_md5
FROM batch_prompts
""")
def batch_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-22: one prompt per snapshot for all its groups."""
    out = _batch_prompt_rows(spark, sf_dir, load_commits(spark, sf_dir))
    return out.select("repo", "commit_id", "n_groups", F.length("prompt_text").alias("prompt_chars"),
                      F.md5("prompt_text").alias("prompt_md5"))


def _batch_prompt_rows(spark: SparkSession, sf_dir: str, commits: DataFrame) -> DataFrame:
    snap = _with_prompt_context(_snapshot_groups(commits), spark, sf_dir)
    return prompts.batch_prompts(snap).withColumn("n_groups", F.size("groups"))


@register("model_choice", f"""
WITH {_RESOLVED_CTE}, {fx.MODELS_CTE},
req AS (SELECT repo, commit_id, CAST(commit_id % 6 AS INTEGER) AS catalog_id, model FROM resolved),
by_id AS (SELECT catalog_id, id, arg_min(name, cat_pos) AS name FROM models GROUP BY catalog_id, id),
fb AS (
  SELECT catalog_id,
    arg_min(id, cat_pos) FILTER (WHERE vendor = 'copilot' AND family = 'gpt-4o') AS t2_id,
    arg_min(name, cat_pos) FILTER (WHERE vendor = 'copilot' AND family = 'gpt-4o') AS t2_name,
    arg_min(id, cat_pos) FILTER (WHERE vendor = 'copilot') AS t3_id,
    arg_min(name, cat_pos) FILTER (WHERE vendor = 'copilot') AS t3_name,
    arg_min(id, cat_pos) AS t4_id, arg_min(name, cat_pos) AS t4_name
  FROM models GROUP BY catalog_id
),
j AS (
  SELECT r.*, b.id AS t1_id, b.name AS t1_name, f.t2_id, f.t2_name, f.t3_id, f.t3_name, f.t4_id, f.t4_name
  FROM req r
  LEFT JOIN by_id b ON r.catalog_id = b.catalog_id AND nullif(r.model, '') = b.id
  LEFT JOIN fb f ON r.catalog_id = f.catalog_id
)
SELECT repo, commit_id, catalog_id, model AS requested,
  coalesce(t1_id, t2_id, t3_id, t4_id) AS model_id,
  coalesce(nullif(CASE WHEN t1_id IS NOT NULL THEN t1_name WHEN t2_id IS NOT NULL THEN t2_name
                       WHEN t3_id IS NOT NULL THEN t3_name ELSE t4_name END, ''),
           coalesce(t1_id, t2_id, t3_id, t4_id)) AS model_name,
  CASE WHEN t1_id IS NOT NULL THEN 1 WHEN t2_id IS NOT NULL THEN 2 WHEN t3_id IS NOT NULL THEN 3
       WHEN t4_id IS NOT NULL THEN 4 END AS tier,
  CASE WHEN coalesce(t1_id, t2_id, t3_id, t4_id) IS NULL THEN 'no language model available' END AS error
FROM j
""")
def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-23: tiered model choice per request; catalogue = commit_id % 6
    (catalogue 5 has no model)."""
    req = resolved_settings(spark, sf_dir).select(
        "repo", "commit_id", (F.col("commit_id") % 6).cast("int").alias("catalog_id"), "model")
    models = models_from_suppliers(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"))
    out = inference.assign_model(req, models)
    return out.select("repo", "commit_id", "catalog_id", F.col("model").alias("requested"), "model_id",
                      "model_name", "tier", "error")


# ---------------------------------------------------------------------------
# Step 5: answers -> parsed -> candidates
# ---------------------------------------------------------------------------

from .operators import responses  # noqa: E402
from .sources.fixtures import (array_responses_from_conversations, chunks_from_responses,  # noqa: E402
                               REFUSAL, echo_model, responses_from_conversations)


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses_from_conversations(table(spark, sf_dir, "conversations"))


@register("assembled", f"""
WITH {fx.RESPONSES_CTE}
SELECT request_id, md5(raw) AS raw_md5,
       CAST(len(regexp_extract_all(raw, '(?s).{{1,7}}')) AS BIGINT) AS chunks, true AS complete
FROM responses
""")
def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-25: chunks (7 characters, any arrival order) reassembled by idx."""
    chunks = chunks_from_responses(_responses(spark, sf_dir))
    out = responses.assemble_chunks(chunks)
    return out.select("request_id", F.md5("raw").alias("raw_md5"), "chunks", "complete")


@register("fence_stripped", f"""
WITH {fx.RESPONSES_CTE}
SELECT request_id, {fx.strip_fences_sql("raw")} AS cleaned FROM responses
""")
def fence_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-26: first opening and first closing fence removed, then trimmed."""
    return _responses(spark, sf_dir).select("request_id", responses.strip_fences("raw").alias("cleaned"))


_OBJ_SQL = f"""
cleaned AS (SELECT request_id, raw, {fx.strip_fences_sql("raw")} AS c FROM responses),
cand AS (
  SELECT request_id, raw,
    CASE WHEN json_valid(c) THEN c END AS direct,
    CASE WHEN json_valid(regexp_extract(c, '(?s)\\{{.*\\}}')) THEN regexp_extract(c, '(?s)\\{{.*\\}}') END AS extracted
  FROM cleaned
),
checked AS (
  SELECT *,
    coalesce(json_type(direct) = 'OBJECT' AND json_type(direct, '$.message') = 'VARCHAR'
             AND json_type(direct, '$.reason') = 'VARCHAR', false) AS direct_ok,
    coalesce(json_type(extracted) = 'OBJECT' AND json_type(extracted, '$.message') = 'VARCHAR'
             AND json_type(extracted, '$.reason') = 'VARCHAR', false) AS extracted_ok
  FROM cand
),
parsed AS (
  SELECT request_id,
    CASE WHEN direct_ok THEN json_extract_string(direct, '$.message')
         WHEN extracted_ok THEN json_extract_string(extracted, '$.message') END AS message,
    CASE WHEN direct_ok THEN json_extract_string(direct, '$.reason')
         WHEN extracted_ok THEN json_extract_string(extracted, '$.reason') END AS reason,
    CASE WHEN NOT direct_ok AND NOT extracted_ok THEN 'unparsable response: ' || left(raw, 300) END AS error
  FROM checked
)"""


@register("parsed", f"""
WITH {fx.RESPONSES_CTE}, {_OBJ_SQL}
SELECT request_id, message, reason, error FROM parsed
""")
def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-26 + OP-27 (object): strict parse, then greedy {{...}} extraction."""
    return responses.parse_object(_responses(spark, sf_dir)).select("request_id", "message", "reason",
                                                                    "error")


@register("dead_letters", f"""
WITH {fx.RESPONSES_CTE}, {_OBJ_SQL}
SELECT request_id, error FROM parsed WHERE error IS NOT NULL AND request_id % 11 <> 3
""")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-28: failed answers with the first 300 characters of the raw text;
    requests that were cancelled are no errors."""
    rows = _responses(spark, sf_dir)
    cancelled = rows.select("request_id").filter(F.col("request_id") % 11 == 3)
    return responses.response_errors(responses.parse_object(rows), ["request_id"], cancelled)


@register("parsed_arrays", f"""
WITH {fx.RESPONSES_CTE},
cleaned AS (SELECT request_id, expected, raw, {fx.strip_fences_sql("raw")} AS c FROM array_responses),
cand AS (
  SELECT request_id, expected, raw,
    CASE WHEN json_valid(c) THEN c END AS direct,
    CASE WHEN json_valid(regexp_extract(c, '(?s)\\[.*\\]')) THEN regexp_extract(c, '(?s)\\[.*\\]') END
      AS extracted
  FROM cleaned
),
checked AS (
  SELECT *,
    coalesce(json_type(direct) = 'ARRAY' AND json_array_length(direct) = expected AND
      list_bool_and(list_transform(CAST(json_extract(direct, '$[*]') AS VARCHAR[]),
        lambda e: json_type(e) = 'OBJECT' AND coalesce(json_type(e, '$.message') = 'VARCHAR', false)
                  AND coalesce(json_type(e, '$.reason') = 'VARCHAR', false))), false) AS direct_ok,
    coalesce(json_type(extracted) = 'ARRAY' AND json_array_length(extracted) = expected AND
      list_bool_and(list_transform(CAST(json_extract(extracted, '$[*]') AS VARCHAR[]),
        lambda e: json_type(e) = 'OBJECT' AND coalesce(json_type(e, '$.message') = 'VARCHAR', false)
                  AND coalesce(json_type(e, '$.reason') = 'VARCHAR', false))), false) AS extracted_ok
  FROM cand
),
chosen AS (
  SELECT request_id, expected, raw,
    CASE WHEN direct_ok THEN direct WHEN extracted_ok THEN extracted END AS j
  FROM checked
)
SELECT request_id, expected,
  CAST(CASE WHEN j IS NOT NULL THEN json_array_length(j) END AS INTEGER) AS n_items,
  array_to_string(list_transform(CAST(json_extract(j, '$[*]') AS VARCHAR[]),
                                 lambda e: json_extract_string(e, '$.message')), chr(10)) AS messages,
  array_to_string(list_transform(CAST(json_extract(j, '$[*]') AS VARCHAR[]),
                                 lambda e: json_extract_string(e, '$.reason')), chr(10)) AS reasons,
  CASE WHEN j IS NULL THEN 'unparsable response (expected array of ' || CAST(expected AS VARCHAR)
                           || '): ' || left(raw, 300) END AS error
FROM chosen
""")
def parsed_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-27 (array): exact element count, every element an object with two strings."""
    df = array_responses_from_conversations(table(spark, sf_dir, "conversations"))
    out = responses.parse_array(df, "expected")
    return out.select("request_id", "expected", F.size("items").alias("n_items"),
                      F.array_join(F.transform("items", lambda i: i["message"]), "\n").alias("messages"),
                      F.array_join(F.transform("items", lambda i: i["reason"]), "\n").alias("reasons"),
                      "error")


def _answers(spark: SparkSession, sf_dir: str, commits: DataFrame) -> DataFrame:
    """Batch prompts answered by the deterministic stand-in model; each row
    keeps its snapshot's file lists so candidates need no join."""
    snap = _batch_prompt_rows(spark, sf_dir, commits).select(
        "repo", "commit_id", "n_groups", "prompt_text",
        F.transform("groups", lambda g: F.transform(g["files"], lambda f: f["path"])).alias("group_files"))
    return inference.infer(snap, echo_model, keys=["repo", "commit_id", "n_groups", "group_files"])


_ECHO_SQL = f"""
echo_items AS (
  SELECT s.repo, s.commit_id, s.group_ord, s.label, b.n_groups, length(b.prompt_text) % 4 AS variant,
    length(b.prompt_text) % 13 = 5 AS refused,
    '{{"message": "chore(' || trim(s.label) || '): update ' || trim(s.label) ||
    ' ", "reason": " Keeps the files of this group together."}}' AS item
  FROM sections s JOIN batch_prompts b ON s.repo = b.repo AND s.commit_id = b.commit_id
),
echo_raw AS (
  SELECT repo, commit_id, any_value(variant) AS variant, any_value(refused) AS refused,
    '[' || coalesce(string_agg(item, ', ' ORDER BY group_ord)
                    FILTER (WHERE variant <> 3 OR group_ord < n_groups - 1), '') || ']' AS body
  FROM echo_items GROUP BY repo, commit_id
),
answers AS (
  SELECT repo, commit_id, variant, refused,
    CASE WHEN refused THEN NULL
         WHEN variant = 1 THEN '```json' || chr(10) || body || chr(10) || '```'
         WHEN variant = 2 THEN 'Here you go:' || chr(10) || body || chr(10) || 'Hope this helps.'
         ELSE body END AS raw,
    CASE WHEN refused THEN 'ValueError: {REFUSAL}' END AS infer_error
  FROM echo_raw
)"""


@register("inference", f"""
WITH {_PROMPT_CTE}, {_BATCH_SQL}, {_ECHO_SQL}
SELECT repo, commit_id, md5(raw) AS raw_md5, infer_error FROM answers
""")
def inference_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-24: every batch prompt through the caller's function (mapInArrow)."""
    return _answers(spark, sf_dir, load_commits(spark, sf_dir)).select("repo", "commit_id", F.md5("raw").alias("raw_md5"), "infer_error")


_CANDS_SQL = f"""{_PROMPT_CTE}, {_BATCH_SQL}, {_ECHO_SQL},
files AS (
  SELECT repo, commit_id, group_key, string_agg(path, ',' ORDER BY file_seq) AS files
  FROM classified GROUP BY repo, commit_id, group_key
),
cands AS (
SELECT e.repo, e.commit_id, e.group_ord,
  sha256(e.repo || '|' || CAST(e.commit_id AS VARCHAR) || '|' || CAST(e.group_ord AS VARCHAR)) AS candidate_id,
  'chore(' || trim(e.label) || '): update ' || trim(e.label) AS message,
  'Keeps the files of this group together.' AS reason, f.files, true AS checked
FROM echo_items e
JOIN sections s ON e.repo = s.repo AND e.commit_id = s.commit_id AND e.group_ord = s.group_ord
JOIN files f ON f.repo = s.repo AND f.commit_id = s.commit_id AND f.group_key = s.group_key
WHERE e.variant <> 3 AND NOT e.refused
)"""


@register("candidates", f"""
WITH {_CANDS_SQL}
SELECT * FROM cands
""")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-24 + OP-27 + OP-29: answers parsed as arrays of exactly n_groups
    items and zipped with the groups; failed snapshots yield no candidates."""
    return _candidates(spark, sf_dir, load_commits(spark, sf_dir))


def _candidates(spark: SparkSession, sf_dir: str, commits: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(spark)
    answers = _answers(spark, sf_dir, commits).checkpoint()  # the model's workers end before the validator's start
    parsed_rows = responses.parse_array(answers, "n_groups")
    cands = responses.build_candidates_in_row(parsed_rows, ["repo", "commit_id"])
    return cands.select("repo", "commit_id", "group_ord", "candidate_id", "message", "reason",
                        F.array_join("files", ",").alias("files"), "checked")


# ---------------------------------------------------------------------------
# Step 6: candidate state, generations, reorder, edits, selection, plan
# ---------------------------------------------------------------------------

from .operators import candidates as cstate  # noqa: E402
from .sources.fixtures import candidate_events_from_events, edits_from_events  # noqa: E402


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_events_from_events(table(spark, sf_dir, "events"))


@register("state", f"""
WITH {fx.CANDIDATE_EVENTS_CTE}, {fx.FOLD_CTE}
SELECT s.session, s.generating, s.error, s.success_count, s.staged_loading,
  CAST(count(f.session) AS BIGINT) AS n_candidates,
  CAST(coalesce(count_if(f.checked), 0) AS BIGINT) AS n_checked
FROM status s LEFT JOIN final_list f ON s.session = f.session
GROUP BY s.session, s.generating, s.error, s.success_count, s.staged_loading
""")
def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-30 + OP-37: folded scalar state and candidate counts per session."""
    ev = _events(spark, sf_dir)
    status = cstate.session_status(ev)
    counts = (cstate.fold_candidates(ev, status).groupBy("session")
              .agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if("checked").alias("n_checked")))
    return (status.join(counts, "session", "left")
            .select("session", "generating", "error", "success_count", "staged_loading",
                    F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
                    F.coalesce("n_checked", F.lit(0)).alias("n_checked")))


@register("state_candidates", f"""
WITH {fx.CANDIDATE_EVENTS_CTE}, {fx.FOLD_CTE}
SELECT session, list_pos, id, message, reason, array_to_string(files, ',') AS files, checked FROM final_list
""")
def state_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-30: the folded candidate list of every session."""
    entries = cstate.fold_candidates(_events(spark, sf_dir))
    return _shown(cstate.list_positions(entries))


def _shown(lists: DataFrame) -> DataFrame:
    return lists.select("session", "list_pos", "id", "message", "reason", F.array_join("files", ",").alias("files"),
                        "checked")


@register("panel_state", f"""
WITH {fx.CANDIDATE_EVENTS_CTE},
sets AS (
  SELECT user_id AS session, event_id AS seq, event_id % 6 = 2 AS whole, event_id % 4 < 2 AS on_conventional,
    CASE WHEN event_id % 6 = 2 THEN event_id % 4 = 0 ELSE event_id % 8 < 4 END AS conventional,
    CASE WHEN event_id % 6 = 2 THEN ['en', 'zh', 'auto'][1 + event_id % 3]
         ELSE ['zh', 'fr'][1 + (event_id % 8) // 4] END AS language
  FROM events WHERE event_type = 'purchase' AND event_id % 6 IN (2, 4)
),
settings AS (
  SELECT session, arg_max(conventional, seq) FILTER (WHERE whole OR on_conventional) AS conventional,
    arg_max(language, seq) FILTER (WHERE whole OR NOT on_conventional) AS language
  FROM sets GROUP BY session
),
last AS (
  SELECT session, arg_max(files[1], seq) FILTER (WHERE type = 'SET_STAGED_FILES') AS staged_files,
    'model-' || CAST(max(seq) FILTER (WHERE type = 'SET_MODELS') AS VARCHAR) || '=Model' AS models,
    arg_max(message, seq) FILTER (WHERE type = 'SET_PROMPT') AS prompt,
    md5(CAST(max(seq) FILTER (WHERE type = 'SET_COMMIT_HISTORY') AS VARCHAR)) AS history
  FROM candidate_events GROUP BY session
)
SELECT l.session, coalesce(staged_files, '') AS staged_files, coalesce(models, '') AS models,
  coalesce(prompt, '') AS prompt, coalesce(history, '') AS history, coalesce(conventional, true) AS conventional,
  coalesce(language, 'en') AS language
FROM last l LEFT JOIN settings s ON l.session = s.session
""")
def panel_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-30: staged files, models, prompt, history and settings per session."""
    p = cstate.panel_state(_events(spark, sf_dir))
    models = F.transform("models", lambda m: F.concat(m["id"], F.lit("="), m["name"]))
    return p.select("session", F.array_join("staged_files", ",").alias("staged_files"),
                    F.array_join(models, ",").alias("models"), "prompt",
                    F.array_join("history", ",").alias("history"), "conventional", "language")


def _host_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded lists as host candidates: candidate_id = entry key, files as added.

    Several branches of a query read this list (selection, client order,
    leftovers, counts), so it is computed once and checkpointed to the shared
    checkpoint folder (reliable: survives executor loss, cuts the lineage).
    """
    ensure_checkpoint_dir(spark)
    entries = cstate.list_positions(cstate.fold_candidates(_events(spark, sf_dir)))
    return entries.select(
        "session", "list_pos", "id", "message", "checked",
        F.concat_ws(":", F.col("id"), F.col("entry_seq").cast("string"), F.col("sub_pos").cast("string"))
        .alias("candidate_id"), "files").checkpoint()


_HOST_SQL = """
host AS (
  SELECT session, list_pos, id, message, checked,
    id || ':' || CAST(entry_seq AS VARCHAR) || ':' || CAST(sub_pos AS VARCHAR) AS candidate_id, files
  FROM final_list
),
nlist AS (SELECT session, count(*) AS n FROM host GROUP BY session),
first_move AS (
  SELECT h.*, n.n, h.session % 3 AS i, (h.session + 1) % 4 AS j, n.n - 1 - h.list_pos AS d
  FROM host h JOIN nlist n ON h.session = n.session
),
moved AS (
  SELECT * REPLACE (session % 2 AS i, (session + 2) % 3 AS j,
    CASE WHEN NOT (i <> j AND i < n AND j < n) THEN d WHEN d = i THEN j
         WHEN i < d AND d <= j THEN d - 1 WHEN j <= d AND d < i THEN d + 1 ELSE d END AS d)
  FROM first_move
),
reordered AS (
  SELECT session, id, message, checked, candidate_id, files,
    CAST(n - 1 - CASE WHEN NOT (i <> j AND i < n AND j < n) THEN d WHEN d = i THEN j
                      WHEN i < d AND d <= j THEN d - 1 WHEN j <= d AND d < i THEN d + 1 ELSE d END
         AS INTEGER) AS list_pos
  FROM moved
)"""


@register("reordered", f"""
WITH {fx.CANDIDATE_EVENTS_CTE}, {fx.FOLD_CTE}, {_HOST_SQL}
SELECT session, list_pos, candidate_id FROM reordered
""")
def reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-32: two drags per session, one after the other."""
    host = _host_list(spark, sf_dir)
    return cstate.reorder(host, _moves(host)).select("session", "list_pos", "candidate_id")


def _moves(host: DataFrame) -> DataFrame:
    """Two drags per session: display session % 3 to (session + 1) % 4, then
    session % 2 to (session + 2) % 3."""
    s = F.col("session")
    drag = lambda n, i, j: F.struct(F.lit(n).alias("seq"), i.alias("from_idx"), j.alias("to_idx"))
    return host.select("session").distinct().select(
        "session", F.inline(F.array(drag(1, s % 3, (s + 1) % 4), drag(2, s % 2, (s + 2) % 3))))


@register("edited", f"""
WITH {fx.CANDIDATE_EVENTS_CTE}, {fx.FOLD_CTE}, {_HOST_SQL},
latest AS (
  SELECT session, id, arg_max(trim(message, {fx.WS_SET}), seq) AS edit
  FROM edits WHERE trim(message, {fx.WS_SET}) <> '' GROUP BY session, id
)
SELECT h.session, h.list_pos, h.candidate_id, coalesce(l.edit, h.message) AS message
FROM host h LEFT JOIN latest l ON h.session = l.session AND h.id = l.id
""")
def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-33: saved edits (trimmed, blanks ignored, latest wins) per candidate id."""
    host = _host_list(spark, sf_dir)
    edits = edits_from_events(table(spark, sf_dir, "events"))
    return cstate.apply_edits(host, edits, ["session", "id"]).select("session", "list_pos", "candidate_id",
                                                                     "message")


def _selection_inputs(spark: SparkSession, sf_dir: str):
    host = _host_list(spark, sf_dir)
    sel_ids = host.filter("checked").select("session", "id").distinct()
    selection = host.join(sel_ids, ["session", "id"], "left_semi").select("session", "candidate_id")
    client = cstate.reorder(host, _moves(host)).filter(F.col("session") % 2 == 0)
    return host, selection, client


_SELECT_SQL = """
sel_ids AS (SELECT DISTINCT session, id FROM host WHERE checked),
selection AS (SELECT h.session, h.candidate_id FROM host h SEMI JOIN sel_ids s ON h.session = s.session AND h.id = s.id),
client AS (SELECT * FROM reordered WHERE session % 2 = 0),
chosen AS (
  SELECT session, candidate_id, message, files, list_pos FROM client
  UNION ALL
  SELECT session, candidate_id, message, files, list_pos FROM host
  WHERE session NOT IN (SELECT DISTINCT session FROM client)
),
selected AS (
  SELECT c.* FROM chosen c SEMI JOIN selection s ON c.session = s.session AND c.candidate_id = s.candidate_id
)"""


@register("selected", f"""
WITH {fx.CANDIDATE_EVENTS_CTE}, {fx.FOLD_CTE}, {_HOST_SQL}, {_SELECT_SQL}
SELECT session, list_pos, candidate_id, message FROM selected
""")
def selected_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-34: checked ids, taken from the client's reordered list when it sent one."""
    host, selection, client = _selection_inputs(spark, sf_dir)
    return cstate.selected(host, selection, client, ["session"]).select("session", "list_pos", "candidate_id",
                                                                        "message")


@register("unselected_files", f"""
WITH {fx.CANDIDATE_EVENTS_CTE}, {fx.FOLD_CTE}, {_HOST_SQL}, {_SELECT_SQL}
SELECT session, candidate_id, list_pos, CAST(generate_subscripts(files, 1) - 1 AS INTEGER) AS file_pos,
       unnest(files) AS path
FROM (SELECT h.* FROM host h ANTI JOIN selection s ON h.session = s.session AND h.candidate_id = s.candidate_id)
""")
def unselected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-35: files of the host's candidates that were not selected."""
    host, selection, _ = _selection_inputs(spark, sf_dir)
    return cstate.unselected_files(host, selection, ["session"])


@register("plan", f"""
WITH {fx.CANDIDATE_EVENTS_CTE}, {fx.FOLD_CTE}, {_HOST_SQL}, {_SELECT_SQL},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY session ORDER BY list_pos) - 1 AS k,
         count(*) OVER (PARTITION BY session) AS n_sel
  FROM selected
),
leftover_files AS (
  SELECT session, path,
    CAST(row_number() OVER (PARTITION BY session ORDER BY list_pos, file_pos) - 1 AS INTEGER) AS file_ord
  FROM (
    SELECT h.session, h.list_pos, unnest(h.files) AS path, generate_subscripts(h.files, 1) AS file_pos
    FROM host h ANTI JOIN selection s ON h.session = s.session AND h.candidate_id = s.candidate_id)
),
steps AS (
  SELECT DISTINCT session, 0 AS step, 'unstage_all' AS action, CAST(NULL AS VARCHAR) AS files,
         CAST(NULL AS VARCHAR) AS message, CAST(NULL AS INTEGER) AS file_ord FROM ranked
  UNION ALL SELECT session, 1 + 2 * k, 'stage', array_to_string(files, ','), NULL, NULL FROM ranked
  UNION ALL SELECT session, 2 + 2 * k, 'commit', NULL, message, NULL FROM ranked
  UNION ALL SELECT l.session, 1 + 2 * n.n_sel, 'restage', l.path, NULL, l.file_ord
  FROM leftover_files l JOIN (SELECT DISTINCT session, n_sel FROM ranked) n ON l.session = n.session
)
SELECT session, CAST(step AS INTEGER) AS step, action, files, message, file_ord FROM steps
""")
def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-36: unstage all, stage + commit each selected candidate in order,
    restage the leftovers; nothing when nothing is selected."""
    from .plans.commit_plan import commit_plan
    host, selection, client = _selection_inputs(spark, sf_dir)
    sel = cstate.selected(host, selection, client, ["session"])
    left = cstate.unselected_files(host, selection, ["session"])
    return commit_plan(sel, left, ["session"]).select("session", "step", "action", "files", "message",
                                                      "file_ord")


@register("counts", f"""
WITH {fx.CANDIDATE_EVENTS_CTE}, {fx.FOLD_CTE}, {_HOST_SQL}, {_SELECT_SQL},
c AS (SELECT session, CAST(count(*) AS BIGINT) AS total, CAST(count_if(checked) AS BIGINT) AS checked,
             CAST(count_if(NOT checked) AS BIGINT) AS unchecked FROM host GROUP BY session),
s AS (SELECT session, CAST(count(*) AS BIGINT) AS created FROM selected GROUP BY session)
SELECT c.session, c.total, c.checked, c.unchecked, c.total > 0 AS has_any, coalesce(s.created, 0) AS created
FROM c LEFT JOIN s ON c.session = s.session
""")
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-37: checked / total / pending per session and commits a run would create."""
    host, selection, client = _selection_inputs(spark, sf_dir)
    base = cstate.selection_counts(host, ["session"])
    created = (cstate.selected(host, selection, client, ["session"]).groupBy("session")
               .agg(F.count(F.lit(1)).alias("created")))
    return (base.join(created, "session", "left")
            .select("session", "total", "checked", "unchecked", "has_any",
                    F.coalesce("created", F.lit(0)).alias("created")))


# ---------------------------------------------------------------------------
# Step 7: blank report, generations, quality, end-to-end, streams
# ---------------------------------------------------------------------------

from .operators import quality  # noqa: E402
from .sources.fixtures import CJK  # noqa: E402
from .operators.ledger import AnswerLedger  # noqa: E402
from .plans.generate import run_generation  # noqa: E402
from .streaming import jobs as streams  # noqa: E402


@register("no_changes", f"""
WITH {fx.COMMITS_CTE}
SELECT repo, commit_id, 'no_changes' AS status FROM commits WHERE trim(raw_diff, {fx.WS_SET}) = ''
""")
def no_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-01: snapshots whose diff is blank after trim() are reported, not parsed."""
    return diffs.blank_snapshots(load_commits(spark, sf_dir))


@register("latest_generation", f"""
WITH {_CANDS_SQL},
runs AS (SELECT repo, seq AS generation, commit_id % 9 = 4 AS cancelled FROM requests
         WHERE kind = 'regenerate'),
newest AS (SELECT repo, max(generation) AS generation, arg_max(cancelled, generation) AS cancelled
           FROM runs GROUP BY repo)
SELECT c.repo, c.commit_id AS generation, c.group_ord, c.candidate_id
FROM cands c JOIN newest n ON c.repo = n.repo AND c.commit_id = n.generation
WHERE NOT n.cancelled
""")
def latest_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-31: per repo only the newest run's candidates survive; a cancelled
    newest run leaves none.  Run = regenerate request, generation = seq.  Only
    the snapshots of surviving runs reach the model."""
    commits = load_commits(spark, sf_dir)
    runs = (requests_from_commits(commits).filter(F.col("kind") == "regenerate")
            .select("repo", F.col("seq").alias("generation"), (F.col("commit_id") % 9 == 4).alias("cancelled")))
    newest = cstate.latest_generation(commits.withColumnRenamed("commit_id", "generation"), runs)
    cands = _candidates(spark, sf_dir, newest.withColumnRenamed("generation", "commit_id"))
    return cands.select("repo", F.col("commit_id").alias("generation"), "group_ord", "candidate_id")


@register("quality", f"""
WITH {fx.RESPONSES_CTE}, {_OBJ_SQL},
messages AS (
  SELECT request_id, error,
    CASE request_id % 4 WHEN 0 THEN 'feat: ' || message WHEN 1 THEN 'fix(core): ' || message
                        WHEN 2 THEN translate(message, 'aeiou', '{CJK * 5}') ELSE message END AS message,
    reason || CASE request_id % 3 WHEN 0 THEN '.' WHEN 1 THEN '. So. There. It is!' ELSE '' END AS reason
  FROM parsed
)
SELECT request_id, message, CAST(length(message) AS INTEGER) AS chars, length(message) < 72 AS under_limit,
  regexp_matches(message, '^(?:feat|fix|docs|style|refactor|perf|test|chore|ci|build)(?:\\([^()\\r\\n]*\\))?: ')
    AS conventional,
  regexp_matches(message, '^(?:feat|fix|docs|style|refactor|perf|test|chore|ci|build)\\([^()\\r\\n]*\\): ')
    AS has_scope,
  CASE WHEN length(message) > 0
        AND length(regexp_replace(message, '[\\x00-\\x7F]', '', 'g')) * 5 > length(message)
       THEN 'zh' ELSE 'en' END AS language,
  CAST(len(regexp_extract_all(reason, '[.!?。！？](\\s|$)')) AS INTEGER) AS reason_sentences,
  len(regexp_extract_all(reason, '[.!?。！？](\\s|$)')) BETWEEN 1 AND 2 AS reason_ok
FROM messages WHERE error IS NULL
""")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-38 (derived): length, type prefix, scope, language and reason-sentence flags."""
    ok = responses.parse_object(_responses(spark, sf_dir)).filter(F.col("error").isNull())
    kind, m = F.col("request_id") % 4, F.col("message")
    ending = (F.when(F.col("request_id") % 3 == 0, ".").when(F.col("request_id") % 3 == 1, ". So. There. It is!")
              .otherwise(""))
    ok = ok.withColumns({
        "message": F.when(kind == 0, F.concat(F.lit("feat: "), m)).when(kind == 1, F.concat(F.lit("fix(core): "), m))
        .when(kind == 2, F.translate(m, "aeiou", CJK * 5)).otherwise(m),
        "reason": F.concat("reason", ending)})
    return quality.message_quality(ok).select(
        "request_id", "message", "chars", "under_limit", "conventional", "has_scope", "language",
        "reason_sentences", "reason_ok")


@register("generation_run", f"""
WITH {_CANDS_SQL}, {fx.MODELS_CTE},
cat AS (SELECT DISTINCT catalog_id FROM models),
snap_ok AS (
  SELECT b.repo, b.commit_id, b.n_groups, (b.commit_id % 6) IN (SELECT catalog_id FROM cat) AS has_model
  FROM batch_prompts b
),
errs AS (
  SELECT repo, commit_id, 'no_changes' AS error FROM commits WHERE trim(raw_diff, {fx.WS_SET}) = ''
  UNION ALL
  SELECT repo, commit_id, 'no language model available' FROM snap_ok WHERE NOT has_model
  UNION ALL
  SELECT a.repo, a.commit_id, 'unparsable response (expected array of ' || CAST(s.n_groups AS VARCHAR)
         || '): ' || left(a.raw, 300)
  FROM answers a JOIN snap_ok s ON a.repo = s.repo AND a.commit_id = s.commit_id
  WHERE s.has_model AND a.variant = 3 AND NOT a.refused
  UNION ALL
  SELECT a.repo, a.commit_id, a.infer_error
  FROM answers a JOIN snap_ok s ON a.repo = s.repo AND a.commit_id = s.commit_id
  WHERE s.has_model AND a.refused
)
SELECT c.repo, c.commit_id, 'candidate' AS kind, c.group_ord, c.candidate_id, c.message, c.files,
       CAST(NULL AS VARCHAR) AS error
FROM cands c JOIN snap_ok s ON c.repo = s.repo AND c.commit_id = s.commit_id WHERE s.has_model
UNION ALL
SELECT repo, commit_id, 'error', CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),
       CAST(NULL AS VARCHAR), error FROM errs
""")
def generation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-39: snapshots -> candidates and error rows; the model's answers are
    checkpointed when the query is built (the deterministic stand-in model answers; model catalogue = commit_id % 6)."""
    models = models_from_suppliers(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"))

    def context(snapshots: DataFrame) -> DataFrame:
        return _with_prompt_context(snapshots, spark, sf_dir, "left").withColumn(
            "catalog_id", (F.col("commit_id") % 6).cast("int"))
    return _outcome_rows(*run_generation(load_commits(spark, sf_dir), context, echo_model, models))


def _outcome_rows(cands: DataFrame, errors: DataFrame) -> DataFrame:
    null = F.lit(None)
    return (cands.select("repo", "commit_id", F.lit("candidate").alias("kind"), "group_ord", "candidate_id",
                         "message", F.array_join("files", ",").alias("files"),
                         null.cast("string").alias("error"))
            .unionByName(errors.select("repo", "commit_id", F.lit("error").alias("kind"),
                                       null.cast("int").alias("group_ord"),
                                       null.cast("string").alias("candidate_id"),
                                       null.cast("string").alias("message"),
                                       null.cast("string").alias("files"), "error")))


@register("generation_resumed", f"""
WITH whole AS ({ORACLES["generation_run"]}), {fx.COMMITS_CTE}, {fx.REQUESTS_CTE},
newest AS (SELECT repo, max(seq) AS generation, arg_max(commit_id % 9 = 4, seq) AS cancelled
           FROM requests WHERE kind = 'regenerate' GROUP BY repo)
SELECT w.* FROM whole w JOIN newest n ON w.repo = n.repo AND w.commit_id = n.generation WHERE NOT n.cancelled
""")
def generation_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-39 with OP-31: only each repo's newest run, none that was cancelled;
    answers kept in a ledger.  Half of the runs are asked first, as by a job
    that broke; the whole job then asks the rest."""
    models = models_from_suppliers(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"))
    commits = load_commits(spark, sf_dir)
    runs = (requests_from_commits(commits).filter(F.col("kind") == "regenerate")
            .select("repo", F.col("seq").alias("commit_id"), (F.col("commit_id") % 9 == 4).alias("cancelled")))

    def context(snapshots: DataFrame) -> DataFrame:
        return _with_prompt_context(snapshots, spark, sf_dir, "left").withColumn(
            "catalog_id", (F.col("commit_id") % 6).cast("int"))

    ledger = AnswerLedger(spark, streams.scratch_dir(spark, "ledger"), waves=2)
    run_generation(commits.filter(F.col("commit_id") % 2 == 0), context, echo_model, models, runs, ledger=ledger)
    return _outcome_rows(*run_generation(commits, context, echo_model, models, runs, ledger=ledger))


_ROUNDTRIP_SQL = f"""
WITH {fx.COMMITS_CTE}
SELECT repo, commit_id, md5(raw_diff) AS diff_md5,
       CASE WHEN trim(raw_diff, {fx.WS_SET}) = '' THEN 'no_changes' END AS status
FROM commits
"""


@register("commits_roundtrip", _ROUNDTRIP_SQL)
def commits_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-01 + OP-03: the corpus through the table sink and the reader."""
    path = streams.scratch_dir(spark, "commits")
    readers.write_table(load_commits(spark, sf_dir), path)
    full, blank = readers.read_commits(spark, path)
    return (full.select("repo", "commit_id", F.md5("raw_diff").alias("diff_md5"), F.lit(None).cast("string").alias("status"))
            .unionByName(blank.select("repo", "commit_id", F.md5("raw_diff").alias("diff_md5"), "status")))


@register("commits_upserted", _ROUNDTRIP_SQL)
def commits_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-03: the corpus through the keyed sink, a third of it written again
    and a third first with an older text; one row per snapshot is left."""
    path = streams.scratch_dir(spark, "upserted")
    ensure_checkpoint_dir(spark)
    commits = load_commits(spark, sf_dir)
    third = F.pmod(F.col("commit_id"), F.lit(3))
    old = commits.filter(third != 0).withColumn("raw_diff", F.when(third == 1, F.lit("older")).otherwise(F.col("raw_diff")))
    for rows in (old, commits):
        readers.upsert_table(rows, path, ["repo", "commit_id"])
    return readers.read_upserted(spark, path).select(
        "repo", "commit_id", F.md5("raw_diff").alias("diff_md5"),
        F.when(is_blank("raw_diff"), F.lit("no_changes")).alias("status"))


@register("stream_commits_roundtrip", _ROUNDTRIP_SQL)
def stream_commits_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-01 + OP-03 streaming: reader stream to sink stream; blank snapshots
    arrive with their status."""
    base = streams.scratch_dir(spark, "commits-stream")
    readers.write_table(load_commits(spark, sf_dir), f"{base}/in")
    rows = readers.read_commits_stream(spark, f"{base}/in")
    readers.write_stream(rows, f"{base}/out", f"{base}/ckpt").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("repo", "commit_id", F.md5("raw_diff").alias("diff_md5"), "status")


@register("stream_newest_run", f"""
WITH {fx.COMMITS_CTE}, {fx.REQUESTS_CTE}
SELECT repo, max(seq) AS generation, arg_max(commit_id % 9 = 4, seq) AS cancelled
FROM requests WHERE kind = 'regenerate' GROUP BY repo
""")
def stream_newest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-31 streaming: the newest run of each repo and whether it was cancelled."""
    base = streams.scratch_dir(spark, "runs")
    runs = (requests_from_commits(load_commits(spark, sf_dir)).filter(F.col("kind") == "regenerate")
            .select("repo", F.col("seq").alias("generation"), (F.col("commit_id") % 9 == 4).alias("cancelled")))
    src = streams.land_as_stream(spark, runs, base)
    streams.run_versioned(streams.newest_run_stream(src), f"{base}/out", f"{base}/ckpt")
    return streams.latest_versions(spark, f"{base}/out", ["repo"])


@register("stream_file_churn", ORACLES["churn_by_group"])
def stream_file_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-40: snapshots landed as files and streamed (availableNow); the
    stateless in-row jobs run on the stream and must equal the batch result."""
    base = streams.scratch_dir(spark, "file-churn")
    src = streams.land_as_stream(spark, load_commits(spark, sf_dir), base)
    streams.run_available(streams.file_churn_stream(src), f"{base}/out", f"{base}/ckpt")
    return churn.churn_totals(spark.read.parquet(f"{base}/out"), ["repo", "group_type"])


@register("stream_churn", f"""
WITH {_CLASSIFIED}
SELECT repo, group_type, CAST(count(*) AS BIGINT) AS files,
       CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions
FROM churned WHERE (repo, commit_id) IN (SELECT (repo, max(commit_id)) FROM commits GROUP BY repo)
GROUP BY repo, group_type
""")
def stream_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-40: churn of each repo's newest snapshot, kept up by retractions:
    a newer snapshot takes back what the one before it contributed."""
    base = streams.scratch_dir(spark, "churn")
    src = streams.land_as_stream(spark, load_commits(spark, sf_dir), base)
    streams.run_superseding_churn(src, base)
    return streams.latest_churn(spark, base)


@register("stream_file_groups", ORACLES["file_groups"])
def stream_file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-40: the groups of a stream of snapshots."""
    base = streams.scratch_dir(spark, "groups")
    src = streams.land_as_stream(spark, load_commits(spark, sf_dir), base)
    streams.run_available(_shown_groups(streams.file_groups_stream(src)), f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out")


# Stored options are those of the updates up to the request, not of all.
_AS_OF_CTE = _RESOLVED_CTE.replace("eff AS (", """points AS (
  SELECT repo, seq, 0 AS rank, CAST(NULL AS BIGINT) AS commit_id, conventional, language FROM option_updates
  UNION ALL SELECT repo, seq, 1, commit_id, NULL, NULL FROM requests
),
stored_then AS (
  SELECT repo, commit_id, rank, last_value(conventional IGNORE NULLS) OVER w AS stored_conventional,
    last_value(language IGNORE NULLS) OVER w AS stored_language
  FROM points WINDOW w AS (PARTITION BY repo ORDER BY seq, rank ROWS UNBOUNDED PRECEDING)
),
eff AS (""").replace("LEFT JOIN stored s ON q.repo = s.repo",
                     "JOIN stored_then s ON q.repo = s.repo AND q.commit_id = s.commit_id AND s.rank = 1")


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settings.option_timeline(option_updates_from_nation(table(spark, sf_dir, "nation")),
                                    requests_from_commits(load_commits(spark, sf_dir)))


def _prompt_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    log = load_commit_log(spark, sf_dir)
    return history.detect_language(log, users_table(spark)), prompts.history_text(log)


def _prompt_digest(rows: DataFrame) -> DataFrame:
    return rows.select("repo", "commit_id", "n_groups", "model", F.length("prompt_text").alias("prompt_chars"),
                       F.md5("prompt_text").alias("prompt_md5"))


@register("settings_as_of", f"""
WITH {_AS_OF_CTE}
SELECT repo, commit_id, seq, kind, conventional, language, model, prompt, session_language FROM eff
""")
def settings_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-20 under the options valid at each request, from versioned state."""
    out = settings.settings_as_of(requests_from_commits(load_commits(spark, sf_dir)), _timeline(spark, sf_dir))
    return out.select("repo", "commit_id", "seq", "kind", "conventional", "language", "model", "prompt",
                      "session_language")


@register("prompts_as_of", f"""
WITH {_PROMPT_CTE.replace(_RESOLVED_CTE, _AS_OF_CTE)}, {_BATCH_SQL}
SELECT repo, commit_id, n_groups, model, CAST(length(prompt_text) AS INTEGER) AS prompt_chars,
       md5(prompt_text) AS prompt_md5
FROM batch_prompts
""")
def prompts_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-22 under the options valid at each request's ``seq``."""
    commits = load_commits(spark, sf_dir)
    return _prompt_digest(streams.snapshot_prompts(commits, requests_from_commits(commits), _timeline(spark, sf_dir),
                                                   *_prompt_facts(spark, sf_dir)))


@register("stream_prompts", ORACLES["prompts_as_of"])
def stream_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-40: prompts of a stream of snapshots; each micro-batch joins the
    option versions of its own span as of the snapshots."""
    base = streams.scratch_dir(spark, "prompts")
    _timeline(spark, sf_dir).repartitionByRange("valid_from").sortWithinPartitions("valid_from").write.parquet(
        f"{base}/timeline")
    src = streams.land_as_stream(spark, load_commits(spark, sf_dir), base)
    facts = [streams.staged(df, f"{base}/{name}") for df, name in
             zip(_prompt_facts(spark, sf_dir), ("languages", "recent"))]
    streams.run_prompt_stream(src, requests_from_commits, f"{base}/timeline", *facts, base)
    return _prompt_digest(spark.read.parquet(f"{base}/prompts"))


@register("stream_assembled", ORACLES["assembled"])
def stream_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-25 streaming: chunks arrive over several micro-batches; the
    update-mode aggregate keeps partial answers in state."""
    base = streams.scratch_dir(spark, "chunks")
    chunks = chunks_from_responses(_responses(spark, sf_dir))
    src = streams.land_as_stream(spark, chunks, base)
    streams.run_versioned(streams.assemble_stream(src), f"{base}/out", f"{base}/ckpt")
    out = streams.latest_versions(spark, f"{base}/out", ["request_id"])
    return out.select("request_id", F.md5("raw").alias("raw_md5"), "chunks", "complete")


@register("stream_state", f"""
WITH {fx.CANDIDATE_EVENTS_CTE}, {fx.FOLD_CTE}
SELECT session, generating, error, success_count, staged_loading FROM status
""")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-30 streaming: per-session status folded over micro-batches."""
    base = streams.scratch_dir(spark, "events")
    src = streams.land_as_stream(spark, _events(spark, sf_dir), base)
    streams.run_versioned(streams.status_stream(src), f"{base}/out", f"{base}/ckpt")
    out = streams.latest_versions(spark, f"{base}/out", ["session"])
    return out.select("session", "generating", "error", "success_count", "staged_loading")


@register("stream_newest_snapshot", f"""
WITH {fx.COMMITS_CTE}
SELECT repo, arg_max(commit_id, commit_id) AS commit_id, md5(arg_max(raw_diff, commit_id)) AS diff_md5
FROM commits GROUP BY repo
""")
def stream_newest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-40 refresh: a newer snapshot of a repo supersedes the previous one."""
    base = streams.scratch_dir(spark, "refresh")
    src = streams.land_as_stream(spark, load_commits(spark, sf_dir), base)
    streams.run_versioned(streams.newest_snapshot_stream(src), f"{base}/out", f"{base}/ckpt")
    out = streams.latest_versions(spark, f"{base}/out", ["repo"])
    return out.select("repo", "commit_id", F.md5("raw_diff").alias("diff_md5"))


@register("stream_state_candidates", ORACLES["state_candidates"])
def stream_state_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-30 streaming: candidate lists folded exactly over micro-batches."""
    base = streams.scratch_dir(spark, "fold")
    src = streams.land_as_stream(spark, _events(spark, sf_dir), base)
    streams.run_fold_stream(src, base)
    return _shown(streams.latest_lists(spark, base))


@register("stream_line_numbers", ORACLES["line_numbers"])
def stream_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-07/08 streaming: numbering per micro-batch (foreachBatch)."""
    base = streams.scratch_dir(spark, "lines")
    src = streams.land_as_stream(spark, load_commits(spark, sf_dir), base)
    streams.run_line_numbers_stream(src, f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out").select("repo", "commit_id", "file_seq", "pos", "kind", "sign",
                                                     "text", "old_n", "new_n")


@register("stream_recent_commits", ORACLES["recent_commits"])
def stream_recent_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-16/17 streaming: newest 20 per repo kept incrementally."""
    base = streams.scratch_dir(spark, "recent")
    src = streams.land_as_stream(spark, load_commit_log(spark, sf_dir), base)
    streams.run_recent_commits_stream(src, base)
    return streams.latest_recent_commits(spark, base)
