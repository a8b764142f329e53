"""Path jobs: classify paths into groups (OP-13), group files (OP-14),
make paths repository-relative (OP-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.js import LT, starts_with_any

# Fixed values of the grouping rules, in rule order.
# Rule 1 - dependency manifests and lock files, exact (case-sensitive) names:
DEPS_NAMES = [
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "npm-shrinkwrap.json",
    "requirements.txt", "Pipfile", "Pipfile.lock", "Cargo.toml", "Cargo.lock", "go.mod", "go.sum",
    "composer.json", "composer.lock", "Gemfile", "Gemfile.lock", "pyproject.toml", "poetry.lock",
]
# Rule 2 - test files: a ``.test``/``.spec`` script name, or any of these path parts:
TEST_DIRS = ["__tests__", "test", "tests", "__test__", "e2e"]
# Rule 3 - config: a ``.config``/``.rc`` script name, a name starting ``.env``,
# one of these extensions, or a name starting with one of these tool prefixes:
CONFIG_EXTS = [".yaml", ".yml", ".toml", ".ini", ".editorconfig"]
CONFIG_NAME_PREFIXES = [
    "tsconfig", "jest.config", "vite.config", "webpack.config", "babel.config",
    ".eslintrc", ".prettierrc", ".stylelintrc", ".babelrc",
]
# Rule 4 - docs: one of these extensions, or a first path part of:
DOCS_EXTS = [".md", ".mdx", ".rst", ".txt", ".adoc"]
DOCS_DIRS = ["docs", "doc"]
# Script extensions for rules 2 and 3: .js .jsx .ts .tsx
SCRIPT_SUFFIX = r"\.[jt]sx?"

GROUP_TYPES = ["source", "test", "deps", "config", "docs", "misc"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base_name(path) -> Column:
    """POSIX basename: the last part after trailing slashes are dropped."""
    return F.substring_index(F.regexp_replace(_col(path), r"/+\z", ""), "/", -1)


def ext_name(name) -> Column:
    """POSIX extname of a base name, lower-cased: from the last dot, but a
    name whose only dot leads (``.env``) or the name ``..`` has none."""
    name = _col(name)
    ext = F.regexp_extract(name, r"(?s)\A.+(\.[^.]*)\z", 1)
    return F.lower(F.when(name == "..", F.lit("")).otherwise(ext))


def classification(path) -> Column:
    """STRUCT<group_key, group_type, label> by the six ordered rules.

    A ``CASE WHEN`` chain is short-circuiting, so later rules cost nothing
    for paths an earlier rule took.  All built-in expressions.
    """
    path = _col(path)
    name = base_name(path)
    ext = ext_name(name)
    parts = F.split(path, "/", -1)
    top = F.element_at(parts, 1)
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])

    deps = name.isin(DEPS_NAMES)
    test = (name.rlike(r"\.(test|spec)" + SCRIPT_SUFFIX + r"\z")
            | F.arrays_overlap(parts, lits(TEST_DIRS)))
    config = (name.rlike(r"\.(config|rc)" + SCRIPT_SUFFIX + r"\z")
              | name.startswith(".env")
              | ext.isin(CONFIG_EXTS)
              | (starts_with_any(name, CONFIG_NAME_PREFIXES) & ~name.rlike(LT)))
    docs = ext.isin(DOCS_EXTS) | top.isin(DOCS_DIRS)
    nested = F.size(parts) > 1

    def pick(deps_v, test_v, config_v, docs_v, source_v, misc_v):
        return (F.when(deps, deps_v).when(test, test_v).when(config, config_v)
                .when(docs, docs_v).when(nested, source_v).otherwise(misc_v))

    return F.struct(
        pick(*[F.lit(v) for v in ("deps", "test", "config", "docs")],
             F.concat(F.lit("source:"), top), F.lit("misc")).alias("group_key"),
        pick(*[F.lit(v) for v in ("deps", "test", "config", "docs", "source", "misc")]).alias("group_type"),
        pick(*[F.lit(v) for v in ("deps", "test", "config", "docs")],
             F.concat(F.lit("source: "), top, F.lit("/")), F.lit("misc")).alias("label"),
    )


def classify_paths(df: DataFrame, path_col: str = "path") -> DataFrame:
    """OP-13: add group_key, group_type and label for every path (narrow)."""
    c = classification(F.col(path_col))
    return df.withColumns({"group_key": c["group_key"], "group_type": c["group_type"],
                           "label": c["label"]})


def tag_files(files: Column) -> Column:
    """Pair every file of a ``files`` array with its classification."""
    return F.transform(files, lambda f: F.struct(f.alias("f"), classification(f["path"]).alias("c")))


def groups_from_tagged(tagged: Column) -> Column:
    """OP-14 in row: ARRAY<STRUCT<group_ord, group_key, group_type, label,
    files>> from a snapshot's tagged files (see ``tag_files``).

    Groups appear in first-seen order (``array_distinct`` keeps the first
    occurrence), files keep input order.  Pass a *column* holding the tagged
    array (not the expression) so each path is classified once.
    """
    keys = F.array_distinct(F.transform(tagged, lambda t: t["c"]["group_key"]))

    def one_group(k, i):
        members = F.filter(tagged, lambda t: t["c"]["group_key"] == k)
        return F.struct(i.alias("group_ord"), k.alias("group_key"),
                        members[0]["c"]["group_type"].alias("group_type"),
                        members[0]["c"]["label"].alias("label"),
                        F.transform(members, lambda t: t["f"]).alias("files"))
    return F.transform(keys, one_group)


def with_groups(parsed: DataFrame, files_col: str = "files", out_col: str = "groups") -> DataFrame:
    """Replace the ``files`` array of each snapshot row by its ``groups`` array.

    Two projections: the classification is computed once per file, then
    the grouping reads the materialised column (Catalyst does not collapse a
    projection whose expensive output is read several times)."""
    others = [c for c in parsed.columns if c != files_col]
    tagged = parsed.select(*others, tag_files(F.col(files_col)).alias("_tagged"))
    return tagged.select(*others, groups_from_tagged(F.col("_tagged")).alias(out_col))


def group_files_in_row(parsed: DataFrame, files_col: str = "files") -> DataFrame:
    """OP-14 on parsed snapshots (one row per snapshot with a ``files`` array):
    one row per (snapshot, group).

    The snapshot is one row, so the grouping runs inside that row: no
    shuffle, and no group is ever larger than the input row it came from.
    A snapshot without any group produces no rows.
    """
    grouped = with_groups(parsed, files_col, "_groups")
    others = [c for c in grouped.columns if c != "_groups"]
    return (grouped.select(*others, F.explode_outer("_groups").alias("g"))
            .filter(F.col("g").isNotNull()).select(*others, "g.*"))


def group_file_changes(file_changes: DataFrame) -> DataFrame:
    """OP-14 for one-row-per-file input: aggregate per (snapshot, group).

    Hash-partitioning once on the snapshot key satisfies both the aggregate
    and the group-order window, so the file rows cross the network once.
    Group size is bounded by the snapshot, which the input already held.
    """
    keyed = classify_paths(file_changes).repartition("repo", "commit_id")
    grouped = (keyed.groupBy("repo", "commit_id", "group_key", "group_type", "label")
               .agg(F.min("file_seq").alias("first_seq"),
                    F.array_sort(F.collect_list(F.struct("file_seq", "path", "change_type", "diff")))
                    .alias("files")))
    w = Window.partitionBy("repo", "commit_id").orderBy("first_seq")
    return (grouped.withColumn("group_ord", (F.row_number().over(w) - 1).cast("int"))
            .drop("first_seq"))


def relativize(df: DataFrame, path_col: str, root_col: str, out_col: str = "rel_path") -> DataFrame:
    """OP-15: drop the first occurrence of ``root + '/'`` anywhere in the path
    (not only a prefix), then turn every backslash into a slash.  No regex."""
    path, needle = F.col(path_col), F.concat(F.col(root_col), F.lit("/"))
    pos = F.instr(path, needle)
    cut = F.when(pos > 0, F.concat(F.substring(path, F.lit(1), pos - 1),
                                   F.substr(path, pos + F.length(needle))))
    return df.withColumn(out_col, F.replace(F.coalesce(cut, path), F.lit("\\"), F.lit("/")))
