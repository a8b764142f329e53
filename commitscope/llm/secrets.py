"""Secret scans: candidate strings by pattern, false positives removed by a
random forest.  DataFrame and SQL functions only.

``candidates`` finds long unbroken strings that hold a digit or letters of
both cases, keys of known kinds, and values assigned to a secret's name (in
quotes up to the closing one), with the text around them.  ``features`` turns
each into numbers: length, changes of character class, share of dictionary
words, path-likeness and the neighbouring words.  Spark ML fits the forest on
labelled findings and scores the rows, both in the JVM.

The dictionary is the corpus' own: words that at least ``DICTIONARY_SHARE`` of
its documents hold, and two of them at least.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, quoted

DICTIONARY_SHARE = 1e-4
MAX_LABELLED = 400
BEFORE, AFTER = 64, 32
# Names that secrets are assigned to, and words that stand
# beside look-alikes.
SECRET_NAMES = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key",
                "accesskey", "auth", "bearer", "credential", "credentials", "private_key", "key", "client_secret", "accesstoken", "authtoken", "secretkey")
HARMLESS_NAMES = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "hash", "digest", "uuid", "guid", "id", "etag",
                  "version", "revision", "build", "ref", "blob", "tree", "integrity", "isbn", "phone", "example", "test",
                  "dummy", "placeholder", "sample")
_NAME = "|".join(sorted(SECRET_NAMES, key=len, reverse=True))
# Names that no other word ends in; the others begin at a word or a hump.
_STRONG = "password|passwd|secret|token|apikey|api_key|api-key|credential|credentials"
# Beginnings of keys that may hold letters only; parts joined by dots.
_KNOWN = (r"(?:gh[oprsu]_|github_pat_|glpat-|xox[abeprs]-|[rsp]k_(?:live|test)_|sk-|AIza|npm_|pypi-|dop_v1_|hf_|shpat_"
          r"|(?:eyJ|SG\.|ya29\.)(?=[A-Za-z0-9_-]))")
_P = "A-Za-z0-9+/_-"
# A name at the end of an unbroken string, and what stands between it and its value.
ASSIGNED = (rf"(?<![{_P}])[{_P}]*?(?:(?:(?<![A-Za-z])|(?<=[a-z0-9])(?=[A-Z]))(?i:{_NAME})|(?i:{_STRONG}))"
            r"[\"']?\s{0,2}(?:=>|:=|[=:])\s{0,2}")
# Values: between quotes up to the closing one on the same line, else up to
# white space, quotes, brackets, commas, semicolons and the next URL parameter.
_QUOTED = r"\"(?=(?:[^\"\\\r\n]|\\.){6,}+\")|'(?=(?:[^'\\\r\n]|\\.){6,}+')"
_PLAIN = r"(?:[^\s\"'`,;()<>{}\[\]\\&]|&(?!\w+=)){6,}+"
VALUE = (r"(?:(?<=\")(?:[^\"\\\r\n]|\\.){6,}+(?=\")|(?<=')(?:[^'\\\r\n]|\\.){6,}+(?=')|" + _PLAIN + ")")
LEAD = rf"{ASSIGNED}(?:{_QUOTED}|[\"']?(?={_PLAIN}))"
# A name with the value assigned to it, else a key of a known kind, else a
# long string with a digit or with letters of both cases.
CANDIDATE = (rf"{LEAD}{VALUE}|(?<![{_P}]){_KNOWN}[{_P}]{{12,}}+(?:\.[{_P}]+)*+"
             rf"|(?<![{_P}])(?=[{_P}]{{16}})(?:[A-Za-z+/_-]*+[0-9]|[A-Z+/_-]*+[a-z][a-z+/_-]*+[A-Z]|[+/_-]*+[A-Z]++[+/_-]*+[a-z])"
             rf"[{_P}]*+={{0,2}}")
RUNS = "[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+"
WORD_PARTS = "[A-Z]?[a-z]{2,}|[A-Z]{3,}"

FEATURES = ("length", "transitions", "transition_rate", "digit_share", "upper_share", "distinct_share", "hex_only",
            "dictionary_share", "separators", "in_path", "near_url", "file_ending", "secret_word_before",
            "harmless_word_before", "assigned", "quoted_value", "repeats")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate: ``doc_id, ordinal`` (from 1 within the text),
    ``start`` (character offset), ``candidate, before, after``.

    The text is split at its candidates, so pieces and candidates alternate.
    Null and empty texts have none.
    """
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    found = docs.select(quoted(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                        text.alias("text")).filter(F.col("text").rlike(CANDIDATE))
    cut = found.select("doc_id", "row", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("c"),
                       F.split("text", CANDIDATE, -1).alias("p"))
    each = cut.select("doc_id", "row", F.posexplode(F.arrays_zip(
        "c", F.slice("p", F.lit(1), F.size("c")).alias("b"), F.slice("p", F.lit(2), F.size("c")).alias("a")))
        .alias("i", "z"))
    # The name of an assigned value belongs to the text before it.
    lead = F.regexp_extract("z.c", rf"^{ASSIGNED}[\"']?(?=[\s\S]{{6}})", 0)
    each = each.select("doc_id", "row", "i", lead.alias("lead"), F.col("z.c").alias("c"),
                       F.length("z.b").alias("gap"), F.right("z.b", F.lit(BEFORE)).alias("b"),
                       F.left("z.a", F.lit(AFTER)).alias("after"))
    each = each.select("*", F.expr("substr(c, length(lead) + 1)").alias("candidate"),
                       F.right(F.concat("b", "lead"), F.lit(BEFORE)).alias("before"))
    # A window per text: its candidates only, never the text.
    w = Window.partitionBy("row").orderBy("i")
    start = F.sum(F.col("gap") + F.length("c")).over(w) - F.length("candidate")
    return each.select("doc_id", "row", (F.col("i") + 1).alias("ordinal"), start.alias("start"), "candidate", "before",
                       "after")


def dictionary(docs: DataFrame, text_col: str = "text", share: float = DICTIONARY_SHARE) -> DataFrame:
    """The corpus' own words of four letters and more (``word``): those in at
    least ``share`` of its documents and in two."""
    least = max(2, math.ceil(share * docs.count()))
    words = F.array_distinct(F.split(F.lower(quoted(text_col).cast("string")), r"[^a-z]+"))
    return (docs.select(F.explode(words).alias("word")).filter(F.length("word") >= 4)
            .groupBy("word").count().filter(F.col("count") >= least).select("word"))


def features(found: DataFrame, known_words: DataFrame, key: list[str]) -> DataFrame:
    """``found`` (``candidate, before, after``; ``key`` identifies a row)
    with the columns of ``FEATURES``.  ``known_words`` is
    broadcast only where Spark measures it as small."""
    c, n = F.col("candidate"), F.length("candidate")
    parts = found.select(*key, F.explode(F.regexp_extract_all("candidate", F.lit(WORD_PARTS), F.lit(0))).alias("part"))
    covered = (parts.join(known_words, F.lower("part") == F.col("word")).groupBy(*key)
               .agg(F.sum(F.length("part")).alias("covered")))
    share = lambda pattern: (n - F.length(F.regexp_replace(c, pattern, ""))) / n
    humps = F.lower(F.regexp_replace("before", "([a-z0-9])([A-Z])", "$1 $2"))
    last_words = F.slice(F.reverse(F.filter(F.split(humps, r"[^a-z0-9_-]+"), lambda w: w != "")), F.lit(1), F.lit(3))
    beside = lambda names: F.arrays_overlap("near", F.array(*map(F.lit, names)))
    runs = F.regexp_count(c, F.lit(RUNS)) - 1
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    rows = found.join(covered, key, "left").withColumn("near", last_words)
    return rows.withColumns({
        "length": n.cast("double"),
        "transitions": runs.cast("double"),
        "transition_rate": runs / n,
        "digit_share": share("[0-9]"),
        "upper_share": share("[A-Z]"),
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / n,
        "hex_only": flag(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "dictionary_share": F.coalesce("covered", F.lit(0)) / n,
        "separators": share("[^A-Za-z0-9]"),
        "in_path": flag(F.col("before").rlike(r"/$") | F.col("after").rlike(r"^[/?]") | c.rlike("[a-zA-Z]/[a-zA-Z]")),
        "near_url": flag(F.col("before").rlike(r"(?:https?|ftp|file|s3)://[^\s\"']*$")),
        "file_ending": flag(F.col("after").rlike(r"^\.[A-Za-z]{1,5}\b")),
        "secret_word_before": flag(F.exists("near", lambda w: w.rlike(rf"(?:(?:^|[_-])(?:{_NAME})|{_STRONG})$"))),
        "harmless_word_before": flag(beside(HARMLESS_NAMES)),
        "assigned": flag(F.col("before").rlike("[=:]>?[\"' ]*$")),
        "quoted_value": flag(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")),
        "repeats": flag(c.rlike(r"(.)\1{3,}|(.{2,64}?)\2{3,}|(?i)(?:xxxx|changeme|your[_-]|example|placeholder|dummy)")),
    }).drop("near", "covered")


def labelled_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      limit: int = MAX_LABELLED) -> DataFrame:
    """Findings with a known label (``k, candidate, before, after, label``)
    made from at most ``limit`` documents: digests of their text set where
    secrets stand and where look-alikes stand, and their own words, numbers
    and paths where neither is."""
    keyed = docs.select(F.xxhash64(quoted(id_col), quoted(text_col).cast("string")).alias("k"),
                        F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("t"))
    last = keyed.select("k").distinct().orderBy("k").limit(limit).agg(F.max("k")).first()[0]
    words = F.filter(F.split("t", r"\s+"), lambda w: w.rlike("^[A-Za-z]{3,20}$"))
    base = (keyed.filter(F.col("k") <= F.lit(last).cast("long"))
            .select("k", F.slice(words, 1, 40).alias("w"), F.sha2("t", 256).alias("h"), F.sha1("t").alias("h1"))
            .dropDuplicates(["k"]))
    pick = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit("word"))
    base64 = F.translate(F.rtrim(F.base64(F.unhex("h"))), "=\n", "")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    lead = say(pick(3), " ", pick(4), " ")
    one = lambda label, value, before, after: F.struct(
        value.alias("candidate"), before.alias("before"), after.alias("after"), F.lit(float(label)).alias("label"))
    number = F.translate("h", "abcdef", "012345")
    tail = say(" ", pick(5), " ", pick(6))
    letters = F.translate(base64, "0123456789+/", "")
    digest = lambda salt: F.translate(F.base64(F.unhex(F.sha2(F.concat("h", F.lit(salt)), 512))), "+/=\n", "xY")
    camel = say(F.lower(pick(20)), F.initcap(pick(21)), F.initcap(pick(22)), F.initcap(pick(23)))
    found = F.array(
        one(1, F.col("h1"), say(lead, 'token = "'), say('"', tail)),
        one(1, F.upper("h1"), say(F.upper(lead), 'TOKEN = "'), say('"', tail)),
        one(1, F.substring(base64, 1, 40), say(lead, "secret: "), tail),
        one(1, F.substring("h", 1, 32), say(lead, "api_key="), tail),
        one(1, F.substring(base64, 3, 24), say(lead, "password = '"), say("'", tail)),
        one(1, say("ghp_", F.substring(F.regexp_replace(base64, "[+/]", "x"), 1, 36)), say(lead, "auth "), tail),
        one(1, say(F.substring(base64, 5, 4), "@", F.substring(base64, 11, 3), "!"), say(lead, 'password = "'), say('"', tail)),
        one(1, say(F.substring(base64, 7, 5), "!", F.substring(base64, 21, 2), "$$"), say(lead, "dbPassword="), tail),
        one(1, F.substring(base64, 9, 9), say(lead, 'userToken: "'), say('"', tail)),
        one(1, say(F.initcap(F.substring(pick(27), 1, 6)), "@", F.substring(number, 1, 2), "!"), say(lead, "DB_PASSWORD="), tail),
        one(1, F.translate(F.substring("h", 1, 14), "abcdef", "!@#$%^"), say(lead, "secret: '"), say("'", tail)),
        one(1, F.substring(letters, 1, 24), say(lead, 'secret = "'), say('"', tail)),
        one(1, F.substring(letters, 3, 28), say(lead, "bearer "), tail),
        one(1, say("eyJ", F.substring(digest("a"), 1, 33), ".", digest("b"), digest("c"), ".", F.substring(digest("d"), 1, 43)),
            say(lead, "token: "), tail),
        one(1, say(digest("e"), digest("f"), digest("g"), digest("h")), say(lead, "private_key = '"), say("'", tail)),
        one(0, say(pick(28), " ", pick(29), " ", pick(30), " ", pick(31)), say(lead, 'key: "'), say('"', tail)),
        one(0, say(pick(32), " ", pick(33), " ", pick(34), "."), say(lead, 'passwordHint = "'), say('"', tail)),
        one(0, camel, lead, tail),
        one(0, camel, say(lead, "token: "), tail),
        one(0, say(F.initcap(pick(24)), F.initcap(pick(25)), F.initcap(pick(26)), "Factory"), lead, say("(", tail)),
        one(0, say(F.initcap(pick(28)), "/", F.initcap(pick(29)), "/", F.lower(pick(30))), say(lead, "/"), say(".txt", tail)),
        one(0, say("${", F.upper(pick(31)), "_", F.upper(pick(32)), "}"), say(lead, 'password: "'), say('"', tail)),
        one(0, say(F.lower(pick(33)), ".", F.lower(pick(34)), ".", F.lower(pick(35))), say(lead, "apiKey = "), tail),
        one(0, say("https://", F.lower(pick(36)), ".example.org/", F.lower(pick(37))), say(lead, 'auth: "'), say('"', tail)),
        one(0, F.initcap(F.concat(pick(38), pick(39))), say(lead, "key: "), tail),
        one(0, F.col("h1"), say(lead, "commit "), tail),
        one(0, F.col("h"), say(lead, "sha256: "), tail),
        one(0, F.substring("h", 1, 32), say(lead, "md5 checksum "), tail),
        one(0, F.col("h1"), say(lead, "https://", F.lower(pick(7)), ".example.org/blob/"), say(".html", tail)),
        one(0, F.substring(number, 1, 16), lead, tail),
        one(0, F.substring(number, 5, 20), say(lead, "id "), tail),
        one(0, say(pick(8), "_", pick(9), "_", pick(10), "_2"), lead, tail),
        one(0, say(F.lower(pick(11)), "/", F.lower(pick(12)), "/", F.lower(pick(13)), "1"), lead, say(".py", tail)),
        one(0, say("your_", F.lower(pick(14)), "_here"), say(lead, 'token = "'), say('"', tail)),
        one(0, F.lit("xxxxxxxxxxxxxxxxxxxx"), say(lead, "secret: "), tail),
        one(0, say(F.lower(pick(15)), F.lower(pick(16))), say(lead, "password: "), tail),
        one(0, say(F.lower(pick(17)), "-", F.lower(pick(18)), "-", F.lower(pick(19)), "-2024"), say(lead, "build "), tail))
    return base.select("k", F.posexplode(found).alias("i", "f")).select(
        "k", "i", "f.candidate", F.right("f.before", F.lit(BEFORE)).alias("before"),
        F.left("f.after", F.lit(AFTER)).alias("after"), "f.label").filter(F.length("candidate") > 0)


def fit_forest(findings: DataFrame, known_words: DataFrame, trees: int = 20, depth: int = 6,
               seed: int = 7) -> PipelineModel | None:
    """A random forest over ``FEATURES``.  ``findings`` holds a bounded
    number of rows (``k, i, candidate, before, after, label``); None without
    any."""
    work = Workspace(findings.sparkSession, "secrets-fit")
    table = work.stage(features(findings, known_words, ["k", "i"]).select(*FEATURES, "label"), "findings")
    if table.isEmpty():
        return None
    rows = table.repartition(1).sortWithinPartitions(*FEATURES, "label")
    forest = RandomForestClassifier(featuresCol="_x", labelCol="label", rawPredictionCol="_raw", probabilityCol="_p",
                                    predictionCol="_y", numTrees=trees, maxDepth=depth, seed=seed,
                                    featureSubsetStrategy="sqrt")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="_x"), forest]).fit(rows)


def with_score(rows: DataFrame, model: PipelineModel | None) -> DataFrame:
    """``rows`` with ``score``, the forest's probability of label 1 (0.5
    without a model; 0 if only label 0 was seen)."""
    if model is None:
        return rows.withColumn("score", F.lit(0.5))
    return (model.transform(rows).withColumn("score", F.coalesce(F.get(vector_to_array("_p"), F.lit(1)), F.lit(0.0)))
            .drop("_x", "_raw", "_p", "_y"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5,
         findings: DataFrame | None = None) -> DataFrame:
    """One row per candidate: ``doc_id, ordinal, start, candidate, score,
    is_secret`` (score from ``threshold`` up).

    ``findings``: labelled findings to learn from (``labelled_findings`` of
    the corpus by default).  Null and empty texts have no candidates; rows
    that repeat are scanned each; an empty table gives no rows; other columns
    are ignored.
    """
    work = Workspace(docs.sparkSession, "secrets")
    known = work.stage(dictionary(docs, text_col), "dictionary")
    model = fit_forest(labelled_findings(docs, id_col, text_col) if findings is None else findings, known)
    found = work.stage(candidates(docs, id_col, text_col), "candidates")
    return (with_score(features(found, known, ["row", "ordinal"]), model)
            .select("doc_id", "ordinal", "start", "candidate", "score", (F.col("score") >= threshold).alias("is_secret")))
