import json

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from commitscope.operators import inference, prompts, quality, responses
from commitscope.plans import generate


def _group_row(spark, history, prompt):
    df = spark.createDataFrame(
        [("r", 1, "docs", [("README.md", "added", "diff --git a/README.md b/README.md\n+x\n")], True, "en",
          prompt, history)],
        "repo string, commit_id long, label string, files array<struct<path:string,change_type:string,"
        "diff:string>>, conventional boolean, prompt_language string, prompt string, history string")
    return df


def test_prompt_slots_and_empty_history(spark):
    text = prompts.group_prompts(_group_row(spark, None, "")).first().prompt_text
    assert prompts.HISTORY_RULE in text                  # the rule line stays
    assert prompts.HISTORY_HEAD not in text              # no history section
    assert prompts.USER_HEAD not in text                 # empty user text adds nothing
    assert "* added: README.md" in text and f"{prompts.PATCH}\n{prompts.FENCE}\n" in text
    text2 = prompts.group_prompts(_group_row(spark, "  - fix: x", "Be short.")).first().prompt_text
    assert prompts.HISTORY_HEAD + "\n  - fix: x" in text2 and text2.endswith(prompts.USER_HEAD + "\nBe short.")


def test_batch_prompt_states_count(spark):
    g = [("docs", [("a.md", "added", "d1")]), ("misc", [("x", "modified", "d2")])]
    df = spark.createDataFrame([("r", 1, g, False, "zh", None, None)],
                               "repo string, commit_id long, groups array<struct<label:string,files:array<struct<"
                               "path:string,change_type:string,diff:string>>>>, conventional boolean, "
                               "prompt_language string, prompt string, history string")
    text = prompts.batch_prompts(df).first().prompt_text
    assert "exactly 2 item(s)" in text and "Answer with 2 of these" in text
    assert text.index("Part: docs") < text.index("Part: misc")
    assert prompts.LANG_ZH in text and prompts.STYLE_PLAIN in text


def test_model_tiers(spark):
    models = spark.createDataFrame([
        (0, "m-a", "", "openai", "x", 1), (0, "m-b", "B", "copilot", "gpt-4o", 2),
        (1, "m-c", "C", "copilot", "other", 5), (1, "m-d", "D", "copilot", "other", 3),
        (2, "m-e", "E", "openai", "x", 9),
    ], "catalog_id int, id string, name string, vendor string, family string, cat_pos int")
    req = spark.createDataFrame([(1, 0, "m-a"), (2, 0, "nope"), (3, 1, None), (4, 2, ""), (5, 4, "m-a")],
                                "k int, catalog_id int, model string")
    got = {r.k: (r.model_id, r.model_name, r.tier, r.error)
           for r in inference.assign_model(req, models).collect()}
    assert got == {1: ("m-a", "m-a", 1, None), 2: ("m-b", "B", 2, None), 3: ("m-d", "D", 3, None),
                   4: ("m-e", "E", 4, None), 5: (None, None, None, inference.NO_MODEL_ERROR)}


def _parse(spark, raws, expected=None):
    df = spark.createDataFrame([(i, r, expected) for i, r in enumerate(raws)], "i int, raw string, n int")
    if expected is None:
        return [(r.message, r.reason, r.error) for r in responses.parse_object(df).orderBy("i").collect()]
    return [(r.items, r.error) for r in responses.parse_array(df, "n").orderBy("i").collect()]


def test_parse_object_rules(spark):
    got = _parse(spark, [
        'x ```json\n{"message": "m", "reason": "r"}\n```',     # fence not at line start: extraction
        'noise {"message": "m", "reason": "r"} tail',          # extraction
        '{"message": "a", "message": "b", "reason": "r"}',     # duplicate key: last wins
        "{'message': 'm', 'reason': 'r'}",                     # single quotes
        '{"message": NaN, "reason": "r"}',
        '{"message": "m", "reason": "r",}',                    # trailing comma
        '[{"message": "m", "reason": "r"}]',                   # array -> object via extraction
        '{"message": "\\ud800", "reason": "r"}',               # lone surrogate survives Arrow
        "x" * 1000,
    ])
    assert got[0][:2] == ("m", "r") and got[1][:2] == ("m", "r") and got[2][0] == "b"
    assert all(g[2] is not None for g in got[3:6])
    assert got[6][:2] == ("m", "r")
    assert got[7][0] == "�"
    assert got[8][2].endswith("x" * 300) and not got[8][2].endswith("x" * 301)


def test_parse_array_exact_count(spark):
    ok = json.dumps([{"message": "a", "reason": "r"}, {"message": "b", "reason": "s"}])
    got = _parse(spark, [ok, "```json\n" + ok + "\n```", ok + " trailing",
                         json.dumps([{"message": "a", "reason": "r"}, {"message": 1, "reason": "s"}])], 2)
    assert [len(g[0]) if g[0] else None for g in got] == [2, 2, 2, None]
    got3 = _parse(spark, [ok], 3)
    assert got3[0][0] is None and "expected array of 3" in got3[0][1]


def test_fences_kept_inside_a_line(spark):
    df = spark.createDataFrame([("a ``` b",), ("```json\nX\n```  \n",)], "raw string")
    assert [r[0] for r in df.select(responses.strip_fences("raw")).collect()] == ["a ``` b", "X"]


def test_assemble_any_order(spark):
    chunks = spark.createDataFrame([(1, 2, "c", True), (1, 0, "a", False), (1, 1, "b", False)],
                                   "request_id long, idx int, chunk string, is_last boolean")
    r = responses.assemble_chunks(chunks).first()
    assert (r.raw, r.chunks, r.complete) == ("abc", 3, True)


def test_infer_failure_becomes_rows(spark):
    prompt = F.when(F.col("id") != 5, F.concat(F.lit("p"), F.col("id")))
    df = spark.range(200).select(F.col("id").alias("k"), prompt.alias("prompt_text")).repartition(1)
    long = "boom" * 1000

    def flaky(batches):
        for b in batches:
            if {"p3", "p77"} & set(b):
                raise RuntimeError(long)
            yield pd.Series(["ok:" + p for p in b])

    def broken(batches):
        raise ValueError("no client")

    def short(batches):
        for b in batches:
            yield pd.Series(["ok:" + p for p in b][:10])

    def early(batches):
        yield pd.Series(["ok:" + p for p in next(batches)])

    def noisy(batches):
        yield pd.Series(["x"])
        yield pd.Series(["y"])

    def run(fn):
        return {r.k: (r.raw, r.infer_error) for r in inference.infer(df, fn, keys=["k"], slice_rows=16).collect()}
    want = {k: (f"ok:p{k}", None) if k != 5 else (None, None) for k in range(200)}
    bad = {k: (None, f"RuntimeError: {long}") for k in (3, 77)}
    assert run(flaky) == {**want, **bad}
    assert run(short) == want and run(early) == want
    assert run(broken) == {k: (None, None if k == 5 else "ValueError: no client") for k in range(200)}
    assert set(run(noisy).values()) == {(None, None), (None, "answer count 2 != prompt count 1")}


def test_infer_holds_few_prompts_at_once(spark):
    """Long prompts reach the function a few at a time, keys of any type and
    missing prompts beside them."""
    text = F.when(F.col("id") % 10 != 7, F.concat(F.lit("p"), F.col("id"), F.lit(":"), F.repeat(F.lit("中x"), 250_000)))
    df = (spark.range(30).select(F.col("id").alias("k"), F.array(F.array(F.col("id").cast("string"))).alias("files"),
                                 text.alias("prompt_text")).repartition(1))

    def sizes(batches):
        for b in batches:
            yield pd.Series([f"{p.split(':')[0]} {len(b)} {sum(len(x.encode()) for x in b)}" for p in b])

    got = {r.k: r for r in inference.infer(df, sizes).collect()}
    assert len(got) == 30 and all(got[k].files == [[str(k)]] and got[k].infer_error is None for k in got)
    assert all((got[k].raw is None) == (k % 10 == 7) for k in got)
    said = [r.raw.split() for r in got.values() if r.raw]
    assert {s[0] for s in said} == {f"p{k}" for k in range(30) if k % 10 != 7}
    assert max(int(s[2]) for s in said) < 5 << 20
    assert len({s[1] for s in said}) <= 5 and max(int(s[1]) for s in said) > 1


def test_generation_asks_few_long_prompts_at_once(spark):
    head = "diff --git a/src/m.ts b/src/m.ts\nindex 1111111..2222222\n--- a/src/m.ts\n+++ b/src/m.ts\n@@ -1,1 +1,1 @@\n"
    commits = spark.range(24).repartition(1).select(
        F.lit("r").alias("repo"), F.col("id").alias("commit_id"),
        F.concat(F.lit(head), F.repeat(F.lit("+line of code\n"), 40_000)).alias("raw_diff"))

    def context(snapshots):
        return snapshots.withColumns({"conventional": F.lit(True), "prompt_language": F.lit("en"),
                                      "prompt": F.lit(None).cast("string"), "history": F.lit("")})

    def model(batches):
        for b in batches:
            yield pd.Series([json.dumps([{"message": str(sum(map(len, b))), "reason": "r"}])] * len(b))

    cands, errors = generate.run_generation(commits, context, model)
    got = {r.commit_id: int(r.message) for r in cands.collect()}
    assert errors.count() == 0 and set(got) == set(range(24))
    assert 500_000 < min(got.values()) and max(got.values()) < 5 << 20


def test_model_and_validator_run_apart(spark, tmp_path):
    """A task never holds the workers of both: the answers are written before
    they are parsed, and no prompt is asked again when outcomes are read twice."""
    commits = spark.range(6).select(
        F.lit("r").alias("repo"), F.col("id").alias("commit_id"),
        F.concat(F.lit("diff --git a/m.ts b/m.ts\n+"), F.col("id"), F.lit("\n")).alias("raw_diff"))

    def context(snapshots):
        return snapshots.withColumns({"conventional": F.lit(True), "prompt_language": F.lit("en"),
                                      "prompt": F.lit(None).cast("string"), "history": F.lit("")})

    asked = str(tmp_path)

    def model(batches):
        import tempfile
        for b in batches:
            for _ in b:
                tempfile.mkstemp(dir=asked)
            yield pd.Series([json.dumps([{"message": "m", "reason": "r"}])] * len(b))

    outcome = generate.snapshot_outcomes(commits, context, model)
    plan = outcome._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    for _ in range(2):
        assert sorted(r.commit_id for r in outcome.collect() if r.error is None) == list(range(6))
    assert len(list(tmp_path.iterdir())) == 6


def test_infer_answers_that_are_no_text(spark):
    df = spark.range(40).select(F.col("id").alias("k"), F.concat(F.lit("p"), F.col("id")).alias("prompt_text")).repartition(1)

    def odd(batches):
        for b in batches:
            yield pd.Series([7 if p == "p1" else "\ud800" if p == "p2" else None if p == "p3" else p for p in b], dtype=object)

    got = {r.k: (r.raw, r.infer_error) for r in inference.infer(df, odd, slice_rows=8).collect()}
    assert got[1] == ("7", None) and got[3] == (None, None)
    assert got[2][0] is None and got[2][1].startswith("UnicodeEncodeError")
    assert all(got[k] == (f"p{k}", None) for k in range(40) if k not in (1, 2, 3))


@pytest.mark.parametrize("texts, rows, size, want", [
    ([], 4, 10, []), (["a"] * 5, 2, 100, [(0, 2), (2, 2), (4, 1)]), (["a" * 30, "b", None, "c" * 9, "d"], 4, 10, [(0, 1), (1, 3), (4, 1)]),
    ([None] * 3, 2, 1, [(0, 2), (2, 1)]), (["a" * 10, "b" * 10], 9, 10, [(0, 1), (1, 1)])])
def test_slices_by_rows_and_bytes(texts, rows, size, want):
    assert list(inference._slices(pa.array(texts, pa.string()), rows, size)) == want


def test_quality_flags(spark):
    df = spark.createDataFrame([("feat(x): " + "a" * 62, "Why. Because."), ("a" * 72, "No end"),
                                ("fix: 中文中文", "One.")], "message string, reason string")
    got = [(r.under_limit, r.conventional, r.has_scope, r.language, r.reason_ok)
           for r in quality.message_quality(df).collect()]
    assert got == [(True, True, True, "en", True), (False, False, False, "en", False),
                   (True, True, False, "zh", True)]


def test_cancelled_runs_are_not_errors(spark):
    parsed = spark.createDataFrame([(1, "bad"), (2, "bad"), (3, None)], "k int, error string")
    cancelled = spark.createDataFrame([(2,)], "k int")
    assert [r.k for r in responses.response_errors(parsed, ["k"], cancelled).collect()] == [1]
