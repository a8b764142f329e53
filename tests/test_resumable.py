"""Answer ledger, balanced inference, keyed sink, splittable logs."""

import glob
import os
import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from commitscope.operators import ledger
from commitscope.sources import readers


def _recording(folder):
    """A model that leaves a file for each prompt it is asked."""
    def fn(batches):
        for prompts in batches:
            for p in prompts:
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write(p)
                if p.startswith("bad"):
                    raise ValueError("no")
            yield pd.Series([f"answer to {p}" for p in prompts])
    return fn


def _asked(folder):
    return sorted(open(f).read() for f in glob.glob(f"{folder}/*"))


def test_a_broken_run_asks_only_what_is_open(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "asked")
    os.mkdir(folder)
    rows = [(k, f"prompt {k % 40}", "m1" if k % 2 else "m2") for k in range(120)] + [(500, None, "m1")]
    prompts = spark.createDataFrame(rows, "id long, prompt_text string, model_id string").repartition(8).checkpoint()
    book = ledger.AnswerLedger(spark, str(tmp_path / "ledger"), waves=4)
    whole, waves = ledger.AnswerLedger._ask_wave, []

    def breaks(self, *args):
        waves.append(1)
        if len(waves) == 3:
            raise KeyboardInterrupt
        whole(self, *args)

    monkeypatch.setattr(ledger.AnswerLedger, "_ask_wave", breaks)
    with pytest.raises(KeyboardInterrupt):
        book.ask(prompts, _recording(folder), tasks=2)
    first = _asked(folder)
    assert 0 < len(first) < 40
    monkeypatch.setattr(ledger.AnswerLedger, "_ask_wave", whole)
    got = ledger.AnswerLedger(spark, str(tmp_path / "ledger"), waves=4).ask(prompts, _recording(folder), tasks=2)
    assert {r.id: r.raw for r in got.collect()} == {k: p and f"answer to {p}" for k, p, _ in rows}
    assert len(_asked(folder)) == 40 == len({(p, m) for _, p, m in rows if p})  # each prompt of a model once
    book.ask(prompts, _recording(folder), tasks=2)
    assert len(_asked(folder)) == 40


def test_models_answer_apart_and_errors_are_asked_again(spark, tmp_path):
    folder = str(tmp_path / "asked")
    os.mkdir(folder)
    prompts = spark.createDataFrame([(1, "same", "a"), (2, "same", "b"), (3, "bad one", "a"), (4, "same", None)],
                                    "id long, prompt_text string, model_id string")
    book = ledger.AnswerLedger(spark, str(tmp_path / "ledger"), waves=4)
    got = {r.id: (r.raw, r.infer_error) for r in book.ask(prompts, _recording(folder), tasks=1).collect()}
    assert got[1] == got[2] == got[4] == ("answer to same", None) and got[3] == (None, "ValueError: no")
    asked = _asked(folder)
    good = lambda batches: (pd.Series(["fine"] * len(b)) for b in batches)
    got = {r.id: (r.raw, r.infer_error) for r in book.ask(prompts, good, tasks=1).collect()}
    assert got[3] == ("fine", None) and got[1] == ("answer to same", None) and _asked(folder) == asked


def test_tasks_get_prompts_of_equal_length(spark):
    rng = random.Random(2)
    rows = [(k, "x" * int(min(4000, 20 * rng.paretovariate(0.9)))) for k in range(4000)]
    prompts = spark.createDataFrame([(k, f"{k} {p}") for k, p in rows], "id long, prompt_text string")
    dealt = ledger.balanced(prompts, 4).withColumn("task", F.spark_partition_id())
    sizes = [r.n for r in dealt.groupBy("task").agg(F.sum(F.length("prompt_text")).alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) <= 1.2 * sum(sizes) / 4
    assert dealt.count() == 4000 and dealt.drop("task").columns == prompts.columns
    assert ledger.balanced(prompts.limit(0), 4).count() == 0


def test_keyed_sink_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "table")
    first = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None), (None, 1, "n")], "repo string, id long, v string")
    for _ in range(2):
        readers.upsert_table(first, path, ["repo", "id"], buckets=4)
    assert sorted(map(str, readers.read_upserted(spark, path).collect())) == sorted(map(str, first.collect()))
    files = len(glob.glob(f"{path}/*/*.parquet"))
    second = spark.createDataFrame([("a", 2, "new"), ("a", 2, "older"), ("c", 9, "z"), (None, 1, "m")], first.schema)
    for _ in range(2):
        readers.upsert_table(second.withColumn("rank", F.length("v")).drop("rank"), path, ["repo", "id"], newest="v", buckets=4)
    got = {(r.repo, r.id): r.v for r in readers.read_upserted(spark, path).collect()}
    assert got == {("a", 1): "x", ("a", 2): "older", ("b", 1): None, (None, 1): "m", ("c", 9): "z"}
    assert len(glob.glob(f"{path}/*/*.parquet")) <= files + 1  # old versions are gone
    readers.upsert_table(second.limit(0), path, ["repo", "id"], buckets=4)
    assert readers.read_upserted(spark, path).count() == 5


def _whole(text):
    from commitscope.functions.js import JS_WS_CHARS
    return list(enumerate(text.strip(JS_WS_CHARS).split("\n")))


def test_logs_are_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    texts = {"org1/a": "\n \n  " + "\n".join(f"line {k} " + "é" * rng.randint(0, 30) for k in range(300)) + "  \n\n\t\n",
             "org2/a": "one\n\n\ntwo\r\n\u3000\nthree", "b": "  \n\n ", "org2/deep/c.x": "x\x85y\u2028z\n" * 40}
    for name, text in texts.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/logs/{name}"), exist_ok=True)
        with open(f"{tmp_path}/logs/{name}.log", "w", newline="", encoding="utf-8") as f:
            f.write(text)
    want = sorted((repo, k, line) for repo, t in texts.items() for k, line in _whole(t))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("200b", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            logs = readers.read_log_text(spark, f"{tmp_path}/logs/*/*.log").unionByName(
                readers.read_log_text(spark, f"{tmp_path}/logs/*.log")).unionByName(
                readers.read_log_text(spark, f"{tmp_path}/logs/*/*/*.log"))
            if size == "200b":
                parts = spark.read.text(f"{tmp_path}/logs/org1/a.log", lineSep="\n").rdd.getNumPartitions()
                assert parts > 5
            assert sorted(map(tuple, logs.collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
