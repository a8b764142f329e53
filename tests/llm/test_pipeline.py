import hashlib
import os
import subprocess
import sys

import pytest

import corpus_pipeline
from commitscope.llm import quality
from commitscope.llm.common import Workspace

from .conftest import SF
from .test_simhash import brute_components, brute_fingerprint

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    work = Workspace(spark, "test")
    tables, at = [docs], docs
    for name, stage in corpus_pipeline.STAGES:
        at = work.stage(stage(spark, at, SF), name)
        tables.append(at)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "simhash", "mixing", "pieces"]
    assert all(t.columns == docs.columns for t in tables[:-1])
    rows = [t.collect() for t in tables]
    # Quality: what the scores say, and clean labelled documents stay.
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}
    assert {r.doc_id for r in rows[1]} == good and 0 < len(good) < len(rows[0])
    # Exact: the largest id of each text.
    best = {}
    for r in rows[1]:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in rows[2]) == sorted(best.values())
    # Near: the smallest id of each component.
    order = sorted(rows[2], key=lambda r: r.doc_id)
    roots = brute_components([brute_fingerprint(r.text) for r in order], 2)
    least = {}
    for r, root in zip(order, roots):
        least.setdefault(root, r.doc_id)
    assert sorted(r.doc_id for r in rows[3]) == sorted(least.values())
    # Mixing: whole rows, three times at most.
    text = {r.doc_id: r.text for r in rows[3]}
    taken = [r.doc_id for r in rows[4]]
    assert all(r.text == text[r.doc_id] for r in rows[4]) and max(map(taken.count, set(taken))) <= 3
    # Pieces: each row round trips.
    assert sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in rows[4]) == sorted(
        (r.doc_id, r.decoded_sha256) for r in rows[5])


def test_run_agrees_with_itself(spark):
    a, b = (sorted(map(str, corpus_pipeline.run(spark, SF).collect())) for _ in range(2))
    assert a == b and a


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs, stage):
    name, function = corpus_pipeline.STAGES[stage]
    for docs in (odd_docs, no_docs):
        out = function(spark, docs, SF)
        rows = out.collect()
        assert stage == 4 or out.columns == docs.columns
        assert docs is odd_docs or not rows


def test_entry_works_without_the_package():
    script = ("import sys, importlib.abc\n"
              "class Hide(importlib.abc.MetaPathFinder):\n"
              "    def find_spec(self, name, path=None, target=None):\n"
              "        if name in ('commitscope.llm', 'corpus_pipeline'):\n"
              "            raise ModuleNotFoundError(name=name)\n"
              "sys.meta_path.insert(0, Hide())\n"
              "import __spark_entry__ as e\n"
              "assert e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())\n"
              "assert set(e.oracle_sql()) <= set(e.queries())\n")
    subprocess.run([sys.executable, "-c", script], cwd=REPO, check=True, timeout=120)
