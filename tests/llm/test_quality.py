import zlib

import numpy as np

from commitscope.llm import quality

SF_LARGER = "/root/testdata/sf0.01"


def test_trees_learn_and_flat_arrays_match_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    model = quality.fit_trees(x, y, trees=60, depth=3)
    p = quality.score_rows(model, x)
    assert ((p > 0.5) == y).mean() > 0.97
    for i in range(50):
        raw = model.base
        for t in range(len(model.leaf)):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + (2 if x[i, model.feature[t, node]] > model.cut[t, node] else 1)
            raw += model.leaf[t, node - (model.leaf.shape[1] - 1)]
        assert abs(p[i] - 1 / (1 + np.exp(-raw))) < 1e-12


def test_one_class_and_no_rows_give_a_constant():
    x = np.zeros((4, len(quality.STATISTICS)))
    assert np.ptp(quality.score_rows(quality.fit_trees(x, np.ones(4)), x)) == 0
    assert quality.score_rows(quality.fit_trees(x[:0], np.ones(0)), x).tolist() == [0.5] * 4


def test_held_out_accuracy_and_columns(spark):
    docs = spark.read.parquet(f"{SF_LARGER}/documents.parquet")
    labels = spark.read.parquet(f"{SF_LARGER}/labels.parquet")
    model = quality.train(docs, labels)
    rows = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows.values())
    assert all(r.predicted == int(r.score >= 0.3) for r in rows.values())
    held = [(rows[r.doc_id].predicted, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([p == q for p, q in held]) > 0.97
    # Held-out labels never reach the training.
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality "
                                          "END AS quality", "toxic")
    again = quality.train(docs, flipped)
    assert (again.leaf == model.leaf).all() and (again.cut == model.cut).all()


def test_nulls_repeats_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (4, 0), (5, 0), (None, 1), (7, None), (99, 1), (11, 0), (3, 1)],
                                   "doc_id long, quality int")
    model = quality.train(odd_docs, labels)
    rows = quality.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    by_text = {}
    for r, d in zip(sorted(rows, key=str), sorted(rows, key=str)):
        by_text.setdefault(r.doc_id, set()).add(r.score)
    assert len(by_text[1]) == 1
    kept = quality.keep_good(odd_docs, model)
    assert kept.dtypes == odd_docs.dtypes
    assert kept.count() == sum(r.predicted for r in rows)
    assert quality.score(no_docs, model).count() == 0 and quality.keep_good(no_docs, model).count() == 0
    nothing = quality.train(no_docs, labels.limit(0))
    assert quality.score(odd_docs, nothing).filter("score <> 0.5 or predicted <> 1").count() == 0
