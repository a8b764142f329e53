import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from commitscope.llm import repeats

from .conftest import SF


def brute(texts, length):
    count = Counter(d[i:i + length] for d in texts for i in range(len(d) - length + 1))
    out = []
    for d in texts:
        gone = np.zeros(len(d) + 1, dtype=int)
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0 if len(d) else np.zeros(0, dtype=bool)
        left = bytes(b for b, g in zip(d, gone) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdeé \n"
    passage = "".join(rng.choice(letters) for _ in range(130))
    other = "".join(rng.choice(letters) for _ in range(60))
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    out = [text(rng.randint(0, 120)) for _ in range(15)]
    out += [text(rng.randint(0, 40)) + passage[rng.randint(0, 60):rng.randint(70, 130)] + text(rng.randint(0, 40))
            for _ in range(40)]
    out += [text(30) + other + text(20) + other + text(9), "abab" * 60, "x" * 200, passage, passage + passage]
    out += [(text(6) * 20) + text(30) for _ in range(3)]  # repeats within one stretch of text
    out += [out[3], out[20], out[20], "", text(39), text(40)]
    return out


@pytest.mark.parametrize("crowd", [512, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed, crowd):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = repeats.remove_repeats(docs, length=40, gram=20, crowd=crowd).orderBy("doc_id").collect()
    want = brute([t.encode() for t in texts], 40)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == want
    assert all(sum(s.b - s.a for s in r.removed) == r.n_removed for r in rows)


@pytest.mark.parametrize("seed", range(6))
def test_transform_finds_all_shared_windows(seed):
    rng = random.Random(seed)
    parts = [bytes(rng.choice(b"ab" if seed % 2 else b"abcdefg\0\xff") for _ in range(rng.randint(0, 60))) for _ in range(12)]
    parts += [parts[0][5:40] + parts[1], parts[2] * 2, b"a" * 50, b"a" * 12]
    for length in (8, 9, 17):
        count = Counter(p[i:i + length] for p in parts for i in range(len(p) - length + 1))
        got = repeats.repeated_windows(parts, length)
        assert [list(g) for g in got] == [[count[p[i:i + length]] > 1 for i in range(max(0, len(p) - length + 1))]
                                          for p in parts]


def test_segments_cover_windows_and_share_names():
    rng = random.Random(9)
    a = bytes(rng.randrange(256) for _ in range(3000))
    b = bytes(rng.randrange(256) for _ in range(700)) + a[500:1500] + b"tail" * 200

    def names(data):
        first, last, name, _ = repeats.segments(data, 400, 200)
        assert first[0] == 0 and last[-1] == len(data) - 400 and (first[1:] == last[:-1] + 1).all()
        assert (last - first < 201).all()
        return np.repeat(name, last - first + 1)

    assert (names(a)[500:1101] == names(b)[700:1301]).all()
    assert len(set(names(a).tolist())) > 15  # names tell windows apart
    assert [len(x) for x in repeats.segments(b"short")] == [0, 0, 0, 0]


def test_nulls_repeats_and_empty_tables(odd_docs, no_docs):
    rows = repeats.remove_repeats(odd_docs).collect()
    texts = [(r.doc_id, (r.text or "").encode()) for r in odd_docs.collect()]
    want = Counter((i, *x) for (i, _), x in zip(texts, brute([t for _, t in texts], 400)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == want
    assert repeats.remove_repeats(no_docs).count() == 0
    for r in rows:
        assert r.n_kept == r.n_bytes - r.n_removed
        assert r.n_removed or hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_table_against_brute_force_at_full_length(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    want = {i: x for (i, _), x in zip(texts, brute([t for _, t in texts], 400))}
    got = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == want
    assert any(r.n_removed and r.n_kept for r in got.values())
    for i, data in texts:
        kept = repeats.without(data, [(x.a, x.b) for x in got[i].removed])
        assert got[i].kept_text == bytes(kept).decode("utf-8", "replace") and got[i].n_kept == len(kept)
