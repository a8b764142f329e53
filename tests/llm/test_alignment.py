"""Alignment against the two libraries and plain sets of end offsets."""

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from commitscope.llm import alignment, queries

from .conftest import SF

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIELDS = "n_a n_b n_groups n_links groups_sha256 n_best count_sum".split()


@pytest.fixture(scope="module")
def libraries():
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=B)


def spelled(libraries, text):
    one, two = libraries
    letters = alignment.byte_letters()
    a = one.encode(" " + text, add_special_tokens=False).ids
    b = two.encode(text)
    bytes_a = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i)
               else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
    return a, b, bytes_a, bytes_b


def brute_groups(libraries, text):
    if not text:
        return []
    a, b, bytes_a, bytes_b = spelled(libraries, text)
    if not (b"".join(bytes_a) == (" " + text).encode() == b"".join(bytes_b)):
        return []

    def ends(parts):
        out, at = [], 0
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    ends_a, ends_b = ends(bytes_a), ends(bytes_b)
    cuts = sorted(set(ends_a) & set(ends_b))
    groups = [([], []) for _ in cuts]
    for side, (ids, where) in enumerate(((a, ends_a), (b, ends_b))):
        for i, e in zip(ids, where):
            groups[bisect_left(cuts, e)][side].append(i)
    return groups


def brute(libraries, texts):
    groups = [brute_groups(libraries, t) for t in texts]
    links = [[(x, y) for a, b in g for x in a for y in b] for g in groups]
    count = Counter(p for x in links for p in set(x))
    highest = defaultdict(int)
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    out = []
    for g, x in zip(groups, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(x),
                    hashlib.sha256(text.encode()).hexdigest() if g else "",
                    sum(count[p] == highest[p[0]] for p in x), sum(count[p] for p in x)))
    return out


@given(st.lists(st.tuples(st.integers(1, 3), st.booleans(), st.booleans()), max_size=60))
@settings(max_examples=200, deadline=None)
def test_runs_are_all_shared_ends(steps):
    a, b, at = [], [], 0
    for size, left, right in steps:
        at += size
        a += [at] * left
        b += [at] * right
    for ends in (a, b):
        ends.append(at + 1)
    runs = alignment.shared_runs(a, b)
    found = [(i + k, j + k) for i, j, n in runs.tolist() for k in range(n)]
    assert found == [(a.index(x), b.index(x)) for x in sorted(set(a) & set(b))]


def test_table_against_brute_force(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in queries.QUERIES["op11_alignment"](spark, SF).collect()}
    assert got == dict(zip((r.doc_id for r in docs), brute(libraries, [r.text for r in docs])))


def test_small_blocks_and_large_groups_change_nothing(spark, libraries, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).cache()
    whole = sorted(map(str, alignment.link_counts(docs, A, B).collect()))
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 500)
    monkeypatch.setattr(alignment, "EXPANDED", 1)
    texts = [r.text for r in docs.collect()]
    one, two, names = alignment._load(open(A, "rb").read(), open(B, "rb").read())
    x = alignment.Aligned(texts, one, two)
    text, pair, times = x.pairs(len(two.pieces))
    want = Counter((k, a * len(two.pieces) + b) for k, t in enumerate(texts) for ga, gb in brute_groups(libraries, t)
                   for a in ga for b in gb)
    assert dict(zip(zip(text.tolist(), pair.tolist()), times.tolist())) == want
    assert sorted(map(str, alignment.link_counts(docs, A, B).collect())) == whole
    docs.unpersist()


def test_odd_texts(spark, libraries):
    texts = ["", None, " ", "  a  b\n\n c ", "▁mark", "<s> </s> <|endoftext|>", "日本語 😀 é é", "a\u0000b",
             "x" * 9000, "\t" * 5000 + "end", "don't we'll  it's", "𝔘𝔫𝔦" * 30, "ab" * 400 + "é" * 300]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in alignment.link_counts(docs, A, B).collect()}
    assert [got[k] for k in range(len(texts))] == brute(libraries, texts)
    assert got[0] == got[1] == got[4] == (0, 0, 0, 0, "", 0, 0)
    plain = {r.doc_id: r.groups for r in alignment.align(docs, A, B).collect()}
    assert all(hashlib.sha256(plain[k].encode()).hexdigest() == got[k][4] or not plain[k] for k in plain)


def test_odd_and_empty_tables(spark, odd_docs, no_docs, libraries):
    rows = odd_docs.collect()
    got = Counter((r.doc_id, *(r[f] for f in FIELDS)) for r in alignment.link_counts(odd_docs, A, B).collect())
    assert got == Counter((r.doc_id, *x) for r, x in zip(rows, brute(libraries, [r.text for r in rows])))
    assert alignment.link_counts(no_docs, A, B).count() == alignment.align(no_docs, A, B).count() == 0
    clash = odd_docs.selectExpr("doc_id", "text", "1 AS block", "2 AS pair", "3 AS `to`", "4 AS total")
    assert alignment.link_counts(clash, A, B).count() == len(rows)
