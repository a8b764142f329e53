"""Patterns against plain regular expressions, disclosure against counts by hand."""

import hashlib
import math
import re
import time
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from commitscope.llm import private, queries

from .conftest import SF

# The contract's patterns.
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == 1:
        return all(int(p) <= 255 for p in text.split("."))
    if kind == 2:
        total = sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == 0 or 8 <= len(digits) <= 15


def brute_base(text):
    return [(k, *m.span()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if passes(k, m.group())]


def brute_near(text, spans, window):
    terms = [m.span() for m in re.finditer(r"\w+", text)
             if not any(a < m.end() and m.start() < b for _, a, b in spans)]
    out = []
    for s in spans:
        left = [t for t in terms if t[0] < s[1]][-window:]
        right = [t for t in terms if t[0] >= s[2]][:window]
        out += [(private.entity(text, s), text[a:b].lower(), a, b) for a, b in left + right]
    return out


def brute(texts, window=private.WINDOW, support=private.SUPPORT):
    texts = [t or "" for t in texts]
    base = [brute_base(t) for t in texts]
    near = [brute_near(t, s, window) for t, s in zip(texts, base)]
    held, both, words = Counter(), Counter(), Counter()
    for t, x in zip(texts, near):
        words.update({w.lower() for w in re.findall(r"\w+", t)})
        held.update({c for c, *_ in x})
        both.update({(c, w) for c, w, *_ in x})
    n, out = len(texts), []
    for s, x in zip(base, near):
        added = defaultdict(int)
        for c, w, a, b in x:
            if both[c, w] >= support and held[c] < n:
                share = math.log2(n * both[c, w] / (held[c] * words[w])) / math.log2(n / held[c])
                if share >= private.GENERALISE:
                    added[a, b] = max(added[a, b], 5 if share >= private.REMOVE else 4)
        out.append((s, sorted((k, a, b) for (a, b), k in added.items())))
    return out


def as_written(spans):
    return ",".join(f"{private.KINDS[k]}:{a}:{b}" for k, a, b in spans)


def test_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op13_private"](spark, SF).collect()}
    assert len(got) == len(docs)
    for r, (base, added) in zip(docs, brute([r.text for r in docs])):
        g = got[r.doc_id]
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(sum(s[0] == k for s in base) for k in range(4))
        assert g.base_sha256 == hashlib.sha256(as_written(base).encode()).hexdigest()
        assert g.spans == as_written(base + added)


@given(st.text(alphabet="a1.@-+ 9()_é4", max_size=60))
@settings(max_examples=1500, deadline=None)
def test_patterns(text):
    assert private.find_base(text) == brute_base(text)


@pytest.mark.parametrize("text", [
    "a@b.c_d@e.f", "a@b.c@d.e.f", "1.2.3.4.5.6.7.8", "256.1.1.1.1 01.002.3.255", "4111 1111 1111 1111 4111-1111-1111-1111",
    "+1 (555) 010-9999 x", "+1   ", "4111111111111111411111111111111141", "x@y", "@a.b", "٣.1.1.1 1.1.1.1"])
def test_corner_cases(text):
    assert private.find_base(text) == brute_base(text)


@pytest.mark.parametrize("unit", ["1", "a", "a@", "1.", "1 ", "+1 ", "a.", "@", ".-", "a@b.", "(+1"])
def test_long_texts_take_linear_time(unit):
    text = unit * (600_000 // len(unit))
    begin = time.process_time()
    private.find_base(text)
    assert time.process_time() - begin < 10


def test_terms_that_reveal_an_entity(spark):
    noise = [(k, f"word{k % 5} the and of report number{k}") for k in range(60)]
    told = [(100 + k, f"the report of Zorblax and x{k}@mail.org agent Zorblax the") for k in range(3)]
    same = [(200 + k, "the report of Quimby and boss@corp.example of the") for k in range(3)]
    docs = spark.createDataFrame(noise + told + same, "doc_id long, text string")
    found = {r.doc_id: r for r in private.private_spans(docs).collect()}
    text = dict(told + same)
    spans = {i: [(k, text[i][int(a):int(b)]) for k, a, b in (s.split(":") for s in found[i].spans.split(","))] for i in text}
    assert spans[200] == [("email", "boss@corp.example"), ("removed", "Quimby")]
    # Each address stands in one document: nothing is known about its terms.
    assert spans[100] == [("email", "x0@mail.org")]
    assert all(not found[i].spans for i, _ in noise)
    clean = {r.doc_id: r for r in private.sanitise(docs).collect()}
    assert clean[201].text == "the report of  and [EMAIL] of the" and clean[201].n_replaced == 2
    assert clean[5].text == noise[5][1]
    loose = {r.doc_id: r.spans for r in private.private_spans(docs, generalise=0.6, remove=1.1).collect()}
    assert "generalised" in loose[200] and "removed" not in loose[200]


def test_replacements():
    assert private.replaced("Bob 17 x a@b.c", [(4, 0, 3), (4, 4, 6), (5, 7, 8), (0, 9, 14)]) == "[NAME] [NUMBER]  [EMAIL]"
    assert private.replaced("+1 2.2.2.2 9", [(1, 3, 10), (3, 0, 12)]) == "[PHONE]"


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    got = Counter((r.doc_id, r.spans) for r in private.private_spans(odd_docs).collect())
    assert got == Counter((r.doc_id, as_written(b + a)) for r, (b, a) in zip(rows, brute([r.text for r in rows])))
    clean = Counter((r.doc_id, r.text) for r in private.sanitise(odd_docs).collect())
    assert clean == Counter((r.doc_id, r.text) for r in rows)  # nothing private in them
    assert private.private_spans(no_docs).count() == private.sanitise(no_docs).count() == 0
    everywhere = spark.createDataFrame([(k, "mail a@b.c now") for k in range(3)], "doc_id long, text string")
    assert {r.spans for r in private.private_spans(everywhere).collect()} == {"email:5:10"}
