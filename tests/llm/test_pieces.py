import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from commitscope.llm import pieces
from commitscope.llm.queries import piece_model

from .conftest import SF, odd_rows

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.read_model(MODEL))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts():
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz  .,\n0123456789AEIOéß漢\t-_/"
    return ["", "  ", " a  b ", "\n\n x\ty", "日本語テキスト😀", "▁▁x", "a" * 3000, "ab" * 2000, "<s></s><0x41>", "x\x00y",
            *(t[1] or "" for t in odd_rows()),
            *("".join(rng.choice(letters) for _ in range(rng.randint(1, 150))) for _ in range(500))]


def test_bpe_ids_equal_the_library(spark, model, library):
    texts = odd_texts() + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for text in texts:
        ids = model.encode(text)
        assert ids == library.encode(text)
        assert model.decode(ids) == library.decode(ids) == text.replace("▁", " ")


def test_border_rule_equals_the_merges(model):
    def merged(text):
        parts = list(text)
        while True:
            ranks = [model.rank.get(a + b, float("inf")) for a, b in zip(parts, parts[1:])]
            if not ranks or min(ranks) == float("inf"):
                return parts
            k = ranks.index(min(ranks))
            parts[k:k + 2] = [parts[k] + parts[k + 1]]

    rng = random.Random(3)
    known = [p for p in model.ids if p.isascii() and len(p) < 7]
    stable = 0
    for _ in range(4000):
        a, b = rng.choice(known), rng.choice(known)
        want = merged(a + b) == [a, b]
        assert model._border_holds(a, b) == want
        stable += want
    assert 200 < stable < 3800


def proto(entries, kind):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(number, body):
        return varint(number << 3 | 2) + varint(len(body)) + body

    out = b""
    for piece, score, t in entries:
        raw = piece.encode()
        out += message(1, message(1, raw) + varint(2 << 3 | 5) + struct.pack("<f", score) + varint(3 << 3) + varint(t))
    return out + message(2, varint(3 << 3) + varint(kind)) + message(3, varint(3 << 3) + b"\x01" + varint(4 << 3) + b"\x00")


def test_unigram_viterbi_equals_all_segmentations():
    rng = random.Random(4)
    for trial in range(30):
        vocabulary = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(8)} | {"▁", "▁a"}
        scores = {p: float(-rng.randint(1, 4000)) / 64 for p in vocabulary}
        model = pieces.Pieces(proto([("<unk>", 0.0, 2)] + [(p, s, 1) for p, s in scores.items()], 1))

        def total(parts):
            return sum(scores.get(p, model.unknown_score) for p in parts)

        def ways(text):
            if not text:
                yield []
            for n in range(1, len(text) + 1):
                if text[:n] in scores or n == 1:
                    for rest in ways(text[n:]):
                        yield [text[:n], *rest]

        for _ in range(10):
            text = "▁" + "".join(rng.choice("ab c") for _ in range(rng.randint(1, 9))).replace(" ", "▁")
            best = max(map(total, ways(text)))
            back = model._best_ways(text, [0, *(model.char_ids.get(c) or ~ord(c) for c in text)])
            got, p = [], len(text)
            while p:
                got.append(text[p - back[p]:p])
                p -= back[p]
            assert total(got[::-1]) == pytest.approx(best)


def test_unsupported_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Pieces(proto([("<unk>", 0.0, 2), ("a", -1.0, 4)], 1))


def test_encode_and_decode_tables(odd_docs, no_docs, library):
    rows = pieces.decode(pieces.encode(odd_docs, MODEL), MODEL).collect()
    want = sorted(((r.doc_id, library.encode(r.text or ""), r.text or "") for r in odd_docs.collect()), key=str)
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in rows), key=str) == want
    assert all(r.n_pieces == len(r.ids) for r in rows)
    assert pieces.encode(no_docs, MODEL).count() == 0


def test_many_texts_at_once_are_encoded_as_alone():
    model = pieces.load(pieces.read_model(piece_model()))
    texts = [r[1] for r in odd_rows()]
    ids, offsets = model.encode_many(texts)
    alone = [pieces.Pieces(pieces.read_model(piece_model()))._segment(model.normalize(t or "")) for t in texts[:6]]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])][:6] == [list(x) for x in alone]
    assert model.decode_many(ids, offsets) == [t or "" for t in texts]
    none, nowhere = model.encode_many([])
    assert len(none) == 0 and nowhere.tolist() == [0]


def test_a_full_table_starts_anew(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_SEGMENTS", 3)
    model = pieces.Pieces(pieces.read_model(piece_model()))
    first = [model.encode("one two three four five") for _ in range(3)]
    assert first[0] == first[1] == first[2]


def test_decode_replaces_a_column_of_its_name(spark):
    encoded = spark.createDataFrame([(1, [1, 2], "old"), (2, None, "x")], "doc_id long, ids array<int>, decoded string")
    out = pieces.decode(encoded, piece_model())
    assert out.columns == ["doc_id", "ids", "decoded"]
    assert {r.doc_id: r.decoded for r in out.collect()}[2] is None
