import random

import pytest

SF = "/root/testdata/sf0.001"
DOCS = ("doc_id long, text string, lang string, source string, n_chars long, id long, h long, k long, fp long, "
        "size long, bucket int, keep_id long, owner int, draws string, _mix int, shard int, word string, row long")


def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, and
    columns named like the operators' own."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "The", "AND", "über", "日本"]
    long_text = " ".join(rng.choice(words) + str(rng.randint(0, 9)) for _ in range(6000))
    base = " ".join(rng.choice(words) for _ in range(120))
    texts = {1: base, 2: base, 3: base + " omega", 4: "", 5: None, 6: "  \n\t ", 7: long_text, 8: long_text + "!",
             9: "one", 10: "one two", 11: "x" * 900, 12: "日本語 テキスト 😀 test", 13: "one"}
    rows = [(i, t, "en", f"s{i % 3}") for i, t in texts.items()]
    rows += [(1, base, "en", "s1"), (1, base, "en", "s1"), (None, base, None, None), (None, None, None, None),
             (14, "null source", None, None), (9, "another text of the same id", "en", "s0")]
    return [(*r, len(r[1] or ""), 1, 2, 3, 4, 5, 6, 7, 8, "d", 9, 10, "w", 11) for r in rows]


@pytest.fixture(scope="session")
def odd_docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows(), DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
