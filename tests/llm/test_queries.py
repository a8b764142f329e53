"""The registered queries: against DuckDB where SQL can express them."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from commitscope.llm import queries

from .conftest import SF

COLUMNS = {
    "op1": "doc_id size source_size target taken", "op2": "doc_id n_pieces ids decoded_sha256",
    "op3": "doc_id n_bytes n_removed n_spans kept_sha256 n_kept kept_text", "op4": "doc_id held_out score predicted",
    "op5": "doc_id ordinal start candidate score is_secret", "op6": "doc_id keep_id group_size kept text_sha256",
    "op7": "query_id rank vec_id score", "op8": "page_id url text n_chars",
    "op9": "page_id payload_bytes payload_digest record_type refers_to", "op10": "doc_id fingerprint component_id",
    "op11": "doc_id n_a n_b n_groups n_links groups_sha256 n_best count_sum",
    "op12": "vec_id component n deviation whitened explained identity_error deviation_digits",
    "op13": "doc_id n_email n_ip n_card n_phone base_sha256 spans"}


def test_registered_once_each():
    assert sorted(q.split("_")[0] for q in queries.QUERIES) == sorted(COLUMNS)
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r) for r in df.select(*names).collect()) == Counter(result.fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name.split("_")[0]].split() or set(df.columns) == set(COLUMNS[name.split("_")[0]].split())
    assert os.path.isdir(SF)
