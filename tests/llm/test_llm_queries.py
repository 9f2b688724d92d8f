"""The registered queries: columns of their contracts, and SQL where there is some."""

import glob
import os

import duckdb
import pytest

from sparkloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
COLUMNS = {
    "op1": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op2": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op3": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op5": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op6": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op7": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op8": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op9": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op10": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    found = queries.QUERIES[name](spark, SF)
    assert dict(found.dtypes) == COLUMNS[name.split("_")[0]]
    rows = sorted(repr(tuple(r)) for r in found.select(*sorted(found.columns)).collect())
    assert rows
    if name in queries.ORACLE_SQL:
        duck = duckdb.connect()
        for path in glob.glob(f"{SF}/*.parquet"):
            duck.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
        result = duck.execute(queries.ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        order = [names.index(c) for c in sorted(found.columns)]
        assert rows == sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())
