"""Blank and null documents among others: these queries give the rows that DuckDB gives for their SQL."""

import duckdb
import pytest

from kilnspark import queries as library

QUERIES, ORACLES = library.queries(), library.oracle_sql()
TEXTS = ["Some words go here.\nMore words go there.", "", " ", "\n", " \n\n ", None, "w " * 1397 + "w", "", "End."]


@pytest.fixture(scope="module")
def blank(tmp_path_factory):
    folder = tmp_path_factory.mktemp("blank")
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?, 'src0')", [[i, t] for i, t in enumerate(TEXTS)])
    connection.execute(f"COPY documents TO '{folder}/documents.parquet' (FORMAT parquet)")
    return connection, str(folder)


def plain(row):
    return tuple("null" if v is None else str(v) for v in row)


@pytest.mark.parametrize("name", ["block_parse", "block_parse_markdown", "chunk_docs", "chunk_markdown"])
def test_blank_documents_keep_their_rows(spark, blank, name):
    connection, folder = blank
    want = connection.execute(ORACLES[name])
    columns, rows = [c[0] for c in want.description], want.fetchall()
    assert sorted(plain(r) for r in QUERIES[name](spark, folder).select(*columns).collect()) == sorted(map(plain, rows))
    assert {r[columns.index("doc_id")] for r in rows} == set(range(len(TEXTS)))
