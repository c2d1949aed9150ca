"""The operators that SQL can express give the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

from kilnspark.llm import queries, urls

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = duck.sql(queries.oracle_sql()[name]).select(", ".join(got.columns)).fetchall()
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, want))


def test_linked_pages_by_sql(spark):
    pages = [
        (1, "http://shop.net/a", '<LINK href="http://b.example.org/es/y" rel="canonical">'),
        (2, "http://shop.net/b", "<meta http-equiv='refresh' content='0; url=/a'>"),
        (3, "http://x.net/", "<link rel=canonical href=//q.com/fr/1>"),
        (4, "http://x.net/#f", "<link rel=canonical href=http://q.com/de/1>"),
        (5, None, None),
    ]
    duck = duckdb.connect()
    frame = pd.DataFrame(pages, columns=["page_id", "url", "html"])
    duck.register("pages", frame)
    want = sorted(duck.sql(queries.oracle_sql()["op9_url_filters"]).select("page_id, verdict").fetchall())
    got = sorted((r["page_id"], r["verdict"]) for r in urls.url_report(spark.createDataFrame(pages, "page_id long, url string, html string")).collect())
    assert got == want == [(1, "block"), (2, "block"), (3, "allow"), (4, "allow"), (5, "allow")]
