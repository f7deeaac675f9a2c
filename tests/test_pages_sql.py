"""Page queries against their SQL on pages made for it."""

import duckdb

import __spark_entry__ as entry


def test_page_gates_count_text_as_the_sql_does(spark, tmp_path):
    # Block tags leave a line end on either side: 1,201 characters with the marks, 1,199 without them.
    pages = [(1, "u", "<p>&quot;" + "a" * 1197 + "&quot;</p>"), (2, "u", "<p>" + "a" * 1200 + "</p>"), (3, "u", "<p>&#39;" + "a" * 1198 + "&amp;</p>"), (4, "u", ""), (5, "u", "<p>" + "&quot;" * 90 + "a" * 30 + "</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = entry.queries()["page_gates"](spark, str(tmp_path))
    want = con.sql(entry.oracle_sql()["page_gates"])
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=lambda r: r[0]) == sorted(want.fetchall(), key=lambda r: r[0])
