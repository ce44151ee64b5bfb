"""page_identities and its SQL over titles with references of all kinds."""

import datetime
from decimal import Decimal

import duckdb

import __spark_entry__

TITLES = [
    "Plain  title", "a &amp; b &lt;c&gt;", "cut &amp;&amp", "said &quot;so&quot;", "one&nbsp;two three", "&copyleft &notit; &notin;", "&unknown; &amp;lt; &", "&#65;&#x42;&#x80;&#0;&#xD800;&#1;&#99999999999;&#11;x",
    "&NotEqualTilde; &#38;amp;", "", "&nbsp;", "none", "it's &apos;s&apos;", "déjà\tvu &eacute &EACUTE;",
]


def test_titles_by_both_sides(spark, tmp_path):
    pages = [(i, f"u{i}", f"<html><body><h1>{t}</h1><p>x</p></body></html>") for i, t in enumerate(TITLES)] + [(90, "u", None), (91, "u", "<p>no title</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    line = (1, 8, Decimal("100.00"), Decimal("0.05"), Decimal("0.02"), Decimal("3.00"), "F", "A", 1, datetime.date(1995, 5, 1))
    columns = "l_orderkey long, l_suppkey long, l_extendedprice decimal(15,2), l_discount decimal(15,2), l_tax decimal(15,2), l_quantity decimal(15,2), l_linestatus string, l_returnflag string, l_linenumber int, l_shipdate date"
    spark.createDataFrame([line], columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for name in ("pages", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = {r[0]: r[1:] for r in con.execute(__spark_entry__.oracle_sql()["page_identities"]).fetchall()}
    got = {r.page_id: tuple(r)[1:] for r in __spark_entry__.queries()["page_identities"](spark, str(tmp_path)).collect()}
    assert got == want
    assert [got[-1 - i][0] for i in (2, 3)] == ["cut &&", 'said "so"'] and got[-91][1:] == (None, None, "no company name")
