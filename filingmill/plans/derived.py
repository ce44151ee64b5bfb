"""Report tables derived from the given star schema, so that every registered query grows with its input.

A supplier is a company; its fiscal years end in March. Line items are sums over its order lines. The SQL twin of each table
is beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import unit_of

ITEMS = (
    ("profit_loss", "Sales", "l_extendedprice * (1 - l_discount)", "true"),
    ("profit_loss", "Net Profit", "l_extendedprice * (l_discount - 0.04)", "true"),
    ("balance_sheet", "Equity Capital", "l_extendedprice * 0.1", "l_linestatus = 'F'"),
    ("balance_sheet", "Reserves", "l_extendedprice * l_tax", "l_returnflag = 'A'"),
    ("balance_sheet", "Borrowings", "l_extendedprice * l_tax", "l_returnflag = 'R'"),
    ("cash_flow", "Free Cash Flow", "l_extendedprice * (l_discount - l_tax)", "true"),
    ("profit_loss", "OPM %", "l_quantity", "l_linenumber = 1"),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fy() -> Column:
    return F.year("l_shipdate") + F.when(F.month("l_shipdate") > 3, 1).otherwise(0)


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """statement, company_id, line_item, period_label, fiscal_year_end, value (null: not disclosed), unit. One shuffle."""
    total = lambda e, cond: F.sum(F.when(F.expr(cond), F.expr(e).cast("decimal(18,4)"))).cast("double")
    lines = read(spark, sf_dir, "lineitem")
    sums = lines.groupBy(F.col("l_suppkey").alias("company_id"), _fy().alias("fy")).agg(*(total(e, c).alias(f"v{i}") for i, (_, _, e, c) in enumerate(ITEMS)))
    rows = F.array(*(F.struct(F.lit(s).alias("statement"), F.lit(n).alias("line_item"), F.col(f"v{i}").alias("value")) for i, (s, n, _, _) in enumerate(ITEMS)))
    out = sums.select("company_id", "fy", F.inline(rows))
    return out.select(
        "statement", "company_id", "line_item", F.concat(F.lit("Mar "), "fy").alias("period_label"),
        F.make_date("fy", F.lit(3), F.lit(31)).alias("fiscal_year_end"), "value", unit_of(F.col("line_item")).alias("unit"),
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        key.alias("company_id"), F.concat(F.lit("c"), key).alias("input_symbol"), F.concat(F.lit("CO"), key).alias("screener_symbol"),
        F.col("s_name").alias("company_name"), F.when(key % 3 != 0, F.concat(F.lit("NS"), key % 50)).alias("nse_symbol"), (key + 500000).cast("string").alias("bse_code"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A structured question per order: company_id (some unknown), years asked (none to two), items, and its user."""
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    year = F.year("o_orderdate")
    years = F.when(key % 4 == 0, F.array().cast("array<int>")).when(key % 4 == 1, F.array(year)).when(key % 4 == 2, F.array(year + 6)).otherwise(F.array(year, year - 1))
    items = F.when(key % 3 == 0, F.array(F.lit("Sales"))).when(key % 3 == 1, F.array(F.lit("Net Profit"), F.lit("Sales"))).otherwise(F.array(F.lit("borrowings")))
    return o.select(
        key.alias("question_id"), (F.col("o_custkey") % 120).alias("company_id"), years.alias("raw_years"), (key % 5 == 0).alias("single_year_only"),
        F.when(key % 7 == 0, F.lit(2)).alias("n"), items.alias("line_items"), (key % 2 == 0).alias("used_context"), F.col("o_custkey").alias("user_id"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


STATEMENTS_SQL = (
    "sums AS (SELECT l_suppkey AS company_id, year(l_shipdate) + CASE WHEN month(l_shipdate) > 3 THEN 1 ELSE 0 END AS fy, "
    + ", ".join(f"CAST(sum(CASE WHEN {c} THEN CAST({e} AS DECIMAL(18,4)) END) AS DOUBLE) AS v{i}" for i, (_, _, e, c) in enumerate(ITEMS))
    + " FROM lineitem GROUP BY 1, 2), stmts AS ("
    + " UNION ALL ".join(
        f"SELECT '{s}' AS statement, company_id, '{n}' AS line_item, 'Mar ' || fy AS period_label, make_date(fy, 3, 31) AS fiscal_year_end, v{i} AS value, '{'PERCENT' if n.endswith('%') else 'INR_CRORE'}' AS unit FROM sums"
        for i, (s, n, _, _) in enumerate(ITEMS)
    )
    + ")"
)
COMPANIES_SQL = (
    "companies AS (SELECT s_suppkey AS company_id, 'c' || s_suppkey AS input_symbol, 'CO' || s_suppkey AS screener_symbol, s_name AS company_name, "
    "CASE WHEN s_suppkey % 3 <> 0 THEN 'NS' || (s_suppkey % 50) END AS nse_symbol, CAST(s_suppkey + 500000 AS VARCHAR) AS bse_code FROM supplier)"
)
QUESTIONS_SQL = (
    "questions AS (SELECT o_orderkey AS question_id, o_custkey % 120 AS company_id, "
    "CASE o_orderkey % 4 WHEN 0 THEN CAST([] AS BIGINT[]) WHEN 1 THEN [year(o_orderdate)] WHEN 2 THEN [year(o_orderdate) + 6] ELSE [year(o_orderdate), year(o_orderdate) - 1] END AS raw_years, "
    "o_orderkey % 5 = 0 AS single_year_only, CASE WHEN o_orderkey % 7 = 0 THEN 2 END AS n, "
    "CASE o_orderkey % 3 WHEN 0 THEN ['Sales'] WHEN 1 THEN ['Net Profit', 'Sales'] ELSE ['borrowings'] END AS line_items, "
    "o_orderkey % 2 = 0 AS used_context, o_custkey AS user_id FROM orders)"
)
