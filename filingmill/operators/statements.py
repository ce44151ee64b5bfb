"""The statement store: one long table `stmts` (statement, company_id, line_item, period_label, fiscal_year_end, value,
unit) and `companies`. Reads are filters that reach the scan; upserts are a union and a last-wins window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources import stored

#: Where a line item is looked for first.
LOOKUP_ORDER = ("profit_loss", "balance_sheet", "cash_flow")


def read_statements(requests: DataFrame, stmts: DataFrame) -> DataFrame:
    """requests: request_id, company_id, statement (null: all), line_items, periods (null or empty: all). The rows of all
    requests in one join; empty lists filter nothing. place is a row's number in its request: by line item, then by the end of the year, rows without one first."""
    asked = requests.select("request_id", "company_id", F.col("statement").alias("_s"), F.col("line_items").alias("_i"), F.col("periods").alias("_p"))
    every = lambda listed: F.coalesce(F.size(listed), F.lit(0)) <= 0
    met = asked.join(stmts, "company_id").filter(F.col("_s").isNull() | (F.col("_s") == F.col("statement")))
    met = met.filter(every("_i") | F.expr("array_contains(_i, line_item)")).filter(every("_p") | F.expr("array_contains(_p, period_label)"))
    order = W.partitionBy("request_id").orderBy("line_item", F.col("fiscal_year_end").asc_nulls_first(), "statement", "period_label")
    return met.drop("_s", "_i", "_p").withColumn("place", F.row_number().over(order))


def pivot_statement(rows: DataFrame, periods: Sequence[str]) -> DataFrame:
    """line_item × period, a column per asked period, and the unit of the earliest row."""
    one = {p: F.first(F.when(F.col("period_label") == p, F.col("value")), ignorenulls=True).alias(p) for p in periods}
    unit = F.min_by("unit", F.coalesce("fiscal_year_end", F.lit("0001-01-01").cast("date"))).alias("unit")
    return rows.groupBy("statement", "company_id", "line_item").agg(*one.values(), unit)  # one shuffle for all of it


def company_keys(companies: DataFrame) -> DataFrame:
    """Every symbol a company is known by, upper-cased, to its company_id; of several companies the lowest id."""
    names = F.explode(F.array_distinct(F.transform(F.array("screener_symbol", "nse_symbol", "bse_code", "input_symbol"), lambda x: F.upper(F.trim(x)))))
    return companies.select(names.alias("key"), "company_id").filter("key IS NOT NULL AND key <> ''").groupBy("key").agg(F.min("company_id").alias("company_id"))


def find_companies(requests: DataFrame, companies: DataFrame) -> DataFrame:
    """requests: symbol and any other columns. Adds company_id, null if unknown."""
    keys = company_keys(companies)
    return requests.join(keys, F.upper(F.trim(requests.symbol)) == keys.key, "left").drop("key")


def statement_of_item(stmts: DataFrame, order: Sequence[str] = LOOKUP_ORDER) -> DataFrame:
    """company_id, line_item, statement: the first statement, in lookup order, that has the item."""
    names = F.array(*map(F.lit, order))
    rank = F.nullif(F.array_position(names, F.col("statement")), F.lit(0))
    best = stmts.groupBy("company_id", "line_item").agg(F.min(rank).alias("_rank"))  # a number, so that it is hashed, not sorted
    return best.select("company_id", "line_item", F.get(names, (F.col("_rank") - 1).cast("int")).alias("statement"))


def series(requests: DataFrame, stmts: DataFrame) -> DataFrame:
    """requests: company_id, line_item, period_label. Every asked period, with value and unit, null where the store has
    none. Values come from the item's first statement."""
    home = statement_of_item(stmts)
    values = stmts.join(home, ["company_id", "line_item", "statement"]).select("company_id", "line_item", "period_label", "statement", "value", "unit")
    return requests.join(values, ["company_id", "line_item", "period_label"], "left")


def line_items(stmts: DataFrame) -> DataFrame:
    """Distinct line items by company, in order, as one array each."""
    return stmts.groupBy("company_id").agg(F.array_sort(F.collect_set("line_item")).alias("line_items"))


def catalogue(stmts: DataFrame) -> DataFrame:
    return stmts.select("statement", "line_item").distinct()


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n_rows, n_columns of each table."""
    one = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns")) for name, df in tables.items()]
    out = one[0]
    for df in one[1:]:
        out = out.unionByName(df)
    return out


def table_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, position, column_name, data_type, description (a column's comment), n_rows and n_nulls, for each column of each
    table; one pass over a table counts all its columns."""
    found = []
    for name, df in tables.items():
        counts = df.agg(F.count("*").alias("n_rows"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)))
        row = lambda i, f: F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
            F.lit(f.metadata.get("comment")).cast("string").alias("description"), F.col(f"_{i}").alias("n_nulls"),
        )
        found.append(counts.select(F.lit(name).alias("table_name"), "n_rows", F.inline(F.array(*(row(i, f) for i, f in enumerate(df.schema))))))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def read_only_sql(tables: dict[str, DataFrame], query: str, args: list | None = None) -> DataFrame:
    """A query that begins with SELECT over the tables by their names; anything else is an error. args fill its ? marks."""
    if not query.lstrip().lower().startswith("select"):
        raise ValueError("only queries that begin with SELECT may be run")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return next(iter(tables.values())).sparkSession.sql(query, args=args or None)


def series_request_text(requests: DataFrame, stmts: DataFrame) -> DataFrame:
    """requests: request_id, symbol, company_id (null: unknown), line_item, periods. Returns request_id, text: the values of
    every asked period on one line, or what is wrong."""
    asked = requests.select("request_id", "symbol", "company_id", "line_item", F.posexplode_outer("periods").alias("p", "period_label"))
    home = statement_of_item(stmts)
    found = asked.join(home, ["company_id", "line_item"], "left").join(
        stmts.select("company_id", "line_item", "statement", "period_label", "value", "unit"), ["company_id", "line_item", "statement", "period_label"], "left"
    )
    part = F.concat("period_label", F.lit(": "), F.when(F.col("value").isNotNull(), F.format_string("%.2f", F.bround("value", 2))).otherwise("not disclosed"))
    one = found.groupBy("request_id", "symbol", "company_id", "line_item", "statement").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", part.alias("t")))), lambda x: x["t"]), "; ").alias("t"), F.max("unit").alias("unit")
    )
    head = F.concat("line_item", F.lit(" for "), "symbol", F.coalesce(F.concat(F.lit(" ("), "unit", F.lit(")")), F.lit("")), F.lit(": "))
    text = F.when(F.col("company_id").isNull(), F.concat(F.lit("ERROR: Company '"), "symbol", F.lit("' not found in financials database.")))
    text = text.when(F.col("statement").isNull(), F.concat(F.lit("ERROR: Line item '"), "line_item", F.lit("' not found for '"), "symbol", F.lit("' in any statement table. Call list_available_line_items to see valid names.")))
    return one.select("request_id", text.otherwise(F.concat(head, "t")).alias("text"))


def available_items_text(requests: DataFrame, stmts: DataFrame) -> DataFrame:
    """requests: request_id, symbol, company_id (null: unknown). Returns request_id, text: the line items by statement."""
    order = F.array(*map(F.lit, LOOKUP_ORDER))
    items = stmts.groupBy("company_id", "statement").agg(F.array_sort(F.collect_set("line_item")).alias("items"))
    line = F.concat("statement", F.lit(": "), F.array_join("items", ", "))
    lines = items.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct(F.array_position(order, F.col("statement")).alias("r"), line.alias("t")))).alias("lines"))
    text = F.when(F.col("company_id").isNull(), F.concat(F.lit("ERROR: Company '"), "symbol", F.lit("' not found in financials database.")))
    text = text.when(F.col("lines").isNull(), F.concat(F.lit("No line items found for '"), "symbol", F.lit("'.")))
    return requests.join(lines, "company_id", "left").select("request_id", text.otherwise(F.array_join(F.transform("lines", lambda x: x["t"]), "\n")).alias("text"))


def upsert(table: DataFrame, changes: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """table and changes have the same columns. Of equal keys the row with the largest `order` stays, of ties that from
    changes; old rows without a change stay."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.col(order).desc_nulls_last(), F.desc("_new")))
    return both.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", "_new")


def upsert_companies(table: DataFrame, changes: DataFrame) -> DataFrame:
    """By screener_symbol: an existing company keeps its id and what the change leaves null; new ones get ids after the
    largest, in symbol order."""
    fields = [c for c in table.columns if c not in ("company_id", "screener_symbol")]
    old, new = table.alias("old"), changes.alias("new")
    met = old.join(new, "screener_symbol", "full").select(
        F.col("old.company_id").alias("company_id"), "screener_symbol", *(F.coalesce(f"new.{c}", f"old.{c}").alias(c) for c in fields)
    )
    last = table.agg(F.coalesce(F.max("company_id"), F.lit(0)).alias("m")).select("m").scalar()
    known, fresh = met.filter("company_id IS NOT NULL"), met.filter("company_id IS NULL")
    return known.unionByName(stored.numbered(fresh.drop("company_id"), "screener_symbol", last, "company_id")).select(*table.columns)


STATEMENT_KEY, COMPANY_KEY = ("company_id", "line_item", "period_label"), ("screener_symbol",)


def upsert_stored(path: str, changes: DataFrame, order: str) -> list[int]:
    """`upsert` into a stored table by its own key: only buckets that a change falls into are read and replaced."""
    key = stored.key_of(changes.sparkSession, path)
    return stored.upsert_into(path, changes, lambda table, new: upsert(table, new, key, order))


def upsert_stored_companies(path: str, changes: DataFrame) -> list[int]:
    """`upsert_companies` into a stored table by screener_symbol. The largest id is looked up in its column alone; new companies are numbered
    before any bucket is replaced, so a job that fails numbers nothing."""
    table = stored.read(changes.sparkSession, path)
    last = table.agg(F.coalesce(F.max("company_id"), F.lit(0))).first()[0]
    fresh = stored.numbered(changes.join(table.select("screener_symbol"), "screener_symbol", "left_anti").select("screener_symbol"), "screener_symbol", last, "_id")

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        fields = [c for c in old.columns if c not in ("company_id", "screener_symbol")]
        met = old.alias("old").join(new.join(fresh, "screener_symbol", "left").alias("new"), "screener_symbol", "full")
        return met.select(F.coalesce("old.company_id", "new._id").alias("company_id"), "screener_symbol", *(F.coalesce(f"new.{c}", f"old.{c}").alias(c) for c in fields))

    return stored.upsert_into(path, changes, merge)


def ingest_summary(written: DataFrame) -> DataFrame:
    """company_id, statement, n_rows, periods (the longest list of any line item)."""
    items = written.groupBy("company_id", "statement", "line_item").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("period_label")).alias("periods"))
    return items.groupBy("company_id", "statement").agg(F.sum("n").alias("n_rows"), F.max_by("periods", F.struct(F.size("periods"), "line_item")).alias("periods"))
