"""Which periods a question is answered for, and what else could be asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .statements import LOOKUP_ORDER

TRAILING = 3
MOST_SUGGESTIONS = 3
# What is suggested first, and how.
PRIORITY_ITEMS = ("Net Profit", "Sales", "EPS in Rs", "Operating Profit", "Cash from Operating Activity", "Borrowings", "Reserves")
UNKNOWN_COMPANY = "I couldn't identify a known company in your question. Please mention the company name explicitly."
UNKNOWN_YEAR = "I couldn't identify a year/period in your question. Please mention a specific year (e.g. 2023)."


def available_periods(stmts: DataFrame) -> DataFrame:
    """company_id, periods: its distinct periods over all statements as array<struct<fiscal_year_end, period_label>>, in
    time order."""
    return stmts.groupBy("company_id").agg(F.array_sort(F.collect_set(F.struct("fiscal_year_end", "period_label"))).alias("periods"))


def company_books(stmts: DataFrame) -> DataFrame:
    """What is stored of a company, a row each: company_id, periods (as available_periods), items (array<struct<r, statement, line_item, home>>, those to suggest first
    at the front): statement is the first by name that has the item, home the first in lookup order. A book grows with
    a company's items, not with its rows."""
    names = F.array(*map(F.lit, LOOKUP_ORDER))
    first = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRIORITY_ITEMS)), F.col("line_item")), F.lit(0)), F.lit(99))
    one = stmts.groupBy("company_id", "line_item").agg(
        F.min("statement").alias("statement"), F.min(F.nullif(F.array_position(names, F.col("statement")), F.lit(0))).alias("_h"), F.collect_set(F.struct("fiscal_year_end", "period_label")).alias("_p")
    )
    item = F.struct(first.alias("r"), "statement", "line_item", F.get(names, (F.col("_h") - 1).cast("int")).alias("home"))
    return one.groupBy("company_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_p")))).alias("periods"), F.array_sort(F.collect_list(item)).alias("items"))


def with_books(questions: DataFrame, books: DataFrame) -> DataFrame:
    """Adds _p and _items, null for a company without data."""
    return questions.join(books.select("company_id", F.col("periods").alias("_p"), F.col("items").alias("_items")), "company_id", "left")


def resolve_periods(questions: DataFrame, stmts: DataFrame, trailing: int = TRAILING) -> DataFrame:
    """questions: company_id, raw_years array<int>, single_year_only, n (null: trailing), and any other columns. Adds
    can_proceed, stop_message and periods (labels, in time order).

    No year: the last n. One year, that alone: its period, else the latest. One year: it and the n - 1 before it in the
    list, else the last n. Several: those there are, possibly none."""
    return resolved_in_books(questions.join(available_periods(stmts).withColumnRenamed("periods", "_p"), "company_id", "left"), trailing).drop("_p")


def resolved_in_books(q: DataFrame, trailing: int = TRAILING) -> DataFrame:
    """resolve_periods of questions that have _p beside them."""
    n = F.coalesce(F.col("n"), F.lit(trailing))
    labels = F.transform("_p", lambda p: p["period_label"])
    years = F.transform("_p", lambda p: F.year(p["fiscal_year_end"]))
    count = F.size("_p")
    last_n = F.slice(labels, F.greatest(count - n + 1, F.lit(1)), n)
    at = F.array_position(years, F.get("raw_years", F.lit(0))).cast("int")
    until = F.slice(labels, F.greatest(at - n + 1, F.lit(1)), F.least(n, F.greatest(at, F.lit(1))))
    several = F.transform(F.filter("_p", lambda p: F.array_contains("raw_years", F.year(p["fiscal_year_end"]))), lambda p: p["period_label"])
    asked = F.coalesce(F.size("raw_years"), F.lit(0))
    found = (
        F.when(asked <= 0, last_n)
        .when((asked == 1) & F.col("single_year_only"), F.when(at > 0, F.array(F.get(labels, at - 1))).otherwise(F.slice(labels, -1, 1)))
        .when(asked == 1, F.when(at > 0, until).otherwise(last_n))
        .otherwise(several)
    )
    known = F.col("company_id").isNotNull()
    stored = F.coalesce(count, F.lit(0)) > 0
    stop = F.when(~known, UNKNOWN_COMPANY).when(~stored, F.concat(F.lit("I don't have any financial data stored for '"), F.col("company_id").cast("string"), F.lit("' yet.")))
    return q.withColumn("stop_message", stop).withColumn("can_proceed", stop.isNull()).withColumn(
        "periods", F.when(stop.isNull(), found)
    )


def follow_ups(asked: DataFrame, stmts: DataFrame) -> DataFrame:
    """asked: question_id, company_id, line_items, periods, used_context. Returns question_id, suggestions (3 at most); none
    for a company without data."""
    found = with_hints(with_books(asked, company_books(stmts)))
    return found.select("question_id", suggestions(F.col("hints"), F.col("used_context")).alias("suggestions"))


def with_hints(asked: DataFrame) -> DataFrame:
    """Adds hints, all four texts that could be suggested (null where there is nothing to), from line_items, periods and the book (_p, _items) beside them."""
    lower = F.transform("line_items", F.lower)
    others = F.slice(F.transform(F.filter("_items", lambda x: ~F.array_contains(lower, F.lower(x["line_item"]))), lambda x: x["line_item"]), 1, 2)
    free = F.get(F.filter(F.transform("_p", lambda p: p["period_label"]), lambda p: ~F.array_contains("periods", p)), F.lit(0))
    found = asked.withColumns({"_others": others, "_free": free})
    phrase = F.when(F.size("line_items") == 1, F.get("line_items", F.lit(0))).otherwise("these figures")
    texts = F.array(
        F.concat(F.lit("Want to see "), F.get("_others", F.lit(0)), F.lit(" for the same period?")),
        F.concat(F.lit("Compare this against "), F.col("_free"), F.lit(" as well?")),
        F.when(F.size("line_items") > 0, F.concat(F.lit("Curious what drove the change in "), phrase, F.lit("? I can search the annual report."))),
        F.concat(F.lit("See "), F.get("_others", F.lit(1)), F.lit(" trend over the last few years?")),
    )
    return found.withColumn("hints", texts).drop("_others", "_free")


def suggestions(hints: Column, used_context: Column) -> Column:
    """At most 3 of the texts; to search the report is not suggested where it was searched."""
    left = F.when(used_context, F.array(F.get(hints, F.lit(0)), F.get(hints, F.lit(1)), F.get(hints, F.lit(3)))).otherwise(hints)
    return F.slice(F.array_compact(left), 1, MOST_SUGGESTIONS)


def carried_state(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, state (a struct; null: unresolved). Adds carried: the last state so far in the conversation."""
    along = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    return turns.withColumn("carried", F.last("state", ignorenulls=True).over(along))
