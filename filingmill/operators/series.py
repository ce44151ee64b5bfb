"""Multi-period analytics: year-over-year change, first-to-last change, CAGR, direction, and ratios of line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import safe_ratio

FLAT_PCT = 0.5
# What the ratios are called.
LABELS = {
    "net_profit_margin": "Net Profit Margin (computed: Net Profit / Sales)",
    "roe": "ROE (computed, average equity: Net Profit / avg of opening+closing Equity)",
    "debt_to_equity": "Debt-to-Equity (computed: Borrowings / Equity, closing balance)",
    "fcf_margin": "Free Cash Flow Margin (computed: Free Cash Flow / Sales)",
}


def pct_change(old: Column, new: Column) -> Column:
    return F.try_divide(new - old, F.abs(old)) * 100


def year_over_year(points: DataFrame, keys=("company_id", "line_item"), order="fiscal_year_end") -> DataFrame:
    """Adds yoy_pct: the change against the last earlier value that is not null."""
    before = F.last("value", ignorenulls=True).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return points.withColumn("yoy_pct", pct_change(before, F.col("value")))


def direction(change: Column) -> Column:
    return F.when(change > FLAT_PCT, "up").when(change < -FLAT_PCT, "down").when(change.isNotNull(), "flat").otherwise("unknown")


def overall_change(points: DataFrame, keys=("company_id", "line_item")) -> DataFrame:
    """A row per series: n_points, n_values, first/last value, change_pct (two values at least), cagr_pct, direction.
    Years between are the difference of fiscal years, or the number of points less one where a label has none."""
    one = points.groupBy(*keys).agg(*(c.alias(n) for n, c in _ends(lambda c: c).items()))
    return one.select(*keys, "n_points", "n_values", *_changes())


def enriched(points: DataFrame, keys=("company_id", "line_item"), order="fiscal_year_end") -> DataFrame:
    """points with yoy_pct and the columns of overall_change beside each: one shuffle and one sort for all of it."""
    whole = W.partitionBy(*keys)
    out = year_over_year(points, keys, order).withColumns(_ends(lambda c: c.over(whole)))
    return out.select(*points.columns, "yoy_pct", "n_points", "n_values", *_changes())


def _ends(over) -> dict[str, Column]:
    valued = F.when(F.col("value").isNotNull(), F.struct("fiscal_year_end", "value"))
    return {"n_points": over(F.count("*")), "n_values": over(F.count("value")), "_a": over(F.min(valued)), "_b": over(F.max(valued))}


def _changes() -> list[Column]:
    first, last = F.col("_a.value"), F.col("_b.value")
    years = F.coalesce(F.year("_b.fiscal_year_end") - F.year("_a.fiscal_year_end"), F.col("n_values") - 1)
    enough = F.col("n_values") >= 2
    change = F.when(enough, pct_change(first, last))
    cagr = F.when(enough & (first > 0) & (last > 0) & (years > 0), (F.pow(last / first, 1 / years) - 1) * 100)
    return [first.alias("first_value"), last.alias("last_value"), change.alias("change_pct"), cagr.alias("cagr_pct"), direction(change).alias("direction")]


def wide_items(stmts: DataFrame) -> DataFrame:
    """company_id, fy, and the line items the ratios need, one shuffle for all of them."""
    item = lambda name: F.max(F.when(F.col("line_item") == name, F.col("value")))
    wide = stmts.groupBy("company_id", F.year("fiscal_year_end").alias("fy")).agg(
        item("Sales").alias("sales"), item("Net Profit").alias("net_profit"), item("Free Cash Flow").alias("fcf"),
        item("Borrowings").alias("borrowings"), item("Equity Capital").alias("capital"), item("Reserves").alias("reserves"),
    )
    return wide.withColumn("equity", F.col("capital") + F.col("reserves"))


def derived_metrics(stmts: DataFrame) -> DataFrame:
    """company_id, fy, metric, value, note: margins, debt to equity (closing), and return on the average of opening and
    closing equity. The opening equity is that of the calendar year before, so a missing year is not bridged; without it
    the closing equity stands alone, which the note says even where the ratio is null."""
    wide = wide_items(stmts)
    opening = F.lag("equity").over(W.partitionBy("company_id").orderBy("fy"))
    was = F.lag("fy").over(W.partitionBy("company_id").orderBy("fy"))
    wide = wide.withColumn("opening", F.when(was == F.col("fy") - 1, opening))
    period = F.concat(F.lit("Mar "), F.col("fy"))
    average = F.when(F.col("opening").isNotNull(), (F.col("equity") + F.col("opening")) / 2).otherwise(F.col("equity"))
    roe = safe_ratio(F.col("net_profit"), average)
    alone = F.col("equity").isNotNull() & F.col("opening").isNull()
    roe_note = F.when(
        alone, F.concat(F.lit("Prior-period balance sheet unavailable for "), period, F.lit(" - using closing equity only, not the average."))
    ).when(roe.isNull(), F.concat(F.lit("Could not compute - Net Profit or Equity not disclosed for "), period, F.lit(".")))
    missing = lambda c: F.when(c.isNull(), F.concat(F.lit("Could not compute - a part is zero or not disclosed for "), period, F.lit(".")))
    simple = {
        "net_profit_margin": safe_ratio(F.col("net_profit"), F.col("sales")),
        "fcf_margin": safe_ratio(F.col("fcf"), F.col("sales")),
        "debt_to_equity": safe_ratio(F.col("borrowings"), F.col("equity")),
    }
    rows = [F.struct(F.lit(k).alias("metric"), c.alias("value"), missing(c).alias("note")) for k, c in simple.items()]
    rows.append(F.struct(F.lit("roe").alias("metric"), roe.alias("value"), roe_note.alias("note")))
    return wide.select("company_id", "fy", F.inline(F.array(*rows)))


def two_decimals(value: Column, signed: bool = False) -> Column:
    """As printf's %.2f or %+.2f: the nearest to the number as stored, ties to the even one, and a sign where a negative one rounds to zero."""
    return F.call_function("format_number", value, F.lit("+0.00;-0.00" if signed else "0.00"))


def signed_pct(value: Column) -> Column:
    return F.concat(two_decimals(value, signed=True), F.lit("%"))


def series_text(points: DataFrame) -> DataFrame:
    """company_id, text: a series as lines, "not disclosed" and "not available" spelled out. points: as from year_over_year,
    with unit."""
    line = F.concat(
        F.lit("  "), F.col("period_label"), F.lit(": "), F.when(F.col("value").isNotNull(), F.format_string("%.2f", F.bround("value", 2))).otherwise("not disclosed"),
        F.coalesce(F.concat(F.lit(" (YoY change vs previous period: "), signed_pct(F.col("yoy_pct")), F.lit(")")), F.lit("")),
    )
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fiscal_year_end", line.alias("line")))), lambda x: x["line"]), "\n")
    body = points.groupBy("company_id", "line_item").agg(F.first("unit").alias("unit"), lines.alias("lines"))
    tail = overall_change(points)
    return body.join(tail, ["company_id", "line_item"]).select(
        "company_id", "line_item",
        F.concat_ws(
            "\n", F.concat(F.lit("Line item: "), F.col("line_item")), F.concat(F.lit("Unit: "), F.coalesce("unit", F.lit("unknown"))), "lines",
            F.concat(F.lit("  Overall change (first to last available period): "), F.coalesce(signed_pct(F.col("change_pct")), F.lit("not available (insufficient data)"))),
            F.concat(F.lit("  CAGR: "), F.coalesce(signed_pct(F.col("cagr_pct")), F.lit("not available"))),
            F.concat(F.lit("  Direction: "), F.col("direction")),
        ).alias("text"),
    )
