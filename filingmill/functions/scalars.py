"""Column functions over cells, labels, periods, symbols and request fields. All stay on the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What units, metrics, documents and redaction go by.
PLAIN_RUPEE_ITEMS = ("eps in rs", "eps", "dividend per share", "book value")
RATIO_ITEMS = ("cfo/op",)
DOC_TYPES = ("ANNUAL_REPORT", "QUARTERLY_REPORT", "INVESTOR_PRESENTATION")
REQUEST_DOC_TYPES = ("ANNUAL_REPORT", "ANNUAL", "QUARTERLY", "TRANSCRIPT", "PRESENTATION")
METRIC_PHRASES = {
    "net profit margin": "net_profit_margin",
    "npm": "net_profit_margin",
    "roe": "roe",
    "return on equity": "roe",
    "debt to equity": "debt_to_equity",
    "debt-to-equity": "debt_to_equity",
    "d/e": "debt_to_equity",
    "free cash flow margin": "fcf_margin",
    "fcf margin": "fcf_margin",
}
SECRET_MARKERS = ("api_key", "apikey", "authorization", "password", "secret", "token", "credential")
YEAR_RANGE = (1990, 2100)
MOST_STRING, MOST_LIST, MOST_CONTEXT = 2000, 100, 12000


def clean_number(cell: Column) -> Column:
    """A number cell as double: Unicode minus, parentheses for negatives, commas and percent signs; null for blanks and
    dashes and for what is no number."""
    t = F.replace(F.trim(F.regexp_replace(cell, r"(?U)^\s+|\s+$", "")), F.lit("−"), F.lit("-"))
    negative = t.rlike(r"(?s)^\(.*\)$")
    inner = F.when(negative, F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    plain = F.regexp_replace(F.translate(inner, ",%", ""), r"(?U)^\s+|\s+$", "")
    number = F.when(plain.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), plain.try_cast("double"))
    return F.when(~t.isin("", "-", "—"), F.when(negative, -number).otherwise(number))


def clean_label(cell: Column) -> Column:
    """White space collapsed, and one trailing expand mark (+) dropped; empty for null."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(cell, F.lit("")), r"(?U)\s+", " "), r"^ | $", "")
    return F.regexp_replace(t, r" *\+ *$", "")


def period_end(label: Column) -> Column:
    """`Mar 2024` to the last day of that month; null for anything that is not a title-case month and a year."""
    fits = label.rlike(r"^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [0-9]{4}$")
    return F.when(fits, F.last_day(F.try_to_date(F.when(fits, label), "MMM yyyy")))


def unit_of(line_item: Column) -> Column:
    label = F.lower(F.trim(line_item))
    return (
        F.when(label.endswith("%"), "PERCENT").when(label.isin(*RATIO_ITEMS), "RATIO")
        .when(label.isin(*PLAIN_RUPEE_ITEMS), "INR").otherwise("INR_CRORE")
    )


def fiscal_year(text: Column) -> Column:
    """`2025`, `FY25` or `FY2025` to `FY25`; null otherwise."""
    year = F.regexp_extract(F.upper(F.trim(text)), r"^(?:FY)?((?:[0-9]{2})?[0-9]{2})$", 1)
    return F.when(year != "", F.concat(F.lit("FY"), F.right(year, F.lit(2))))


def year_in_text(text: Column) -> Column:
    """The first standalone 20xx as int, or null."""
    return F.nullif(F.regexp_extract(text, r"(?U)\b(20[0-9]{2})\b", 1), F.lit("")).cast("int")


def year_of_period(label: Column) -> Column:
    return F.nullif(F.regexp_extract(label, r"([0-9]{4})", 1), F.lit("")).cast("int")


def symbol(text: Column) -> Column:
    """Trimmed and upper-cased where it has 1 to 20 letters, digits, & or -, else null."""
    t = F.upper(F.trim(text))
    return F.when(t.rlike(r"^[A-Z0-9&\-]{1,20}$"), t)


def year_in_range(text: Column) -> Column:
    year = text.try_cast("int")
    return F.when(year.between(*YEAR_RANGE), year)


def doc_type(text: Column) -> Column:
    """The document type a request names, trimmed and upper-cased; null for any other. (Registry rows have DOC_TYPES.)"""
    t = F.upper(F.trim(text))
    return F.when(t.isin(*REQUEST_DOC_TYPES), t)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Null where either is null or the denominator is 0."""
    return F.try_divide(numerator, denominator)


def normal_question(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)\s+", " "), r"^ | $", "")


def optional_value(text: Column) -> Column:
    """Trimmed and upper-cased; null for blanks."""
    return F.nullif(F.upper(F.trim(text)), F.lit(""))


def sorted_map(entries: Column) -> Column:
    """The map with its keys in order, so that equal filters give equal text."""
    return F.map_from_entries(F.array_sort(F.map_entries(entries)))


def expiry(now: Column, ttl_seconds: Column) -> Column:
    """now plus so many seconds; a null ttl never expires (null)."""
    return now + F.make_dt_interval(secs=ttl_seconds.cast("decimal(18,6)"))


def metric_key(phrase: Column) -> Column:
    """The metric a phrase names, or null."""
    pairs = F.create_map(*(F.lit(x) for pair in METRIC_PHRASES.items() for x in pair))
    return F.try_element_at(pairs, F.lower(F.trim(phrase)))


def redacted(fields: Column) -> Column:
    """A string map with secret-named values hidden and long ones cut."""
    hidden = lambda k: reduce(Column.__or__, (F.lower(k).contains(m) for m in SECRET_MARKERS))
    return F.transform_values(fields, lambda k, v: F.when(hidden(k), "[REDACTED]").otherwise(F.substring(v, 1, MOST_STRING)))


def cut_list(values: Column) -> Column:
    return F.slice(values, 1, MOST_LIST)


def without_controls(text: Column) -> Column:
    """Control characters dropped, but for tabs and line ends."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def fenced_context(text: Column) -> Column:
    """Untrusted text without control characters, cut, between two marker lines."""
    plain = F.trim(without_controls(F.coalesce(text, F.lit(""))))
    cut = F.when(F.length(plain) > MOST_CONTEXT, F.concat(F.substring(plain, 1, MOST_CONTEXT), F.lit("\n[TRUNCATED_CONTEXT]"))).otherwise(plain)
    return F.concat(F.lit("<untrusted_context>\n"), cut, F.lit("\n</untrusted_context>"))


def flat_blocks(blocks: Column) -> Column:
    """array<struct<type, text>>: the texts of blocks of type text, one under another."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")


def as_json(value: Column) -> Column:
    """JSON text of a struct, map or array; null stays null."""
    return F.when(value.isNotNull(), F.to_json(value))


def from_json_text(text: Column, schema: str) -> Column:
    """The value a JSON text holds; null for null, blank or broken text."""
    return F.from_json(F.nullif(F.trim(text), F.lit("")), schema)


def parsed_day(text: Column) -> Column:
    """A date written YYYY-MM-DD, DD-MM-YYYY or DD/MM/YYYY; null otherwise."""
    return F.coalesce(*(F.try_to_date(text, f) for f in ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy")))


def is_clock_time(text: Column) -> Column:
    return F.coalesce(text.rlike("^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$"), F.lit(False))
