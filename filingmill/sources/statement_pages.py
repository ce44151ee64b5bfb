"""Statements out of stored HTML pages: the tables under section headings, and the company's identity."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import zip_longest

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import clean_label, clean_number, period_end, unit_of

# The heading each statement stands under.
SECTIONS = {"Profit & Loss": "profit_loss", "Balance Sheet": "balance_sheet", "Cash Flows": "cash_flow"}
YEARS = 5
CELLS = "page_id long, symbol string, name string, nse string, bse string, statement string, row int, label string, period string, cell string, row_misaligned boolean, error string"


class _Page(HTMLParser):
    """Headings, tables as rows of cell texts, and link texts, in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, object]] = []
        self._text: list[str] | None = None
        self._table: list[list[str]] | None = None

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "table":
            self._table = []
        elif tag == "tr" and self._table is not None:
            self._table.append([])
        if tag in ("h1", "h2", "td", "th", "a"):
            self._text = []

    def handle_endtag(self, tag: str) -> None:
        text = " ".join("".join(self._text or []).split())
        if tag in ("h1", "h2"):
            self.found.append((tag, text))
        elif tag in ("td", "th") and self._table:
            self._table[-1].append(text)
        elif tag == "a":
            self.found.append(("a", text))
            return
        elif tag == "table" and self._table is not None:
            self.found.append(("table", [r for r in self._table if r]))
            self._table = None

    def handle_data(self, data: str) -> None:
        if self._text is not None:
            self._text.append(data)


def _rows(page_id, symbol: str | None, html: str | None, years: int) -> Iterator[dict]:
    page = _Page()
    page.feed(html or "")
    name = next((x for kind, x in page.found if kind == "h1"), None)
    links = [x for kind, x in page.found if kind == "a"]
    code = lambda at: next((m[1] for x in links if (m := re.match(rf"{at}:\s*(\S+)", x))), None)
    base = {"page_id": page_id, "symbol": symbol, "name": name, "nse": code("NSE"), "bse": code("BSE")}
    if not name or symbol and name.strip().upper() == symbol.strip().upper():
        yield base | {"error": "no company name"}
        return
    missing = []
    for heading, statement in SECTIONS.items():
        at = next((i for i, (kind, x) in enumerate(page.found) if kind in ("h1", "h2") and x.lower().startswith(heading.lower())), None)
        table = next((x for kind, x in page.found[at + 1 :] if kind == "table"), None) if at is not None else None
        if not table:
            missing.append(heading)
            continue
        kept = table[0][1:][-years:]
        for i, row in enumerate(table[1:]):
            values = row[1:][-len(kept) :] if len(row) > len(kept) else row[1:]
            short = len(row) < len(table[0])
            for period, cell in zip_longest(kept, values[: len(kept)]):  # a missing cell is a null value
                yield base | {"statement": statement, "row": i, "label": row[0], "period": period, "cell": cell, "row_misaligned": short}
    if missing:
        yield base | {"error": "missing: " + ", ".join(missing)}


def statement_cells(pages: DataFrame, years: int = YEARS) -> DataFrame:
    """pages: page_id, symbol, html. A row per cell of the last `years` periods, and a row with error for what a page lacks."""
    names = [c.split()[0] for c in CELLS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, s, h in zip(batch["page_id"], batch["symbol"], batch["html"], strict=True) for r in _rows(p, s, h, years)]
            out = pd.DataFrame(rows, columns=names, dtype=object)
            for c in ("page_id", "row"):
                out[c] = out[c].astype("Int64")
            out["row_misaligned"] = out["row_misaligned"].astype("boolean")
            yield out

    return pages.select("page_id", "symbol", "html").mapInPandas(run, CELLS)


def tidy(cells: DataFrame) -> DataFrame:
    """Long statement rows; of equal (page, statement, label, period) the last row wins."""
    label = clean_label(F.col("label"))
    out = cells.filter("statement IS NOT NULL").select(
        "page_id", "symbol", "statement", label.alias("line_item"), F.col("period").alias("period_label"), period_end(F.col("period")).alias("fiscal_year_end"),
        clean_number(F.col("cell")).alias("value"), unit_of(label).alias("unit"), "row_misaligned", "row",
    ).filter("line_item <> ''")
    last = F.row_number().over(W.partitionBy("page_id", "statement", "line_item", "period_label").orderBy(F.desc("row")))
    return out.withColumn("_n", last).filter("_n = 1").drop("_n", "row")


def identities(cells: DataFrame) -> DataFrame:
    """page_id, symbol, name, nse, bse, n_cells, error: one row per page."""
    return cells.groupBy("page_id", "symbol").agg(
        F.first("name").alias("name"), F.first("nse").alias("nse"), F.first("bse").alias("bse"), F.count("statement").alias("n_cells"), F.max("error").alias("error")
    )
