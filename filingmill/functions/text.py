"""Column functions over page text: cleaning, tables, sections, chunks and safety. One stage, no shuffle; Python for the literals of patterns and
Unicode normal form alone."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import patterns as P

MIN_WORDS = 20
CHUNK_WORDS, CHUNK_OVERLAP = 150, 30
MOST_PAGE_CHARS = 5_000_000


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Parts between white space of any kind."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def clean_page(text: Column) -> Column:
    """Line ends unified, quote marks and entities undone, images, contents lines and rules dropped, blank lines at most two
    in a row."""
    unified = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))

    def line(x: Column) -> Column:
        t = F.replace(F.replace(x, F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
        t = F.regexp_replace(t, r"(?U)^[> ]+|\s+$", "")
        return stripped(F.regexp_replace(t, "(?d)" + P.IMAGE, ""))

    lines = F.transform(F.split(unified, "\n"), line)
    kept = F.filter(lines, lambda t: (t == "") | ~(t.rlike("(?d)" + P.CONTENTS_LINE) | t.rlike("(?d)" + P.RULE_LINE)))
    return stripped(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), stripped)


def is_separator(line: Column) -> Column:
    return line.rlike(P.TABLE_SEPARATOR)


def is_row(line: Column) -> Column:
    return line.rlike(P.TABLE_ROW)


def has_table(text: Column) -> Column:
    """A row of cells and a separator row, anywhere."""
    lines = _lines(text)
    return F.exists(lines, is_separator) & F.exists(lines, lambda x: is_row(x) & ~is_separator(x))


def split_tables(text: Column) -> Column:
    """struct<prose, tables>: a piped line before a separator opens a table, the first line without pipes closes it. Lone
    piped lines stay prose; tables are blocks with a blank line between."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    piped = lambda x: x.contains("|")
    separator = lambda x: stripped(x).rlike(r"^[|\s:-]*-[|\s:-]*$")
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("prose"), empty.alias("tables"), F.lit(False).alias("open"))
    pairs = F.arrays_zip(lines.alias("line"), F.concat(F.slice(lines, 2, F.size(lines)), F.array(F.lit(None).cast("string"))).alias("after"))

    def step(s: Column, x: Column) -> Column:
        inside = piped(x["line"]) & (s["open"] | F.coalesce(separator(x["after"]), F.lit(False)))
        begins = inside & ~s["open"]
        block = F.when(begins & (F.size(s["tables"]) > 0), F.array(F.lit(""), x["line"])).otherwise(F.array(x["line"]))
        return F.struct(
            F.when(inside, s["prose"]).otherwise(F.concat(s["prose"], F.array(x["line"]))).alias("prose"),
            F.when(inside, F.concat(s["tables"], block)).otherwise(s["tables"]).alias("tables"),
            inside.alias("open"),
        )

    out = F.aggregate(pairs, start, step)
    return F.struct(stripped(F.array_join(out["prose"], "\n")).alias("prose"), F.array_join(out["tables"], "\n").alias("tables"))


def table_rows(tables: Column, prefix: Column) -> Column:
    """array<struct<table_index, row_index, text>>: each data row as `header: value | …`; rows of another width are left
    out, and of equal headers the last value stands, in the first one's place."""
    blocks = F.filter(F.split(F.coalesce(tables, F.lit("")), "\n\n"), lambda b: stripped(b) != "")
    cells = lambda line: F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), stripped)

    def block_rows(block: Column, t: Column) -> Column:
        rows = F.filter(F.split(block, "\n"), lambda r: stripped(r) != "")
        header = cells(F.get(rows, F.lit(0)))
        skip = F.when(stripped(F.get(rows, F.lit(1))).rlike(r"^[|\s:\-]+$"), 2).otherwise(1)
        data = F.slice(rows, skip + 1, F.size(rows))

        def text(row: Column) -> Column:
            values = cells(row)
            named = F.transform(F.array_distinct(header), lambda h: F.concat(h, F.lit(": "), F.element_at(F.filter(F.arrays_zip(header.alias("h"), values.alias("v")), lambda p: p["h"] == h), -1)["v"]))
            return F.when(F.size(values) == F.size(header), F.concat_ws(" | ", F.nullif(prefix, F.lit("")), F.array_join(named, " | ")))

        made = F.transform(data, lambda r, i: F.struct(t.alias("table_index"), i.alias("row_index"), text(r).alias("text")))
        return F.when(F.size(rows) >= 2, F.filter(made, lambda x: x["text"].isNotNull())).otherwise(F.array().cast("array<struct<table_index:int,row_index:int,text:string>>"))

    return F.flatten(F.transform(blocks, block_rows))


def table_type(text: Column) -> Column:
    """financial or qualitative, by which list has more words in the table lines; a tie is financial."""
    table = F.lower(F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: is_row(stripped(x)) | is_separator(stripped(x))), "\n"))
    score = lambda listed: reduce(Column.__add__, (table.contains(w).cast("int") for w in listed))
    return F.when(score(P.FINANCIAL_WORDS) >= score(P.QUALITATIVE_WORDS), "financial").otherwise("qualitative")


def sections(text: Column) -> Column:
    """All section tags whose pattern is found, in list order; a pattern is tried only on texts that hold one of its literals."""

    def found(x: Column) -> Column:
        held = lambda gates: reduce(Column.__or__, (F.contains(x["lower"], F.lit(g)) for g in gates))
        tags = (F.when(held(gates), F.when(x["text"].rlike("(?id)" + pattern), name)) for (name, pattern), gates in zip(P.SECTIONS, P.SECTION_GATES, strict=True))
        return F.array_compact(F.array(*tags))

    return _let(F.struct(text.alias("text"), F.lower(text).alias("lower")), found)


def chunks(text: Column, most: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP, mark: str = "\n\n") -> Column:
    """Paragraphs packed into chunks of at most `most` words, each beginning with the last `overlap` of the one before. A
    longer paragraph is cut into windows of its own and hands nothing on."""
    none = F.array().cast("array<string>")
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), mark), words), lambda w: F.size(w) > 0)
    start = F.struct(none.alias("done"), none.alias("open"))
    joined = lambda w: F.array_join(w, " ")

    def step(s: Column, w: Column) -> Column:
        n = F.size(w)
        flushed = F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(joined(s["open"])))).otherwise(s["done"])
        windows = F.transform(F.sequence(F.lit(0), n - 1, F.lit(most - overlap)), lambda i: joined(F.slice(w, i + 1, F.lit(most))))
        tail = F.slice(s["open"], F.greatest(F.size(s["open"]) - overlap + 1, F.lit(1)), F.lit(overlap)) if overlap else none
        long, fits = n > most, F.size(s["open"]) + n <= most
        return F.struct(
            F.when(long, F.concat(flushed, windows)).when(fits, s["done"]).otherwise(flushed).alias("done"),
            F.when(long, none).when(fits, F.concat(s["open"], w)).otherwise(F.concat(tail, w)).alias("open"),
        )

    out = F.aggregate(paragraphs, start, step)
    return F.when(F.size(out["open"]) > 0, F.concat(out["done"], F.array(joined(out["open"])))).otherwise(out["done"])


def _one_of(chars: str) -> str:
    return "[" + "".join(f"\\u{ord(c):04x}" for c in chars) + "]"


#: All literals that the gates of patterns are made of.
LITERALS = tuple(sorted({x for gates in (P.SQL_GATES, P.CODE_GATES, P.INJECTION_GATES) for g in gates for x in g}))


@F.pandas_udf(ArrayType(StringType()))
def literals_in(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Which of LITERALS a text holds: one automaton goes over it once, where Spark's functions would once for each."""
    automaton = ahocorasick.Automaton()
    for x in LITERALS:
        automaton.add_word(x, x)
    automaton.make_automaton()
    for batch in batches:
        yield batch.map(lambda t: [] if t is None else sorted({x for _, x in automaton.iter(t)}))


def _matches(text: Column, held: Column, patterns, gates, flags: str) -> Column:
    """Whether one of the patterns matches; each is tried only on texts that hold (see literals_in) one of its literals."""
    some = lambda literals: F.arrays_overlap(held, F.array(*map(F.lit, literals)))
    return reduce(Column.__or__, (F.when(some(g), text.rlike(f"({flags}){p}")).otherwise(False) for p, g in zip(patterns, gates, strict=True)))


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def unsafe_reasons(text: Column) -> Column:
    """All reasons against a page's text, in the order in which they are checked; empty for blank text."""
    only_ascii = F.length(text) == F.octet_length(text)
    wide = lambda c: F.when(only_ascii, False).otherwise(c)
    plain = F.when(only_ascii, text).otherwise(F.regexp_replace(text, _one_of(P.ZERO_WIDTH), ""))

    def found(x: Column) -> Column:
        checks = {
            "too_long": F.length(text) > MOST_PAGE_CHARS,
            "bidi_override": wide(text.rlike(_one_of(P.BIDI))),
            "direction_mark": wide(text.rlike(_one_of(P.DIRECTION_MARKS))),
            "separator": wide(text.rlike(_one_of(P.SEPARATORS))),
            "tag_block": wide(text.rlike(r"[\x{E0000}-\x{E007F}]")),
            "annotation": wide(text.rlike(_one_of(P.ANNOTATIONS))),
            "object_marks": wide(F.contains(text, F.lit(P.OBJECT_MARK)) & (F.regexp_count(text, F.lit(_one_of(P.OBJECT_MARK))) > 10)),
            "zero_width_run": wide(text.rlike(_one_of(P.ZERO_WIDTH) + "{4,}")),
            "control_characters": text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"),
            "sql": _matches(x.plain, x.held, P.SQL_PATTERNS, P.SQL_GATES, "?id"),
            "code": _matches(x.plain, x.held, P.CODE_PATTERNS, P.CODE_GATES, "?id"),
            "path_traversal": F.when(reduce(Column.__or__, (F.contains(x.lower, F.lit(g)) for g in ("..", "%2", "\x00"))), text.rlike(P.PATH_TRAVERSAL)).otherwise(False),
            "data_uri": F.when(F.contains(x.lower, F.lit("data:")), text.rlike(P.DATA_URI)).otherwise(False),
            "nesting": text.rlike(r"[\[({<]{8,}"),
            "long_token": F.when(F.length(text) > 10000, text.rlike(r"\S{10001}")).otherwise(False),
            "repeated_run": F.when(F.length(text) > 200, text.rlike(r"(?s)(.)\1{200}")).otherwise(False),
        }
        return F.array_compact(F.array(*(F.when(c, name) for name, c in checks.items())))

    listed = _let(F.struct(plain.alias("plain"), F.lower(plain).alias("lower"), literals_in(F.lower(plain)).alias("held")), found)
    return F.when(F.coalesce(stripped(text), F.lit("")) == "", F.array().cast("array<string>")).otherwise(listed)


@F.pandas_udf(StringType())
def nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode normal form C; Spark has no function for it."""
    for batch in batches:
        yield batch.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def is_private_address(host: Column) -> Column:
    """Whether a host is a private, loopback or link-local address: four parts, each decimal, octal or hexadecimal, or one
    number for them all; or IPv6 by its beginning, also where it wraps an IPv4 address. Arithmetic on the JVM."""
    bare = F.lower(F.regexp_replace(F.coalesce(host, F.lit("")), r"^\[|\]$", ""))
    wrapped = F.regexp_extract(bare, r"^::(?:ffff:)?([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)
    bare = F.when(wrapped != "", wrapped).otherwise(bare)

    def number(part: Column) -> Column:
        return (
            F.when(part.rlike("^0x[0-9a-f]{1,8}$"), F.conv(F.substring(part, 3, 8), 16, 10).cast("long"))
            .when(part.rlike("^0[0-7]{1,11}$"), F.conv(part, 8, 10).cast("long"))
            .when(part.rlike("^[0-9]{1,10}$"), part.try_cast("long"))
        )

    parts = F.transform(F.split(bare, r"\."), number)
    last = F.element_at(parts, -1)
    least = F.size(parts) - 1
    # The last part fills what the ones before leave of the 32 bits.
    head = F.aggregate(F.slice(parts, F.lit(1), least), F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    room = F.pow(F.lit(256.0), 4 - least).cast("long")
    fits = (F.size(parts) <= 4) & ~F.exists(parts, lambda x: x.isNull()) & (last < room) & ~F.exists(F.slice(parts, F.lit(1), least), lambda x: x > 255)
    value = F.when(fits, head * room + last)
    within = lambda a, bits: F.shiftright(value, 32 - bits) == F.lit(a >> (32 - bits))
    blocks = reduce(Column.__or__, (within(int.from_bytes(bytes(map(int, a.split("."))), "big"), bits) for a, bits in P.PRIVATE_BLOCKS))
    return F.coalesce(blocks, F.lit(False)) | bare.rlike(r"^(?:::1?|fe[89ab][0-9a-f]:.*|f[cd][0-9a-f]{2}:.*)$")


def link_targets(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.LINK), F.lit(1))


def link_problem(target: Column) -> Column:
    """bad_scheme, private_host or null. Hosts are read by pattern, as a target need not be a whole URL."""
    scheme = F.lower(F.regexp_extract(target, r"^\s*([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = F.lower(F.regexp_extract(target, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    private = host.isin(*P.PRIVATE_HOSTS) | F.regexp_replace(host, r"[\[\]]", "").rlike(P.PRIVATE_ADDRESS) | is_private_address(host)
    return F.when(scheme.isin(*P.BAD_SCHEMES), "bad_scheme").when(private, "private_host")


def injection_flag(text: Column) -> Column:
    return F.coalesce(_let(literals_in(F.lower(text)), lambda held: _matches(text, held, P.INJECTION_PHRASES, P.INJECTION_GATES, "?im")), F.lit(False))


def injection_score(text: Column) -> Column:
    """5 for an injection phrase, 1 for each marker word, 1 for a code fence or comment."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    marks = reduce(Column.__add__, (lower.contains(m).cast("int") for m in P.INJECTION_MARKERS))
    fence = (lower.contains("```") | lower.contains("<!--")).cast("int")
    return F.when(injection_flag(text), 5).otherwise(0) + marks + fence
