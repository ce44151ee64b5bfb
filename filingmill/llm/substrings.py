"""Substring deduplication by compacting a De Bruijn graph of words.

Every window of WINDOW consecutive words is an edge of the graph (between its first and its last WINDOW - 1 words), and its source
coordinate is the place where it starts (text, position). An edge with two different coordinates is repeated. Repeated edges
are compacted into nonbranching paths by joins, each occurrence of a path's first edge is one span of a text, and words that a
span covers are removed.

1. Not every window is shuffled. Two equal windows hold the same minimizer, the smallest hash among their
   KMER-word pieces, so only minimizers (about 2 in WINDOW - KMER + 2 words) are counted over all texts; windows of a minimizer
   that stands at one place alone cannot be repeated.
2. The other edges are grouped by 96 bits of hash. A group keeps its first and last coordinate and the number of its occurrences,
   which verify that it is repeated, and whether the words before and after it are always the same.
3. An edge continues another if the one has a single word after it, the other a single word before it, and
   first coordinate, last coordinate and number of occurrences say that the one stands wherever the other ended: an equi-join on the
   coordinates. So the edges of a path have consecutive first coordinates, and paths grow by joins of neighbours at multiples of
   1, 2, 4 ... words; every join handles about half the rows of the one before.
4. Spans are the occurrences of paths' first edges; edges inside a path are not looked at again.

Copies of a whole text are one text from the start (128 bits of hash, then a number of its own), counted narrowly, and removed as a
whole; so a group of copies is never gathered or compared. Grouping has partial aggregation, joins read stored tables so that
adaptive execution can split a hot key, and what is collected per text is bounded by that text's own length.

Two different windows are taken for equal with a chance of about 10^-5 over 10^12 windows (96 bits), two texts with one of
about 10^-18 over 10^10 texts (128 bits).

Defined results: null text has no words; a text shorter than a window keeps all its words; equal rows are copies of each
other; a null doc_id is a value like any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import cut_batches, dropped, small, small_batches, staged

WINDOW = 35
KMER = 8
#: Text in one batch; the hashes of its words and windows take some twenty times as much.
BATCH_BYTES = 2 * 1024 * 1024
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: bytes | None) -> list[bytes]:
    """bytes.split() parts at exactly the ASCII white space that bounds a word."""
    return text.split() if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def _rolled(hashes: np.ndarray, width: int, odd: np.uint64) -> np.ndarray:
    """The polynomial hash of every `width` consecutive values, by doubling; shorter than the input by width - 1."""
    out, done, power, step, size = None, 0, odd.reshape(1), hashes, 1  # an array, as scalars warn when they wrap around
    while width:
        if width & 1:
            if out is None:
                out, done = step, size
            else:
                n = len(hashes) - done - size + 1
                out = out[: max(n, 0)] * power + step[done : done + max(n, 0)]
                done += size
        width >>= 1
        if width:
            n = max(len(step) - size, 0)
            step = step[:n] * power + step[size : size + n]
            power, size = power * power, size * 2
    return out


def _running(x: np.ndarray, width: int, of) -> np.ndarray:
    """of() over every `width` consecutive values; shorter than x by width - 1."""
    size = 1
    while size * 2 <= width:
        x = of(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return of(x[: len(x) - rest], x[rest:]) if rest else x


class Batch:
    """The word hashes of some texts, one after another, and where each text begins."""

    def __init__(self, texts: list[bytes | None], window: int):
        self.words = [words_of(t) for t in texts]
        self.bounds = np.concatenate([[0], np.cumsum([len(w) for w in self.words])])
        n = int(self.bounds[-1])
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in self.words for w in ws), dtype=np.uint64, count=n)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        self.left = self.bounds[self.text + 1] - np.arange(n) if n else np.zeros(0, dtype=np.int64)  # words to the text's end
        self.window = window
        spare = np.zeros(window, dtype=np.uint64)
        padded = np.concatenate([self.hashes, spare])
        self.kmers = _mixed(_rolled(padded, KMER, _ODD[0]))[:n]
        pieces = window - KMER + 1
        self.minima = _running(np.concatenate([self.kmers, spare]), pieces, np.minimum)[:n]
        self.minima[self.left < window] = 0
        self.whole = self.left >= window

    def minimizers(self) -> np.ndarray:
        """Positions of pieces that are the smallest of a window that holds them."""
        pieces = self.window - KMER + 1
        before = np.concatenate([np.zeros(pieces - 1, dtype=np.uint64), self.minima])
        most = _running(before, pieces, np.maximum) if len(self.minima) else self.minima
        return np.flatnonzero((most == self.kmers) & (self.left >= KMER) & (most > 0))


def _marks(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_batches(batches, "text", BATCH_BYTES):
            b = Batch(batch.column("text").cast(pa.binary()).to_pylist(), window)
            at = b.minimizers()
            offsets = np.searchsorted(at, b.bounds).astype(np.int32)
            at_text = (at - b.bounds[b.text[at]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("a"), batch.column("b"),
                    pa.array(np.diff(b.bounds), pa.int64()),
                    pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in b.words], pa.string()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(b.kmers[at].view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(at_text)),
                ],
                ["doc_id", "a", "b", "n_words", "full_sha256", "k", "q"],
            )

    return run


#: h1 and h2 are 96 bits of the window's hash; before and after are 31 bits of the words beside it (0: none); at is the
#: coordinate: the text's number and the position, packed.
EDGES = "h1 long, h2 int, before int, after int, at long, single boolean"


def _edges(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_batches(batches, "text", BATCH_BYTES):
            b = Batch(batch.column("text").cast(pa.binary()).to_pylist(), window)
            lists = batch.column("qs")
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            at = lists.flatten().to_numpy() + b.bounds[owner]
            p = np.flatnonzero(b.whole & np.isin(b.minima, b.kmers[at]))
            if not len(p):
                continue
            spare = np.zeros(window, dtype=np.uint64)
            padded = np.concatenate([b.hashes, spare])
            h1, h2 = (_mixed(_rolled(padded, window, odd))[p] for odd in _ODD)
            text = b.text[p]
            pos = p - b.bounds[text]
            word = ((b.hashes >> np.uint64(33)) | np.uint64(1)).astype(np.int64).astype(np.int32)
            before = np.where(pos > 0, word[np.maximum(p - 1, 0)], 0)
            after = np.where(b.left[p] > window, word[np.minimum(p + window, len(word) - 1)], 0)
            base = batch.column("base").to_numpy(zero_copy_only=False).astype(np.int64)[text]
            single = batch.column("single").to_numpy(zero_copy_only=False).astype(bool)[text]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h1.view(np.int64)), pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), pa.array(base + pos), pa.array(single),
                ],
                ["h1", "h2", "before", "after", "at", "single"],
            )

    return run


KEPT = "t long, n_removed long, kept string, kept_sha256 string"


def _removed(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_batches(batches, "text", BATCH_BYTES):
            counts, texts, digests = [], [], []
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = words_of(text)
                gone = np.zeros(len(words) + 1, dtype=np.int32)
                for s in spans:
                    gone[s["start"]] += 1
                    gone[s["end"]] -= 1
                stays = np.cumsum(gone)[:-1] == 0
                kept = b" ".join([w for w, s in zip(words, stays.tolist(), strict=True) if s])
                counts.append(len(words) - int(stays.sum()))
                texts.append(kept.decode() if with_text else None)
                digests.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("t"), pa.array(counts, pa.int64()), pa.array(texts, pa.string()), pa.array(digests, pa.string())],
                ["t", "n_removed", "kept", "kept_sha256"],
            )

    return run


def _of_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The one row of docs that stands for each text of wanted (a stored table: a, b, rep, ...), with wanted's columns. Other
    texts are left out before any shuffle where the list of those wanted is small enough to be broadcast."""
    docs = docs.join(small(wanted.select("a", "b")), ["a", "b"], "left_semi")
    w = wanted.alias("w")
    stands = (docs.a == F.col("w.a")) & (docs.b == F.col("w.b")) & docs.doc_id.eqNullSafe(F.col("w.rep"))
    return docs.join(w, stands).select(docs["text"], *(F.col(f"w.{c}") for c in wanted.columns if c != "rep"))


def counted_edges(edges: DataFrame) -> DataFrame:
    """edges: the rows of EDGES. Each repeated edge: h1, h2, first and last coordinate, n, and whether the words before and after
    it are always the same (none counts as different)."""
    one = lambda c: (F.min(c) == F.max(c)) & (F.min(c) != 0)
    seen = edges.groupBy("h1", "h2").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"), one("before").alias("joins"), one("after").alias("goes_on")
    )
    return seen.filter("first <> last")


def compacted_paths(counted: DataFrame) -> DataFrame:
    """counted: first, last, n, joins, goes_on (a stored table). The maximal nonbranching paths: start, end (first
    coordinates of their first and last edge)."""
    next_edge = counted.filter("joins").select((F.col("first") - 1).alias("first"), (F.col("last") - 1).alias("last"), "n")
    links = staged(counted.filter("goes_on").select("first", "last", "n").join(next_edge, ["first", "last", "n"]).select("first"), "links")
    into = links.select((F.col("first") + 1).alias("first"), F.lit(True).alias("linked_left"))
    out_of = links.withColumn("linked_right", F.lit(True))
    parts = counted.select("first").join(out_of, "first", "left").join(into, "first", "left")
    parts = parts.select(
        F.col("first").alias("start"), F.col("first").alias("end"),
        F.coalesce("linked_left", F.lit(False)).alias("linked_left"), F.coalesce("linked_right", F.lit(False)).alias("linked_right"),
    )
    open_ = staged(parts, "parts")
    done = [open_.filter("NOT linked_left AND NOT linked_right")]
    open_, step = open_.filter("linked_left OR linked_right"), 1
    while open_.limit(1).count():
        # Parts lie within aligned blocks of `step` words; neighbours that meet in the middle of two such blocks become one.
        middle = lambda c, step=step: c.bitwiseAND(F.lit(2 * step - 1)) == step
        ends, begins = F.col("linked_right") & middle(F.col("end") + 1), F.col("linked_left") & middle(F.col("start"))
        left = open_.filter(ends).select("start", (F.col("end") + 1).alias("meet"), "linked_left")
        right = open_.filter(begins).select(F.col("start").alias("meet"), "end", "linked_right")
        grown = left.join(right, "meet").select("start", "end", "linked_left", "linked_right")
        parts = staged(open_.filter(~ends & ~begins).unionByName(grown), "parts")
        done.append(parts.filter("NOT linked_left AND NOT linked_right"))
        open_, step = parts.filter("linked_left OR linked_right"), 2 * step
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("start", "end")


def repeated_spans(edges: DataFrame, window: int = WINDOW) -> DataFrame:
    """edges: the rows of EDGES (a stored table). The occurrences of compacted paths in texts without copies: at (the
    coordinate of the first word), words."""
    # Stored, so that the join below reads both its sides from shuffles of their own, and a very common edge can be split.
    counted = staged(counted_edges(edges), "counted")
    paths = staged(compacted_paths(counted), "paths")
    heads = counted.select("h1", "h2", F.col("first").alias("start")).join(paths, "start")
    heads = staged(heads.select("h1", "h2", (F.col("end") - F.col("start") + window).alias("words")), "heads")
    return edges.filter("single").select("h1", "h2", "at").join(small(heads), ["h1", "h2"]).select("at", "words")


def _shared_edges(docs: DataFrame, marks: DataFrame, copies: DataFrame, window: int, bits: int) -> DataFrame:
    """The edges of all texts, one for each text, that hold a minimizer standing at more than one place."""
    m, c = marks.alias("m"), copies.alias("c")
    stands = (F.col("m.a") == F.col("c.a")) & (F.col("m.b") == F.col("c.b")) & F.col("m.doc_id").eqNullSafe(F.col("c.rep"))
    own = m.join(c, stands).filter(F.col("m.n_words") >= window)
    at = staged(own.select("c.t", F.inline(F.arrays_zip("k", "q"))), "minimizers")
    place = F.shiftleft("t", bits) + F.col("q")
    places = at.select("k", place.alias("_c")).groupBy("k").agg(F.min("_c").alias("_c1"), F.max("_c").alias("_c2"))
    # Stored, so that the join below reads both sides from shuffles of their own and a very common minimizer can be split.
    shared = staged(places.filter("_c1 <> _c2").select("k"), "shared")
    met = staged(at.join(shared, "k").groupBy("t").agg(F.collect_set("q").alias("qs")), "met")
    dropped(at, shared)
    wanted = met.join(copies, "t").select("a", "b", "rep", F.shiftleft("t", bits).alias("base"), (F.col("m") == 1).alias("single"), "qs")
    wanted = staged(wanted, "wanted")
    dropped(met)
    edges = staged(_of_texts(docs, wanted).select("base", "single", "text", "qs").mapInArrow(_edges(window), EDGES), "edges")
    dropped(wanted)
    return edges


def numbered_texts(marks: DataFrame) -> tuple[DataFrame, int]:
    """(a, b, m, rep, t: each distinct text, how often it stands there, the doc_id that stands for it, its number; the bits that
    a position takes). Stored."""
    copies = marks.groupBy("a", "b").agg(F.count("*").alias("m"), F.min("doc_id").alias("rep"), F.max("n_words").alias("_n"))
    copies = staged(copies.withColumn("_id", F.monotonically_increasing_id()), "copies")
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    parts, rows, words = (int(x or 0) for x in copies.agg(F.max(part), F.max(row), F.max("_n")).first())
    bits = (words + 1).bit_length()
    if parts.bit_length() + rows.bit_length() + bits > 63:
        raise ValueError("coordinates of these texts do not fit into 63 bits: read them in fewer partitions")
    return copies.select("a", "b", "m", "rep", (F.shiftleft(part, rows.bit_length()) + row).alias("t")), bits


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_words, n_removed, kept (null where nothing is removed, or without with_text),
    kept_sha256 (hex, of the kept words joined by single spaces)."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit("key"), "text").alias("b"), "text")
    id_field = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    schema = T.StructType([id_field]).add("a", "long").add("b", "long").add("n_words", "long").add("full_sha256", "string")
    schema = schema.add("k", T.ArrayType(T.LongType())).add("q", T.ArrayType(T.IntegerType()))
    marks = staged(docs.mapInArrow(_marks(window), schema), "marks")
    copies, bits = numbered_texts(marks)

    edges = _shared_edges(docs, marks, copies, window, bits)
    found = repeated_spans(edges, window)
    start = F.col("at").bitwiseAND(F.lit((1 << bits) - 1))
    found = found.select(F.shiftright("at", bits).alias("t"), start.alias("start"), (start + F.col("words")).alias("end"))
    spans = found.groupBy("t").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = staged(spans.join(copies.select("a", "b", "rep", "t"), "t"), "spans")
    dropped(edges)
    kept = staged(_of_texts(docs, spans).select("t", "text", "spans").mapInArrow(_removed(with_text), KEPT), "kept")

    nothing = hashlib.sha256(b"").hexdigest()
    whole = (F.col("m") > 1) & (F.col("n_words") >= window)
    rows = marks.select("doc_id", "a", "b", "n_words", "full_sha256").join(copies.select("a", "b", "m", "t"), ["a", "b"])
    rows = rows.join(kept, "t", "left")
    return rows.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit("") if with_text else F.lit(None)).otherwise(F.col("kept")).alias("kept"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "full_sha256")).alias("kept_sha256"),
    )
