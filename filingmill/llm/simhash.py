"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 1 bit in one of their two 32-bit halves. Each half
is covered by the words of a code as anchors: the product of the Golay code on 23 bits, the Hamming code on 7 bits and all words of 2
bits, 2^18 anchors of covering radius 3 + 1 + 0 = 4. A half is at home at its nearest anchor and is replicated to every
anchor within covering radius plus threshold, 4 + 1 = 5 bits: 15 on average. Whatever is within 1 bit of a half is therefore
found at that half's home anchor. Candidates are compared there in all 64 bits, and each anchor gives a spanning forest of
its links (at most a row per fingerprint), never all pairs.

Equal fingerprints are one node from the start, so a group of copies is one row. An anchor with more than BLOCK
fingerprints (a dense group of near copies) is cut into blocks, and blocks are compared in pairs by separate tasks. Components over
all anchors come from joins (`_components`).

Defined results: null or empty text, or one without words, has fingerprint zero and links like any other; a text of one or
two words has one shingle, its words; a null doc_id gets the component of its fingerprint but is never named as its
smallest member unless all are null; repeated rows are each returned; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._shared import small_batches, staged

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
BLOCK = 8192
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Hashes are turned into bits so many at a time.
_CHUNK = 1 << 16

# Generator polynomials of the perfect codes.
GOLAY_23 = 0b101011100011
HAMMING_7 = 0b1011
COVER_RADIUS, HALF_THRESHOLD = 4, 1


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """The SimHash of a whole text, as an unsigned number."""
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [" ".join(words)]
    else:
        grams = map(" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), dtype=">u8", count=max(1, len(words) - shingle + 1))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, a (a hash of the text), fp (long, the fingerprint's bits)."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            values = np.array([fingerprint(t) for t in batch], dtype=np.uint64)
            yield pd.Series(values.view(np.int64))

    return docs.select("doc_id", F.xxhash64("text").alias("a"), of("text").alias("fp"))


def _remainder(words: np.ndarray, generator: int, bits: int) -> np.ndarray:
    """Each word modulo the generator, as polynomials over two elements."""
    degree = generator.bit_length() - 1
    words = words.copy()
    for bit in range(bits - 1, degree - 1, -1):
        words ^= np.where(words >> bit & 1, generator << (bit - degree), 0)
    return words


def _syndrome(halves: np.ndarray) -> np.ndarray:
    """Of the 32-bit words' parts of 23 and 7 bits; equal for words that differ by an anchor (but for the 2 free bits)."""
    golay = _remainder(halves & 0x7FFFFF, GOLAY_23, 23)
    hamming = _remainder(halves >> 23 & 0x7F, HAMMING_7, 7)
    return golay | hamming << 11


@functools.cache
def _errors() -> tuple[np.ndarray, np.ndarray]:
    """All words of at most COVER_RADIUS + HALF_THRESHOLD bits, by syndrome and then by weight; where each syndrome begins."""
    found = [np.zeros(1, dtype=np.int64)]
    for weight in range(1, COVER_RADIUS + HALF_THRESHOLD + 1):
        at = np.array(list(combinations(range(32), weight)), dtype=np.int64)
        found.append((1 << at).sum(axis=1))
    weights = np.concatenate([np.full(len(x), w) for w, x in enumerate(found)])
    words = np.concatenate(found)
    syndromes = _syndrome(words)
    order = np.lexsort((words, weights, syndromes))
    return words[order], np.searchsorted(syndromes[order], np.arange((1 << 14) + 1))


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of 32-bit words: index of the word, anchor, whether it is the word's home; a row for each anchor in reach."""
    words, starts = _errors()
    s = _syndrome(halves)
    begin, count = starts[s], starts[s + 1] - starts[s]
    index = np.repeat(np.arange(len(halves)), count)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    step = np.arange(len(index)) - first[index]
    return index, halves[index] ^ words[begin[index] + step], step == 0


def _replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        fps = batch["fp"].to_numpy(dtype=np.int64)
        for half in (0, 1):
            part = fps.view(np.uint64) >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)
            index, anchor, home = anchors(part.astype(np.int64))
            yield pd.DataFrame({"anchor": anchor | half << 32, "fp": fps[index], "home": home})


def _forest(homes: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within MAX_BITS as a spanning forest: (fingerprint, root) pairs. Memory is bounded by a strip of the block."""
    nodes = np.unique(np.concatenate([homes, members]))
    root = np.arange(len(nodes))
    h, m = np.searchsorted(nodes, homes), np.searchsorted(nodes, members)
    words = nodes.view(np.uint64)
    strip = max(1, (1 << 21) // max(1, len(m)))
    for i in range(0, len(h), strip):
        near = np.bitwise_count(words[h[i : i + strip], None] ^ words[None, m]) <= MAX_BITS
        a, b = np.nonzero(near)
        a, b = h[i : i + strip][a], m[b]
        keep = a != b
        a, b = a[keep], b[keep]
        while len(a):  # hook the larger root to the smaller one, then halve the paths
            ra, rb = root[a], root[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            if not len(a):
                break
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := root[root], root):
                root = up
    linked = root != np.arange(len(nodes))
    return nodes[linked], nodes[root[linked]]


def _sorted_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by (anchor, block pair): the links of each group. A group holds at most two blocks of fingerprints."""
    keys = ["anchor", "bi", "bj"]
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        k = batch[keys].to_numpy(dtype=np.int64)
        ends = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        cut = ends[-1] if len(ends) else 0
        rest = batch.iloc[cut:]
        yield from _grouped(batch.iloc[:cut], ends[:-1] if len(ends) else ends)
    if rest is not None and len(rest):
        yield from _grouped(rest, np.array([], dtype=np.int64))


def _grouped(batch: pd.DataFrame, ends: np.ndarray) -> Iterator[pd.DataFrame]:
    if not len(batch):
        return
    fps, home = batch["fp"].to_numpy(dtype=np.int64), batch["home"].to_numpy(dtype=bool)
    us, vs = [], []
    bounds = [0, *ends.tolist(), len(batch)]
    for i, j in zip(bounds, bounds[1:], strict=False):
        own = home[i:j]
        if j - i > 1 and own.any():
            u, v = _forest(fps[i:j][own], fps[i:j])
            if len(u):
                us.append(u)
                vs.append(v)
    if us:
        yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})


def near_links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """fps: fp, distinct. Returns u, v: links within MAX_BITS from which all components follow."""
    spread = fps.select("fp").mapInPandas(_replicate, "anchor long, fp long, home boolean")
    spread = staged(spread, "anchors")
    hot = spread.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    hot = staged(hot.select("anchor", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "hot")
    dealt = spread.join(hot, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # A member meets the homes of every block; a home stands in its own block for the members of every block.
    members = dealt.select("anchor", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("bi"), own.alias("bj"), "fp", "home", own.alias("own"))
    members = members.withColumn("home", F.col("home") & (F.col("bi") == F.col("own"))).drop("own")
    extra = dealt.filter("home AND blocks > 1").select("anchor", own.alias("bi"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("bj"), "fp", "home", own.alias("own"))
    extra = extra.filter("bj <> own").drop("own")
    pairs = members.unionByName(extra).repartition("anchor", "bi", "bj").sortWithinPartitions("anchor", "bi", "bj")
    return pairs.mapInPandas(_sorted_groups, "u long, v long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, a, fp, component_id per row."""
    marked = staged(fingerprints(docs), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = staged(components(near_links(nodes)), "roots")
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = staged(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(named.join(least, "root").select("fp", "component_id"), "fp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id, as it is; of several such rows that whose text has
    the smallest hash. Rows equal in doc_id and text count as one. Of a group in which no row has a doc_id, one row of each
    fingerprint stays."""
    found = near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = staged(found.groupBy("component_id").agg(F.min("a").alias("_a"), F.count("*").alias("_n")), "kept")
    if found.filter("doc_id IS NULL").limit(1).count():  # groups without any id: one row of each fingerprint's group
        kept = staged(found.groupBy("component_id", "fp").agg(F.min("a").alias("_a"), F.count("*").alias("_n")).drop("fp"), "kept")
    same = docs.doc_id.eqNullSafe(kept.component_id) & (F.xxhash64(docs.text) == kept["_a"])
    out = docs.join(kept, same, "left_semi")
    return out.dropDuplicates(["doc_id", "text"]) if kept.filter("_n > 1").limit(1).count() else out
