"""One of each group of near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come first from SimHash anchors (`simhash.near_links` over fingerprints of five-word shingles): the texts of a component of fingerprints within 3 bits
share a key. These reach few of the similar pairs, so MinHash bands give further keys: BANDS a text, each over BAND_ROWS minima; two texts
at similarity 0.8 miss each other in all of them with a chance of 2 in 10,000, nearer ones more rarely. Texts that share a key of either
kind are then compared by their whole sets of shingles: only pairs that reach the similarity are linked, and each key gives a spanning
forest of its links, never all pairs. Only texts that share a key with another are shuffled, and of keys with the same members one is left.

Equal texts are one node, so a group of copies is one row. A key with more than BLOCK texts is cut into blocks, and blocks
are compared in pairs by separate tasks. Components over all keys come from joins (`_components`).

Defined results: texts without words (null and empty ones too) are alike; a text of fewer than five words has one shingle,
its words; texts are named by 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._components import components
from ._shared import dropped, small, small_batches, staged, text_key
from .simhash import _LOWER, _WORD, fingerprint

SHINGLE_WORDS = 5
LEAST_SIMILARITY = 0.8
BANDS, BAND_ROWS = 16, 4
SEED = 42
BLOCK = 2048
#: Hashes are turned into minima so many at a time.
_CHUNK = 1 << 12

_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, size=(2, BANDS * BAND_ROWS), dtype=np.uint64)
_MIX[1] |= np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The hashes of a text's shingles, each once and in order."""
    words = _WORD.findall((text or "").translate(_LOWER))
    grams = [" ".join(words)] if len(words) <= size else map(" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """A key (long) for each band of minima."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), _CHUNK):
        mixed = (hashes[i : i + _CHUNK, None] ^ _MIX[0]) * _MIX[1]
        least = np.minimum(least, (mixed ^ mixed >> np.uint64(32)).min(axis=0))
    keys = [xxhash.xxh64_intdigest(least[i * BAND_ROWS : (i + 1) * BAND_ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [bands(shingles(t)) for t in batch["text"]]
        prints = np.array([fingerprint(t, SHINGLE_WORDS) for t in batch["text"]], dtype=np.uint64).view(np.int64)
        yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "fp": prints, "keys": found})


def anchored(fps: DataFrame) -> DataFrame:
    """fps: fp, distinct. Returns fp, key: the same key for all fingerprints joined by steps of at most 3 bits, found by anchors."""
    roots = staged(components(simhash.near_links(fps)), "anchored")
    return fps.join(small(roots), fps.fp == roots.node, "left").select("fp", F.xxhash64(F.lit("anchors"), F.coalesce("root", "fp")).alias("key"))


def linked(sets: list[np.ndarray], least: float = LEAST_SIMILARITY) -> list[tuple[int, int]]:
    """Positions of sets as (member, where it was reached from): a spanning forest of all pairs at least so similar."""
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    left, flat_left, has = np.arange(len(sets)), flat, np.zeros(flat.max() + 1, dtype=bool)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out, open_ = [], []
    while len(left):
        if not open_:
            at, reached = int(left[0]), np.arange(len(left)) == 0
        else:
            at = open_.pop()
            own = flat[starts[at] : starts[at + 1]]
            has[own] = True
            common = np.add.reduceat(has[flat_left], np.concatenate([[0], np.cumsum(sizes[left])[:-1]]), dtype=np.int64)
            has[own] = False
            reached = common >= least * (sizes[left] + len(own) - common) - 1e-9
            out += [(int(x), at) for x in left[reached]]
        if reached.any():
            open_ += left[reached].tolist()
            flat_left = flat_left[np.repeat(~reached, sizes[left])]
            left = left[~reached]
    return out


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by (key, bi, bj): the links of each group."""
    group, names, sets = None, [], []

    def flush() -> Iterator[pd.DataFrame]:
        if len(sets) > 1 and (found := linked(sets)):
            yield pd.DataFrame([(*names[i], *names[j]) for i, j in found], columns=["ua", "ub", "va", "vb"])

    for batch in batches:
        for key, bi, bj, a, b, text in batch[["key", "bi", "bj", "a", "b", "text"]].itertuples(index=False, name=None):
            if (key, bi, bj) != group:
                yield from flush()
                group, names, sets = (key, bi, bj), [], []
            names.append((a, b))
            sets.append(shingles(text))
    yield from flush()


def near_links(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs: a, b, text. Returns u, v (structs of a and b): links of similar texts from which all components follow."""
    small_batches(docs.sparkSession)
    keyed = docs.mapInPandas(_keys, "a long, b long, fp long, keys array<long>").dropDuplicates(["a", "b"])
    spread = staged(keyed.select("a", "b", "fp", F.explode(F.concat(F.array(F.lit(None).cast("long")), "keys")).alias("key")), "bands")
    prints = spread.filter("key IS NULL").select("a", "b", "fp")
    spread = spread.filter("key IS NOT NULL").select("a", "b", "key").unionByName(prints.join(anchored(prints.select("fp").distinct()), "fp").select("a", "b", "key"))
    spread = staged(spread, "keys")
    name = F.xxhash64("a", "b")
    met = spread.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(name).alias("x"), F.bit_xor(F.xxhash64("b", "a")).alias("y"))
    met = met.filter("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    met = staged(met.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "shared")
    members = staged(spread.join(met, "key"), "members")
    wanted = staged(members.select("a", "b").distinct(), "wanted")
    texts = staged(docs.join(small(wanted), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.first("text").alias("text")), "texts")
    own = F.pmod(name, F.col("blocks")).cast("int")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("blocks") - 1), F.array(own)))
    dealt = members.select("key", "a", "b", own.alias("_own"), F.explode(others).alias("_other"))
    dealt = dealt.select("key", F.least("_own", "_other").alias("bi"), F.greatest("_own", "_other").alias("bj"), "a", "b")
    pairs = dealt.join(texts, ["a", "b"]).repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    found = pairs.mapInPandas(_links, "ua long, ub long, va long, vb long")
    side = lambda s: F.struct(F.col(f"{s}a").alias("a"), F.col(f"{s}b").alias("b")).alias(s)
    links = staged(found.select(side("u"), side("v")).distinct(), "links")
    dropped(spread, met, members, wanted, texts)
    return links


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id, as it is; of several such rows that whose text has the
    smallest hash. Rows equal in doc_id and text count as one; a row without a doc_id stays only in a group without any."""
    key = text_key(F.coalesce(docs.text, F.lit("")))
    marked = staged(docs.select("doc_id", key.alias("node")), "marked")
    roots = staged(components(near_links(docs.select(key["a"].alias("a"), key["b"].alias("b"), "text"))), "roots")
    nodes = marked.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least"))
    named = nodes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), F.struct("least", "node").alias("first"))
    kept = staged(named.groupBy("root").agg(F.min("first").alias("first")).select("first.least.doc_id", "first.node"), "kept")
    same = docs.doc_id.eqNullSafe(kept.doc_id) & (key["a"] == kept.node.a) & (key["b"] == kept.node.b)
    out = docs.join(kept, same, "left_semi")
    repeated = marked.groupBy("doc_id", "node").count().filter("count > 1").limit(1).count()
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out
