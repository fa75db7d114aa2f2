"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks (operator 7).

A text is compared with the benchmark in windows as long as the items. Words are runs of ASCII letters and
digits and of all characters beyond ASCII, in lower case, so changed case and punctuation make no difference. Each item, and each window of an item's length, has a
``64 * LANES``-bit SimHash: the sign of a sum over its distinct shingles (``k`` words, weighted by rarity in the whole
benchmark) of +-1 for each bit of the shingle's hash, so equal sets of shingles have equal fingerprints.

Multi-index Hamming search: a fingerprint is cut into ``BLOCKS`` blocks; two fingerprints within ``RADIUS`` differ
in at most ``RADIUS // BLOCKS`` bits of some block. Each block of the items is expanded to all values that near
(``NEAR``), so a lookup by exact block value finds every item within the radius. Candidates within the radius are
then verified by exact weighted-shingle Jaccard similarity, and the best window of each (document, item) is returned.

A window that shares no shingle with any item has similarity 0 with all of them, so only windows around shared
shingles are fingerprinted; shared shingles are found by a sorted lookup of all shingles of all texts. This drops no
window that could be verified.

The benchmark is the small side by contract: its words are sent to all tasks if it has ``MAX_ITEM_WORDS`` words or
fewer, and else handled in runs of items of that many words, one pass over the documents each. Rarity is counted once
over all items; a shingle of one item weighs as much as one of none, so only those of several are sent. Documents
are never shuffled; each text is handled whole.

Edge cases: null and empty texts and items match nothing; an item shorter than ``k`` words is one shingle as a whole
and is sought as such; texts shorter than an item are one window; repeated items are each reported; repeated rows
give repeated results; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, materialize, ship_package
from .hashing import PUNCTUATION, mix, runs

K = 5
THRESHOLD = 0.8
LANES = 2
BLOCKS = 16
#: A pair at similarity 0.8 differs in about 37 of 128 bits at most (angle of weighted sums), with a spread of about 5.
RADIUS = 63
NEAR = RADIUS // BLOCKS
MAX_ITEM_WORDS = 1_000_000


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words of one text."""
    acc = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + words[j: len(words) - k + 1 + j])
    return acc


def _signs(h: np.ndarray) -> np.ndarray:
    """+-1 for each fingerprint bit of each shingle."""
    lanes = [mix(h + np.uint64((0xD1B54A32D192ED03 * (i + 1)) & 0xFFFFFFFFFFFFFFFF)) for i in range(LANES)]
    bits = np.unpackbits(np.stack(lanes, axis=1).view(np.uint8), axis=1)
    return bits.astype(np.float32) * 2 - 1


def _fold(total: np.ndarray) -> np.ndarray:
    """Fingerprints (packed bytes) of weighted sums; sums that are 0 but for rounding give 0."""
    return np.packbits(total > 1e-6, axis=-1)


def _shingled(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(place, words, distinct shingles) of each of the items' ``texts`` that has words."""
    for words in runs(pc.utf8_lower(texts), space=PUNCTUATION):
        edge = np.searchsorted(words.text, np.arange(words.first, words.first + words.count + 1))
        for i in range(words.count):
            n = int(edge[i + 1] - edge[i])
            if n:
                yield words.first + i, n, np.unique(_grams(words.hash[edge[i]: edge[i + 1]], min(k, n)))


def shared_shingles(items: DataFrame, k: int = K) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of items with words, shingles that several of them hold, how many hold each) over all ``items``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, own in _shingled(b.column(0).fill_null(""), k):
                # null stands for the item itself
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(own.view(np.int64))])], names=["h"])

    found = items.select("text").mapInArrow(each, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("h IS NULL OR n > 1").collect()
    n = sum(r["n"] for r in found if r["h"] is None)
    some = sorted((r["h"] % 2**64, r["n"]) for r in found if r["h"] is not None)
    return n, np.array([h for h, _ in some], dtype=np.uint64), np.array([c for _, c in some], dtype=np.int64)


class Items:
    """Items of the benchmark, ready for search. ``shared`` are the shared shingles of the whole benchmark, if ``rows`` are
    a part of it."""

    def __init__(self, rows: list[tuple[int, str]], k: int = K, threshold: float = THRESHOLD, shared: tuple[int, np.ndarray, np.ndarray] | None = None):
        self.k, self.threshold = k, threshold
        self.ids, self.sets, self.words, prints = [], [], [], []
        kept = [(rows[i][0], n, own) for i, n, own in _shingled(pa.array([t or "" for _, t in rows], pa.string()), k)]
        everything = np.concatenate([own for _, _, own in kept]) if kept else np.empty(0, dtype=np.uint64)
        self.known, count = np.unique(everything, return_counts=True)
        # rarity in the benchmark; a shingle that no item holds weighs as much as one that one item holds
        n_items, self.shared, count = shared if shared is not None else (len(kept), self.known, count)
        self.top = float(np.log(1 + max(n_items, 1)))
        self.rarity = np.log(1 + max(n_items, 1) / count).astype(np.float64)
        for item_id, n, own in kept:
            self.ids.append(item_id)
            self.words.append(n)
            self.sets.append((own, self.weight(own)))
            prints.append(_fold((_signs(own) * self.weight(own)[:, None]).sum(axis=0)))
        self.holders: dict[int, list[int]] = {}
        for i, (own, _) in enumerate(self.sets):
            for x in own.tolist():
                self.holders.setdefault(x, []).append(i)
        self.prints = np.array(prints, dtype=np.uint8).reshape(len(prints), 8 * LANES)
        self.total = np.array([w.sum() for _, w in self.sets])
        self.sizes = sorted(set(self.words))
        self.short = sorted({n for n in self.sizes if n < k})
        self.index = self._blocks()

    def weight(self, h: np.ndarray) -> np.ndarray:
        if not len(self.shared):
            return np.full(len(h), self.top)
        at = np.minimum(np.searchsorted(self.shared, h), len(self.shared) - 1)
        return np.where(self.shared[at] == h, self.rarity[at], self.top)

    def _values(self, prints: np.ndarray) -> np.ndarray:
        """The blocks of fingerprints (bytes) as numbers, one column a block."""
        wide = prints.shape[1] // BLOCKS
        return sum(prints[:, i::wide].astype(np.int64) << (8 * i) for i in range(wide)) if wide else prints.astype(np.int64)

    def _blocks(self) -> list[list[np.ndarray]]:
        """For each block and value, the items whose block is within NEAR bits of it."""
        bits = 8 * (self.prints.shape[1] // BLOCKS) if len(self.ids) else 8
        masks = [sum(1 << b for b in some) for r in range(NEAR + 1) for some in combinations(range(bits), r)]
        index = []
        values = self._values(self.prints) if len(self.ids) else np.empty((0, BLOCKS), dtype=np.int64)
        for b in range(BLOCKS):
            table: list[list[int]] = [[] for _ in range(1 << bits)]
            for i, v in enumerate(values[:, b]):
                for m in masks:
                    table[v ^ m].append(i)
            index.append([np.array(x, dtype=np.int64) for x in table])
        return index

    def within(self, prints: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, items within RADIUS, distances) of each fingerprint, by lookups in the blocks."""
        values = self._values(prints)
        for row in range(len(prints)):
            near = np.unique(np.concatenate([self.index[b][values[row, b]] for b in range(BLOCKS)]))
            distance = np.unpackbits(self.prints[near] ^ prints[row], axis=1).sum(axis=1)
            close = distance <= RADIUS
            if close.any():
                yield row, near[close], distance[close]

    def search(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int, float, int]]:
        """(text, item, start, end, similarity, distance) of the best window of each item that a text holds."""
        if not self.ids or not len(texts):
            return
        for words in runs(pc.utf8_lower(texts), space=PUNCTUATION):
            edge = np.searchsorted(words.text, np.arange(words.first, words.first + words.count + 1))
            best: dict[int, dict[int, tuple]] = {}
            for k, sizes in [(self.k, [n for n in self.sizes if n >= self.k])] + [(n, [n]) for n in self.short]:
                at, h = words.grams(k)
                if not sizes or not len(at):
                    continue
                known = self.known[np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)] == h
                for t in np.unique(words.text[at[known]]):
                    lo, hi = np.searchsorted(at, [edge[t - words.first], edge[t - words.first + 1]])
                    self._windows(h[lo:hi], k, sizes, np.flatnonzero(known[lo:hi]), best.setdefault(int(t), {}))
            for t, found in sorted(best.items()):
                first = edge[t - words.first]
                base = words.bounds[t - words.first]
                # code points: bytes that don't continue a character
                chars = lambda end: int(((words.data[base:end] & 0xC0) != 0x80).sum())  # noqa: B023, E731
                for i, (s, d, a, b) in sorted(found.items()):
                    yield t, i, chars(words.start[first + a]), chars(words.end[first + b - 1]), round(s, 6), d

    def _windows(self, h: np.ndarray, k: int, sizes: list[int], shared: np.ndarray, best: dict) -> None:
        n = len(h)
        weight = self.weight(h)
        # stretches of the text that hold every window with a shared shingle
        reach = max(sizes) - k + 1
        breaks = np.flatnonzero(np.diff(shared) > 2 * reach)
        first = np.concatenate([[0], breaks + 1])
        last = np.concatenate([breaks, [len(shared) - 1]])
        for lo, hi in zip(shared[first], shared[last]):
            a = max(0, int(lo) - reach + 1)
            for at in range(a, int(hi) + 1, 4096):
                b = min(n, min(int(hi) + 1, at + 4096) + reach - 1)
                self._stretch(h[at:b], weight[at:b], at, k, sizes, shared, best, min(int(hi) + 1, at + 4096) - at)

    def _stretch(self, h: np.ndarray, weight: np.ndarray, offset: int, k: int, sizes: list[int], shared: np.ndarray, best: dict, starts: int) -> None:
        inside = shared[(shared >= offset) & (shared < offset + len(h))] - offset
        # only items that hold one of these shingles can be verified here, in windows of their length
        here = {self.words[i] for x in np.unique(h[inside]).tolist() for i in self.holders[x]}
        hit = np.zeros(len(h) + 1, dtype=np.int64)
        hit[inside + 1] = 1
        hit = np.cumsum(hit)
        signs = _signs(h) * weight[:, None]
        sums = np.zeros((len(h) + 1, 64 * LANES), dtype=np.float64)
        np.cumsum(signs, axis=0, out=sums[1:])
        # places whose shingle stands before, and the last such place
        order = np.argsort(h, kind="stable")
        again = np.flatnonzero(h[order[1:]] == h[order[:-1]])
        again, before = order[again + 1], order[again]
        for size in sorted(here & set(sizes)):
            m = min(size - k + 1, len(h))
            begin = np.arange(0, max(1, min(starts, len(h) - m + 1)))
            begin = begin[hit[begin + m] > hit[begin]]
            if not len(begin):
                continue
            total = sums[begin + m] - sums[begin]
            # a repeat counts in no window that holds the place before too: those that begin in (again - m, before]
            near = again - before < m
            if near.any():
                twice = np.zeros_like(sums)
                np.add.at(twice, np.maximum(again[near] - m + 1, 0), signs[again[near]])
                np.add.at(twice, before[near] + 1, -signs[again[near]])
                total -= np.cumsum(twice, axis=0)[begin]
            prints = _fold(total)
            for row, items, distance in self.within(prints):
                a = int(begin[row])
                own, first = np.unique(h[a: a + m], return_index=True)
                w = weight[a: a + m][first]
                for i, d in zip(items, distance):
                    if self.words[i] != size:
                        continue
                    other, ow = self.sets[i]
                    both = float(ow[np.isin(other, own, assume_unique=True)].sum())
                    similar = both / (float(w.sum()) + float(self.total[i]) - both)
                    found = (similar, -int(d), -(offset + a))
                    if similar >= self.threshold and (i not in best or found > (best[i][0], -best[i][1], -best[i][2])):
                        best[int(i)] = (similar, int(d), offset + a, offset + a + m + k - 1)


SCHEMA = "doc_id long, item_id long, start long, end long, similarity double, distance int"


def matches(docs: DataFrame, benchmark: DataFrame, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, start, end, similarity, distance``: the best window (offsets in code points) of every item
    that a document of ``docs`` holds."""
    spark = docs.sparkSession
    ship_package(spark)
    items = materialize(benchmark.select(F.col("item_id").cast("long"), "text"), "benchmark")
    total = items.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")))).first()[0] or 0
    runs = max(1, -(-total // MAX_ITEM_WORDS))
    # one run counts its own items, which are all
    shared = spark.sparkContext.broadcast(shared_shingles(items, k) if runs > 1 else None)
    out = None
    for run in range(runs):
        rows = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(runs)) == run).sort("item_id", "text").collect()]
        found = _search(docs, spark.sparkContext.broadcast(rows), shared, k, threshold)
        out = found if out is None else out.unionByName(found)
    return out


def _search(docs: DataFrame, rows, shared, k: int, threshold: float) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows.value, k, threshold, shared.value)
        for b in batches:
            ids = b.column(0).to_pylist()
            out = [(ids[t], items.ids[i], a, e, s, d) for t, i, a, e, s, d in items.search(b.column(1).fill_null(""))]
            cols = list(zip(*out)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "item_id", "start", "end", "similarity", "distance"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    found = materialize(matches(docs, benchmark).select("doc_id").distinct(), "contaminated")
    # user columns travel in one struct, so their names can't clash
    d, f = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*docs.columns).alias("row")).alias("d"), found.alias("f")
    return d.join(f, F.expr("d.id <=> f.doc_id"), "left_anti").select("row.*")


def op7_benchmark_decontamination(spark, sf_dir) -> DataFrame:
    """Every benchmark item that a document holds, with its best window."""
    return matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
