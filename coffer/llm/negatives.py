"""Hard-negative mining by vertical scans (operator 11).

For each anchor and each of its positives (the best rows of its label by inner product), the best rows of other labels
whose score lies in a window below the positive's. The search is exact, in the manner of BOND: vectors are stored by
dimension, and an anchor reads the dimensions in the order of its own magnitudes.

1. ``packed``: the table is written once as blocks, each a matrix with one contiguous run a dimension, rows ordered by
   label, components as integers of the least width that holds them.
2. Anchors go in rounds of about ``ANCHORS``; a round's anchors are sent to all tasks (their bound in bytes follows), and each task scans its
   blocks anchor by anchor. Data aren't shuffled or repeated; only the best few rows of each anchor and task are.
3. The scan keeps a score so far for each candidate of the block. What the unread dimensions can still add lies between
   sums of their minima and maxima in the block, so after a few dimensions a candidate whose upper bound is below the worst
   wanted score, or whose bounds miss every window, leaves the candidate set. Scores are final once every dimension is read.
4. A first scan gives the positives, which fix the windows of the second one.

Edge cases: rows without id, label or vector, or with a null, non-finite or oversized component (beyond which an inner product could leave 64-bit
integers) take no part; vectors meet vectors of equal length only; equal scores are ordered by id; rows that share id and score count
once, of anchors that share an id the one with the smallest label and vector counts, and an anchor's "other rows" have another id; an
empty table, or one without anchors, gives an empty result; columns are read by name, so others don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load, materialize, ship_package
from coffer.session import RoundTable

SCALE = 256.0
#: Anchors of a round, about.
ANCHORS = 8192
#: Dimensions read before the candidates are looked over, at first and then each time.
FIRST, STEP = 16, 8
KEEP = 5
BLOCK = "dims int, n int, width int, ids binary, labels binary, cols binary"
_ARROW = pa.schema([("dims", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("cols", pa.binary())])


def _vectors(ids, labels, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, integer rows) of the valid rows of a batch, for each length of vector."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    ids, labels = np.asarray(ids.to_numpy(zero_copy_only=False), dtype=np.int64), np.asarray(labels.to_numpy(zero_copy_only=False), dtype=np.int64)
    size = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.concatenate([[0], np.cumsum(size)])
    for dims in np.unique(size[size > 0]):
        at = np.flatnonzero(size == dims)
        rows = values[begin[at][:, None] + np.arange(dims)]
        # nulls arrive as NaN
        limit = math.isqrt((1 << 62) // int(dims))
        good = (np.isfinite(rows) & (np.abs(rows) < limit / SCALE)).all(axis=1)
        if good.any():
            yield ids[at[good]], labels[at[good]], np.floor(SCALE * rows[good]).astype(np.int64)


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of ``rows`` (``vec_id, label, embedding``) by dimension, one for each batch and length of vector."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for ids, labels, q in _vectors(b.column(0), b.column(1), b.column(2)):
                order = np.lexsort((ids, labels))
                q = q[order]
                kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= q.min() and q.max() <= np.iinfo(t).max)
                out.append((q.shape[1], len(q), np.dtype(kind).itemsize, ids[order].tobytes(), labels[order].tobytes(), np.ascontiguousarray(q.T.astype(kind)).tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, x)) for x in out], schema=_ARROW)

    valid = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    return valid.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(pack, BLOCK)


class Block:
    """Columns of a block, and where each label's rows are."""

    def __init__(self, dims: int, n: int, width: int, ids: bytes, labels: bytes, cols: bytes):
        self.dims, self.ids, self.labels = dims, np.frombuffer(ids, dtype=np.int64), np.frombuffer(labels, dtype=np.int64)
        self.cols = np.frombuffer(cols, dtype=f"<i{width}").reshape(dims, n)
        #: Rows beyond the first of each id: so many more must be kept for a number of different ones.
        self.repeats = n - len(np.unique(self.ids))

    def of(self, label: int) -> tuple[int, int]:
        lo, hi = np.searchsorted(self.labels, [label, label + 1])
        return int(lo), int(hi)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for r in b.to_pylist():
            yield Block(**r)


class Scan:
    """One anchor's vertical scan over rows ``lo:hi`` of a block."""

    def __init__(self, block: Block, vector: np.ndarray, order: np.ndarray, lo: int, hi: int):
        self.cols, self.vector, self.order, self.base = block.cols[:, lo:hi], vector, order, lo
        least, most = self.cols.min(axis=1).astype(np.int64)[order], self.cols.max(axis=1).astype(np.int64)[order]
        a = vector[order]
        ends = np.stack([a * least, a * most])
        #: What dimensions from the i-th on can add, at least and at most.
        self.rest_lo = np.concatenate([np.cumsum(ends.min(axis=0)[::-1])[::-1], [0]])
        self.rest_hi = np.concatenate([np.cumsum(ends.max(axis=0)[::-1])[::-1], [0]])
        self.score = np.zeros(hi - lo, dtype=np.int64)
        self.alive: np.ndarray | None = None  # all rows, until some leave

    def steps(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(lower, upper) bounds of the candidates after each step; ``keep`` may be called in between."""
        at, dims = 0, len(self.order)
        while at < dims:
            end = min(dims, at + (STEP if at else FIRST))
            for d in self.order[at:end]:
                col = self.cols[d] if self.alive is None else self.cols[d][self.alive]
                self.score += self.vector[d] * col.astype(np.int64)
            at = end
            yield self.score + self.rest_lo[at], self.score + self.rest_hi[at]
            if not len(self.score):
                return

    def keep(self, mask: np.ndarray) -> None:
        if not mask.all():
            at = np.flatnonzero(mask)
            self.alive = at if self.alive is None else self.alive[at]
            self.score = self.score[at]

    def rows(self) -> np.ndarray:
        return self.base + (np.arange(len(self.score)) if self.alive is None else self.alive)


def _best(found: list[tuple[int, int]], score: np.ndarray, ids: np.ndarray, keep: int) -> list[tuple[int, int]]:
    """The best ``keep`` of ``found`` (pairs of negated score and id) and new rows; pairs count once."""
    return sorted({*found, *zip((-score).tolist(), ids.tolist())})[:keep]


def _top(score: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:keep]


def scan_positives(block: Block, anchor: tuple, found: list, keep: int) -> list:
    """``found`` with the block's rows of the anchor's label, as far as they are among the best ``keep``."""
    own, label, vector, order = anchor
    lo, hi = block.of(label)
    if lo == hi or block.dims != len(vector):
        return found
    scan, wide = Scan(block, vector, order, lo, hi), keep + block.repeats
    mine = np.flatnonzero(block.ids[lo:hi] == own)
    if len(mine):
        scan.keep(~np.isin(np.arange(hi - lo), mine))
    for lower, upper in scan.steps():
        floor = -found[keep - 1][0] if len(found) >= keep else None
        if len(lower) > wide:
            kth = int(np.partition(lower, len(lower) - wide)[len(lower) - wide])
            floor = kth if floor is None else max(floor, kth)
        if floor is not None:
            scan.keep(upper >= floor)
    ids = block.ids[scan.rows()]
    at = _top(scan.score, ids, wide)
    return _best(found, scan.score[at], ids[at], keep)


def scan_negatives(block: Block, anchor: tuple, windows: list[tuple[int, int]], found: list[list], keep: int) -> None:
    """Adds to ``found`` the block's rows of other labels that are among the best ``keep`` of each window (least, most)."""
    own, label, vector, order = anchor
    if block.dims != len(vector):
        return
    lo, hi = block.of(label)
    wide = keep + block.repeats
    for a, b in ((0, lo), (hi, len(block.ids))):
        if a == b:
            continue
        scan = Scan(block, vector, order, a, b)
        floors = [max(least, -f[keep - 1][0]) if len(f) >= keep else least for (least, _), f in zip(windows, found)]
        mine = block.ids[a:b] == own
        if mine.any():
            scan.keep(~mine)
        for lower, upper in scan.steps():
            wanted = np.zeros(len(lower), dtype=bool)
            for i, (_, most) in enumerate(windows):
                sure = lower[(upper <= most) & (lower >= floors[i])]
                if len(sure) >= wide:
                    floors[i] = max(floors[i], int(np.partition(sure, len(sure) - wide)[len(sure) - wide]))
                wanted |= (upper >= floors[i]) & (lower <= most)
            scan.keep(wanted)
        ids = block.ids[scan.rows()]
        for i, (_, most) in enumerate(windows):
            in_ = np.flatnonzero((scan.score >= floors[i]) & (scan.score <= most))
            at = in_[_top(scan.score[in_], ids[in_], wide)]
            found[i] = _best(found[i], scan.score[at], ids[at], keep)


def anchors_of(blocks_: DataFrame, every: int) -> DataFrame:
    """``vec_id, label, q`` (packed integers) of the rows whose id ``every`` divides."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            at = np.flatnonzero(block.ids % every == 0)
            q = np.ascontiguousarray(block.cols[:, at].T.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[at]), pa.array(block.labels[at]), pa.array([r.tobytes() for r in q], pa.binary())], names=["vec_id", "label", "q"])

    picked = blocks_.mapInArrow(pick, "vec_id long, label long, q binary")
    return picked.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("a")).select("vec_id", "a.*")


def _ranked(df: DataFrame, by: list[str], keep: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return df.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def mine(rows: DataFrame, every: int = 100, positives: int = KEEP, negatives: int = KEEP, low: int = 80, whole: int = 100) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of ``rows`` (``vec_id, label,
    embedding``) whose id ``every`` divides; a negative's score N and its positive's P satisfy low P <= whole N <= whole P."""
    spark = rows.sparkSession
    ship_package(spark)
    data = materialize(packed(rows), "negatives-blocks")
    anchors = materialize(anchors_of(data, every), "negatives-anchors")
    rounds = -(-anchors.count() // ANCHORS)
    best, out = RoundTable(spark, "negatives-positives"), RoundTable(spark, "negatives-found")
    for i in range(rounds):
        batch = []
        # at most about ANCHORS rows of one vector each come to the driver and go to every task
        for a in anchors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == i).collect():
            vector = np.frombuffer(a.q, dtype=np.int64)
            batch.append((a.vec_id, a.label, vector, np.argsort(-np.abs(vector), kind="stable")))
        sent = spark.sparkContext.broadcast(batch)

        def first(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            found = [[] for _ in sent.value]
            for block in blocks(batches):
                for k, anchor in enumerate(sent.value):
                    found[k] = scan_positives(block, anchor, found[k], positives)
            flat = [(sent.value[k][0], x, -s) for k, f in enumerate(found) for s, x in f]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*flat)) or [[], [], []])], names=["anchor", "id", "score"])

        near = best.write(_ranked(data.mapInArrow(first, "anchor long, id long, score long"), ["anchor"], positives))
        windows = {}
        for r in near.collect():
            windows.setdefault(r.anchor, []).append((r.score, r.rank))
        # equal scores open equal windows: one scan serves them
        spans = {a: sorted({s for s, _ in w if s >= 0}, reverse=True) for a, w in windows.items()}
        told = spark.sparkContext.broadcast(spans)

        def second(batches: Iterator[pa.RecordBatch], sent=sent, told=told) -> Iterator[pa.RecordBatch]:
            work = [(a, [(-(-low * p // whole), p) for p in told.value.get(a[0], [])]) for a in sent.value]
            found = [[[] for _ in w] for _, w in work]
            for block in blocks(batches):
                for (anchor, w), f in zip(work, found):
                    if w:
                        scan_negatives(block, anchor, w, f, negatives)
            flat = [(a[0], w[j][1], x, -s) for (a, w), f in zip(work, found) for j, g in enumerate(f) for s, x in g]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*flat)) or [[], [], [], []])], names=["anchor", "most", "id", "score"])

        hard = _ranked(data.mapInArrow(second, "anchor long, most long, id long, score long"), ["anchor", "most"], negatives)
        n, p = hard.alias("n"), near.alias("p")
        out.write(p.join(n, F.expr("p.anchor = n.anchor AND p.score = n.most")).select(
            F.col("p.anchor").alias("anchor_id"), F.col("p.id").alias("positive_id"), F.col("n.rank").alias("rank"), F.col("n.id").alias("negative_id"),
            F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score")))
        sent.unpersist()
        told.unpersist()
    if not rounds:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out.all()


def op11_hard_negatives(spark, sf_dir) -> DataFrame:
    """Hard negatives of every hundredth vector, after a seventh of the labels has moved on by one."""
    rows = load(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", moved.alias("label"), "embedding"))
