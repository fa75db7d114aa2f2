"""N-gram Jaccard join by prefix trees (operator 3).

Two texts link when the Jaccard similarity of their sets of ``k``-word shingles (64-bit hashes) is ``num/den`` or more.
The join is exact: a set of ``n`` shingles shares one of its first ``n - ceil(n num/den) + 1`` shingles, in any order that is
the same for all sets, with every set it links to.

1. ``fingerprints``: one row a text (size and digest of its set). Equal sets are one vertex from here on.
2. ``prefixes``: the global order puts the shingles of the lowest quarter of the hash space first, rare ones before
   frequent ones, then the others by hash. Each task packs the low shingles of its texts into one block for each part
   of the hash space; a part counts the sets that hold each shingle and sends back only shared ones, in blocks for
   each part of the vertices; there each set's prefix is cut. A set with enough shingles of its own has no shared
   shingle in its prefix and drops out for good. Parts grow in number with the corpus, not in size, and a shingle
   that a third of all texts hold is one small entry of each block.
3. Candidates meet at shared prefix shingles. First each set meets only one set of each size band there
   (a map-side minimum), so a group of thousands of near copies gives pairs in proportion to its members. The links
   found are contracted to components; then only sets of different components that still share a prefix shingle, and
   whose sizes, positions, own shingles and parity bits allow a link, meet pair by pair. Own shingles are those that no other live set
   holds, counted over the whole sets that are still alive; they are a lower bound of what a pair doesn't share, and
   the set with the fewest of them is the one that each group meets first. Every link between components is so
   found; links within a component that is already known change nothing.
4. ``verify``: the sets that meet one host are stored in a prefix tree (sorted sets; a node is a range with a common
   prefix). The host's overlap with a node's prefix is counted once for all sets below, and a subtree is left as soon
   as the overlap so far plus what the remaining lengths allow can't reach the threshold. Hosts with many partners are
   split into chunks of bounded size.
5. ``degrees``: every link lies inside a component, so the links of a text are counted there. A component is cut into
   blocks of bounded size; two blocks meet in a group of their own if they share a prefix shingle, and all overlaps of
   their sets come from one product of matrices. Counts come back, no pairs: a group of thousands of near copies, all
   linked with each other, gives a row for each set and meeting of blocks.

Edge cases: null or empty texts have no shingles, link with nothing and are their own component; a text of fewer words
than ``k`` is one shingle; repeated rows and equal texts share a component; one text of any length is handled in one
piece; an empty table gives an empty result. Components are named by their smallest ``doc_id`` (null only where all
of its ids are null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load, materialize, ship_package
from .components import components
from .hashing import mix, runs
from .marks import Marks

#: Share of the hash space whose shingles are ordered by rarity: hashes below 2 ** LOW_BITS.
LOW_BITS = 62
#: What travels with a set: its vertex, its size, and how many of its shingles are in the low quarter.
META = np.dtype([("fp", np.int64), ("n", np.int32), ("c", np.int32)])
#: Shingles of a part of the hash space, and of a chunk of partners, at most on average.
PART_ROWS = 3_000_000
CHUNK_ROWS = 500_000
#: Prefix shingles that a row carries from before it.
WINDOW = 8
#: 64-bit words of a set's parity bits.
PARITY_WORDS = 8
#: Sets of one shingle that a task meets at once, and meetings of a task on average.
SLICE_ROWS = 256
TASK_MEETINGS = 2_000_000
#: Sets of a block on average, and the blocks' columns (shingles) that are multiplied at once.
BLOCK_SETS = 512
COLUMNS = 4096


def _prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return n - (n * num + den - 1) // den + 1


def _digest(h: np.ndarray) -> int:
    """Digest of a set of shingles, as a signed 64-bit integer."""
    total = mix(h).sum(dtype=np.uint64, keepdims=True) + np.array([len(h)], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(mix(total).view(np.int64)[0])


def _parity(h: np.ndarray) -> np.ndarray:
    """For each bit, whether an odd number of shingles falls on it. A shingle that one of two sets lacks changes one bit, so
    their parities differ in no more bits than the sets differ in shingles."""
    bits = np.bincount((mix(h) >> np.uint64(20)).astype(np.int64) % (64 * PARITY_WORDS), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n_shingles, fp`` of every row; ``fp`` is null for an empty set."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, fp = [], []
            for words in runs(b.column(1)):
                for _, h in words.sets(k):
                    n.append(len(h))
                    fp.append(_digest(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.int64())], names=["doc_id", "n_shingles", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, n_shingles long, fp long")


def _blocks(part: np.ndarray, parts: int, owner: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """Rows dealt out by ``part``: (part, owners, columns) of each part that has any."""
    order = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(edge[1:] > edge[:-1]):
        at = order[edge[p]: edge[p + 1]]
        yield int(p), owner[at], [c[at] for c in columns]


def prefixes(docs: DataFrame, k: int, num: int, den: int, shingles: int) -> DataFrame:
    """``token, fp, n, pos`` of the shared shingles in the prefix of every set; ``shingles`` is their number in all texts,
    which sets the number of parts."""
    parts = max(8, -(-shingles // 4 // PART_ROWS))
    low = np.uint64(1) << np.uint64(LOW_BITS)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words in runs(b.column(0)):
                seen, meta, owner, token = set(), [], [], []
                for _, h in words.sets(k):
                    if not len(h) or (fp := _digest(h)) in seen:
                        continue
                    seen.add(fp)
                    n = len(h)
                    c = int(np.searchsorted(h, low))
                    take = max(c, n - (n * num + den - 1) // den + 1)
                    owner.append(np.full(take, len(meta), dtype=np.int32))
                    token.append(h[:take])
                    meta.append((fp, n, c))
                if not meta:
                    continue
                t, o = np.concatenate(token), np.concatenate(owner)
                m = np.array(meta, dtype=META)
                rows = []
                for p, own, (tok,) in _blocks((t % np.uint64(parts)).astype(np.int64), parts, o, [t]):
                    who, count = np.unique(own, return_counts=True)
                    rows.append((p, m[who].tobytes(), count.astype(np.int32).tobytes(), tok.tobytes()))
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        p, m, c, t = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(m, pa.binary()), pa.array(c, pa.binary()), pa.array(t, pa.binary())],
                                          names=["part", "meta", "count", "token"])

    def share(table: pa.Table) -> pa.Table:
        m, who, tok = _unpack(table)
        fp = m["fp"][who]
        order = np.lexsort((fp, tok))
        tok, fp, who = tok[order], fp[order], who[order]
        new = np.ones(len(tok), dtype=bool)
        new[1:] = (tok[1:] != tok[:-1]) | (fp[1:] != fp[:-1])
        tok, fp, who = tok[new], fp[new], who[new]
        edge = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1], [True]]))
        df = np.repeat(np.diff(edge), np.diff(edge))
        keep = df > 1
        tok, fp, who, df = tok[keep], fp[keep], who[keep], df[keep]
        rows = []
        both = np.stack([tok.view(np.int64), df], axis=1) if len(tok) else np.empty((0, 2), dtype=np.int64)
        for q, own, (tb,) in _blocks(fp.astype(np.int64) % parts, parts, who, [both]):
            order = np.argsort(m["fp"][own], kind="stable")
            own, tb = own[order], tb[order]
            _, first, count = np.unique(m["fp"][own], return_index=True, return_counts=True)
            rows.append((q, m[own[first]].tobytes(), count.astype(np.int32).tobytes(), tb.tobytes()))
        return pa.Table.from_batches([_batch(rows)] if rows else [], schema=schema)

    def cut(table: pa.Table) -> pa.Table:
        m, who, both = _unpack(table, 2)
        fp, n, c = m["fp"][who], m["n"][who].astype(np.int64), m["c"][who].astype(np.int64)
        tok, df = both[:, 0], both[:, 1]
        quota = _prefix_length(n, num, den)
        # where the low shingles are fewer than the prefix, everything sent is in it, ordered by hash alone
        rare = c >= quota
        order = np.lexsort((tok.view(np.uint64), np.where(rare, df, 0), fp))
        tok, fp, n, c, quota, rare = tok[order], fp[order], n[order], c[order], quota[order], rare[order]
        begin = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]])) if len(fp) else np.empty(0, dtype=np.int64)
        size = np.diff(np.append(begin, len(fp)))
        rank = np.arange(len(fp)) - np.repeat(begin, size)
        pos = np.where(rare, c - np.repeat(size, size) + rank, 0)
        keep = pos < quota
        return pa.table({"token": pa.array(tok[keep]), "fp": pa.array(fp[keep]), "n": pa.array(n[keep]), "pos": pa.array(pos[keep].astype(np.int64))})

    def _unpack(table: pa.Table, wide: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        join = lambda name, dtype: np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=dtype)
        m, count = join("meta", META), join("count", np.int32)
        values = join("token", np.uint64) if wide == 1 else join("token", np.int64).reshape(-1, wide)
        return m, np.repeat(np.arange(len(m)), count), values

    schema = pa.schema([("part", pa.int64()), ("meta", pa.binary()), ("count", pa.binary()), ("token", pa.binary())])
    ddl = "part long, meta binary, count binary, token binary"
    sent = docs.select("text").mapInArrow(scatter, ddl)
    shared = sent.groupBy("part").applyInArrow(share, ddl)
    return shared.groupBy("part").applyInArrow(cut, "token long, fp long, n long, pos long")


def shared_counts(sets: DataFrame, shingles: int) -> DataFrame:
    """``fp, shared``: how many shingles of each set in ``sets`` another of them holds too (no row for none)."""
    parts = max(8, -(-shingles // PART_ROWS))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.asarray(b.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            held = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in b.column(1)]
            at = 0
            while at < len(held):
                end, size = at, 0
                while end < len(held) and (end == at or size + len(held[end]) <= PART_ROWS // 4):
                    size += len(held[end])
                    end += 1
                t = np.concatenate(held[at:end])
                o = np.repeat(np.arange(at, end), [len(h) for h in held[at:end]])
                rows = []
                for p, own, (tok,) in _blocks((t % np.uint64(parts)).astype(np.int64), parts, o, [t]):
                    who, count = np.unique(own, return_counts=True)
                    rows.append((p, fps[who].tobytes(), count.astype(np.int32).tobytes(), tok.tobytes()))
                part, who, count, tok = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(who, pa.binary()), pa.array(count, pa.binary()), pa.array(tok, pa.binary())],
                                                 names=["part", "fps", "count", "token"])
                at = end

    def share(table: pa.Table) -> pa.Table:
        join = lambda name, dtype: np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=dtype)
        fp, tok = np.repeat(join("fps", np.int64), join("count", np.int32)), join("token", np.uint64)
        order = np.argsort(tok, kind="stable")
        fp, tok = fp[order], tok[order]
        same = tok[1:] == tok[:-1]
        several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        who, count = np.unique(fp[several], return_counts=True)
        return pa.table({"fp": pa.array(who, pa.int64()), "shared": pa.array(count, pa.int64())})

    sent = sets.select("fp", "shingles").mapInArrow(scatter, "part long, fps binary, count binary, token binary")
    return sent.groupBy("part").applyInArrow(share, "fp long, shared long").groupBy("fp").agg(F.sum("shared").alias("shared"))


class PrefixTree:
    """Sorted sets as a prefix tree: a node is a range of sets, its edge the shingles they share beyond its parent."""

    BLOCK = 256

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.order, self.sets = order, [sets[i] for i in order]
        self.size = np.array([len(s) for s in self.sets], dtype=np.int64)
        self.common = np.array([0] + [self._shared(a, b) for a, b in zip(self.sets, self.sets[1:])], dtype=np.int64)

    @staticmethod
    def _shared(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        step = 64
        for at in range(0, n, step):
            differ = np.flatnonzero(a[at: min(at + step, n)] != b[at: min(at + step, n)])
            if len(differ):
                return at + int(differ[0])
        return n

    def linked(self, host: np.ndarray, num: int, den: int) -> list[int]:
        """Indexes of the sets whose similarity with ``host`` is num/den or more."""
        found = []
        nh = len(host)
        stack = [(0, len(self.sets), 0, 0)] if self.sets else []
        while stack:
            lo, hi, depth, overlap = stack.pop()
            end = len(self.sets[lo]) if hi - lo == 1 else int(self.common[lo + 1: hi].min())
            least, most = int(self.size[lo:hi].min()), int(self.size[lo:hi].max())
            need = -(-num * (nh + least) // (num + den))
            alive = min(least, nh) >= need or min(most, nh) >= need
            while alive and depth < end:
                edge = self.sets[lo][depth: min(depth + self.BLOCK, end)]
                at = np.searchsorted(host, edge)
                hit = host[np.minimum(at, nh - 1)] == edge
                overlap += int(hit.sum())
                depth += len(edge)
                passed = int(at[-1]) + int(hit[-1])
                alive = overlap + min(most - depth, nh - passed) >= need
            if not alive:
                continue
            if hi - lo == 1:
                if (num + den) * overlap >= num * (nh + len(self.sets[lo])):
                    found.append(self.order[lo])
                continue
            cuts = [lo] + [int(x) + lo + 1 for x in np.flatnonzero(self.common[lo + 1: hi] == end)] + [hi]
            stack.extend((a, b, end, overlap) for a, b in zip(cuts, cuts[1:]))
        return found


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The links ``a, b`` among ``pairs`` (``host, partner, n`` with ``n`` the partner's size); ``sets`` has ``fp, shingles``."""
    load_of = pairs.groupBy("host").agg(F.ceil(F.sum("n") / CHUNK_ROWS).cast("long").alias("chunks"))
    dealt = pairs.join(load_of, "host").select("host", "partner", F.pmod(F.xxhash64("partner"), F.col("chunks")).alias("chunk"))
    p, s = dealt.alias("p"), sets.alias("s")
    members = p.join(s, F.col("p.partner") == F.col("s.fp")).select("host", "chunk", F.col("partner").alias("member"), "shingles")
    d = dealt.select("host", "chunk").distinct().alias("d")
    hosts = d.join(s, F.col("d.host") == F.col("s.fp")).select("host", "chunk", F.lit(None).cast("long").alias("member"), "shingles")
    rows = hosts.unionByName(members).repartition("host", "chunk").sortWithinPartitions("host", "chunk", F.col("member").asc_nulls_first())

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, members, sets = None, [], []

        def closed() -> tuple[list[int], list[int]]:
            if not members:
                return [], []
            hit = [members[i] for i in PrefixTree(sets).linked(host[1], num, den)]
            return [host[0]] * len(hit), hit

        for b in batches:
            a_out, b_out = [], []
            for h, m, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                values = np.frombuffer(s.as_buffer(), dtype=np.uint64)
                if m is None:
                    x, y = closed()
                    a_out += x
                    b_out += y
                    host, members, sets = (h, values.copy()), [], []
                else:
                    members.append(m)
                    sets.append(values.copy())
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])
        x, y = closed()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(links, "a long, b long")


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``fp, shingles, parity`` of the vertices in ``wanted`` (``fp, doc_id`` of one text each): packed, sorted shingles and
    their parity bits."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, packed, parity = [], [], []
            for words in runs(b.column(0)):
                for _, h in words.sets(k):
                    fp.append(_digest(h) if len(h) else None)
                    packed.append(h.tobytes())
                    parity.append(_parity(h))
            yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array(packed, pa.binary()), pa.array(parity, pa.list_(pa.int64()))],
                                             names=["fp", "shingles", "parity"])

    # most texts are not live: marks keep them out of the exchange
    d = docs.select(F.col("doc_id").cast("long"), "text")
    d = Marks(wanted.select("doc_id")).tell(d, F.col("doc_id"), "live").filter("live").alias("d")
    w = wanted.select("fp", F.col("doc_id").alias("of")).alias("w")
    # as a merge join at any size: the live ids are no small side by contract
    texts = d.join(w.hint("merge"), F.expr("d.doc_id <=> w.of")).select("d.text")
    # repeated ids may bring other texts along: they are told by their digest
    made = texts.mapInArrow(of, "fp long, shingles binary, parity array<long>")
    return made.join(wanted.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.first("shingles").alias("shingles"), F.first("parity").alias("parity"))


def _may_link(num: int, den: int) -> F.Column:
    """Whether rows ``x`` and ``y`` can link by what each holds for itself: at least ``need`` shingles must be common,
    and at most ``x.n + y.n - 2 need`` may be in one of them only."""
    need = F.ceil((F.col("x.n") + F.col("y.n")) * num / (num + den))
    alone = F.col("x.n") - F.col("x.shared") + F.col("y.n") - F.col("y.shared")
    return (need <= F.least("x.shared", "y.shared")) & (alone <= F.col("x.n") + F.col("y.n") - 2 * need)


def _parity_allows(num: int, den: int) -> F.Column:
    """Whether the parities of rows ``x`` and ``y`` differ in no more bits than linked sets can differ in shingles."""
    need = F.ceil((F.col("x.n") + F.col("y.n")) * num / (num + den))
    differ = sum((F.bit_count(F.col("x.parity")[i].bitwiseXOR(F.col("y.parity")[i])) for i in range(PARITY_WORDS)), F.lit(0))
    return differ <= F.col("x.n") + F.col("y.n") - 2 * need


def _pairs(met: DataFrame) -> DataFrame:
    """Pairs that meet at any shingle, without the sides' order."""
    return met.groupBy(F.col("x.fp").alias("host"), F.col("y.fp").alias("partner")).agg(F.first("y.n").alias("n"))


def _meet_once(rows: DataFrame) -> DataFrame:
    """``rows`` with ``prev``, the WINDOW prefix shingles before each: two sets that share a shingle before, near by on both
    sides, have met there. Their first common shingle always lets them meet."""
    before = Window.partitionBy("fp").orderBy("pos", "token")
    return rows.withColumn("prev", F.array_compact(F.array(*[F.lag("token", i).over(before) for i in range(1, WINDOW + 1)])))


def _sliced(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the meeting of ``open_`` (a written table), by ``token, slice``: the sets of a shingle are cut into slices,
    and each slice meets all of them in a group of its own, so the meetings of a frequent shingle are many tasks' work.
    The partitions are as many as the meetings ask for, not the bytes, which say little about them."""
    size = materialize(open_.groupBy("token").agg(F.count("*").alias("m")).withColumn("slices", F.ceil(F.col("m") / SLICE_ROWS).cast("int")), "jaccard-slices")
    meetings = size.agg(F.sum(F.col("m").cast("double") * F.col("m"))).first()[0] or 0
    parts = max(8, int(meetings // TASK_MEETINGS) + 1)
    rows = open_.join(size.select("token", "slices"), "token")
    x = rows.withColumn("slice", F.pmod(F.hash("fp"), "slices")).drop("slices")
    y = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    return x.repartition(parts, "token", "slice").alias("x"), y.repartition(parts, "token", "slice").alias("y")


def links(docs: DataFrame, rows: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Enough links ``a, b`` between the vertices of ``rows`` (a written table of ``fingerprints``) to join every component,
    with the sets (``_sets_of``) and the prefix rows of the vertices that may link."""
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    prefix = materialize(prefixes(docs, k, num, den, total), "jaccard-prefix")
    several = prefix.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1").select("token")
    live = prefix.join(several, "token", "left_semi").groupBy("fp").agg(F.first("n").alias("n"))
    one = rows.filter("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    sets = materialize(_sets_of(docs, materialize(one.join(live, "fp"), "jaccard-live"), k), "jaccard-sets")

    # shingles that no other live set holds bound every overlap of their set
    counts = shared_counts(sets, (live.agg(F.sum("n")).first()[0] or 0))
    p, c = prefix.alias("p"), materialize(counts, "jaccard-shared").alias("c")
    prefix = (p.join(c, F.col("p.fp") == F.col("c.fp")).select("token", "p.fp", "n", "pos", "shared")
              .filter(F.col("shared") * den >= F.col("n") * num))
    prefix = materialize(prefix, "jaccard-open")

    # of each shingle and size band, the set with the least of its own stands for the others
    step = float(np.log(den / num)) if num < den else 1.0
    banded = prefix.withColumn("band", F.floor(F.log("n") / step).cast("long"))
    own = F.struct((1 - F.col("shared") / F.col("n")).alias("own"), "fp", "n", "shared")
    pivots = banded.groupBy("token", "band").agg(F.min(own).alias("h")).select("token", "band", "h.fp", "h.n", "h.shared")
    near = banded.select("token", "fp", "n", "shared", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    x, y = pivots.alias("x"), near.alias("y")
    first = x.join(y, ["token", "band"]).filter((F.col("x.fp") != F.col("y.fp")) & _may_link(num, den))
    first = materialize(_pairs(first), "jaccard-pairs")
    found = materialize(verify(first, sets, num, den), "jaccard-links")

    # what different components still share
    label = components(found)
    p, c = prefix.alias("p"), label.alias("c")
    marked = p.join(c, F.col("p.fp") == F.col("c.vertex"), "left").select("token", "fp", "n", "pos", "shared", F.coalesce("component", "fp").alias("label"))
    marked = materialize(marked, "jaccard-marked")
    mixed = marked.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token")
    m, s = _meet_once(marked.join(mixed, "token", "left_semi")).alias("m"), sets.alias("s")
    open_ = materialize(m.join(s, F.col("m.fp") == F.col("s.fp")).select("m.*", "s.parity"), "jaccard-meeting")
    x, y = _sliced(open_)
    need = F.ceil((F.col("x.n") + F.col("y.n")) * num / (num + den))
    rest = x.join(y, ["token", "slice"]).filter((F.col("x.fp") < F.col("y.fp")) & (F.col("x.label") != F.col("y.label")) & _may_link(num, den)
                                     & (F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= need)
                                     & _parity_allows(num, den) & ~F.arrays_overlap("x.prev", "y.prev"))
    done = first.select(F.least("host", "partner").alias("host"), F.greatest("host", "partner").alias("partner"))
    rest = materialize(_pairs(rest).join(done, ["host", "partner"], "left_anti"), "jaccard-rest")
    more = materialize(verify(rest, sets, num, den), "jaccard-more")
    return found.unionByName(more), sets, prefix


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``x`` shares with each set of ``y``."""
    held = x + y
    token = np.unique(np.concatenate(held), return_inverse=True)[1]
    who = np.repeat(np.arange(len(held)), [len(h) for h in held])
    left = who < len(x)
    df = [np.bincount(token[at], minlength=token.max() + 1) for at in (left, ~left)]
    # shingles with the same holders are one column, as heavy as they are many; holders told apart by sums of random words
    word = mix(np.arange(1, len(held) + 1, dtype=np.uint64))
    order = np.argsort(token, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], token[order][1:] != token[order][:-1]]))
    holders = np.add.reduceat(word[who[order]], begin)
    both = np.flatnonzero((df[0] > 0) & (df[1] > 0))
    _, first, weight = np.unique(holders[both], return_index=True, return_counts=True)
    column = np.full(len(begin), -1)
    column[both[first]] = np.arange(len(first))
    col = column[token]
    out = np.zeros((len(x), len(y)))
    for at in range(0, len(first), COLUMNS):
        wide = min(COLUMNS, len(first) - at)
        here = (col >= at) & (col < at + wide)
        m = np.zeros((len(held), wide), dtype=np.float32)
        m[who[here], col[here] - at] = 1
        out += (m[:len(x)] * weight[at: at + wide].astype(np.float32)) @ m[len(x):].T
    return out


def degrees(label: DataFrame, sets: DataFrame, prefix: DataFrame, copies: DataFrame, num: int, den: int) -> DataFrame:
    """``fp, links``: with how many rows of other sets each set of the components ``label`` (``vertex, component``) links;
    ``copies`` (``fp, copies``) are the rows of a set, ``prefix`` the prefix rows of all sets that may link."""
    # a little wider than the sizes of linked sets can differ, so that they lie in neighbouring bands in spite of rounding
    step = 1.001 * float(np.log(den / num)) if num < den else 1.0
    # as many blocks as members or shingles ask for; linked sets mostly have the same least shingle
    cells = lambda: F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / CHUNK_ROWS))
    s = sets.select("fp", (F.octet_length("shingles") / 8).cast("long").alias("n"), F.xxhash64(F.expr("substring(shingles, 1, 8)")).alias("least")).alias("s")
    l_ = label.alias("l")
    members = materialize(s.join(l_, F.col("s.fp") == F.col("l.vertex")).select("fp", "n", "least", "component"), "jaccard-members")
    large = members.groupBy("component").agg(cells().alias("cells"))
    dealt = members.join(large, "component").select(
        "fp", "n", "component", F.when(F.col("cells") > 1, F.floor(F.log("n") / step).cast("long")).otherwise(0).alias("band"), F.pmod("least", "cells").alias("cell"))
    dealt = materialize(dealt, "jaccard-cells")
    cut = dealt.groupBy("component", "band", "cell").agg(cells().alias("cuts"))
    place = F.struct("component", "band", "cell", F.pmod(F.xxhash64("fp"), "cuts").alias("cut"))
    block = materialize(dealt.join(cut, ["component", "band", "cell"]).select("fp", "component", "band", F.xxhash64(place).alias("block")), "jaccard-blocks")
    # blocks of one component meet if a shingle is in a prefix on both sides and their sizes allow a link
    p, b = prefix.select("token", "fp").alias("p"), block.alias("b")
    several = block.groupBy("component").agg(F.count_distinct("block").alias("m")).filter("m > 1").select("component")
    at = p.join(b.join(several, "component", "left_semi"), "fp").select("token", "component", "band", "block").distinct()
    at = materialize(at, "jaccard-block-tokens")
    x, y = at.alias("x"), at.alias("y")
    met = (x.join(y, ["token", "component"]).filter((F.col("x.block") < F.col("y.block")) & (F.abs(F.col("x.band") - F.col("y.band")) <= 1))
           .select(F.col("x.block").alias("a"), F.col("y.block").alias("b")).distinct())
    met = materialize(met.unionByName(block.select(F.col("block").alias("a"), F.col("block").alias("b")).distinct()), "jaccard-block-pairs")
    sides = met.select("a", "b", F.col("a").alias("block"), F.lit(0).alias("side")).unionByName(
        met.filter("a <> b").select("a", "b", F.col("b").alias("block"), F.lit(1).alias("side")))
    full = block.select("fp", "block").join(sets.select("fp", "shingles"), "fp").join(copies, "fp")
    rows = full.join(sides, "block").select("a", "b", "side", "fp", "copies", "shingles").repartition("a", "b").sortWithinPartitions("a", "b", "side")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [])

        def closed() -> tuple[list, list]:
            x, y = held
            if key is None or len(x) + len(y) < 2:
                return [], []
            other = y if key[0] != key[1] else x
            size = [np.array([len(h) for _, _, h in side]) for side in (x, other)]
            linked = (num + den) * _overlaps([h for _, _, h in x], [h for _, _, h in other]) >= num * (size[0][:, None] + size[1][None, :])
            if other is x:
                np.fill_diagonal(linked, False)
            fp, n = [f for f, _, _ in x], (linked @ np.array([c for _, c, _ in other])).tolist()
            if other is not x:
                fp, n = fp + [f for f, _, _ in y], n + (np.array([c for _, c, _ in x]) @ linked).tolist()
            return fp, n

        for batch in batches:
            fps, ns = [], []
            for a, b, side, fp, c, s in zip(*[batch.column(i).to_pylist() for i in range(5)], batch.column(5)):
                if (a, b) != key:
                    f, n = closed()
                    fps += f
                    ns += n
                    key, held = (a, b), ([], [])
                held[side].append((fp, c, np.frombuffer(s.as_buffer(), dtype=np.uint64).copy()))
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(ns, pa.int64())], names=["fp", "links"])
        f, n = closed()
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(n, pa.int64())], names=["fp", "links"])

    return rows.mapInArrow(count, "fp long, links long").groupBy("fp").agg(F.sum("links").alias("links"))


def _classes(docs: DataFrame, k: int, num: int, den: int, count_links: bool) -> tuple[DataFrame, DataFrame]:
    """``fingerprints`` of ``docs``, and ``fp, component_id`` of their vertices, with ``n_links`` if asked, as written tables."""
    ship_package(docs.sparkSession)
    rows = materialize(fingerprints(docs, k), "jaccard-rows")
    edges, sets, prefix = links(docs, rows, k, num, den)
    label = materialize(components(materialize(edges, "jaccard-edges")), "jaccard-components")
    one = rows.filter("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    o, c = one.alias("o"), label.alias("c")
    vertex = (o.join(c, F.col("o.fp") == F.col("c.vertex"), "left")
              .select("o.fp", "least", "copies", F.coalesce("component", "o.fp").alias("component")))
    name = vertex.groupBy("component").agg(F.min("least").alias("component_id"))
    if not count_links:
        return rows, materialize(vertex.join(name, "component").select("fp", "component_id"), "jaccard-named")
    vertex = materialize(vertex, "jaccard-vertices")
    v, g = vertex.alias("v"), degrees(label, sets, prefix, vertex.select("fp", "copies"), num, den).alias("g")
    counted = v.join(g, F.col("v.fp") == F.col("g.fp"), "left").select(
        "v.fp", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows, materialize(counted.join(name, "component").select("fp", "component_id", "n_links"), "jaccard-named")


def join(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` of every row of ``docs``; ``n_links`` counts all other rows that it links with,
    also those with the same set."""
    return _joined(*_classes(docs, k, num, den, True)).withColumn("n_links", F.coalesce("n_links", F.lit(0)))


def _joined(rows: DataFrame, named: DataFrame) -> DataFrame:
    r, v = rows.alias("r"), named.alias("v")
    return r.join(v, F.col("r.fp") == F.col("v.fp"), "left").select(
        "r.doc_id", "r.n_shingles", F.when(F.col("r.fp").isNull(), F.col("r.doc_id")).otherwise(F.col("v.component_id")).alias("component_id"),
        *[f"v.{c}" for c in named.columns if c == "n_links"])


def keep_one(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` without the rows whose component has a smaller ``doc_id``; of rows with equal id and text, one stays.

    What goes is decided on narrow rows. Only the texts that may go, or whose id occurs twice, are shuffled; the others
    stay where they are read. User columns travel in one struct, so their names can't clash.
    """
    decided = materialize(_joined(*_classes(docs, k, num, den, False)).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max(F.expr("component_id <=> doc_id")).alias("kept")), "jaccard-decided")
    gone = materialize(decided.filter("NOT kept").select("doc_id"), "jaccard-gone")
    repeated = materialize(decided.filter("n > 1").select("doc_id"), "jaccard-repeated")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("body"), F.struct(*docs.columns).alias("row"))
    rows = Marks(gone).tell(Marks(repeated).tell(rows, F.col("id"), "twice"), F.col("id"), "out")
    d, g = rows.filter("out OR twice").alias("d"), gone.alias("g")
    # as a merge join at any size: what goes grows with the input
    unsure = d.join(g.hint("merge"), F.expr("d.id <=> g.doc_id"), "left_anti").dropDuplicates(["id", "body"])
    return rows.filter("NOT (out OR twice)").select("row.*").unionByName(unsure.select("row.*"))


def op3_ngram_jaccard_join(spark, sf_dir) -> DataFrame:
    """Four-word shingles, similarity 85/100, over all documents."""
    return join(load(spark, sf_dir, "documents").select("doc_id", "text"), 4, 85, 100)
