"""Near-duplicate classes by bottom-k sketches (operator 12).

A document's set holds the 64-bit hashes of its distinct ``k``-word shingles; its sketch is the ``SKETCH`` smallest of them, so one hash function
serves all documents. Documents of a Jaccard similarity of num/den or more link; classes are what links connect.

1. ``rows``: one pass over the texts: size and digest of every set, and the ``PROBE`` smallest hashes. Equal sets are one vertex from here on.
2. ``live``: the probe is a sketch too, and a prefix of the larger one. Sets of which fewer than the least probe overlap are held by any other set
   drop out; they are most. Only the texts of live sets are read again, for their sketches. Whole sets are neither written nor moved.
3. Inverted lists: each retained value's sets, rare values first. Two sets that link must share ``need`` values of their sketches,
   so each set enters the lists of its first ``size - need + 1`` values alone, and a pair is made at the first value that both enter. Values of one set and sets with too few
   shared values drop out; a value that a third of all texts hold comes last in every set's order.
4. First each list's sets of like size meet only one of them, the set with most shared values, so a group of thousands of near copies gives pairs
   in proportion to its members. Links found are contracted to classes; then only sets of different classes meet, and only if the parity
   bits of their sketches allow the needed overlap, and those of their whole sets the similarity.
5. The union-sketch estimate: of the smallest ``SKETCH`` values of two sketches' union, those that both hold. Pairs whose estimate is
   below ``need`` are dropped, as are those whose whole sets differ in more parity bits than linked sets can.
6. The other pairs are verified on whole sets, host by host: their texts move, less than their hashes, and are hashed where they meet.

Probability enters in steps 2, 3 and 5 alone: the overlap of a linked pair in the union sketch is a sum of at least num/den per draw.
``least_overlap`` takes the number that a pair at the threshold undercuts with a probability below ``MISS`` (1e-8), so a link is lost once in a
hundred million; sets within the sketch size are exact. No list, class or number of partners is capped.

Edge cases: null or empty texts have no shingles, link with nothing and are kept; a text of fewer words than ``k`` is one
shingle; repeated rows and equal texts share a class, and of rows with the class's smallest id each is kept; null ids are named only where all ids of a
class are null (null equals null, so such rows are kept); one text of any length is handled in one piece; an empty table gives an empty result; only
``doc_id`` and ``text`` are read, so other columns never clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import load, materialize, ship_package
from .components import components
from .hashing import mix, runs
from .marks import Marks

SKETCH, PROBE = 64, 32
MISS = 1e-8
#: 64-bit words of parity bits.
WORDS = 8
#: Shingles of the partners that one task entry of a host holds, about.
CHUNK = 500_000


def least_overlap(k: int, num: int, den: int, miss: float = MISS) -> int:
    """The largest m so that k draws with chance num/den each give fewer than m with a probability below ``miss``."""
    p, below = num / den, 0.0
    for m in range(k + 1):
        below += math.comb(k, m) * p**m * (1 - p) ** (k - m)
        if below >= miss:
            return m
    return k


def _need(n: Column, k: int, num: int, den: int) -> Column:
    """Values of its sketch of size k that a set of ``n`` shares with every set it links to: exact while the partner can't exceed the sketch."""
    return F.when(n * den <= F.lit(k * num), F.ceil(n * num / den)).otherwise(F.least(F.ceil(n * num / den), F.lit(least_overlap(k, num, den)))).cast("int")


def _digest(h: np.ndarray) -> int:
    total = mix(h).sum(dtype=np.uint64, keepdims=True) + np.array([len(h)], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(mix(total).view(np.int64)[0])


def _parity(h: np.ndarray) -> np.ndarray:
    """For each bit, whether an odd number of hashes falls on it: two sets differ in no fewer elements than bits."""
    bits = np.bincount((mix(h) >> np.uint64(20)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


_LONGS = pa.list_(pa.int64())


def summaries(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n, fp, probe`` of every row: size and digest of its set (null for an empty one) and its smallest hashes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, fp, probe = [], [], []
            for words in runs(b.column(1)):
                for _, h in words.sets(k):
                    n.append(len(h))
                    fp.append(_digest(h) if len(h) else None)
                    probe.append(h[:PROBE].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(probe, _LONGS)], names=["doc_id", "n", "fp", "probe"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, n long, fp long, probe array<long>")


def _shared(sets: DataFrame, values: str, k: int, num: int, den: int) -> DataFrame:
    """``token, fp, n, df`` of the values that several of ``sets`` (``fp, n`` and the array ``values``) hold, of sets that have enough of them."""
    each = sets.select("fp", "n", F.explode(values).alias("token"))
    several = materialize(each.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "sketch-several")
    # most values are one set's alone: marks keep them out of the exchange, the join decides
    e, s = Marks(several.select("token")).tell(each, F.col("token"), "known").filter("known").alias("e"), several.alias("s")
    held = e.join(s, F.col("e.token") == F.col("s.token")).select("e.token", "fp", "n", "df")
    enough = held.groupBy("fp", "n").agg(F.count("*").alias("shared"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"))
    return enough.filter(F.col("shared") >= _need(F.col("n"), k, num, den))


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, text`` of the rows whose id is in the column ``doc_id`` of ``ids`` (written), and of a few others: a join decides."""
    return Marks(ids.select("doc_id")).tell(docs.select(F.col("doc_id").cast("long"), "text"), F.col("doc_id"), "asked").filter("asked").select("doc_id", "text")


def sketched(docs: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """``fp, n, sketch, sketch_parity, parity`` of the vertices in ``live`` (written: ``fp, doc_id`` of one text each, and
    whether several rows have that id)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, at = [[] for _ in range(5)], []
            for words in runs(b.column(1)):
                for i, h in words.sets(k):
                    if len(h):
                        at.append(i)
                        low = h[:SKETCH]
                        for c, v in zip(cols, (_digest(h), len(h), low.view(np.int64), _parity(low), _parity(h))):
                            c.append(v)
            types = [pa.int64(), pa.int64(), _LONGS, _LONGS, _LONGS]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))],
                                             names=["doc_id", "fp", "n", "sketch", "sketch_parity", "parity"])

    def read(some: DataFrame) -> DataFrame:
        return _texts(docs, some).mapInArrow(of, "doc_id long, fp long, n long, sketch array<long>, sketch_parity array<long>, parity array<long>")

    once, twice = live.filter("NOT twice"), live.filter("twice")
    out = read(once).join(once.select("fp", F.col("doc_id").alias("of")).alias("l").hint("merge"), "fp").filter("doc_id <=> of").drop("doc_id", "of")
    if twice.isEmpty():
        return out
    # rows that share an id bring other texts along and may repeat one: they are told by their digest
    return out.unionByName(read(twice).drop("doc_id").dropDuplicates(["fp"]).join(twice.select("fp").hint("merge"), "fp", "left_semi"))


def _differ(bits: str) -> Column:
    return sum((F.bit_count(F.col(f"x.{bits}")[i].bitwiseXOR(F.col(f"y.{bits}")[i])) for i in range(WORDS)), F.lit(0))


def _parity_allows(num: int, den: int) -> Column:
    """Whether whole sets ``x`` and ``y`` differ in no more parity bits than linked sets can differ in shingles."""
    need = F.ceil((F.col("x.n") + F.col("y.n")) * num / (num + den))
    return _differ("parity") <= F.col("x.n") + F.col("y.n") - 2 * need


def _sizes_allow(num: int, den: int) -> Column:
    return F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num


def lists(sets: DataFrame, num: int, den: int) -> DataFrame:
    """``token, fp, n, shared, before``: the lists that each set enters, with the values that it enters before."""
    held = _shared(sets, "sketch", SKETCH, num, den)
    # a set's first values by rarity, one more than may be missing from a partner; those that nobody shares come first and are gone
    own = F.least(F.col("n"), F.lit(SKETCH)) - F.col("shared")
    take = F.least(F.col("n"), F.lit(SKETCH)) - _need(F.col("n"), SKETCH, num, den) + 1 - own
    prefix = held.withColumn("entered", F.slice(F.transform("held", lambda v: v["token"]), 1, F.greatest(take, F.lit(0)).cast("int")))
    each = prefix.select("fp", "n", "shared", "entered", F.posexplode("entered").alias("at", "token"))
    return each.select("token", "fp", "n", "shared", F.slice("entered", 1, F.col("at")).alias("before"))


def estimated(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``pairs`` (``host, partner``) that pass the union-sketch estimate and the parity of the whole sets, with the partner's size ``n``."""
    # sets without a pair stay where they are
    met = Marks(pairs.select(F.explode(F.array("host", "partner")).alias("fp"))).tell(sets.select("fp", "n", "sketch", "parity"), F.col("fp"), "met").filter("met").drop("met")
    p, x, y = pairs.alias("p"), met.alias("x"), met.alias("y")
    # as merge joins at any size: pairs grow with the sets
    both = p.join(x.hint("merge"), F.col("p.host") == F.col("x.fp")).join(y.hint("merge"), F.col("p.partner") == F.col("y.fp"))
    union = F.slice(F.array_sort(F.array_union(F.transform("x.sketch", _unsigned), F.transform("y.sketch", _unsigned))), 1, SKETCH)
    common = F.size(F.array_intersect(union, F.array_intersect(F.transform("x.sketch", _unsigned), F.transform("y.sketch", _unsigned))))
    least = least_overlap(SKETCH, num, den)
    # where the union is within the sketch, the estimate is the similarity itself
    passes = F.when((F.col("x.n") <= SKETCH) & (F.col("y.n") <= SKETCH) & (F.size(F.array_union("x.sketch", "y.sketch")) <= SKETCH),
                    common * den >= F.size(union) * num).otherwise(common >= least)
    return both.filter(_parity_allows(num, den) & passes).select("host", "partner", F.col("y.n").alias("n"))


def _unsigned(v: Column) -> Column:
    """Order of unsigned integers, as the sketches have it, among signed ones."""
    return v.bitwiseXOR(F.lit(-(1 << 63)))


def verified(pairs: DataFrame, docs: DataFrame, live: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The links ``a, b`` among ``pairs`` (``host, partner, n``, written) of vertices in ``live``, by whole sets. A host's text is read once for each
    chunk of its partners, and chunks have a bounded number of shingles."""
    load_of = pairs.groupBy("host").agg(F.ceil(F.sum("n") / CHUNK).cast("long").alias("chunks"))
    dealt = pairs.join(load_of, "host").select("host", "partner", F.pmod(F.xxhash64("partner"), F.col("chunks")).alias("chunk"))
    none = F.lit(None).cast("long")
    asked = dealt.select("host", "chunk", F.col("partner").alias("member"), F.col("partner").alias("fp")).unionByName(
        dealt.select("host", "chunk").distinct().select("host", "chunk", none.alias("member"), F.col("host").alias("fp")))
    asked = materialize(asked.join(live.hint("merge"), "fp"), "sketch-asked")
    once, twice = asked.filter("NOT twice"), asked.filter("twice")
    # one merge join fetches hosts and members; texts that nobody asks for stay where they are
    a, t = once.hint("merge").alias("a"), _texts(docs, once).alias("t")
    rows = a.join(t, F.expr("a.doc_id <=> t.doc_id")).select("host", "chunk", "member", "text")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [_digest(h) if len(h) else None for words in runs(b.column(1)) for _, h in words.sets(k)]
            yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), b.column(1)], names=["fp", "text"])

    if not twice.isEmpty():
        # of rows that share an id, as in ``sketched``
        own = _texts(docs, twice).mapInArrow(told, "fp long, text string").filter("fp IS NOT NULL")
        own = Marks(twice.select("fp")).tell(own, F.col("fp"), "asked").filter("asked").drop("asked").dropDuplicates(["fp"])
        rows = rows.unionByName(twice.hint("merge").join(own, "fp").select("host", "chunk", "member", "text"))
    rows = rows.repartition("host", "chunk").sortWithinPartitions("host", "chunk", F.col("member").asc_nulls_first())

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, values = None, None
        for b in batches:
            a_out, b_out = [], []
            of, members = b.column(0).to_pylist(), b.column(2).to_pylist()
            for words in runs(b.column(3)):
                for i, h in words.sets(k):
                    if members[i] is None:
                        # the host comes first and stays while its members pass
                        host, values = of[i], h.copy()
                        continue
                    at = np.minimum(np.searchsorted(values, h), len(values) - 1)
                    both = int((values[at] == h).sum())
                    if den * both >= num * (len(values) + len(h) - both):
                        a_out.append(host)
                        b_out.append(members[i])
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(links, "a long, b long")


def links(docs: DataFrame, rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Enough links ``a, b`` between the vertices of ``rows`` (written ``summaries``) to join every class."""
    some = rows.filter("fp IS NOT NULL")
    one = materialize(some.groupBy("fp", "n").agg(F.min("doc_id").alias("doc_id"), F.first("probe").alias("probe")), "sketch-one")
    live = _shared(one, "probe", PROBE, num, den).select("fp")
    twice = rows.groupBy("doc_id").agg(F.count("*").alias("m")).filter("m > 1").select(F.col("doc_id").alias("of"), F.lit(True).alias("several"))
    live = one.select("fp", "doc_id").join(live.hint("merge"), "fp", "left_semi").join(twice.hint("merge"), F.expr("doc_id <=> of"), "left")
    live = materialize(live.select("fp", "doc_id", F.coalesce("several", F.lit(False)).alias("twice")), "sketch-live")
    sets = materialize(sketched(docs, live, k), "sketch-sets")
    entered = materialize(lists(sets, num, den), "sketch-lists")

    # of each list and size band, the set with most shared values stands for the others
    step = math.log(den / num) if num < den else 1.0
    banded = entered.withColumn("band", F.floor(F.log("n") / step).cast("long"))
    most = F.max(F.struct((F.col("shared") / F.least(F.col("n"), F.lit(SKETCH))).alias("share"), "fp", "n")).alias("h")
    pivots = banded.groupBy("token", "band").agg(most).select("token", "band", "h.fp", "h.n")
    near = banded.select("token", "fp", "n", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    x, y = pivots.alias("x"), near.alias("y")
    first = x.join(y, ["token", "band"]).filter((F.col("x.fp") != F.col("y.fp")) & _sizes_allow(num, den)).select(F.col("x.fp").alias("host"), F.col("y.fp").alias("partner"))
    first = materialize(first.distinct(), "sketch-first")
    found = materialize(verified(materialize(estimated(first, sets, num, den), "sketch-estimated"), docs, live, k, num, den), "sketch-links")

    # what different classes still share
    e, c = entered.alias("e"), components(found).alias("c")
    marked = e.join(c, F.col("e.fp") == F.col("c.vertex"), "left").select("token", "fp", "n", "before", F.coalesce("component", "fp").alias("label"))
    marked = materialize(marked, "sketch-marked")
    mixed = marked.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token")
    m, s = marked.join(mixed, "token", "left_semi").alias("m"), sets.select("fp", "sketch_parity", "parity").alias("s")
    meeting = materialize(m.join(s, F.col("m.fp") == F.col("s.fp")).select("m.*", F.col("sketch_parity").alias("bits"), "parity"), "sketch-meeting")
    x, y = meeting.alias("x"), meeting.alias("y")
    sketch = lambda side: F.least(F.col(f"{side}.n"), F.lit(SKETCH))
    apart = sketch("x") + sketch("y") - 2 * F.greatest(_need(F.col("x.n"), SKETCH, num, den), _need(F.col("y.n"), SKETCH, num, den))
    rest = x.join(y, "token").filter((F.col("x.fp") < F.col("y.fp")) & (F.col("x.label") != F.col("y.label")) & _sizes_allow(num, den)
                                     & (_differ("bits") <= apart) & _parity_allows(num, den) & ~F.arrays_overlap("x.before", "y.before"))
    rest = rest.select(F.col("x.fp").alias("host"), F.col("y.fp").alias("partner"))
    done = first.select(F.least("host", "partner").alias("host"), F.greatest("host", "partner").alias("partner"))
    rest = materialize(rest.join(done, ["host", "partner"], "left_anti"), "sketch-rest")
    more = materialize(verified(materialize(estimated(rest, sets, num, den), "sketch-estimated"), docs, live, k, num, den), "sketch-more")
    return found.unionByName(more)


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``."""
    ship_package(docs.sparkSession)
    rows = materialize(summaries(docs, k), "sketch-rows")
    label = materialize(components(materialize(links(docs, rows, k, num, den), "sketch-edges")), "sketch-components")
    one = rows.filter("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least"))
    o, c = one.alias("o"), label.alias("c")
    vertex = o.join(c, F.col("o.fp") == F.col("c.vertex"), "left").select("o.fp", "least", F.coalesce("component", "o.fp").alias("component"))
    name = vertex.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(vertex.join(name, "component").select("fp", "component_id"), "sketch-named")
    r, v = rows.alias("r"), named.alias("v")
    out = r.join(v, F.col("r.fp") == F.col("v.fp"), "left").select(
        "r.doc_id", F.col("r.n").alias("n_shingles"), F.when(F.col("r.fp").isNull(), F.col("r.doc_id")).otherwise(F.col("v.component_id")).alias("component_id"))
    return out.withColumn("kept", F.expr("doc_id <=> component_id"))


def op12_minhash_near_dedup(spark, sf_dir) -> DataFrame:
    """Three-word shingles, similarity 85/100, over all documents."""
    return near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"), 3, 85, 100)
