"""Toxicity by nearest labelled examples under exact TF-IDF cosine (operator 5).

Terms are the words of a text in lower case (letters and digits). Examples are a bounded sample of labelled training rows
(``EXAMPLES`` of each class, those with the smallest hashes; a documented parameter), and every term of every example is
in the term space. Inverse document frequencies come from one pass over all documents, the share of toxic documents from all
training labels. A term's weight is its idf times one plus the root of the G statistic by which its presence tells toxic from
other documents in a bounded sample of training rows (``TRAIN`` of each class, those with the smallest id hashes): what tells
the classes apart weighs more, and no term weighs nothing. A text is the vector of its terms, (1 + log tf) times these
weights, scaled to length one; terms that no example holds match nothing and are left out of its length.

The examples form an inverted index. Rare terms have a list of the examples that hold them, which a query adds up in full.
The lists of common terms (in more than one example in ``COMMON``) are kept in blocks of ``BLOCK`` examples with the largest
weight in each. A query's upper bound in a block is the largest sum of rare terms there plus its common weights times these maxima; blocks
are scored in falling order of their bounds, in waves, until no bound exceeds the ``NEIGHBOURS``-th best similarity, so the
nearest examples are exact. Ties go to the smaller example number.

The score is a vote of the nearest examples, weighted by similarity, with a prior of weight ``PRIOR`` at the training share of
toxic documents, and then calibrated by isotonic steps fitted on the examples themselves, each scored without itself. Texts
without a term of an example have no neighbours and get the share of toxic documents among examples without terms, or else
among training documents. Evidence: the nearest examples' ids, similarities and labels.

Learning uses training rows only; labels, language, source and ids are never inputs of a score. The index is bounded
by its parameters and is what is broadcast; documents are never shuffled.

Edge cases: null and empty texts count as empty; a document labelled twice takes its larger label; null labels and labels
of no document are left out; without a label of either class every score is 0; repeated rows get equal scores; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import load, materialize, ship_package

#: Training documents of each class, at most, and examples of each class in the index, at most.
TRAIN = 8000
EXAMPLES = 1500
BLOCK = 64
#: A term that more than one example in so many holds has its list in blocks.
COMMON = 8
#: Blocks scored before the first look at the bounds; each further look comes after twice as many.
WAVE = 4
NEIGHBOURS = 15
PRIOR = 0.25
_WORD = re.compile(r"[^\W_]+")


def held_out(doc_id: str = "doc_id") -> Column:
    """Fixed by the task: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def terms(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def training_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic`` of the labelled documents outside the held-out fifth."""
    return labels.filter(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def _counted(rows: DataFrame, wanted: list[str], columns: int) -> dict[str, list[int]]:
    """For each of ``wanted``, and for ``""`` (every row), the rows of ``rows`` (``text, column``) that hold it, by ``column``.
    A task folds its own rows and sends one row a term."""
    names = [f"n{i}" for i in range(columns)]
    held = rows.sparkSession.sparkContext.broadcast(frozenset(wanted))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = held.value, [Counter() for _ in range(columns)]
        for b in batches:
            for text, column in zip(*(c.to_pylist() for c in b.columns)):
                counts[column].update(known.intersection(terms(text)))
                counts[column][""] += 1
        found = sorted(set().union(*counts))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())] + [pa.array([c[t] for t in found], pa.int64()) for c in counts], names=["term", *names])

    folded = rows.mapInArrow(fold, ", ".join(["term string", *[f"{n} long" for n in names]]))
    return {r[0]: list(r[1:]) for r in folded.groupBy("term").agg(*[F.sum(n).alias(n) for n in names]).collect()}


def discrimination(counts: dict[str, list[int]]) -> dict[str, float]:
    """The root of the G statistic of each term's presence against the class, from its (other, toxic) documents."""
    other, toxic = counts.get("", [0, 0])
    if not other or not toxic:
        return {}
    part = lambda x, y: x * math.log(x / y) if x > 0 and y > 0 else 0.0

    def root(n: int, m: int) -> float:
        a, b, both = m / toxic, n / other, (m + n) / (toxic + other)
        g = 2 * (toxic * (part(a, both) + part(1 - a, 1 - both)) + other * (part(b, both) + part(1 - b, 1 - both)))
        return math.sqrt(max(g, 0.0))

    return {t: root(n, m) for t, (n, m) in counts.items() if t}


def document_frequencies(docs: DataFrame, chosen: list[str]) -> dict[str, float]:
    """idf of each chosen term, over all of ``docs``."""
    n = _counted(docs.select(F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("column")), chosen, 1)
    every = n.get("", [0])[0]
    return {t: math.log(1 + every / n[t][0]) for t in chosen if n.get(t, [0])[0]}


class Index:
    """Block-max inverted index of unit vectors."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int):
        self.n = len(vectors)
        self.blocks = max(1, -(-self.n // BLOCK))
        term = np.array([t for v in vectors for t in v], dtype=np.int64)
        who = np.repeat(np.arange(self.n), [len(v) for v in vectors])
        weight = np.array([w for v in vectors for w in v.values()], dtype=np.float64)
        common = np.bincount(term, minlength=n_terms) * COMMON > self.n
        # the list of a common term, as the BLOCK weights of each block
        self.place = np.where(common, np.cumsum(common) - 1, -1)
        self.lists = np.zeros((int(common.sum()), self.blocks, BLOCK))
        here = common[term]
        self.lists[self.place[term[here]], who[here] // BLOCK, who[here] % BLOCK] = weight[here]
        self.most = self.lists.max(axis=2)
        # the list of a rare term t is [begin[t], begin[t + 1]) of who and weight
        term, self.who, self.weight = term[~here], who[~here], weight[~here]
        order = np.argsort(term, kind="stable")
        self.who, self.weight = self.who[order], self.weight[order]
        self.begin = np.searchsorted(term[order], np.arange(n_terms + 1))

    def nearest(self, v: dict[int, float], k: int, without: int = -1) -> list[tuple[int, float]]:
        """The ``k`` nearest vectors of positive similarity, exactly."""
        if not v or not self.n:
            return []
        t = np.fromiter(v, dtype=np.int64, count=len(v))
        w = np.fromiter(v.values(), dtype=np.float64, count=len(v))
        place = self.place[t]
        begin, size = self.begin[t], self.begin[t + 1] - self.begin[t]
        at = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
        rare = np.bincount(self.who[at], self.weight[at] * np.repeat(w, size), self.blocks * BLOCK).reshape(self.blocks, BLOCK)
        t, w = place[place >= 0], w[place >= 0]
        bound = rare.max(axis=1) + w @ self.most[t]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        similar, number, least = np.empty(0), np.empty(0, dtype=np.int64), 0.0
        at, wave = 0, WAVE
        while at < len(order):
            # a bound below the k-th best similarity ends the search: all later ones are no higher
            b = order[at: at + wave]
            b = b[bound[b] + 1e-11 >= least]
            if not len(b):
                break
            at, wave = at + wave, 2 * wave
            got = np.round(rare[b].ravel() + w @ self.lists[t[:, None], b].reshape(len(t), len(b) * BLOCK), 12)
            who = (b[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            hit = (got > 0) & (got >= least) & (who != without)
            similar, number = np.concatenate([similar, got[hit]]), np.concatenate([number, who[hit]])
            if len(similar) >= k:
                least = float(np.partition(similar, len(similar) - k)[len(similar) - k])
                similar, number = similar[similar >= least], number[similar >= least]
        best = np.lexsort((number, -similar))[:k]
        return list(zip(number[best].tolist(), similar[best].tolist()))


class Model:
    """Examples, index and calibration; everything that a task needs to score texts."""

    def __init__(self, weights: dict[str, float], share: float, examples: list[tuple[int, str, int]]):
        self.number = {t: i for i, t in enumerate(sorted(weights))}
        self.weights = [weights[t] for t in sorted(weights)]
        self.share = share
        vectors = [self.vector(x[1]) for x in examples]
        self.ids, self.labels = [x[0] for x in examples], [x[2] for x in examples]
        bare = [y for v, y in zip(vectors, self.labels) if not v]
        # the sample is dealt by class; weights bring back the training shares
        tox = max(1, sum(self.labels))
        self.weight = {1: share / tox, 0: (1 - share) / max(1, len(self.labels) - tox)}
        mass = sum(self.weight[y] for y in bare)
        self.bare = sum(self.weight[y] for y in bare if y) / mass if mass else share
        self.index = Index(vectors, len(self.weights))
        raw = [(self._vote(self.index.nearest(v, NEIGHBOURS, i)), y) for i, (v, y) in enumerate(zip(vectors, self.labels)) if v]
        self.steps = _isotonic(sorted((s, self.weight[y], y) for s, y in raw))

    def vector(self, text: str) -> dict[int, float]:
        tf = Counter(i for i in map(self.number.get, terms(text)) if i is not None)
        v = {t: (1 + math.log(n)) * self.weights[t] for t, n in sorted(tf.items())}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    def _vote(self, near: list[tuple[int, float]]) -> float:
        for_, all_ = PRIOR * self.share, PRIOR
        for i, s in near:
            # classes count by their training shares
            w = s * s * self.weight[self.labels[i]] * len(self.labels)
            all_ += w
            for_ += w * self.labels[i]
        return for_ / all_

    def score(self, text: str) -> tuple[float, list[tuple[int, float]]]:
        v = self.vector(text)
        if not v:
            return round(self.bare, 6), []
        near = self.index.nearest(v, NEIGHBOURS)
        return round(self._calibrated(self._vote(near)), 6), near

    def _calibrated(self, raw: float) -> float:
        if not self.steps:
            return raw
        xs, ys = self.steps
        return float(np.interp(raw, xs, ys))


def _isotonic(rows: list[tuple[float, float, int]]) -> tuple[list[float], list[float]] | None:
    """Pool-adjacent-violators fit of label on raw vote, as points to interpolate between."""
    pools: list[list[float]] = []
    for x, w, y in rows:
        pools.append([x * w, w, w * y])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return ([p[0] / p[1] for p in pools], [p[2] / p[1] for p in pools]) if pools else None


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, toxic``)."""
    ship_package(docs.sparkSession)
    known = materialize(training_labels(labels).withColumn("h", F.xxhash64("doc_id")), "toxic-labels")
    total = known.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("t")).first()
    share = total["t"] / total["n"] if total["n"] else 0.0
    chosen = None
    for toxic in (True, False):
        of = known.filter((F.col("toxic") == 1) == toxic)
        last = of.select("h").orderBy("h").limit(TRAIN).agg(F.max("h")).first()[0]
        some = of.filter(F.col("h") <= (last if last is not None else 0))
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most 2 TRAIN rows of two numbers, so the texts need no shuffle
    d, k = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).alias("d"), F.broadcast(chosen.select("doc_id", "toxic")).alias("k")
    labelled = materialize(d.join(k, F.col("d.doc_id") == F.col("k.doc_id")).select("d.doc_id", "text", "toxic"), "toxic-examples")
    # only hashes are sorted to choose the examples
    hashed = labelled.withColumn("h", F.xxhash64("doc_id", "text"))
    examples = []
    for label in (0, 1):
        of = hashed.filter((F.col("toxic") == 1) if label else (F.col("toxic") != 1))
        last = of.select("h").orderBy("h").limit(EXAMPLES).agg(F.max("h")).first()[0]
        if last is not None:
            examples += [(r[0], r[1], label) for r in of.filter(F.col("h") <= last).select("doc_id", "text", "h").sort("h", "doc_id", "text").collect()]
    if len({label for *_, label in examples}) < 2:
        return Model({}, share, examples)
    chosen = sorted({t for _, text, _ in examples for t in terms(text)})
    told = discrimination(_counted(labelled.select("text", (F.col("toxic") == 1).cast("int").alias("column")), chosen, 2))
    idf = document_frequencies(docs, chosen)
    return Model({t: x * (1 + told.get(t, 0.0)) for t, x in idf.items()}, share, examples)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, neighbours array<struct<doc_id:long,similarity:double,toxic:int>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted, neighbours`` of every row of ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            made = [m.score(t) for t in b.column(2).to_pylist()]
            near = [[{"doc_id": m.ids[i], "similarity": round(s, 6), "toxic": m.labels[i]} for i, s in n[:3]] for _, n in made]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([s for s, _ in made], pa.float64()), pa.array([int(s >= 0.5) for s, _ in made], pa.int32()), pa.array(near, kind)],
                names=["doc_id", "held_out", "score", "predicted", "neighbours"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(of, SCHEMA)


def op5_toxicity(spark, sf_dir) -> DataFrame:
    """Toxicity of every document."""
    docs = load(spark, sf_dir, "documents")
    return score(docs, train(docs, load(spark, sf_dir, "labels")))
