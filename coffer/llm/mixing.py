"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 10, native).

Each source has a token target. Whole epochs come first: a source whose target is ``e`` times its size or more
gives every document ``e`` times. What is left of the target is drawn without replacement: document ``i`` gets the
exponential key ``-ln(u_i) / w_i`` (``u_i`` uniform, from a hash of the row; ``w_i`` its quality weight), documents
are ordered by key within their source, sizes are prefix-summed, and documents are taken until the budget is used;
the document that crosses it is cut there.

The prefix sums need no sort of a whole source: ``1 - exp(-key)`` maps keys, in order, to ``buckets`` equal bins;
bin totals are summed with map-side combining, a running total over at most ``buckets`` rows a source finds the bin
that the budget falls in, and only the rows of that bin are ordered. So a source that holds a third of all rows is
never in one task. The decision for a source is then one row (epochs, cut key, words left at the cut), joined to
the documents without moving their texts.

Edge cases: a null text has size 0; null sources are one source, ordered last; a source without words has target 0
and takes nothing; rows that are equal in doc_id and text share a key, and share the words left if the cut falls on
them; an empty table gives an empty result. Columns that the operator doesn't use are passed through by ``mix``;
its own columns win over columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import load, materialize, text_of, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BUCKETS = 4096
#: Columns that ``mix`` adds.
MIX = ("size", "source_size", "target", "taken")


def quality_weight(text: Column) -> Column:
    """Share of letters among the characters that are no white space, from 0.1 (also for no such character) to 1."""
    body = F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")
    letters = F.length(F.regexp_replace(body, r"\P{L}+", ""))
    n = F.length(body)
    return F.when(n > 0, F.greatest(F.lit(0.1), letters / n)).otherwise(F.lit(0.1))


def sample_key(doc_id: str, text: Column, weight: Column, seed: int) -> Column:
    """Efraimidis-Spirakis key of a row: smallest keys are drawn first."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), text))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1.0) / float(2**48 + 1)
    return -F.log(u) / weight


def measure(docs: DataFrame, seed: int = 1) -> DataFrame:
    """``docs`` with ``size`` and ``mix_key``; no shuffle."""
    own = [c for c in docs.columns if c not in (*MIX, "mix_key")]
    text = text_of()
    return docs.select(*own, F.size(words(text)).cast("long").alias("size"),
                       sample_key("doc_id", text, quality_weight(text), seed).alias("mix_key"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Token target of each source: ``source, source_size, target``.

    Weights repeat over the sources in code-point order, null last. ``share`` times all words are dealt out by
    weight; no source gets more than ``cap`` times its words, and the excess goes to the others by weight. With the
    sources ordered by ``cap / weight``, the capped ones are a prefix, so two running sums solve it without a loop.
    The windows run over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # code-point order: Spark compares the UTF-8 bytes
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(rank, F.lit(len(weights))).cast("int"))
    s = per.select("source", "source_size", w.alias("w"), (F.col("source_size") * float(cap)).alias("most"))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * float(share)
    s = s.withColumn("level", (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    s = s.withColumn("capped", F.col("most") <= F.col("level") * F.col("w"))
    s = s.withColumn("final", F.max(F.when(~F.col("capped"), F.struct(-F.col("most") / F.col("w"), F.col("level"))))
                     .over(everything).getField("level"))
    return s.select("source", "source_size",
                    F.when(F.col("capped"), F.col("most")).otherwise(F.least("most", F.col("final") * F.col("w"))).alias("target"))


def cuts(sizes: DataFrame, goal: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Decision for each source: ``source, source_size, target, epochs, cut_key, cut_take``.

    A document is taken ``epochs`` times, once more if its key is below ``cut_key``, and ``cut_take`` words more if
    its key is ``cut_key``.
    """
    plan = goal.select("source", "source_size", "target",
                       F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
                       .cast("long").alias("epochs"))
    plan = plan.withColumn("left", F.floor(F.col("target")) - F.col("epochs") * F.col("source_size"))
    bin_of = F.least(F.floor((1 - F.exp(-F.col("mix_key"))) * buckets), F.lit(buckets - 1)).cast("int")
    binned = sizes.filter(F.col("size") > 0).select("source", "mix_key", "size", bin_of.alias("bin"))
    totals = binned.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    upto = Window.partitionBy("source").orderBy("bin")
    totals = totals.withColumn("above", F.sum("bin_size").over(upto)).withColumn("below", F.col("above") - F.col("bin_size"))
    p, t = plan.alias("p"), totals.alias("t")
    hit = (p.join(t, F.expr("p.source <=> t.source") & (F.col("below") <= F.col("left")) & (F.col("left") < F.col("above")))
           .select("p.source", "left", "bin", "below"))
    # rows of the bin in which the budget ends; equal keys are one step
    h, b = hit.alias("h"), binned.alias("b")
    rows = (b.join(h, F.expr("b.source <=> h.source") & (F.col("b.bin") == F.col("h.bin")))
            .groupBy("h.source", "left", "below", "mix_key").agg(F.sum("size").alias("size"), F.count("*").alias("same")))
    step = Window.partitionBy("source").orderBy("mix_key")
    rows = rows.withColumn("end", F.col("below") + F.sum("size").over(step))
    at = (rows.filter((F.col("end") > F.col("left")) & (F.col("end") - F.col("size") <= F.col("left")))
          .select("source", F.col("mix_key").alias("cut_key"),
                  F.floor((F.col("left") - F.col("end") + F.col("size")) / F.col("same")).alias("cut_take")))
    p, a = plan.alias("p"), at.alias("a")
    return p.join(a, F.expr("p.source <=> a.source"), "left").select(
        "p.source", "source_size", "target", "epochs", "cut_key", "cut_take")


def apply_cuts(measured: DataFrame, decided: DataFrame) -> DataFrame:
    """``measured`` with ``source_size, target, taken``; ``decided`` is a written table, so its size is known."""
    m, c = measured.alias("m"), decided.alias("c")
    extra = (F.when(F.col("mix_key") < F.col("cut_key"), F.col("size"))
             .when(F.col("mix_key") == F.col("cut_key"), F.col("cut_take")).otherwise(F.lit(0)))
    return m.join(c, F.expr("m.source <=> c.source"), "left").select(
        "m.*", "c.source_size", "c.target", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 1) -> DataFrame:
    """All rows of ``docs`` with ``size, source_size, target, taken`` (which replace columns of these names)."""
    # user columns travel in one struct, so their names can't clash
    rows = docs.select("doc_id", "text", "source", F.struct(*[c for c in docs.columns if c not in MIX]).alias("row"))
    sizes = materialize(measure(rows, seed).select("source", "size", "mix_key"), "mix-sizes")
    decided = materialize(cuts(sizes, materialize(targets(sizes, weights, share, cap), "mix-targets")).coalesce(1), "mix-cuts")
    return apply_cuts(measure(rows, seed), decided).select("row.*", *MIX)


def op10_mix_sources(spark, sf_dir) -> DataFrame:
    """Mix of all documents: ``doc_id, size, source_size, target, taken``."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sizes = materialize(measure(docs).drop("text"), "mix-sizes")
    decided = materialize(cuts(sizes, materialize(targets(sizes), "mix-targets")).coalesce(1), "mix-cuts")
    return apply_cuts(sizes, decided).select("doc_id", "size", "source_size", "target", "taken")
