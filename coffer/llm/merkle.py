"""Merkle manifest of a document table by slot pivots (operator 13).

A leaf is the digest of a row; each run of ``fanout`` consecutive nodes of a tree becomes the digest of its children's
digests. One tree a source, then one over the sources' subroots.

1. ``leaves``: one pass over the texts; a leaf, and where the row is to be tampered with, the leaf it then has. The texts go no further.
2. ``numbered``: dense places inside each tree in two levels. Rows are dealt out by ranges of (tree, order), so a hot
   source is cut into many ranges; a place is the row number inside its (tree, range) piece plus the rows of the tree's earlier pieces.
3. ``levels``: the slot pivot. Nodes are grouped by (tree, place div fanout), and conditional aggregates spread the children into
   ``fanout`` columns; the digest of their concatenation is the parent. A level has a ``fanout``-th of the rows of the one below; a tree with one
   node left is done. Runs of a hot source are many groups of at most ``fanout`` rows.
4. ``paths``: top down, each run's row meets its parent's path and hands every child its own: what stands left and
   right of it in the run (the columns without its own slot), then its parent's path.

A leaf's proof is its path; hashing the leaf between the two sides of each step leads to the root.

Edge cases: null fields count as ``-``; null ids come first, rows with equal ids are ordered by leaf, repeated rows are
leaves of their own; null source is the first tree; a lone leaf is its subroot and a lone subroot the root; an empty
table gives an empty result; texts of any length are hashed whole; extra columns are not part of a leaf and never clash,
because only the listed fields are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import load, materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
#: Rows of a range of leaves, about.
RANGE_ROWS = 500_000
PATH = "array<struct<l:string,r:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def _field(col: Column) -> Column:
    """``-`` for null, else the byte count of the value, a colon and the value."""
    value = col.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def tampered_text(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike("[A-Z]"), F.translate(text, upper, upper.lower())).otherwise(text)


def is_tampered(doc_id: Column) -> Column:
    """Whether 5 divides the CRC-32 of the decimal id; a null id is left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def leaves(docs: DataFrame, fields: tuple = FIELDS) -> DataFrame:
    """``doc_id, tree, leaf, forged`` of every row; ``forged`` is the leaf after tampering, null where that changes nothing."""
    cols = {c: F.col(c) for c in fields}
    leaf = digest(*[_field(c) for c in cols.values()])
    changed = is_tampered(cols["doc_id"]) & cols["text"].rlike("[A-Z]")
    forged = digest(*[_field(c) for c in (cols | {"text": tampered_text(cols["text"])}).values()])
    return docs.select(F.col("doc_id").cast("long"), F.col("source").alias("tree"), leaf.alias("leaf"), F.when(changed, forged).alias("forged"))


def numbered(rows: DataFrame, order: tuple) -> DataFrame:
    """``rows`` (a written table with ``tree``) with ``pos``, the place in its tree from 0, and ``n``, the rows of the tree."""
    ranges = max(2, -(-rows.count() // RANGE_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = materialize(rows.repartitionByRange(ranges, F.col("tree").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order])
                      .withColumn("piece", F.spark_partition_id()), "merkle-ranges")
    pieces = cut.groupBy("tree", "piece").agg(F.count("*").alias("m"))
    earlier = Window.partitionBy("tree").orderBy("piece")
    pieces = pieces.select("tree", "piece", (F.sum("m").over(earlier) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy("tree")).alias("n"))
    inside = Window.partitionBy("tree", "piece").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    r, p = cut.withColumn("nth", F.row_number().over(inside) - 1).alias("r"), materialize(pieces, "merkle-pieces").alias("p")
    return r.join(p, F.expr("r.tree <=> p.tree AND r.piece = p.piece")).select(*[f"r.{c}" for c in rows.columns], (F.col("nth") + F.col("before")).cast("long").alias("pos"), "p.n")


def _slots(fanout: int) -> list[str]:
    return [f"c{i}" for i in range(fanout)]


def levels(nodes: DataFrame, fanout: int, payload: tuple = ()) -> tuple[list[DataFrame], DataFrame]:
    """(runs of each level from the lowest, roots) of the trees of ``nodes`` (``tree, pos, n, digest``, written). Runs are
    ``tree, run, n, c0, c1, ...``: a run's children by slot, null beyond its end, at the lowest level with an array
    ``who`` of the children's ``payload``; roots are ``tree, digest``."""
    slot, runs, roots = F.col("pos") % fanout, [], nodes.filter("n = 1").select("tree", "digest")
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        spread = [F.max(F.when(slot == i, F.col("digest"))).alias(c) for i, c in enumerate(_slots(fanout))]
        if payload and not runs:
            spread.append(F.array(*[F.max(F.when(slot == i, F.struct(*payload))) for i in range(fanout)]).alias("who"))
        wide = nodes.filter("n > 1").groupBy("tree", F.floor(F.col("pos") / fanout).cast("long").alias("run"), "n").agg(*spread)
        runs.append(materialize(wide, "merkle-runs"))
        nodes = runs[-1].select("tree", F.col("run").alias("pos"), F.ceil(F.col("n") / fanout).cast("long").alias("n"),
                                F.sha2(F.concat_ws("", *_slots(fanout)), 256).alias("digest"))
        roots = roots.unionByName(nodes.filter("n = 1").select("tree", "digest"))
        most = -(-most // fanout)
    return runs, roots


def _with_above(wide: DataFrame, parents: DataFrame | None, above: DataFrame, fanout: int) -> DataFrame:
    """Runs with ``above``, the path of their parent: a tree's last run meets what stands above the tree, the others a parent's path."""
    w, a = wide.filter(F.col("n") <= fanout).alias("w"), above.alias("a")
    met = w.join(a, F.expr("w.tree <=> a.tree")).select("w.*", F.col("a.path").alias("above"))
    if parents is None:
        return met
    w, p = wide.filter(F.col("n") > fanout).alias("w"), parents.alias("p")
    return met.unionByName(w.join(p, F.expr("w.tree <=> p.tree AND w.run = p.pos")).select("w.*", F.col("p.path").alias("above")))


def _children(met: DataFrame, fanout: int) -> DataFrame:
    """``tree, pos, path`` of every child of the runs ``met``, and ``who`` where they have it: each child's step is the columns
    without its own slot, left and right of it."""
    slots = _slots(fanout)
    who = "who" in met.columns
    child = lambda i, c: F.when(F.col(c).isNotNull(), F.struct(
        F.lit(i).alias("slot"), F.concat_ws("", F.lit(""), *slots[:i]).alias("l"), F.concat_ws("", F.lit(""), *slots[i + 1:]).alias("r"),
        *([F.col("who")[i].alias("who")] if who else [])))
    each = met.select("tree", "run", "above", F.explode(F.array_compact(F.array(*[child(i, c) for i, c in enumerate(slots)]))).alias("x"))
    step = F.array(F.struct("x.l", "x.r"))
    return each.select("tree", (F.col("run") * fanout + F.col("x.slot")).alias("pos"), F.concat(step, "above").alias("path"), *(["x.who"] if who else []))


def paths(runs: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame | None:
    """Children of the lowest of ``runs`` with their paths, top down (None without runs); ``above`` is ``tree, path``."""
    out = None
    for i, wide in reversed(list(enumerate(runs))):
        out = _children(_with_above(wide, out, above, fanout), fanout)
        if i:
            out = materialize(out, "merkle-paths")
    return out


@dataclass
class Manifest:
    """``subroots`` (``tree, digest``), ``root`` (one row, none for an empty table) and ``proofs`` (``doc_id, tree, leaf, forged, path``)."""

    subroots: DataFrame
    root: DataFrame
    proofs: DataFrame


def manifest(docs: DataFrame, fanout: int = FANOUT) -> Manifest:
    """The two-level tree over ``docs`` and the path of every row."""
    if fanout < 2:
        raise ValueError("a tree needs a fanout of 2 or more")
    nodes = materialize(numbered(materialize(leaves(docs), "merkle-leaves"), ("doc_id", "leaf")).withColumn("digest", F.col("leaf")), "merkle-nodes")
    runs, subroots = levels(nodes, fanout, ("doc_id", "leaf", "forged"))
    subroots = materialize(subroots, "merkle-subroots")
    over = materialize(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), ("source",)), "merkle-top")
    top, root = levels(over, fanout, ("source",))
    start = over.select("tree").limit(1).select("tree", F.array().cast(PATH).alias("path"))
    up = paths(top, start, fanout)
    above = (up.select(F.col("who.source").alias("tree"), "path") if up is not None
             else over.select(F.col("source").alias("tree"), F.array().cast(PATH).alias("path")))
    above = materialize(above, "merkle-above")
    n, a = nodes.filter("n = 1").alias("n"), above.alias("a")
    proofs = n.join(a, F.expr("n.tree <=> a.tree")).select("doc_id", "n.tree", "leaf", "forged", "path")
    low = paths(runs, above, fanout)
    if low is not None:
        proofs = proofs.unionByName(low.select("who.doc_id", "tree", "who.leaf", "who.forged", "path"))
    return Manifest(subroots, materialize(root.select("digest"), "merkle-root"), proofs)


def folded(start: Column, path: Column) -> Column:
    """The digest that a leaf reaches along its path."""
    return F.aggregate(path, start, lambda acc, s: digest(s["l"], acc, s["r"]))


def verify(made: Manifest) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row; ``folded_root`` starts from the tampered leaf where there is one."""
    p, s = made.proofs.alias("p"), made.subroots.alias("s")
    siblings = F.array_join(F.flatten(F.transform("path", lambda x: F.array(x["l"], x["r"]))), "")
    # the subroots are one row a source, the root is one row: both written, so Spark knows their size
    out = p.join(s, F.expr("p.tree <=> s.tree")).select("p.*", F.col("s.digest").alias("subroot"))
    root = made.root.select(F.lit(1).alias("one"), F.col("digest").alias("root"))
    out = out.withColumn("one", F.lit(1)).join(F.broadcast(root), "one")
    done = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
                      folded(F.coalesce("forged", "leaf"), F.col("path")).alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark, sf_dir) -> DataFrame:
    """Manifest of all documents, every row verified against the root."""
    return verify(manifest(load(spark, sf_dir, "documents")))
