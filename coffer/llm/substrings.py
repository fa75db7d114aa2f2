"""Substring deduplication by hashing of text units (operator 1).

Texts are cut into units: lines, and within a line sentences (a unit ends after ``.``, ``!`` or ``?`` and white space), so a passage
that stands inside a longer line of another text is found too. A unit is normalised (words in lower case, letters and digits
only, one space between) and hashed to 128 bits; every unit that holds a word is. Digests are grouped over the whole corpus, the occurrence ranked
first (smallest ``doc_id``, then smallest offset) is kept, and every later one is removed; original offsets stay with every removed
unit. Repeated units that follow each other, with nothing that occurs once between them, form a run. A run goes if it has
``MIN_RUN`` words or more, or if it is the whole text, however short; units of fewer than ``MIN_WORDS`` words at its ends stay. So a greeting
or a stock phrase that many clean documents share is no reason to cut them, and text that occurs once is never cut. Of
letters written without spaces (Chinese, Japanese, Thai, ...) each counts as a word.

Scale: what is shuffled is one narrow row a unit, never texts. The first occurrence is a map-side minimum, so a line
that a third of all documents hold is one row a task; units that occur once drop out in that aggregation, and the join
back to the units is one that Spark can split. Removal reads each text once more, with its own units only.

Edge cases: null and empty texts have no units; equal units inside one text count as occurrences like any others;
repeated rows (equal doc_id and text) count as one document: each keeps or loses the same units; null doc_ids rank last;
a text of any length is handled whole; empty tables give empty results; other columns are passed through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load, materialize, ship_package

MIN_WORDS = 4
MIN_RUN = 25
_UNIT = re.compile(r"[^\n]*?[.!?](?=\s)|[^\n]+")
_WORD = re.compile(r"[^\W_]+")
# letters of scripts that don't put spaces between words
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
UNITS = "doc_id long, row long, unit int, units int, start int, end int, n_words int, hi long, lo long"


def units_of(text: str) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each unit that holds a word, without white space at its ends."""
    out = []
    for m in _UNIT.finditer(text):
        raw = m[0]
        words = _WORD.findall(raw)
        if words:
            start = m.start() + len(raw) - len(raw.lstrip())
            # a word of unspaced letters counts by its letters
            n = len(words) if raw.isascii() else sum(max(1, len(_UNSPACED.findall(w))) for w in words)
            out.append((start, m.start() + len(raw.rstrip()), n, hashlib.blake2b(" ".join(words).lower().encode(), digest_size=16).digest()))
    return out


def units(docs: DataFrame) -> DataFrame:
    """One row a unit of every whole text, with the number of its ``units``; ``row`` tells rows of equal doc_id apart (a hash of the text)."""
    ship_package(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            for doc_id, row, text in zip(*(c.to_pylist() for c in b.columns)):
                found = units_of(text)
                for i, (start, end, n, digest) in enumerate(found):
                    for c, v in zip(cols, (doc_id, row, i, len(found), start, end, n, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True))):
                        c.append(v)
                if len(cols[0]) >= 100_000:
                    yield _rows(cols)
                    cols = [[] for _ in range(9)]
            yield _rows(cols)

    def _rows(cols: list[list]) -> pa.RecordBatch:
        types = [pa.int64()] * 2 + [pa.int32()] * 5 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[f.split()[0] for f in UNITS.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, UNITS)


def repeated(docs: DataFrame) -> DataFrame:
    """``doc_id, row, unit, units, start, end, n_words, kept_doc_id, kept_start`` of every unit that is not the first of its kind."""
    every = units(docs)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "start")
    first = every.groupBy("hi", "lo").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1").select("hi", "lo", "first")
    e, f = every.alias("e"), materialize(first, "unit-first").alias("f")
    later = e.join(f, F.expr("e.hi = f.hi AND e.lo = f.lo")).filter(
        ~(F.expr("e.doc_id <=> f.first.doc_id") & (F.col("e.row") == F.col("f.first.row")) & (F.col("e.start") == F.col("f.first.start"))))
    return later.select("e.doc_id", "e.row", "e.unit", "e.units", "e.start", "e.end", "e.n_words",
                        F.col("f.first.doc_id").alias("kept_doc_id"), F.col("f.first.start").alias("kept_start"))


def removed_spans(docs: DataFrame, min_words: int = MIN_WORDS, min_run: int = MIN_RUN) -> DataFrame:
    """One row for every document that loses something: ``doc_id, row, n_removed, removed_words, removed`` (spans in
    code points of the original text, with the place of the occurrence that is kept, in order) and ``kept_doc_ids``."""
    r = repeated(docs)
    # repeated rows have the same spans
    r = r.groupBy("doc_id", "row", "unit", "units", "start", "end", "n_words").agg(F.min(F.struct("kept_doc_id", "kept_start")).alias("k"))
    run = F.col("unit") - F.row_number().over(Window.partitionBy("doc_id", "row").orderBy("unit"))
    one = Window.partitionBy("doc_id", "row", "run")
    long = F.when(F.col("n_words") >= min_words, F.col("unit"))
    r = r.withColumn("run", run).withColumns({"from": F.min(long).over(one), "to": F.max(long).over(one),
                                              "whole": F.count("*").over(one) == F.col("units")})
    runs = (r.filter(F.col("whole") | F.col("unit").between(F.col("from"), F.col("to"))).groupBy("doc_id", "row", "run")
            .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").alias("words"), F.min_by("k", "unit").alias("k"),
                 F.collect_set("k.kept_doc_id").alias("from"), F.max("whole").alias("whole")).filter(F.col("whole") | (F.col("words") >= min_run)))
    span = F.struct("start", "end", F.col("k.kept_doc_id").alias("kept_doc_id"), F.col("k.kept_start").alias("kept_start"))
    return (runs.groupBy("doc_id", "row").agg(F.count("*").alias("n_removed"), F.sum("words").alias("removed_words"),
                                              F.sort_array(F.collect_list(span)).alias("removed"),
                                              F.sort_array(F.array_distinct(F.flatten(F.collect_list("from")))).alias("kept_doc_ids")))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with ``text`` without its repeated units, and ``removed`` (null where nothing is)."""
    lost = materialize(removed_spans(docs, min_words, min_run), "unit-spans")
    own = [c for c in docs.columns if c != "removed"]
    d = docs.select(*own).withColumn("_row", F.xxhash64("text")).withColumn("_id", F.col("doc_id").cast("long")).alias("d")
    j = d.join(lost.alias("l"), F.expr("d._id <=> l.doc_id AND d._row = l.row"), "left")
    # after a cut, white space goes up to the next text; all else stays as it is
    def after(start, length):
        return F.regexp_replace(F.col("d.text").substr(start, length), r"^\s+", "")

    piece = F.aggregate(
        "l.removed", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.when(acc["at"] == 0, F.col("d.text").substr(F.lit(1), s["start"])).otherwise(
            after(acc["at"] + 1, s["start"] - acc["at"]))).alias("out")),
        lambda acc: F.concat(acc["out"], after(acc["at"] + 1, F.length("d.text"))))
    return j.select(*[F.when(F.col("l.removed").isNull(), F.col("d.text")).otherwise(piece).alias("text") if c == "text" else F.col(f"d.{c}") for c in own],
                    F.col("l.removed").alias("removed"))


def op1_substring_dedup(spark, sf_dir) -> DataFrame:
    """Every document that holds a unit of an earlier one: the spans removed and the documents whose copies stay."""
    return removed_spans(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("row")
