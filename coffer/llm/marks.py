"""Marks: a bitmap of hashed ids, of bounded size, that spares most rows a join.

A row whose bit isn't set is not among the ids for certain; a row whose bit is set may be and goes on to the join
that decides. The bitmap has 16 bits an id up to ``MAX_WORDS`` words of 64 bits, so the broadcast side never exceeds
``MAX_WORDS`` rows of two longs (about 32 MB as a hash table); with more ids more rows go to the join, none is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_WORDS = 1 << 20


class Marks:
    """Marks of the ids in the only column of ``ids`` (a written table; null is an id like others)."""

    def __init__(self, ids: DataFrame):
        count, self.words = ids.count(), 1 << 10
        while self.words < MAX_WORDS and self.words * 4 < count:
            self.words *= 2
        word, bit = self._place(F.col(ids.columns[0]))
        # one exchange of one row a word and task at most
        self.table = materialize(ids.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), "bit")).alias("mask")), "marks")

    def _place(self, col) -> tuple:
        h = F.pmod(F.xxhash64(col.cast("long")), F.lit(self.words * 64))
        return F.floor(h / 64).cast("long"), F.pmod(h, F.lit(64)).cast("int")

    def tell(self, df: DataFrame, col, name: str) -> DataFrame:
        """``df`` with the boolean ``name``: whether the row's bit is set."""
        word, bit = self._place(col)
        b = F.broadcast(self.table).alias("_b")
        held = F.coalesce(F.call_function("shiftright", F.col("_b.mask"), bit).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))
        return df.alias("_d").join(b, word == F.col("_b.word"), "left").select("_d.*", held.alias(name))
