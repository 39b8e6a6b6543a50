"""Which of many texts contain which of many entries, as hash joins by pieces of a few characters.

What contains an entry contains each of its pieces.  An entry is looked for by the one of them
that fewest texts hold, of equal ones the one that fewest entries hold, so that neither a
frequent ending of the entries nor one of the texts gathers them under one key.  Texts meet
only keys: their pieces are filtered by the set of keys before anything is shuffled, where the
set is of a size to be sent.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a piece; pieces up to this many are sent to the tasks instead of shuffled.
GRAM, SENT_PIECES = 4, 2_000_000


def grams(c: Column, size: Column | int) -> Column:
    """Distinct pieces of ``size`` characters; a shorter text has none."""
    n = F.lit(size) if isinstance(size, int) else size
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, n)))).otherwise(F.array().cast("array<string>"))


def pieces(c: Column, sizes) -> Column:
    """Distinct pieces of all the sizes; 0 stands for the empty piece, which every text holds."""
    return reduce(F.array_union, [grams(c, n) if n else F.array(F.lit("")) for n in sizes], F.array().cast("array<string>"))


def own_pieces(c: Column) -> Column:
    """The pieces of the largest size that a text has any of; the empty one of an empty text."""
    return F.when(F.length(c) == 0, F.array(F.lit(""))).otherwise(grams(c, F.least(F.length(c), F.lit(GRAM))))


class Pieces:
    """An index of distinct entries (e) for the texts (v, and what else a row has) in ``sides``.

    ``sizes`` are the piece sizes that entries and, for around_texts, texts have; ``sent`` says whether the entries' pieces
    are few enough to be sent to every task.
    """

    def __init__(self, entries: DataFrame, sides: DataFrame, sizes: Iterable[int] = range(GRAM + 1), sent: bool = True):
        self.entries, self.sides, self.sizes = entries, sides, list(sizes)
        self.held = F.broadcast if sent else (lambda df: df)
        self.of_entries = entries.select("e", F.explode(pieces(F.col("e"), self.sizes)).alias("g"))
        self.in_entries = self.of_entries.groupBy("g").agg(F.count("*").alias("n_entries"))
        self.of_sides = sides.select(*sides.columns, F.explode(pieces(F.col("v"), self.sizes)).alias("g"))
        in_sides = self.of_sides.select("g").join(self.held(self.in_entries.select("g")), "g").groupBy("g").agg(F.count("*").alias("n_texts"))
        counts = self.in_entries.join(in_sides, "g", "left").select("g", F.struct(F.coalesce("n_texts", F.lit(0)).alias("n_texts"), "n_entries", "g").alias("k"))
        own = entries.select("e", F.explode(own_pieces(F.col("e"))).alias("g"))
        self.keys = own.join(counts, "g").groupBy("e").agg(F.min("k").alias("k")).select("e", "k.g", "k.n_texts", "k.n_entries")

    def met(self, keys: DataFrame) -> DataFrame:
        """Rows of sides with each row of keys (g, e, ...) whose entry they contain."""
        some = self.of_sides.join(self.held(keys.select("g").distinct()), "g", "left_semi")
        return some.join(keys, "g").filter(F.contains("v", F.col("e"))).drop("g")

    def in_texts(self) -> DataFrame:
        """Rows of sides with each entry (e) that they contain."""
        return self.met(self.keys.select("g", "e"))

    def around_texts(self) -> DataFrame:
        """Rows of sides with each entry (e) that contains them: all pieces of the text are the entry's, the rarest leads to it."""
        mine = self.sides.columns
        own = self.sides.select(*mine, own_pieces(F.col("v")).alias("__p")).select(*mine, F.size("__p").alias("__n"), F.explode("__p").alias("g"))
        best = own.join(self.held(self.in_entries), "g").groupBy(*mine, "__n").agg(F.count("*").alias("__found"), F.min(F.struct("n_entries", "g")).alias("__k"))
        whole = best.filter("__found = __n").select(*mine, "__k.g")
        return whole.join(self.of_entries, "g").filter(F.contains("e", F.col("v"))).drop("g")
