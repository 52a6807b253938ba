"""Weighted edit distances of two columns, by rows of the usual table inside aggregate()."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pairs of similar sounds.
PHONETIC_PAIRS = (
    ("d", "t"), ("k", "g"), ("b", "p"), ("v", "f"), ("b", "v"), ("p", "f"), ("s", "z"), ("n", "m"), ("ɸ", "β"),
    ("θ", "ð"), ("ʃ", "ʒ"), ("ʂ", "ʐ"), ("x", "ɣ"), ("h", "ɦ"), ("i", "y"), ("ɪ", "ʏ"), ("ɨ", "ʉ"), ("ɛ", "œ"),
    ("a", "ä"), ("ɑ", "ɒ"), ("w", "u"), ("t͡s", "d͡z"), ("t͡ʃ", "d͡ʒ"), ("l", "ɫ"), ("r", "ɾ"), ("e", "ø"), ("ə", "ɐ"),
)
SIMILAR_COST = 0.5
SHIFT_SCORES = (1.0, 0.5, 0.4, 0.3)


def characters(c: Column) -> Column:
    """The code points of a text as an array; an empty text has none."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))


def table_distance(a: Column, b: Column, cost: Callable[[Column, Column], Column]) -> Column:
    """Least cost of turning array a into b: unit insertions and deletions, substitutions by cost(i, j), 1-based."""
    n, m = F.size(a), F.size(b)
    first = F.transform(F.sequence(F.lit(0), m), lambda j: j.cast("double"))

    def row(above: Column, i: Column) -> Column:
        def cell(left: Column, j: Column) -> Column:
            best = F.least(F.get(above, j) + 1, F.get(left, j - 1) + 1, F.get(above, j - 1) + cost(i, j))
            return F.concat(left, F.array(best))

        start = F.array(i.cast("double"))
        return F.when(m == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), start, cell))

    whole = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), first, row)
    return F.when(n == 0, m.cast("double")).otherwise(F.element_at(whole, -1))


def graphic_distance(a: Column, b: Column) -> Column:
    """Edit distance of two texts; a substitution costs half if either letter equals the other word's previous one."""
    x, y = characters(a), characters(b)

    def cost(i: Column, j: Column) -> Column:
        here, there = F.get(x, i - 1), F.get(y, j - 1)
        near = ((j > 1) & (here == F.get(y, j - 2))) | ((i > 1) & (F.get(x, i - 2) == there))
        return F.when(here == there, 0.0).when(near, 0.5).otherwise(1.0)

    return table_distance(x, y, cost)


def graphic_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; null if either word is empty or null."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), 1 - graphic_distance(a, b) / longer)


def phonetic_tokens(c: Column) -> Column:
    """The four listed affricates as one token each, else a token for each code point."""
    units = sorted({s for pair in PHONETIC_PAIRS for s in pair if len(s) > 1}, key=len, reverse=True)
    return F.regexp_extract_all(c, F.lit(f"(?s)({'|'.join(units)}|.)"), F.lit(1))


def phonetic_cost(x: Column, y: Column) -> Column:
    """0 if equal, 0.5 for a listed pair in either order, else 1."""
    listed = "".join(f"\x01{p}\x02{q}\x01\x01{q}\x02{p}\x01" for p, q in PHONETIC_PAIRS)
    known = F.lit(listed).contains(F.concat(F.lit("\x01"), x, F.lit("\x02"), y, F.lit("\x01")))
    return F.when(x == y, 0.0).when(known, SIMILAR_COST).otherwise(1.0)


def phonetic_distance(a: Column, b: Column) -> Column:
    """Edit distance of two token arrays, similar sounds at half cost."""
    return table_distance(a, b, lambda i, j: phonetic_cost(F.get(a, i - 1), F.get(b, j - 1)))


def phonetic_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer token count of two texts; null if either has no token."""
    x, y = phonetic_tokens(a), phonetic_tokens(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), 1 - phonetic_distance(x, y) / F.greatest(F.size(x), F.size(y)))


def shift_similarity(a: Column, b: Column) -> Column:
    """Best score of a shift of 0 to 3 letters by which one word's start has at least three letters of the other's."""
    found = []
    for shift, score in enumerate(SHIFT_SCORES):
        for x, y in ((a, b), (b, a)):
            met = F.substring(x, shift + 1, 3) == F.substring(y, 1, 3)
            long_enough = (F.length(x) >= shift + 3) & (F.length(y) >= 3)
            found.append(F.when(met & long_enough, score).otherwise(0.0))
    return F.greatest(*found)
