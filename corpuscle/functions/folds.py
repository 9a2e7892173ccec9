"""Sequential packing by folds that carry only places, never texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscle.functions.text import sentences, tokens


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f names it, inside lambdas too."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _cut(items: Column, starts: Column, sep: str) -> Column:
    """Joins items[starts[k]] up to the next start."""
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(items) + 1))
    return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.array_join(F.slice(items, x["a"], x["b"] - x["a"]), sep))


def _packed(items: Column, first: Column, step) -> Column:
    """Items joined by spaces into chunks; without items no chunk."""
    return let(items, lambda w: let(_starts(w, first, step), lambda starts: F.when(F.size(w) > 0, _cut(w, starts, " ")).otherwise(F.array().cast("array<string>"))))


def _starts(items: Column, first: Column, step) -> Column:
    """Folds the items' lengths; step(n, length, i) gives (whether a new chunk starts at i, the new n)."""
    state = F.struct(F.array(F.lit(1)).alias("starts"), first.alias("n"), F.lit(1).alias("i"))

    def fold(s: Column, length: Column) -> Column:
        new, n = step(s["n"], length, s["i"])
        return F.struct(F.when(new, F.concat(s["starts"], F.array(s["i"]))).otherwise(s["starts"]).alias("starts"), n.alias("n"), (s["i"] + 1).alias("i"))

    return F.aggregate(F.transform(items, lambda w: F.length(w)), state, fold, lambda s: s["starts"])


def pack_words(text: Column, max_chars: int = 800) -> Column:
    """Chunks of whole words: the first shorter than max_chars, later ones up to it; longer words stand alone.

    A first word that does not fit leaves an empty chunk before it. Texts without words (or null) have no chunk.
    """
    items = F.coalesce(tokens(text), F.array().cast("array<string>"))
    return _packed(items, F.lit(0), lambda n, w, i: (n + w + 1 > max_chars, F.when(n + w + 1 > max_chars, w).otherwise(n + w + 1)))


def pack_sentences(text: Column, max_chars: int = 1500) -> Column:
    """Whole sentences joined up to max_chars; a longer sentence stands alone."""
    items = F.coalesce(sentences(text), F.array().cast("array<string>"))
    return _packed(items, F.lit(-1), lambda n, s, i: ((i > 1) & (n + 1 + s > max_chars), F.when((i > 1) & (n + 1 + s > max_chars), s).otherwise(n + 1 + s)))


def greedy_take(items: Column, capacity: int) -> Column:
    """Of (w, ...) structs in order, those that still fit when their turn comes."""
    empty = F.struct(F.lit(0).cast("long").alias("w"), F.filter(items, lambda x: F.lit(False)).alias("taken"))
    return F.aggregate(
        items,
        empty,
        lambda s, x: F.when(s["w"] + x["w"] <= capacity, F.struct((s["w"] + x["w"]).cast("long").alias("w"), F.concat(s["taken"], F.array(x)).alias("taken"))).otherwise(s),
        lambda s: s["taken"],
    )


def best_value(items: Column, capacity: int) -> Column:
    """The largest sum of v over items (w, v) whose w add up to the capacity at most; w at least 0."""
    start = F.array_repeat(F.lit(0).cast("long"), capacity + 1)

    def fold(dp: Column, x: Column) -> Column:
        return F.transform(dp, lambda c, j: F.greatest(c, F.when(j >= x["w"], F.get(dp, (j - x["w"]).cast("int")) + x["v"])))

    return F.get(F.aggregate(items, start, fold), F.lit(capacity))
