"""Error rates and citation scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.functions.text import tokens


def char_errors(truth: Column, said: Column) -> Column:
    """Insertions, deletions and changes of characters; null counts as empty."""
    return F.levenshtein(F.coalesce(truth, F.lit("")), F.coalesce(said, F.lit(""))).cast("long")


def rate(errors: Column, length: Column) -> Column:
    """Errors for each unit of the truth; against an empty truth 0 without errors, else 1."""
    return F.round(F.when(length > 0, errors / length).otherwise(F.when(errors > 0, 1.0).otherwise(0.0)), 6)


def edit_distance(a: list, b: list) -> int:
    """Insertions, deletions and changes between two sequences, row by row."""
    names = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.array([names[t] for t in s], np.int64) for s in (a, b))
    row, steps = np.arange(len(y) + 1), np.arange(len(y) + 1)
    for i, t in enumerate(x, 1):
        best = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (y != t))])
        row = np.minimum.accumulate(best - steps) + steps  # insertions run along the row
    return int(row[-1])


@F.pandas_udf(T.LongType())
def _word_errors(truth: pd.Series, said: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(list(a), list(b)) for a, b in zip(truth, said, strict=True)], dtype="int64")


def word_errors(truth: Column, said: Column) -> Column:
    """Insertions, deletions and changes of words between white space; null counts as empty."""
    return _word_errors(tokens(F.coalesce(truth, F.lit(""))), tokens(F.coalesce(said, F.lit(""))))


def cited(answer: Column) -> Column:
    """Distinct numbers cited like [1]."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("long"))))


def citation_overlap(answer: Column, gold: Column) -> Column:
    """Jaccard similarity of two answers' citations; 1 if neither cites."""
    a, b = cited(answer), cited(gold)
    union = F.size(F.array_union(a, b))
    return F.round(F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(1.0), 6)


def exact_match(answer: Column, gold: Column) -> Column:
    """Whether two texts are equal in lower case and with white space collapsed."""
    from corpuscle.functions.text import collapse

    return F.coalesce(collapse(F.lower(answer)) == collapse(F.lower(gold)), F.lit(False))
