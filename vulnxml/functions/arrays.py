"""Array scalars for model inputs (Q1, Q2, A17) and score maths (R2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fit_length(ids, max_len: int) -> Column:
    """Q1: struct(input_ids, attention_mask, token_type_ids) of length max_len.

    Longer input keeps the first max_len-1 ids plus the last id; shorter input
    is right-padded with 0. The mask is 1 on real ids; type ids are all 0."""
    a = _c(ids)
    n = F.size(a)
    cut = F.concat(F.slice(a, 1, max_len - 1), F.array(F.try_element_at(a, F.lit(-1))))
    padded = F.concat(a, F.array_repeat(F.lit(0), F.greatest(F.lit(max_len) - n, F.lit(0))))
    input_ids = F.when(n > max_len, cut).otherwise(padded)
    mask = F.concat(F.array_repeat(F.lit(1), F.least(n, F.lit(max_len))),
                    F.array_repeat(F.lit(0), F.greatest(F.lit(max_len) - n, F.lit(0))))
    types = F.array_repeat(F.lit(0), F.lit(max_len))
    return F.struct(input_ids.alias("input_ids"), mask.alias("attention_mask"),
                    types.alias("token_type_ids"))


def strip_padding(ids) -> Column:
    """Q2: when the last id is 0 (padded), drop all zero ids."""
    a = _c(ids)
    return F.when(F.try_element_at(a, F.lit(-1)) == 0, F.filter(a, lambda x: x != 0)).otherwise(a)


def multi_hot(ids, n_labels: int | Column) -> Column:
    """0/1 vector of length n_labels with 1 at every id in ``ids``. The ids
    are the sparse form; this is its export, in O(n_labels + k log k): the
    sorted ids, each as the zeros since the one before it and a one. Repeated
    ids count once; nulls and ids outside the range are left out; a null array
    gives all zeros."""
    n = (n_labels if isinstance(n_labels, Column) else F.lit(n_labels)).cast("int")
    a = F.coalesce(F.array_sort(F.array_distinct(F.filter(_c(ids).cast("array<int>"), lambda x: (x >= 0) & (x < n)))), F.array().cast("array<int>"))
    gaps = F.zip_with(F.concat(a, F.array(n)), F.concat(F.array(F.lit(-1)), a),
                      lambda x, before: F.concat(F.array_repeat(F.lit(0), x - before - 1), F.array(F.lit(1))))
    return F.slice(F.flatten(gaps), F.lit(1), n)


def sigmoid(col) -> Column:
    """R2: 1 / (1 + e^-x)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(col)))
