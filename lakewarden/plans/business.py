"""A migrated business view: a five-way star of left joins with a group maximum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def star(
    base: DataFrame, joins: list[tuple[DataFrame, list[str]]], where: Column, group: list[str], maxima: dict[str, str],
) -> DataFrame:
    """Filter the base, left-join each dimension on its (composite) key, group, and take maxima.

    The filter is on base columns and is applied before the joins.
    """
    out = base.filter(where)
    for dim, keys in joins:
        out = out.join(dim, keys, "left")
    return out.groupBy(*group).agg(*[F.max(c).alias(name) for name, c in maxima.items()])
