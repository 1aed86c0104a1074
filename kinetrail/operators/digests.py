"""Mergeable statistics: partial digests per key that are added up later, in any order and any grouping, without the rows.

A digest of a value is a struct: n, total, squares, least, most of its non-null values and, where asked for, a KLL sketch
of them, whose quantiles have a rank error of about 1.33 % at the default k = 200 (0.3 % at k = 1000). Counts, extremes and
sums of integers are exact; sums of doubles agree up to rounding. Without any value n is 0 and the rest null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def schema(values: Sequence[str], sketch: bool = False) -> str:
    """DDL of the digests' columns."""
    return ", ".join(f"{v} struct<n:long,total:double,squares:double,least:double,most:double{',sketch:binary' if sketch else ''}>" for v in values)


def partial(df: DataFrame, keys: list[str], values: Mapping[str, Column], *more: Column, k: int | None = None) -> DataFrame:
    """One row per key with a digest of each value (with a sketch of size k where given), and further aggregates."""

    def one(name: str, x: Column) -> Column:
        x = x.cast("double")
        parts = [F.count(x).alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"), F.min(x).alias("least"), F.max(x).alias("most")]
        return F.struct(*parts, *([F.kll_sketch_agg_double(x, k).alias("sketch")] if k else [])).alias(name)

    return df.groupBy(*keys).agg(*[one(n, x) for n, x in values.items()], *more)


def merge(parts: DataFrame, keys: list[str], values: Sequence[str], *more: Column, sketch: bool = False) -> DataFrame:
    """Digests of all rows behind the parts, per key; any coarser key works as well."""

    def one(v: str) -> Column:
        sums = [F.sum(f"{v}.{c}").alias(c) for c in ("n", "total", "squares")]
        return F.struct(*sums, F.min(f"{v}.least").alias("least"), F.max(f"{v}.most").alias("most"), *([F.kll_merge_agg_double(f"{v}.sketch").alias("sketch")] if sketch else [])).alias(v)

    return parts.groupBy(*keys).agg(*[one(v) for v in values], *more)


def mean(v: str) -> Column:
    return F.try_divide(F.col(f"{v}.total"), F.col(f"{v}.n"))


def deviation(v: str) -> Column:
    """Of the population."""
    m = mean(v)
    return F.when(F.col(f"{v}.n") > 0, F.sqrt(F.greatest(F.col(f"{v}.squares") / F.col(f"{v}.n") - m * m, F.lit(0.0))))


def quantile(v: str, q: float) -> Column:
    """Approximate; null without values."""
    return F.when(F.col(f"{v}.n") > 0, F.kll_sketch_get_quantile_double(F.col(f"{v}.sketch"), F.lit(q)))
