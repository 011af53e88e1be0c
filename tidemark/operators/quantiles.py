"""Exact percentiles without holding a group's values in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import running_sum


def magnitude_bucket(x: Column, per_octave: int = 16) -> Column:
    """An order-preserving coarse bucket of a double."""
    size = F.floor(F.log2(F.abs(x)) * per_octave) + 20_000
    return F.when(x == 0, F.lit(0).cast("long")).otherwise((F.signum(x) * size).cast("long"))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float]) -> DataFrame:
    """Linear-interpolated percentiles per key.

    Values are counted first, then ranked in two levels, so a key with very many rows is spread over
    its value buckets and repeated values cost one row.
    """
    keys = list(keys)
    x = F.col(value)
    counts = df.where(x.isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    ranked = running_sum(counts, keys, [value], magnitude_bucket(x), {"_cum": F.col("_n")})
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    ranked = ranked.join(totals, keys) if keys else ranked.withColumn("_total", totals.scalar())
    aggs, outs = [], []
    for name, p in wanted.items():
        h = (F.col("_total") - 1) * p
        low = F.floor(h)
        aggs += [F.min(F.when(F.col("_cum") >= low + 1, x)).alias(f"_lo_{name}"),
                 F.min(F.when(F.col("_cum") >= F.least(low + 2, F.col("_total")), x)).alias(f"_hi_{name}"),
                 F.max(h - low).alias(f"_w_{name}")]
        outs.append((F.col(f"_lo_{name}") + F.col(f"_w_{name}")
                     * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name))
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, *outs)
