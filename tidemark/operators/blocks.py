"""Time windows that stay parallel when one symbol holds most of the rows.

``Window.partitionBy(symbol)`` puts a symbol's whole history into one task.  The helpers here cut
every series into blocks of consecutive rows first:

* :func:`numbered` gives each row its position, from row counts per time bucket;
* :func:`in_blocks` evaluates bounded frames (lag, lead, rolling) per block, with the neighbouring
  rows copied in from the adjacent blocks;
* :func:`carried_last` and :func:`running_sum` evaluate unbounded frames in two levels: inside the
  bucket, plus what earlier buckets carry over.

Only one row per (key, bucket) ever meets in a per-key window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
BUCKET_SECONDS = 30 * 86_400


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp column (with or without time zone)."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def time_bucket(ts: str | Column, seconds: int = BUCKET_SECONDS) -> Column:
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def _before(keys: Sequence[str], bucket: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, -1)


def numbered(df: DataFrame, keys: Sequence[str], ts: str = "ts", pos: str = "pos",
             seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Zero-based row number per key in time order, without gathering a key in one task."""
    tagged = df.withColumn("_bucket", time_bucket(ts, seconds))
    starts = (tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_start", F.coalesce(F.sum("_n").over(_before(keys, "_bucket")), F.lit(0)))
              .drop("_n"))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(ts)
    return (tagged.join(starts, [*keys, "_bucket"])
            .withColumn(pos, F.col("_start") + F.row_number().over(inner) - 1)
            .drop("_bucket", "_start"))


def in_blocks(df: DataFrame, keys: Sequence[str], compute: Callable[[DataFrame, WindowSpec], DataFrame],
              before: int, after: int = 0, pos: str = "pos", rows: int = BLOCK_ROWS) -> DataFrame:
    """Run ``compute(df, window)`` on blocks of ``rows`` positions.

    ``window`` is partitioned by key and block and ordered by position.  A result is exact as long as
    it reaches at most ``before`` rows back and ``after`` rows ahead.
    """
    rows = max(rows, before + after, 1)
    p = F.col(pos)
    first = F.floor(F.greatest(p - after, F.lit(0)) / rows)
    last = F.floor((p + before) / rows)
    spread = df.withColumn("_block", F.explode(F.sequence(first, last)))
    window = Window.partitionBy(*keys, "_block").orderBy(pos)
    return (compute(spread, window)
            .where(F.floor(F.col(pos) / rows) == F.col("_block")).drop("_block"))


def carried_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column,
                 value: Column, out: str) -> DataFrame:
    """Last non-null ``value`` at or before each row."""
    tagged = df.withColumn("_bucket", bucket).withColumn("_v", value)
    inner = (Window.partitionBy(*keys, "_bucket").orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, 0))
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    ends = tagged.groupBy(*keys, "_bucket").agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), rank)).alias("_end"))
    carry = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(_before(keys, "_bucket"))).drop("_end")
    return (tagged.withColumn("_in", F.last("_v", ignorenulls=True).over(inner))
            .join(carry, [*keys, "_bucket"])
            .withColumn(out, F.coalesce("_in", "_carry"))
            .drop("_bucket", "_v", "_in", "_carry"))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column,
                values: dict[str, Column]) -> DataFrame:
    """Inclusive running sums of several columns, NULL counting as zero."""
    tagged = df.withColumn("_bucket", bucket)
    inner = (Window.partitionBy(*keys, "_bucket").orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, 0))
    names = list(values)
    for n in names:
        tagged = tagged.withColumn(f"_v_{n}", F.coalesce(values[n], F.lit(0.0)))
    sums = tagged.groupBy(*keys, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    carry = sums.select(*keys, "_bucket", *[
        F.coalesce(F.sum(f"_s_{n}").over(_before(keys, "_bucket")), F.lit(0.0)).alias(f"_c_{n}")
        for n in names])
    out = tagged.join(carry, [*keys, "_bucket"])
    for n in names:
        out = out.withColumn(n, F.col(f"_c_{n}") + F.sum(f"_v_{n}").over(inner))
    return out.drop("_bucket", *[f"_v_{n}" for n in names], *[f"_c_{n}" for n in names])


def state_after(df: DataFrame, keys: Sequence[str], flags: str, states: int, step: Callable[[Column, Column], Column],
                out: str, pos: str = "pos", rows: int = 2048) -> DataFrame:
    """The state of a small machine after each row; it starts in state 0 and ``step(state, flags)`` gives the next.

    A block of rows is a map from entry state to exit state.  Blocks are mapped in parallel, one map per block meets in a
    per-key chain, and each block is replayed from its true entry state.
    """
    block = F.floor(F.col(pos) / rows)
    packed = (df.select(*keys, F.col(pos).alias("_pos"), F.col(flags).alias("_flags"), block.alias("_block")).groupBy(*keys, "_block")
              .agg(F.array_sort(F.collect_list(F.struct("_pos", "_flags"))).alias("_rows")))
    start = F.array(*[F.lit(s) for s in range(states)])
    mapped = packed.select(*keys, "_block", F.aggregate(
        "_rows", start, lambda m, r: F.transform(m, lambda s: step(s, r["_flags"]))).alias("_exit"))
    entries = F.array().cast("array<struct<block:bigint,state:int>>")
    chain = (mapped.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", "_exit"))).alias("_maps"))
             .select(*keys, F.explode(F.aggregate(
                 "_maps", F.struct(F.lit(0).alias("s"), entries.alias("out")),
                 lambda a, b: F.struct(F.element_at(b["_exit"], a["s"] + 1).alias("s"), F.array_append(a["out"], F.struct(
                     b["_block"].alias("block"), a["s"].alias("state"))).alias("out")), lambda a: a["out"])).alias("_e"))
             .select(*keys, F.col("_e.block").alias("_block"), F.col("_e.state").alias("_entry")))
    seen = F.array().cast(f"array<struct<{pos}:bigint,{out}:int>>")

    def replay(a: Column, r: Column) -> Column:
        new = step(a["s"], r["_flags"])
        return F.struct(new.alias("s"), F.array_append(a["out"], F.struct(r["_pos"].alias(pos), new.alias(out))).alias("out"))

    known = (packed.join(chain, [*keys, "_block"]).select(*keys, F.explode(F.aggregate(
        "_rows", F.struct(F.col("_entry").alias("s"), seen.alias("out")), replay, lambda a: a["out"])).alias("_e")).select(*keys, "_e.*"))
    return df.join(known, [*keys, pos])


def lag(col: str | Column, n: int, window: WindowSpec) -> Column:
    return F.lag(col, n).over(window)


def full_frame(agg: Callable[[Column], Column], value: Column, n: int, window: WindowSpec) -> Column:
    """Rolling aggregate over ``n`` rows, NULL until all ``n`` values are present."""
    frame = window.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) == n, agg(value).over(frame))



def correlation(x: str, y: str, over: Callable[[Column], Column] = lambda c: c) -> Column:
    """Pearson correlation that is NULL, not an error, for a constant side."""
    return F.try_divide(over(F.covar_pop(x, y)), over(F.stddev_pop(x)) * over(F.stddev_pop(y)))
