"""Cross-sections: ranks, books, selection.  One timestamp holds at most one row per symbol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import uniform
from .blocks import BLOCK_ROWS, correlation, in_blocks, state_after
from .rolling import per_symbol


def average_rank(section: Sequence[str], value: str, present: Column | None = None) -> Column:
    """Rank from 1 with ties sharing their mean rank, over non-null values of the section."""
    ok = F.col(value).isNotNull() if present is None else present
    within = Window.partitionBy(*section, ok)
    tied = Window.partitionBy(*section, ok, value)
    return F.when(ok, F.rank().over(within.orderBy(value)) + (F.count(F.lit(1)).over(tied) - 1) / 2)


def present_count(section: Sequence[str], value: str) -> Column:
    return F.count(value).over(Window.partitionBy(*section))


def centred_rank(df: DataFrame, value: str, out: str = "cross_rank", section: Sequence[str] = ("ts",)) -> DataFrame:
    """Average rank mapped to [-1, 1]; NULL with fewer than two values."""
    n = present_count(section, value)
    ranked = df.withColumn("_r", average_rank(section, value)).withColumn("_n", n)
    return ranked.withColumn(out, F.when(F.col("_n") > 1, 2 * (F.col("_r") - 1) / (F.col("_n") - 1) - 1)).drop("_r", "_n")


def momentum_buckets(panel: DataFrame, lookback: int = 252, skip: int = 21, top: float = 0.3,
                     bottom: float = 0.3) -> DataFrame:
    """+1 for the highest trailing returns of a timestamp, -1 for the lowest, 0 between."""
    scored = per_symbol(panel, lambda w: {
        "trailing": F.lag("price", skip).over(w) / F.lag("price", lookback + skip).over(w) - 1},
        lookback + skip)
    pct = average_rank(["ts"], "trailing") / present_count(["ts"], "trailing")
    return (scored.withColumn("pct_rank", pct)
            .withColumn("signal", F.when(F.col("trailing").isNull(), None)
                        .when(F.col("pct_rank") <= bottom, -1.0)
                        .when(F.col("pct_rank") > 1 - top, 1.0).otherwise(0.0)))


def rank_ic(scored: DataFrame, section: Sequence[str] = ("ts", "variant"), minimum: int = 3) -> DataFrame:
    """Spearman correlation of score and forward return per section."""
    both = scored.where(F.col("score").isNotNull() & F.col("fwd").isNotNull())
    ranked = (both.withColumn("_rs", average_rank(section, "score", F.lit(True)))
              .withColumn("_rf", average_rank(section, "fwd", F.lit(True))))
    return ranked.groupBy(*section).agg(
        F.when(F.count(F.lit(1)) >= minimum, correlation("_rs", "_rf")).alias("ic"),
        F.count(F.lit(1)).alias("n"))


def top_bottom(scored: DataFrame, n_long: int, n_short: int,
               section: Sequence[str] = ("ts", "variant")) -> DataFrame:
    """Position from the top (score descending, then symbol) and a +1/-1/0 side."""
    order = Window.partitionBy(*section).orderBy(F.col("score").desc(), "symbol")
    every = Window.partitionBy(*section)
    rows = (scored.where(F.col("score").isNotNull() & F.col("fwd").isNotNull())
            .withColumn("place", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(every)))
    return rows.withColumn("side", F.when(F.col("place") > F.col("n") - n_short, -1)
                           .when(F.col("place") <= n_long, 1).otherwise(0))


def gross_spread(scored: DataFrame, n_long: int, n_short: int,
                 section: Sequence[str] = ("ts", "variant")) -> DataFrame:
    """Mean forward return of the top names minus that of the bottom names."""
    rows = top_bottom(scored, n_long, n_short, section)
    top = F.col("place") <= n_long
    low = F.col("place") > F.col("n") - n_short
    return rows.groupBy(*section).agg(F.when(F.max("n") >= n_long + n_short,
        F.sum(F.when(top, F.col("fwd"))) / n_long - F.sum(F.when(low, F.col("fwd"))) / n_short).alias("spread"))


def ranked_book(scored: DataFrame, n_long: int, n_short: int,
                section: Sequence[str] = ("ts", "variant")) -> DataFrame:
    """Equal weights with gross exposure 1: half over the top names, half over the bottom names."""
    rows = top_bottom(scored, n_long, n_short, section).where(F.col("n") >= n_long + n_short)
    return rows.withColumn("weight", F.when(F.col("side") == 1, 1 / (2 * n_long))
                           .when(F.col("side") == -1, -1 / (2 * n_short)).otherwise(0.0))


def book_turnover(book: DataFrame, keys: Sequence[str] = ("fold", "variant"),
                  rows: int = BLOCK_ROWS) -> DataFrame:
    """Sum of absolute weight changes per timestamp; weights start from zero in each fold.

    ``book`` holds every symbol at every evaluated timestamp, numbered by ``step`` inside its fold.
    """
    moved = in_blocks(book, [*keys, "symbol"], lambda d, w: d.withColumn(
        "_dw", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(w), F.lit(0.0)))),
        1, pos="step", rows=rows)
    return moved.groupBy(*keys, "ts").agg(F.sum("_dw").alias("turnover"))


def hysteresis_sides(ranked: DataFrame, n_long: int, n_short: int, zone: int,
                     keys: Sequence[str] = (), rows: int = BLOCK_ROWS) -> DataFrame:
    """Sides with entry in the strict top/bottom and exit on leaving the wider zone.

    Input has ``edge``, ``pos`` and ``universe_pos`` (ties keep universe order), all symbols present at
    each ``pos``.  Per symbol this is a machine with the states none, long and short.  Where the zones overlap both sides may be
    due: a held long then stays long, and otherwise the short is taken.  ``zone_overlap`` marks rows of such a universe.
    """
    if zone < n_long or zone < n_short:
        raise ValueError("zone must cover both entry counts")
    section = Window.partitionBy(*keys, "pos")
    place = F.row_number().over(section.orderBy(F.col("edge").desc(), "universe_pos"))
    df = ranked.withColumn("place", place).withColumn("_n", F.count(F.lit(1)).over(section))
    low = F.col("_n") - F.col("place") + 1
    flags = ((F.col("place") <= n_long).cast("int") + 2 * (F.col("place") <= zone).cast("int")
             + 4 * (low <= n_short).cast("int") + 8 * (low <= zone).cast("int"))

    def step(state: Column, found: Column) -> Column:
        has = lambda bit: found.bitwiseAND(bit) != 0
        long, short = has(1) | (state == 1) & has(2), has(4) | (state == 2) & has(8)
        return F.when(long & (~short | (state == 1)), 1).when(short, 2).otherwise(0)

    df = df.withColumn("zone_overlap", F.col("_n") < 2 * zone).withColumn("_flags", flags)
    df = state_after(df, [*keys, "symbol"], "_flags", 3, step, "_state", rows=min(rows, 2048))
    side = F.when(F.col("_state") == 1, 1).when(F.col("_state") == 2, -1).otherwise(0)
    return df.withColumn("side", side).drop("_n", "_flags", "_state")


def neutral_weights(sides: DataFrame, gross: float = 1.0, section: Sequence[str] = ("pos",)) -> DataFrame:
    """Half the gross over the longs, half over the shorts."""
    counted = Window.partitionBy(*section, "side")
    return sides.withColumn("weight", F.when(F.col("side") != 0, F.col("side") * (gross / 2)
                                             / F.count(F.lit(1)).over(counted)).otherwise(0.0))


def gated_inverse_vol(df: DataFrame, section: Sequence[str] = ("ts",)) -> DataFrame:
    """Inverse-volatility weights of all assets; assets with a non-positive forecast stay in cash."""
    inv = 1 / F.col("vol")
    return df.withColumn("base", F.when(F.col("pred") > 0, inv / F.sum(inv).over(Window.partitionBy(*section))).otherwise(0.0))


def signal_weights(df: DataFrame, section: Sequence[str], long_only: Column) -> DataFrame:
    """signal / vol scaled to gross 1; missing or zero volatility counts as no position."""
    signal = F.when(long_only, F.greatest(F.col("signal"), F.lit(0.0))).otherwise(F.col("signal"))
    raw = F.coalesce(F.when(F.col("vol") > 0, signal / F.col("vol")), F.lit(0.0))
    rows = df.withColumn("_raw", raw).withColumn("_gross", F.sum(F.abs("_raw")).over(Window.partitionBy(*section)))
    return rows.withColumn("base", F.when(F.col("_gross") > 0, F.col("_raw") / F.col("_gross")).otherwise(0.0)).drop("_raw", "_gross")


def volatility_cap(base: DataFrame, panel: DataFrame, keys: Sequence[str], cap: float = 0.10, window: int = 63,
                   decision: str = "decision_pos") -> DataFrame:
    """Scale base weights down so the last ``window`` rows' weighted deviation stays under ``cap``.

    ``base`` rows are (keys, decision_pos, symbol, base).  Each decision is spread over its own window
    positions and meets the panel in an equi-join on (symbol, pos).  Never scales up.
    """
    wanted = base.where(F.col("base") != 0).withColumn("pos", F.explode(F.sequence(
        F.greatest(F.col(decision) - (window - 1), F.lit(0)), F.col(decision))))
    daily = (wanted.join(panel.select("symbol", "pos", "ret"), ["symbol", "pos"])
             .groupBy(*keys, decision, "pos").agg(F.sum(F.col("base") * F.coalesce("ret", F.lit(0.0))).alias("_r")))
    risk = daily.groupBy(*keys, decision).agg((F.stddev_samp("_r") * F.sqrt(F.lit(252.0))).alias("risk"))
    scale = F.when(F.col("risk") > 0, F.least(F.lit(1.0), cap / F.col("risk"))).otherwise(1.0)
    return (base.join(risk, [*keys, decision], "left")
            .withColumn("weight", F.col("base") * F.coalesce(scale, F.lit(1.0))))


def hash_scores(df: DataFrame, seed: int, keys: Sequence[str] = ("pos", "symbol")) -> DataFrame:
    """A score in [0, 1) that depends on the seed and the row keys alone."""
    return df.withColumn("score", uniform(F.lit(seed), *[F.col(k) for k in keys]))

