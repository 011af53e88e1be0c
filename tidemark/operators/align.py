"""Joins on time: as-of, forward fill, trailing ranges, reproduction and pairing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import carried_last, in_blocks, micros, numbered, time_bucket

DAY = 86_400


def last_known(left: DataFrame, right: DataFrame, values: Sequence[str], keys: Sequence[str] = ("symbol",),
               left_ts: str = "ts", right_ts: str = "ts", tie: str | None = None,
               keep_unmatched: bool = False, seconds: int = DAY) -> DataFrame:
    """Backward as-of join: the last ``right`` row at or before each ``left`` row.

    Both sides become one tagged series; the last right-hand struct is carried along it, so there is
    one sort and no range join.  Equal right-hand timestamps resolve by ``tie`` (last wins).  The time
    column matched on is explicit on both sides.
    """
    keys = list(keys)
    payload = F.struct(*[F.col(v) for v in values])
    r = right.select(*keys, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"),
                     (F.col(tie) if tie else F.lit(0)).cast("long").alias("_tie"),
                     payload.alias("_value"))
    rest = [c for c in left.columns if c not in keys]
    l = left.select(*keys, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"),
                    F.struct(*rest).alias("_left"))
    both = r.unionByName(l, allowMissingColumns=True)
    out = carried_last(both, keys, ["_ts", "_side", "_tie"], time_bucket("_ts", seconds), F.col("_value"), "_found")
    out = out.where(F.col("_side") == 1)
    if not keep_unmatched:
        out = out.where(F.col("_found").isNotNull())
    return out.select(*keys, "_left.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def forward_filled(panel: DataFrame, calendar: DataFrame, rows: int = 4096) -> DataFrame:
    """Each symbol's last price on every calendar row from its first one on.

    A price holds until the symbol's next row, so each row is spread over the calendar positions it
    covers: no grid of symbols and timestamps is built and matched.
    """
    days = numbered(calendar, [])
    last = days.select(F.max("pos")).scalar()
    placed = numbered(panel.join(days.withColumnRenamed("pos", "day"), "ts"), ["symbol"])
    held = in_blocks(placed, ["symbol"], lambda d, w: d.withColumn("_next", F.lead("day").over(w)), 0, 1, rows=rows)
    spread = held.select("symbol", "price", F.explode(F.sequence(
        F.col("day"), F.coalesce(F.col("_next") - 1, last))).alias("pos"))
    return spread.join(days, "pos").drop("pos")


def cash_rate(calendar: DataFrame, cash: DataFrame, causal: bool) -> DataFrame:
    """Daily cash return on the calendar from a percent-per-year series.

    ``causal=False`` fills forward and fills the head backward (which looks ahead there);
    ``causal=True`` uses the rate known one row earlier and leaves the head NULL.
    """
    filled = last_known(calendar, cash.where(F.col("rate_pa_pct").isNotNull()), ["rate_pa_pct"], keys=(),
                        keep_unmatched=True, seconds=365 * DAY)
    if causal:
        rate = in_blocks(filled, [], lambda d, w: d.withColumn("_rate", F.lag("rate_pa_pct").over(w)), 1)
    else:
        head = cash.where(F.col("rate_pa_pct").isNotNull()).select(F.min_by("rate_pa_pct", "ts")).scalar()
        rate = filled.withColumn("_rate", F.coalesce("rate_pa_pct", head))
    return rate.select("ts", "pos", (F.col("_rate") / 100 / 252).alias("cash"))


def news_window(bars: DataFrame, news: DataFrame, minutes: int = 240) -> DataFrame:
    """log1p(count) and mean score of the news in (t - minutes, t] per bar.

    Articles of one symbol and moment are summed before anything else.  Buckets are one window long; each sum is copied into its
    own and the next bucket.
    """
    width = minutes * 60_000_000
    n = (news.groupBy("symbol", micros("created_at").alias("_us")).agg(F.sum("score").alias("_score"), F.count("score").alias("_articles"))
         .withColumn("_side", F.lit(0)))
    n = n.withColumn("_bucket", F.explode(F.array(F.floor(F.col("_us") / width), F.floor(F.col("_us") / width) + 1)))
    rest = [c for c in bars.columns if c != "symbol"]
    b = (bars.select("symbol", micros("ts").alias("_us"), F.lit(1).alias("_side"), F.struct(*rest).alias("_bar"))
         .withColumn("_bucket", F.floor(F.col("_us") / width)))
    frame = Window.partitionBy("symbol", "_bucket").orderBy("_us").rangeBetween(-(width - 1), 0)
    both = n.unionByName(b, allowMissingColumns=True)
    return (both.withColumn("_n", F.coalesce(F.sum("_articles").over(frame), F.lit(0)))
            .withColumn("_mean", F.try_divide(F.sum("_score").over(frame), F.col("_n")))
            .where(F.col("_side") == 1)
            .select("symbol", "_bar.*", F.log1p(F.col("_n").cast("double")).alias("news_intensity"),
                    F.coalesce("_mean", F.lit(0.0)).alias("news_sentiment")))


def attach(bars: DataFrame, extra: DataFrame) -> DataFrame:
    """Add feature columns by (symbol, ts)."""
    return bars.join(extra, ["symbol", "ts"], "left")


def mismatches(actual: DataFrame, expected: DataFrame, keys: Sequence[str], value: str,
               atol: float = 1e-12, rtol: float = 1e-10) -> DataFrame:
    """Rows missing on one side or apart by more than atol + rtol * |expected|."""
    a = actual.select(*keys, F.col(value).alias("actual"), F.lit(True).alias("_a"))
    b = expected.select(*keys, F.col(value).alias("expected"), F.lit(True).alias("_b"))
    joined = a.join(b, list(keys), "full")
    apart = F.abs(F.col("actual") - F.col("expected")) > atol + rtol * F.abs("expected")
    one_null = F.col("actual").isNull() != F.col("expected").isNull()
    return (joined.where(F.col("_a").isNull() | F.col("_b").isNull() | one_null | apart)
            .withColumn("reason", F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "extra").otherwise("value"))
            .drop("_a", "_b"))


def paired(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Inner join of two runs on their keys, with the difference b - a."""
    return (a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), list(keys))
            .withColumn("diff", F.col("b") - F.col("a")))


def calendar_mismatch(left: DataFrame, right: DataFrame) -> DataFrame:
    """(symbol, ts) present on one side only."""
    keys = ["symbol", "ts"]
    l, r = left.select(*keys), right.select(*keys)
    return (l.join(r, keys, "left_anti").withColumn("only_in", F.lit("left"))
            .unionByName(r.join(l, keys, "left_anti").withColumn("only_in", F.lit("right"))))


def excluded_panels(panel: DataFrame, exclusions: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One copy of the panel per exclusion id, without the symbols that id names."""
    copies = panel.withColumn("exclude_id", F.explode(F.array(*[F.lit(i) for i in ids])))
    return copies.join(exclusions, ["exclude_id", "symbol"], "left_anti")

