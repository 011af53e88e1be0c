"""Trading-row calendars: positions, month ends, cut-offs, masks, folds and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import micros, numbered


def common_calendar(panel: DataFrame) -> DataFrame:
    """Timestamps that every symbol has, with their position.  (symbol, ts) must be unique."""
    symbols = panel.select(F.count_distinct("symbol")).scalar()
    days = panel.groupBy("ts").agg(F.count(F.lit(1)).alias("_n"))
    return numbered(days.where(F.col("_n") == symbols).select("ts"), [])


def on_common_calendar(panel: DataFrame) -> DataFrame:
    """Rows on the common calendar, with ``pos`` counting its timestamps from zero."""
    return panel.join(common_calendar(panel), "ts")


def month_ends(calendar: DataFrame, drop_partial_last: bool = False) -> DataFrame:
    """Last row of each calendar month; optionally without a last month that ends early.

    A last month counts as ended when its last timestamp reaches its last Monday-to-Friday day.
    """
    month = F.trunc("ts", "month")
    ends = calendar.groupBy(month.alias("month")).agg(F.max("ts").alias("ts"))
    if drop_partial_last:
        last = calendar.select(F.max("ts")).scalar()
        end = F.last_day(F.col("month"))
        back = F.greatest(F.weekday(end) - 4, F.lit(0))
        unfinished = (F.col("ts") == last) & (F.to_date("ts") < F.date_sub(end, back))
        ends = ends.where(~unfinished)
    return ends


def development_end(calendar: DataFrame, fraction: float = 0.8) -> DataFrame:
    """One row: the latest month end not after the calendar row at ``int(n * fraction) - 1``."""
    n = calendar.select(F.count(F.lit(1))).scalar()
    limit = calendar.where(F.col("pos") == F.floor(n * F.lit(fraction)) - 1).select(F.max("ts")).scalar()
    return month_ends(calendar).where(F.col("ts") <= limit).agg(F.max("ts").alias("ts"))


def fraction_split(df: DataFrame, fraction: float, out: str = "part") -> DataFrame:
    """Label rows ``head`` or ``tail`` by position against ``int(n * fraction)``."""
    n = df.select(F.max("pos") + 1).scalar()
    return df.withColumn(out, F.when(F.col("pos") < F.floor(n * F.lit(fraction)), "head").otherwise("tail"))


def cadence(pos: Column, first: Column | int, every: int) -> Column:
    return (pos - first) % every == 0


def decisions_between(decisions: DataFrame, calendar: DataFrame, start: str, end: str) -> DataFrame:
    """Decisions in [start, end) plus the last earlier one when trading resumes at or after start.

    ``anchor_ok`` is false where the earlier decision's next calendar row comes before ``start``.
    """
    s, e = F.to_timestamp_ntz(F.lit(start)), F.to_timestamp_ntz(F.lit(end))
    prior = decisions.where(F.col("ts") < s).select(F.max("ts")).scalar()
    anchor = decisions.where(F.col("ts") == prior)
    following = calendar.where((F.col("ts") > prior) & (F.col("ts") <= e)).select(F.min("ts")).scalar()
    return (decisions.where((F.col("ts") >= s) & (F.col("ts") < e)).withColumn("anchor_ok", F.lit(True))
            .unionByName(anchor.withColumn("anchor_ok", F.coalesce(following >= s, F.lit(False)))))


def exact_step_mask(calendar: DataFrame, seconds: int = 60) -> DataFrame:
    """True where the next calendar row is exactly ``seconds`` later; the last row is false."""
    following = calendar.select((F.col("pos") - 1).alias("pos"), micros("ts").alias("_next"))
    return (calendar.join(following, "pos", "left")
            .withColumn("is_step", F.coalesce(
                F.col("_next") - micros("ts") == seconds * 1_000_000, F.lit(False)))
            .drop("_next"))


def rolling_folds(calendar: DataFrame, train: int, test: int, step: int, purge: int = 0) -> DataFrame:
    """Fold table over ``n`` rows: train [start, stop), test [stop, stop + test).

    ``purge`` drops the last training rows whose label reaches into the test block.
    """
    if purge >= train:
        raise ValueError("purging leaves no training rows")
    n = calendar.agg((F.max("pos") + 1).alias("n"))
    start = F.explode(F.when(F.col("n") >= train + test, F.sequence(
        F.lit(0).cast("long"), F.col("n") - train - test, F.lit(step).cast("long"))).otherwise(
        F.array().cast("array<bigint>")))
    return (n.select(start.alias("train_start"))
            .withColumn("fold", (F.col("train_start") / step).cast("long"))
            .withColumn("train_stop", F.col("train_start") + train - purge)
            .withColumn("test_start", F.col("train_start") + train)
            .withColumn("test_stop", F.col("train_start") + train + test))


def expanding_windows(span: DataFrame, windows: int = 5) -> DataFrame:
    """Cut one (first, last) range into equal test blocks; the last block takes the remainder."""
    size = F.floor((F.col("last") - F.col("first")) / windows)
    k = F.col("block")
    return (span.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))))
            .select(k, (F.col("first") + k * size).alias("test_start"),
                    F.when(k == windows - 1, F.col("last"))
                    .otherwise(F.col("first") + (k + 1) * size).alias("test_stop")))


def coverage(panel: DataFrame, minimum: float = 0.9) -> DataFrame:
    """Symbols with at least ``int(calendar size * minimum)`` priced rows."""
    size = panel.select(F.count_distinct("ts")).scalar()
    return (panel.where(F.col("price").isNotNull()).groupBy("symbol")
            .agg(F.count(F.lit(1)).alias("rows"))
            .where(F.col("rows") >= F.floor(size * F.lit(minimum))))


def index_faults(panel: DataFrame) -> DataFrame:
    """Per symbol: duplicate timestamps, missing or non-positive prices, holes against the calendar."""
    days = numbered(panel.select("ts").distinct(), [])
    return (panel.join(days, "ts").groupBy("symbol")
            .agg(F.count(F.lit(1)).alias("rows"),
                 (F.count(F.lit(1)) - F.count_distinct("ts")).alias("duplicates"),
                 F.count_if(F.col("price").isNull() | F.isnan("price") | (F.col("price") <= 0))
                 .alias("bad_prices"),
                 (F.max("pos") - F.min("pos") + 1 == F.count_distinct("pos")).alias("contiguous")))

