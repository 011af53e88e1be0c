"""Features over one series.  Input rows carry ``symbol`` and ``pos``; see :mod:`blocks`."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .blocks import BLOCK_ROWS, correlation, full_frame, in_blocks, lag, time_bucket

TRADING_DAYS = 252
YEAR_SECONDS = 365 * 86_400


def per_symbol(df: DataFrame, columns: Callable[[WindowSpec], dict[str, Column]], before: int,
               after: int = 0, rows: int = BLOCK_ROWS) -> DataFrame:
    """Add window columns that look ``before`` rows back and ``after`` rows ahead."""
    return in_blocks(df, ["symbol"], lambda d, w: d.withColumns(columns(w)), before, after, rows=rows)


def change(w: WindowSpec, n: int = 1, price: str = "price") -> Column:
    return F.col(price) / lag(price, n, w) - 1


def returns(panel: DataFrame) -> DataFrame:
    return per_symbol(panel, lambda w: {
        "ret": change(w), "log_ret": F.log("price") - F.log(lag("price", 1, w))}, 1)


def trend_signs(panel: DataFrame, lookbacks: Sequence[int] = (63, 126, 252)) -> DataFrame:
    """Sign of the return over each lookback, and their mean where all exist."""
    def cols(w: WindowSpec) -> dict[str, Column]:
        signs = {f"mom{n}": F.signum(change(w, n)) for n in lookbacks}
        total = sum(signs.values(), F.lit(0.0))
        return {**signs, "combo": total / len(lookbacks)}
    return per_symbol(panel, cols, max(lookbacks))


def ewma_vol(df: DataFrame, value: str = "ret", span: int = 63, out: str = "vol",
             periods: int = TRADING_DAYS, rows: int = BLOCK_ROWS) -> DataFrame:
    """Annualised exponentially weighted deviation, bias corrected, after ``span`` observations.

    Weights decay by g = 1 - 2/(span+1) per row.  Sums of x * g**-pos run inside a block whose
    history reaches back until g**n < 1e-17; the exponent is centred in the block.
    """
    g = 1 - 2 / (span + 1)
    memory = max(span, math.ceil(39 / -math.log(g)))
    rows = min(rows, max(memory, int(600 / -math.log(g)) - memory))

    def compute(d: DataFrame, w: WindowSpec) -> DataFrame:
        centre = (F.col("_block") + 0.5) * max(rows, memory) - memory / 2
        up = F.pow(F.lit(g), centre - F.col("pos"))
        x = F.col(value)
        frame = w.rowsBetween(Window.unboundedPreceding, 0)
        weight = F.when(x.isNotNull(), up)
        d = (d.withColumn("_w", weight).withColumn("_sw", F.sum("_w").over(frame))
             .withColumn("_sx", F.sum(F.col("_w") * x).over(frame))
             .withColumn("_sxx", F.sum(F.col("_w") * x * x).over(frame))
             .withColumn("_sww", F.sum(F.col("_w") * F.col("_w")).over(frame))
             .withColumn("_n", F.count(x).over(frame)))
        mean = F.col("_sx") / F.col("_sw")
        var = F.greatest(F.col("_sxx") / F.col("_sw") - mean * mean, F.lit(0.0))
        fix = F.col("_sw") * F.col("_sw")
        out_col = F.sqrt(var * fix / (fix - F.col("_sww"))) * math.sqrt(periods)
        return (d.withColumn(out, F.when(F.col("_n") >= span, out_col))
                .drop("_w", "_sw", "_sx", "_sxx", "_sww", "_n"))

    return in_blocks(df, ["symbol"], compute, memory, rows=rows)


def sd(value: Column | str, n: int, w: WindowSpec) -> Column:
    return full_frame(F.stddev_samp, F.col(value) if isinstance(value, str) else value, n, w)


def quote_from_bar(bars: DataFrame, spread_bp: float = 2.0) -> DataFrame:
    """Bid and ask around the price, and the volume split in half, where no quotes exist."""
    half = F.col("price") * (spread_bp / 1e4) / 2
    return (bars.withColumn("bid", F.col("price") - half).withColumn("ask", F.col("price") + half)
            .withColumn("bid_volume", F.col("volume") / 2).withColumn("ask_volume", F.col("volume") / 2))


BAR_FEATURES = ("log_return", "realized_vol", "orderbook_imbalance", "spread_norm", "vwap_deviation",
                "trade_intensity", "mid_price_return")


def bar_features(bars: DataFrame, vol_rows: int = 30, vwap_rows: int = 20, trade_rows: int = 50,
                 eps: float = 1e-8) -> DataFrame:
    """Seven features of a bar: returns, volatility, book, spread, VWAP distance, trade intensity."""
    mid = (F.col("bid") + F.col("ask")) / 2

    def first(w: WindowSpec) -> dict[str, Column]:
        return {"log_return": F.log("price") - F.log(lag("price", 1, w)),
                "mid_price_return": F.log(mid) - lag(F.log(mid), 1, w)}

    def second(w: WindowSpec) -> dict[str, Column]:
        vwap = F.try_divide(full_frame(F.sum, F.col("price") * F.col("volume"), vwap_rows, w),
                            full_frame(F.sum, F.col("volume"), vwap_rows, w))
        bv, av = F.col("bid_volume"), F.col("ask_volume")
        return {"realized_vol": sd("log_return", vol_rows, w),
                "orderbook_imbalance": (bv - av) / (bv + av + eps),
                "spread_norm": (F.col("ask") - F.col("bid")) / (mid + eps),
                "vwap_deviation": (F.col("price") - vwap) / (vwap + eps),
                "trade_intensity": F.col("trade_count")
                / (full_frame(F.avg, F.col("trade_count"), trade_rows, w) + eps)}

    return in_blocks(bars, ["symbol"],
                     lambda d, w: d.withColumns(first(w)).withColumns(second(w)),
                     max(vol_rows + 1, vwap_rows, trade_rows))


def rolling_zscore(df: DataFrame, columns: Sequence[str], n: int = 100, eps: float = 1e-8,
                   suffix: str = "_z", include_current: bool = True) -> DataFrame:
    """(x - mean) / (deviation + eps) over ``n`` rows; the frame holds the current row by default."""
    def cols(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for c in columns:
            frame = w.rowsBetween(-(n - 1), 0) if include_current else w.rowsBetween(-n, -1)
            full = F.count(c).over(frame) == n
            out[c + suffix] = F.when(full, (F.col(c) - F.avg(c).over(frame))
                                     / (F.stddev_samp(c).over(frame) + eps))
        return out
    return per_symbol(df, cols, n)


def floored(vol: Column, floor: float = 1e-6) -> Column:
    return F.when(vol.isNotNull(), F.greatest(vol, F.lit(floor)))


HORIZONS = (1, 5, 21, 63, 126)


def daily_channels(panel: DataFrame, horizons: Sequence[int] = HORIZONS, vol_rows: int = 63) -> DataFrame:
    """Volatility-scaled momentum over several horizons, floored volatility, direction and next label."""
    def compute(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("ret", change(w)).withColumn("vol", floored(sd("ret", vol_rows, w)))
        d = d.withColumns({f"m{h}": change(w, h) / F.col("vol") / math.sqrt(h) for h in horizons})
        return (d.withColumn("reference", F.coalesce(change(w, 126) > 0, F.lit(False)))
                .withColumn("y", clip(F.lead("ret", 2).over(w) / F.col("vol"), 10)))
    return in_blocks(panel, ["symbol"], compute, max(max(horizons), vol_rows + 1), after=2)


def clip(x: Column, limit: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(-float(limit)), F.least(F.lit(float(limit)), x)))


def extended_channels(panel: DataFrame, market: str) -> DataFrame:
    """Skip momentum, volatility ratio, distance from the 252-row high and market correlation.

    Adds ``skip_momentum, vol_ratio, drawdown, market_corr``; the cross rank of the first is
    :func:`ranking.centred_rank`.
    """
    index = (returns(panel.where(F.col("symbol") == market).select("symbol", "pos", "price"))
             .select("pos", F.col("ret").alias("market_ret")))

    def compute(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("ret", change(w)).withColumn("vol", floored(sd("ret", 63, w)))
        both = w.rowsBetween(-62, 0)
        paired = F.col("ret").isNotNull() & F.col("market_ret").isNotNull()
        d = d.withColumn("_own", F.when(paired, F.col("ret"))).withColumn("_market", F.when(paired, F.col("market_ret")))
        corr = correlation("_own", "_market", lambda agg: agg.over(both))
        return d.withColumns({
            "skip_momentum": (lag("price", 21, w) / lag("price", 147, w) - 1) / F.col("vol") / math.sqrt(126),
            "vol_ratio": F.log(floored(sd("ret", 21, w)) / floored(sd("ret", 126, w))),
            "drawdown": (F.col("price") / full_frame(F.max, F.col("price"), 252, w) - 1)
            / F.col("vol") / math.sqrt(252),
            "market_corr": F.when(F.count("_own").over(both) == 63, clip(corr, 1))
        }).drop("_own", "_market")
    return in_blocks(panel.join(index, "pos", "left"), ["symbol"], compute, 252)


def holding_label(panel: DataFrame, horizon: int, vol: str = "vol", out: str = "label") -> DataFrame:
    """Return from the next close over ``horizon`` rows, per unit of volatility, clipped at 10."""
    return per_symbol(panel, lambda w: {out: clip(
        (F.lead("price", horizon + 1).over(w) / F.lead("price", 1).over(w) - 1)
        / (F.col(vol) * math.sqrt(horizon)), 10)}, 0, horizon + 1)


def forward_log_return(panel: DataFrame, horizon: int, out: str = "target") -> DataFrame:
    return per_symbol(panel, lambda w: {
        out: F.log(F.lead("price", horizon).over(w)) - F.log("price")}, 0, horizon)


def trailing_percentile(df: DataFrame, value: str, n: int = 500, out: str = "percentile") -> DataFrame:
    """Share of the previous ``n`` values at or below the current one; 0.5 without predecessors."""
    def compute(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("_past", F.collect_list(value).over(w.rowsBetween(-n, -1)))
        hits = F.size(F.filter("_past", lambda v: v <= F.col(value)))
        return d.withColumn(out, F.when(F.size("_past") > 0, hits / F.size("_past")).otherwise(0.5)).drop("_past")
    return in_blocks(df, ["symbol"], compute, n)


def trailing_apply(df: DataFrame, value: str, n: int, function: Callable[[Column], Column], out: str) -> DataFrame:
    """``function(array of the last n values)``, NULL until ``n`` values are present."""
    def compute(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("_last", F.collect_list(value).over(w.rowsBetween(-(n - 1), 0)))
        return d.withColumn(out, F.when(F.size("_last") == n, function(F.col("_last")))).drop("_last")
    return in_blocks(df, ["symbol"], compute, n)


def bar_momentum(panel: DataFrame, n: int = 20) -> DataFrame:
    """Momentum and reversal scores; rows without ``n`` predecessors are absent."""
    scored = per_symbol(panel, lambda w: {
        "momentum": (F.col("price") - lag("price", n, w)) / lag("price", n, w)}, n)
    return scored.where(F.col("momentum").isNotNull()).withColumn("reversal", -F.col("momentum"))


def market_relative(panel: DataFrame, reference: DataFrame) -> DataFrame:
    """Log return minus the reference's log return on the symbol's own rows; gaps become 0.

    ``reference`` rows are (ts, ref_price), already carried forward onto every timestamp of the panel.
    """
    def cols(w: WindowSpec) -> dict[str, Column]:
        own = F.log("price") - F.log(lag("price", 1, w))
        ref = F.log("ref_price") - F.log(lag("ref_price", 1, w))
        return {"market_relative_return": F.coalesce(own - ref, F.lit(0.0))}
    return per_symbol(panel.join(reference, "ts", "left"), cols, 1)


def equity(returns_table: DataFrame, keys: Sequence[str] = ("scenario",), value: str = "net",
           seconds: int = YEAR_SECONDS) -> DataFrame:
    """Compounded equity from 1.0, its running peak, and the two drawdowns.

    ``drawdown`` counts the starting equity 1.0 as a peak, ``path_drawdown`` does not.  Time is cut into
    buckets: a bucket's own curve starts at 1, and its growth, high and low carry to the later ones.
    """
    keys = list(keys)
    inner = Window.partitionBy(*keys, "_bucket").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    own = (returns_table.withColumn("_bucket", time_bucket("ts", seconds))
           .withColumn("_rel", _product(1 + F.col(value), inner))
           .withColumn("_high", F.max("_rel").over(inner)).withColumn("_low", F.min("_rel").over(inner)))
    ends = own.groupBy(*keys, "_bucket").agg(F.product(1 + F.col(value)).alias("_growth"),
                                             F.max("_rel").alias("_top"), F.min("_rel").alias("_bottom"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.withColumn("_start", F.coalesce(_product(F.col("_growth"), earlier), F.lit(1.0)))
    starts = starts.withColumn("_peak0", F.max(F.when(F.col("_start") >= 0, F.col("_start") * F.col("_top"))
                                               .otherwise(F.col("_start") * F.col("_bottom"))).over(earlier))
    out = own.join(starts.select(*keys, "_bucket", "_start", "_peak0"), [*keys, "_bucket"])
    high = F.when(F.col("_start") >= 0, F.col("_start") * F.col("_high")).otherwise(F.col("_start") * F.col("_low"))
    out = out.withColumn("equity", F.col("_start") * F.col("_rel")).withColumn("peak", F.greatest(high, F.col("_peak0")))
    return (out.withColumn("drawdown", F.col("equity") / F.greatest(F.col("peak"), F.lit(1.0)) - 1)
            .withColumn("path_drawdown", F.col("equity") / F.col("peak") - 1)
            .drop("_bucket", "_rel", "_high", "_low", "_start", "_peak0"))


def _product(x: Column, frame: WindowSpec) -> Column:
    """Running product by logarithms, with zeros and signs counted apart."""
    size = F.exp(F.sum(F.when(x != 0, F.log(F.abs(x)))).over(frame))
    negatives = F.count_if(x < 0).over(frame)
    return F.when(F.count_if(x == 0).over(frame) > 0, 0.0).otherwise(
        F.coalesce(size, F.lit(1.0)) * F.when(negatives % 2 == 1, -1.0).otherwise(1.0))
