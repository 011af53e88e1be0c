"""Signal scores from a forecast table and their diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import numbered
from .calendars import exact_step_mask
from .quantiles import exact_percentiles
from .rolling import equity, trailing_percentile

VARIANTS = ("mu", "mu_over_sigma", "kelly_edge", "p_up", "mu_percentile")
BASELINES = ("random", "momentum", "reversal")


def calibrate_k(forecast: DataFrame, keys: Sequence[str] = ("symbol",), utilisation: float = 0.5,
                maximum: float = 1.0, percentile: float = 0.95, eps: float = 1e-6, max_edge: float | None = None) -> DataFrame:
    """k such that the 95th percentile of |edge|, clipped at ``max_edge`` if given, uses half of the maximum position."""
    size = F.abs(F.col("mu") / (F.col("sigma") * F.col("sigma") + eps))
    edges = forecast.withColumn("_abs_edge", size if max_edge is None else F.when(size.isNotNull(), F.least(size, F.lit(float(max_edge)))))
    ref = exact_percentiles(edges, keys, "_abs_edge", {"_ref": percentile})
    return ref.select(*keys, F.when(F.col("_ref") < eps, 0.0).otherwise(utilisation * maximum / F.col("_ref")).alias("k"))


def fold_positions(folds: DataFrame, first: str, stop: str) -> DataFrame:
    """(fold, pos): the calendar positions of one slice of every fold; a position may belong to several folds."""
    last = F.col(stop) - 1
    return folds.where(last >= F.col(first)).select("fold", F.explode(F.sequence(first, last)).alias("pos"))


def walk_forward_k(forecast: DataFrame, folds: DataFrame, **options: float) -> DataFrame:
    """(fold, symbol, k): k of each fold from the forecasts of its purged training slice only."""
    training = forecast.join(fold_positions(folds, "train_start", "train_stop"), "pos")
    return calibrate_k(training, ("fold", "symbol"), **options)


def evaluated_bars(calendar: DataFrame, folds: DataFrame, seconds: int) -> DataFrame:
    """(fold, pos, step): test bars whose forward return spans exactly ``seconds``, numbered inside their fold."""
    exact = exact_step_mask(calendar.select("ts", "pos"), seconds).where("is_step").drop("is_step")
    tested = exact.join(fold_positions(folds, "test_start", "test_stop"), "pos")
    return numbered(tested, ["fold"], pos="step").select("fold", "pos", "step")


def score_variants(forecast: DataFrame, k: DataFrame, window: int = 500, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """(symbol, ts, pos, fwd, variant, score) in long form; ``k`` is joined on ``keys``."""
    mu, sigma = F.col("mu"), F.col("sigma")
    wide = trailing_percentile(forecast, "mu", window, "mu_percentile").join(k, list(keys)).withColumns({
        "mu_over_sigma": mu / (sigma + 1e-6), "kelly_edge": F.col("k") * mu / (sigma * sigma + 1e-6)})
    keep = [c for c in forecast.columns if c not in ("mu", "p_up")]
    return wide.unpivot(keep, list(VARIANTS), "variant", "score")


def simple_forward(df: DataFrame, log_return: str = "target") -> DataFrame:
    return df.withColumn("fwd", F.expm1(log_return))


def diagnostics(per_bar: DataFrame) -> DataFrame:
    """Per variant: rank-IC level and stability over folds, spread, gross-1 equity, turnover, break-even.

    ``per_bar`` is (fold, variant, ts, ic, spread, turnover).  Equity compounds half the spread, which is
    the return of a book with gross exposure 1.  Fold means that cancel to rounding noise are not positive.
    """
    gross1 = per_bar.where(F.col("spread").isNotNull()).select(
        F.col("variant").alias("scenario"), "ts", (F.col("spread") / 2).alias("net"))
    curve = equity(gross1).groupBy("scenario").agg(
        F.max_by("equity", "ts").alias("final_equity"),
        F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown_gross1"))
    flat = per_bar.groupBy("variant").agg(
        F.avg("ic").alias("mean_ic"), F.count("ic").alias("n_ic"), F.avg("spread").alias("mean_spread"),
        F.avg("turnover").alias("mean_turnover"))
    folds = (per_bar.where(F.col("ic").isNotNull()).groupBy("variant", "fold").agg(F.avg("ic").alias("_m"))
             .groupBy("variant").agg(F.stddev_pop("_m").alias("ic_sd_folds"),
                                     F.avg((F.col("_m") > 1e-12).cast("double")).alias("share_folds_positive"),
                                     F.count(F.lit(1)).alias("folds")))
    out = (flat.join(folds, "variant", "left")
           .join(curve.withColumnRenamed("scenario", "variant"), "variant", "left"))
    out = out.withColumn("compounded_gross1", F.col("final_equity") - 1)
    return out.withColumn("breakeven_cost", F.when(
        F.col("mean_turnover") != 0, F.col("mean_spread") / 2 / F.col("mean_turnover")))
