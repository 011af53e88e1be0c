"""Sequence samples, pooled scaling, ridge by normal equations, boosted trees, walk-forward scoring."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .blocks import in_blocks, numbered

STEPS = 20


def _complete(channels: Sequence[str]) -> Column:
    whole = F.lit(True)
    for c in channels:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)
    return whole


def dense_sequences(panel: DataFrame, channels: Sequence[str], steps: int = STEPS) -> DataFrame:
    """``seq`` (steps x channels) per row, for the dates on which every asset has a complete one."""
    def compute(d: DataFrame, w) -> DataFrame:
        frame = w.rowsBetween(-(steps - 1), 0)
        step = F.when(_complete(channels), F.array(*[F.col(c).cast("double") for c in channels]))
        return d.withColumn("seq", F.collect_list(step).over(frame))
    rows = in_blocks(panel, ["symbol"], compute, steps)
    symbols = panel.select(F.count_distinct("symbol")).scalar()
    full = F.size("seq") == steps
    dates = rows.where(full).groupBy("pos").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == symbols).select("pos")
    return rows.where(full).join(dates, "pos", "left_semi")


def compacted_sequences(rows: DataFrame, channels: Sequence[str], target: str, steps: int) -> DataFrame:
    """Drop incomplete rows first, then slide over what is left; the target is the one of the last row."""
    kept = rows.where(_complete([*channels, target])).drop("pos")
    dense = numbered(kept, ["symbol"])

    def compute(d: DataFrame, w) -> DataFrame:
        return d.withColumn("seq", F.collect_list(F.array(*[F.col(c).cast("double") for c in channels])).over(
            w.rowsBetween(-(steps - 1), 0)))
    return in_blocks(dense, ["symbol"], compute, steps).where(F.size("seq") == steps)


def training_rows(samples: DataFrame, windows: DataFrame, delay: int = 2) -> DataFrame:
    """Samples joined to every window whose first test row comes at least ``delay`` rows later.

    ``windows`` (block, test_start) is a handful of rows held as one array value, so each sample is spread
    over its own windows without a join.
    """
    held = windows.select(F.sort_array(F.collect_list(F.struct("test_start", "block")))).scalar()
    spread = samples.where(F.col("y").isNotNull()).withColumn("_held", held).withColumn("_w", F.explode(F.filter(
        "_held", lambda x: F.col("pos") <= x["test_start"] - delay))).drop("_held")
    return spread.withColumn("block", F.col("_w.block")).drop("_w")


def refit_windows(samples: DataFrame, first: int, every: int = 21, days: int = 252, delay: int = 2) -> DataFrame:
    """(refit_pos, from_rank, to_rank): the latest ``days`` labelled days that are mature at each refit."""
    labelled = numbered(samples.where(F.col("y").isNotNull()).select("ts", F.col("pos").alias("day_pos")).distinct(), [], pos="day_rank")
    last = samples.select(F.max("pos")).scalar()
    grid = samples.sparkSession.range(1).select(F.explode(F.sequence(
        F.lit(first + every).cast("long"), last, F.lit(every).cast("long"))).alias("refit_pos"))
    # a day counts from the first refit at or after its maturity; later refits inherit the count
    step = F.greatest(F.lit(1), F.ceil((F.col("day_pos") + delay - first) / every))
    first_use = (labelled.groupBy((F.lit(first) + step * every).alias("refit_pos")).agg(F.count(F.lit(1)).alias("_n")))
    cum = Window.orderBy("refit_pos").rowsBetween(Window.unboundedPreceding, 0)
    counted = grid.join(first_use, "refit_pos", "left").withColumn("_total", F.sum(F.coalesce("_n", F.lit(0))).over(cum))
    return counted.select("refit_pos", F.greatest(F.col("_total") - days, F.lit(0)).alias("from_rank"),
                          (F.col("_total") - 1).alias("to_rank")).where(F.col("to_rank") >= 0)


def refit_rows(samples: DataFrame, refits: DataFrame) -> DataFrame:
    """Samples of each refit window, by an equi-join on the day rank."""
    labelled = numbered(samples.where(F.col("y").isNotNull()).select("ts").distinct(), [], pos="day_rank")
    ranks = refits.select(F.col("refit_pos").alias("block"), F.explode(F.sequence("from_rank", "to_rank")).alias("day_rank"))
    return samples.where(F.col("y").isNotNull()).join(labelled, "ts").join(ranks, "day_rank").drop("day_rank")


def pooled_scaler(training: DataFrame) -> DataFrame:
    """(block, channel, mean, scale): moments pooled over steps; overlapping sequences count repeatedly."""
    steps = F.size("seq")
    channels = F.sequence(F.lit(0), F.size(F.col("seq")[0]) - 1)
    means = F.transform(channels, lambda c: F.aggregate("seq", F.lit(0.0), lambda a, v: a + v[c]) / steps)
    spreads = F.transform(channels, lambda c: F.aggregate(
        "seq", F.lit(0.0), lambda a, v: a + (v[c] - F.col("_m")[c]) * (v[c] - F.col("_m")[c])) / steps)
    rows = training.select("block", "seq", means.alias("_m")).select(
        "block", F.posexplode(F.arrays_zip(F.col("_m").alias("m"), spreads.alias("v"))).alias("channel", "x"))
    # every sequence has the same length, so pooled variance = mean variance inside + variance of the means
    pooled = rows.groupBy("block", "channel").agg(
        F.avg("x.m").alias("mean"), F.sqrt(F.avg("x.v") + F.var_pop("x.m")).alias("_sd"))
    return pooled.select("block", "channel", "mean", F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd")).alias("scale"))


def scaler_arrays(scaler: DataFrame) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("channel", "mean", "scale")))
    return scaler.groupBy("block").agg(ordered.alias("_s")).select(
        "block", F.transform("_s", lambda s: s["mean"]).alias("mean"), F.transform("_s", lambda s: s["scale"]).alias("scale"))


def standardised(rows: DataFrame, scalers: DataFrame, limit: float = 10.0) -> DataFrame:
    """``z``: the flattened sequence, per-channel standardised and clipped."""
    def one(step: Column) -> Column:
        return F.transform(F.arrays_zip(step.alias("x"), F.col("mean").alias("m"), F.col("scale").alias("s")),
                           lambda t: F.greatest(F.lit(-limit), F.least(F.lit(limit), (t["x"] - t["m"]) / t["s"])))
    return rows.join(scalers, "block").withColumn("z", F.flatten(F.transform("seq", one))).drop("mean", "scale")


def _partial_moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, list] = {}
    for pdf in batches:
        for block, part in pdf.groupby("block", sort=False):
            z = np.stack(part["z"].to_numpy())
            y = part["y"].to_numpy(dtype=float)
            x = np.column_stack([np.ones(len(y)), z, y])
            gram = x.T @ x
            sums[block] = sums[block] + gram if block in sums else gram
    if sums:  # an empty frame has no column type that Arrow could turn into an array
        yield pd.DataFrame({"block": list(sums), "gram": [g.ravel().tolist() for g in sums.values()]})


def ridge_moments(training: DataFrame) -> DataFrame:
    """(block, moments): the summed cross products of (1, z, y), one small matrix per task and block."""
    parts = training.select(F.col("block").cast("long"), "z", "y").mapInPandas(_partial_moments, "block long, gram array<double>")
    return parts.groupBy("block").agg(Summarizer.sum(array_to_vector("gram")).alias("_m")).select(
        "block", vector_to_array("_m").alias("moments"))


def ridge_weights(moments: DataFrame, penalty_per_feature: float = 1.0) -> DataFrame:
    """(block, weights, intercept): the p x p solves, one row per block, inside tasks."""
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for block, flat in zip(pdf["block"], pdf["moments"]):
                size = int(round(len(flat) ** 0.5))
                m = np.asarray(flat).reshape(size, size)
                n, zs, ys = m[0, 0], m[0, 1:-1], m[0, -1]
                p = len(zs)
                lhs = m[1:-1, 1:-1] - np.outer(zs, zs) / n + penalty_per_feature * p * np.eye(p)
                w = np.linalg.solve(lhs, m[1:-1, -1] - zs * ys / n)
                out.append((block, w.tolist(), float(ys / n - zs / n @ w)))
            yield pd.DataFrame(out, columns=["block", "weights", "intercept"])
    return moments.mapInPandas(solve, "block long, weights array<double>, intercept double")


def owned(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """Each sample with the one window whose test range holds it."""
    held = windows.select(F.sort_array(F.collect_list(F.struct("test_start", "test_stop", "block")))).scalar()
    mine = F.filter("_held", lambda x: (F.col("pos") >= x["test_start"]) & (F.col("pos") < x["test_stop"]))
    return (samples.withColumn("_held", held).withColumn("block", F.try_element_at(mine, F.lit(1))["block"])
            .drop("_held").where(F.col("block").isNotNull()))


def ridge_forecasts(samples: DataFrame, windows: DataFrame, delay: int = 2, subset: Sequence[int] | None = None) -> DataFrame:
    """Fit one ridge per window on its mature labels and score the window's own rows."""
    s = subset_channels(samples, subset)
    train = training_rows(s, windows, delay)
    scalers = scaler_arrays(pooled_scaler(train))
    fitted = ridge_weights(ridge_moments(standardised(train, scalers)))
    test = standardised(owned(s, windows), scalers).join(fitted, "block")
    dot = F.aggregate(F.zip_with("z", "weights", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return test.withColumn("forecast", dot + F.col("intercept")).drop("z", "weights", "intercept", "seq")


def refit_forecasts(samples: DataFrame, first: int, every: int = 21, days: int = 252, delay: int = 2) -> DataFrame:
    """Score each row with the latest refit before it; every refit uses its last ``days`` mature days.

    The first ``every`` rows are scored by an initial fit on all rows mature before ``first``.
    """
    refits = refit_windows(samples, first, every, days, delay)
    mature = F.col("y").isNotNull() & (F.col("pos") <= first - delay)
    initial = samples.where(mature).withColumn("block", F.lit(first).cast("long"))
    train = refit_rows(samples, refits).unionByName(initial)
    scalers = scaler_arrays(pooled_scaler(train))
    fitted = ridge_weights(ridge_moments(standardised(train, scalers)))
    start = F.lit(first) + F.floor((F.col("pos") - first) / every) * every
    mine = samples.where(F.col("pos") >= first).withColumn("block", start)
    test = standardised(mine, scalers).join(fitted, "block")
    dot = F.aggregate(F.zip_with("z", "weights", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return test.withColumn("forecast", dot + F.col("intercept")).drop("z", "weights", "intercept", "seq")


def tree_forecasts(samples: DataFrame, windows: DataFrame, delay: int = 2, subset: Sequence[int] | None = None,
                   rounds: int = 300, depth: int = 4, leaf_rows: int = 200, at_once: int = 8) -> DataFrame:
    """Boosted trees on the same standardised vectors; one distributed fit per window (a handful), ``at_once`` of them together.

    A window without a mature label fits nothing and gives no forecast.
    """
    s = subset_channels(samples, subset)
    train = training_rows(s, windows, delay)
    scalers = scaler_arrays(pooled_scaler(train))
    # boosting reads its input many times
    fit_rows = stored(standardised(train, scalers).select("block", "z", "y"), "tree-rows").withColumn("features", array_to_vector("z"))
    test_rows = standardised(owned(s, windows), scalers).withColumn("features", array_to_vector("z"))
    trees = GBTRegressor(featuresCol="features", labelCol="y", predictionCol="forecast", maxIter=rounds, maxDepth=depth, stepSize=0.05,
                         subsamplingRate=0.7, featureSubsetStrategy="0.7", minInstancesPerNode=leaf_rows, seed=7)

    @inheritable_thread_target(samples.sparkSession)
    def scored(block: int) -> DataFrame:
        model = trees.fit(fit_rows.where(F.col("block") == block))
        return model.transform(test_rows.where(F.col("block") == block))

    blocks = [r[0] for r in fit_rows.select("block").distinct().orderBy("block").collect()]
    out = test_rows.where(F.lit(False)).withColumn("forecast", F.lit(0.0))
    with ThreadPoolExecutor(at_once) as pool:
        for part in pool.map(scored, blocks):
            out = out.unionByName(part)
    return out.drop("z", "features", "seq")


def subset_channels(samples: DataFrame, subset: Sequence[int] | None) -> DataFrame:
    if subset is None:
        return samples
    return samples.withColumn("seq", F.transform("seq", lambda v: F.array(*[v[i] for i in subset])))


def variance_grid(returns: DataFrame, alphas: Sequence[float], betas: Sequence[float], limit: float = 0.999,
                  rows: int = 2048) -> DataFrame:
    """Best (alpha, beta) of var' = omega + alpha r^2 + beta var by Gaussian likelihood, per symbol.

    The recursion is linear in r^2, so var is omega (1 - beta^t)/(1 - beta) + beta^t v0 plus alpha times a
    decayed sum of past r^2: one blocked window per beta, then a plain expression per alpha.
    """
    if not 0 < min(betas) <= max(betas) < 1:
        raise ValueError("betas lie between 0 and 1")
    history = math.ceil(math.log(1e-16) / math.log(max(betas)))
    target = returns.groupBy("symbol").agg(F.avg(F.col("ret") * F.col("ret")).alias("v0"))
    spread = returns.select("symbol", "pos", "ret").withColumn("beta", F.explode(F.array(*[F.lit(float(b)) for b in betas])))

    def compute(d: DataFrame, w) -> DataFrame:
        centre = (F.col("_block") + 0.5) * max(rows, history) - history / 2
        rr = F.col("ret") * F.col("ret")
        past = F.sum(rr * F.pow("beta", centre - F.col("pos"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
        return d.withColumn("_s", F.coalesce(past * F.pow("beta", F.col("pos") - 1 - centre), F.lit(0.0)))

    sums = in_blocks(spread, ["symbol", "beta"], compute, history, rows=rows)
    grid = (sums.join(target, "symbol").withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
            .where(F.col("alpha") + F.col("beta") < limit))
    omega = F.col("v0") * (1 - (F.col("alpha") + F.col("beta")))
    decay = F.pow("beta", F.col("pos"))
    var = omega * (1 - decay) / (1 - F.col("beta")) + decay * F.col("v0") + F.col("alpha") * F.col("_s")
    ll = grid.withColumn("_v", var).groupBy("symbol", "alpha", "beta").agg(
        F.sum(-0.5 * (F.log("_v") + F.col("ret") * F.col("ret") / F.col("_v"))).alias("loglik"), F.max(omega).alias("omega"))
    best = F.max_by(F.struct("omega", "alpha", "beta", "loglik"), F.struct("loglik", -F.col("alpha"), -F.col("beta")))
    return ll.groupBy("symbol").agg(best.alias("b")).select("symbol", "b.*")


def correlation_factors(returns: DataFrame, factors: int = 2, max_symbols: int = 2000) -> DataFrame:
    """(symbol, factor, loading, idio_vol) from the leading components of the correlation matrix.

    The matrix of symbols is pivoted to one vector per row; its width is checked first.
    """
    names = [r[0] for r in returns.select("symbol").distinct().orderBy("symbol").limit(max_symbols + 1).collect()]
    if len(names) > max_symbols:
        raise ValueError(f"more than {max_symbols} symbols: the correlation matrix would not fit a task")
    moments = returns.groupBy("symbol").agg(F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("sd"))
    wide = (returns.join(moments, "symbol").withColumn("u", (F.col("ret") - F.col("_m")) / F.col("sd"))
            .groupBy("pos").pivot("symbol", names).agg(F.first("u")))
    vectors = wide.select("pos", array_to_vector(F.array(*[F.col(f"`{n}`") for n in names])).alias("v"))
    matrix = Correlation.corr(vectors, "v").head()[0].toArray()
    values, basis = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1][:factors]
    basis, values = basis[:, order], values[order]
    spark = returns.sparkSession
    table = spark.createDataFrame([(n, int(k), float(basis[i, k]), float(values[k])) for i, n in enumerate(names) for k in range(factors)],
                                  "symbol string, factor int, direction double, eigenvalue double")
    units = returns.join(moments, "symbol").withColumn("u", (F.col("ret") - F.col("_m")) / F.col("sd"))
    scores = units.join(table, "symbol").groupBy("pos", "factor").agg(
        (F.sum(F.col("u") * F.col("direction")) / F.sqrt(F.max("eigenvalue"))).alias("score"))
    # one row of scores per position and one of weights per symbol: the joins are on position and symbol, never on the factor
    by_pos = scores.groupBy("pos").agg(F.map_from_entries(F.collect_list(F.struct("factor", "score"))).alias("_scores"))
    by_symbol = table.groupBy("symbol").agg(F.collect_list(F.struct("factor", (F.col("direction") * F.sqrt("eigenvalue")).alias("w"))).alias("_w"))
    fitted = (units.select("symbol", "pos").join(by_pos, "pos").join(by_symbol, "symbol").select("symbol", "pos", F.aggregate(
        "_w", F.lit(0.0), lambda total, x: total + x["w"] * F.col("_scores")[x["factor"]]).alias("_f")))
    idio = (units.join(fitted, ["symbol", "pos"]).groupBy("symbol")
            .agg((F.stddev_pop(F.col("u") - F.col("_f")) * F.max("sd")).alias("idio_vol")))
    return (table.join(moments, "symbol").join(idio, "symbol")
            .select("symbol", "factor", (F.col("direction") * F.sqrt("eigenvalue") * F.col("sd")).alias("loading"), "eigenvalue", "idio_vol"))
