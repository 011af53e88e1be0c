"""Bootstrap and permutation inference over many scenarios at once.

Draws depend on (seed, length, block length, replicate, position) only, never on the scenario: all
scenarios of one length share the same resamples.  A replicate is one row holding its picked indices, a scenario
one row holding its periods (a bounded number of months or days); they meet in an equi-join on length and salt,
and a resampled mean is a sum inside the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import digest, uniform, unit_draw

Keys = Sequence[str]


def indexed(months: DataFrame, keys: Keys, order: str = "month") -> DataFrame:
    """Number each scenario's periods from zero and add their count.  One row per period."""
    w = Window.partitionBy(*keys)
    return (months.withColumn("i", F.row_number().over(w.orderBy(order)) - 1)
            .withColumn("n", F.count(F.lit(1)).over(w)))


SALTS = 32
#: Tasks of a resampling.  Its inputs are small however large the replicates are that a task makes of them, so their size must not set it.
PARTS = 64


def _arrays(v: DataFrame, keys: list[str], columns: Keys) -> DataFrame:
    """One row per scenario with its periods in order, copied once per salt so that no length is a hot key."""
    packed = v.groupBy(*keys, "n").agg(F.sort_array(F.collect_list(F.struct("i", *columns))).alias("_v"))
    return packed.select(*keys, "n", *[F.col(f"_v.{c}").alias(c) for c in columns]).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).repartition(PARTS, "n", "salt")


def _replicates(v: DataFrame, count: int) -> DataFrame:
    """(n, b, salt) for every scenario length, where the scenarios of that length and salt are: replicates are made there and stay there."""
    return (v.select("n").distinct().withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(count))))
            .withColumn("salt", F.col("b") % SALTS).repartition(PARTS, "n", "salt"))


def _rows(n: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), n - 1)


def stationary_draws(replicates: DataFrame, block_lens: Sequence[float], seed: int) -> DataFrame:
    """(n, b, salt, which, picks): the resampled indices of replicate b for the block length ``which``.

    A step restarts at a uniform index with probability 1/block length, else moves to the successor with
    wrap-around.  The picks of a replicate are the runs between its restarts, laid end to end inside its row.
    """
    lens = F.array(*[F.lit(float(x)) for x in block_lens])
    n = F.col("n")
    drawn = replicates.withColumn("_d", F.transform(_rows(n), lambda i: digest(F.lit(seed), F.col("b"), i))).withColumn(
        "which", F.explode(F.sequence(F.lit(0), F.lit(len(block_lens) - 1))))

    def restart(d: Column, i: Column) -> Column:
        return F.when((i == 0) | (unit_draw(d, 0) < 1 / lens[F.col("which")]), F.struct(i.alias("at"), F.floor(unit_draw(d, 1) * n).alias("pick")))

    def runs(starts: Column) -> Column:
        def run(s: Column, k: Column) -> Column:
            stop = F.coalesce(F.get(starts, k + 1)["at"].cast("long"), n)
            return F.transform(F.sequence(F.lit(0).cast("long"), stop - s["at"] - 1), lambda j: ((s["pick"] + j) % n).cast("int"))
        return F.flatten(F.transform(starts, run))

    starts = F.filter(F.transform("_d", restart), lambda s: s.isNotNull())
    return drawn.select("n", "b", "which", "salt", F.transform(F.array(starts), runs)[0].alias("picks"))


#: Resampled means within this of zero are zero up to rounding, whatever order they were summed in; they count as not above it.
ZERO = 1e-12


def _total(picks: str, values: str) -> Column:
    return F.aggregate(picks, F.lit(0.0), lambda a, j: a + F.col(values)[j])


def stationary_bootstrap(months: DataFrame, keys: Keys = ("scenario",), block_lens: Sequence[float] = (6.0,),
                         n_boot: int = 10_000, seed: int = 0, value: str = "log_ret", order: str = "month") -> DataFrame:
    """Annualised geometric return from monthly logs with percentile bounds and a one-sided p-value."""
    keys = list(keys)
    v = indexed(months.select(*keys, order, value), keys, order)
    draws = stationary_draws(_replicates(v, n_boot), block_lens, seed)
    ann = (draws.hint("merge").join(_arrays(v, keys, [value]), ["n", "salt"])
           .select(*keys, "which", (F.exp(12 * _total("picks", value) / F.col("n")) - 1).alias("_ann")))
    lens = F.array(*[F.lit(float(x)) for x in block_lens])
    boot = ann.groupBy(*keys, "which").agg(
        F.percentile("_ann", F.array(F.lit(0.05), F.lit(0.025), F.lit(0.975))).alias("_p"),
        ((F.count_if(F.col("_ann") <= ZERO) + 1) / (F.count(F.lit(1)) + 1)).alias("p_leq_zero"))
    boot = boot.select(*keys, lens[F.col("which")].alias("block_len"), "p_leq_zero", F.col("_p")[0].alias("ann_lower_95"),
                       F.col("_p")[1].alias("ci_low_95"), F.col("_p")[2].alias("ci_high_95"))
    point = v.groupBy(*keys).agg(F.avg(value).alias("mean_monthly"), F.count(F.lit(1)).alias("n_months"))
    return (boot.join(point, keys)
            .withColumn("ann_geom", F.exp(12 * F.col("mean_monthly")) - 1))


def sign_flip(periods: DataFrame, keys: Keys = ("scenario",), n_perm: int = 10_000, seed: int = 0,
              value: str = "log_ret", order: str = "month", plus_one: bool = True) -> DataFrame:
    """Two-sided and one-sided sign-flip p-values of a mean.

    ``plus_one`` counts the observed statistic as one of the permutations.
    """
    keys = list(keys)
    v = indexed(periods.select(*keys, order, value), keys, order)
    b = F.col("b")
    signs = _replicates(v, n_perm).withColumn("signs", F.transform(_rows(F.col("n")), lambda i: F.when(
        uniform(F.lit(seed), b, i, F.lit("sign")) < 0.5, -1.0).otherwise(1.0)))
    point = v.groupBy(*keys).agg(F.avg(value).alias("observed"), F.count(F.lit(1)).alias("n_periods"))
    flipped = F.aggregate(F.zip_with("signs", value, lambda s, x: s * x), F.lit(0.0), lambda a, x: a + x) / F.col("n")
    means = (signs.hint("merge").join(_arrays(v, keys, [value]), ["n", "salt"]).select(*keys, flipped.alias("_m")).join(point, keys))
    add = 1 if plus_one else 0
    # permuted sums that equal the observed one up to rounding count as reaching it
    slack = 1e-12 * F.abs("observed")
    return means.groupBy(*keys).agg(
        F.max("observed").alias("observed"), F.max("n_periods").alias("n_periods"),
        ((F.count_if(F.abs("_m") >= F.abs("observed") - slack) + add) / (F.count(F.lit(1)) + add)).alias("p_two_sided"),
        ((F.count_if(F.col("_m") >= F.col("observed") - slack) + add) / (F.count(F.lit(1)) + add)).alias("p_greater_zero"))


def day_blocks(values: DataFrame, keys: Keys = ("variant",), value: str = "ic") -> DataFrame:
    return (values.where(F.col(value).isNotNull()).groupBy(*keys, F.to_date("ts").alias("day"))
            .agg(F.sum(value).alias("_sum"), F.count(value).alias("_cnt"), F.avg(value).alias("day_mean")))


def day_bootstrap(values: DataFrame, keys: Keys = ("variant",), n_boot: int = 2000, seed: int = 0,
                  value: str = "ic") -> DataFrame:
    """Mean over resampled whole days (pooled rows, not the mean of day means), without +1 in p."""
    keys = list(keys)
    v = indexed(day_blocks(values, keys, value), keys, "day")
    b, n = F.col("b"), F.col("n")
    draws = _replicates(v, n_boot).withColumn("picks", F.transform(_rows(n), lambda k: F.floor(
        uniform(F.lit(seed), b, k, F.lit("day")) * n).cast("int")))
    means = (draws.hint("merge").join(_arrays(v, keys, ["_sum", "_cnt"]), ["n", "salt"])
             .select(*keys, (_total("picks", "_sum") / _total("picks", "_cnt")).alias("_m")))
    boot = means.groupBy(*keys).agg(
        F.percentile("_m", F.lit(0.025)).alias("ci_low_95"), F.percentile("_m", F.lit(0.975)).alias("ci_high_95"),
        F.avg((F.col("_m") <= ZERO).cast("double")).alias("p_leq_zero"))
    point = v.groupBy(*keys).agg((F.sum("_sum") / F.sum("_cnt")).alias("mean"), F.count(F.lit(1)).alias("n_days"))
    return boot.join(point, keys)


def day_sign_flip(values: DataFrame, keys: Keys = ("variant",), n_perm: int = 2000, seed: int = 0,
                  value: str = "ic") -> DataFrame:
    return sign_flip(day_blocks(values, keys, value), keys, n_perm, seed, "day_mean", "day", plus_one=False)
