"""Target weights to returns: lagged accounting, self-financing value, spread costs, latches.

A target decided at row t fills at row t+1 and earns from row t+2.  At every fill the weights equal the
target, so each (scenario, segment between fills) is independent.  Inside a segment a holding is
``w * exp(level(t) - level(fill))`` with ``level`` the symbol's running log return, computed once per symbol
and not per scenario.  Scenarios meet the panel in one equi-join on (schedule, segment, symbol).
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .blocks import running_sum
from .rolling import per_symbol
from .speculation import speculated

Keys = Sequence[str]


def levels(panel: DataFrame, rows: int = 4096, on: Keys = ()) -> DataFrame:
    """Running log return per symbol (of each panel ``on``), total losses left out, and how many of those there were; a return below -1 is an error."""
    ret = F.when(F.col("ret") < -1, F.raise_error(F.lit("a return is below -1")).cast("double")).otherwise(F.col("ret"))
    return running_sum(panel.withColumn("ret", ret), [*on, "symbol"], ["pos"], F.floor(F.col("pos") / rows), {
        "level": F.when(F.col("ret") > -1, F.log1p(F.col("ret"))), "losses": (F.col("ret") <= -1).cast("double")})


def segments(decisions: DataFrame, panel: DataFrame, on: Keys = ()) -> DataFrame:
    """(on, schedule, seg, fill, stop, next_seg): rows fill+1..stop are earned with the target of ``seg``.

    ``decisions`` is (on, schedule, decision_pos); a decision on the last row of its panel never fills.
    """
    d = decisions.select(*on, "schedule", F.col("decision_pos").alias("seg")).distinct().withColumn("fill", F.col("seg") + 1)
    last = panel.groupBy(*on).agg(F.max("pos").alias("_last"))
    d = d.join(last, list(on)) if on else d.withColumn("_last", last.scalar())
    d = d.where(F.col("fill") <= F.col("_last"))
    w = Window.partitionBy(*on, "schedule").orderBy("seg")
    return (d.withColumn("next_seg", F.lead("seg").over(w))
            .withColumn("stop", F.coalesce(F.col("next_seg") + 1, F.col("_last")))
            .withColumn("is_first", F.row_number().over(w) == 1).drop("_last"))


def segment_rows(panel: DataFrame, segs: DataFrame, on: Keys = ()) -> DataFrame:
    """Panel rows per segment with growth since the fill: before (g0) and after (g1) the row's return; 0 from a total loss on."""
    spread = segs.select(*on, "schedule", "seg", "next_seg", "fill", "stop", F.explode(F.sequence("fill", "stop")).alias("pos"))
    rows = levels(panel, on=on).select(*on, "symbol", "pos", "ret", "level", "losses").join(spread, [*on, "pos"])
    start = rows.where(F.col("pos") == F.col("fill")).select(*on, "schedule", "seg", "symbol", F.col("level").alias("_l0"), F.col("losses").alias("_n0"))
    gone, now = F.col("losses") - F.col("_n0"), (F.col("ret") <= -1).cast("double")
    own = F.when(F.col("ret") > -1, F.log1p("ret")).otherwise(0.0)
    return (rows.where(F.col("pos") > F.col("fill")).join(start, [*on, "schedule", "seg", "symbol"])
            .withColumn("g1", F.when(gone > 0, 0.0).otherwise(F.exp(F.col("level") - F.col("_l0"))))
            .withColumn("g0", F.when(gone - now > 0, 0.0).otherwise(F.exp(F.col("level") - own - F.col("_l0"))))
            .select(*on, "schedule", "seg", "next_seg", "symbol", "pos", "stop", "ret", "g0", "g1"))


def _value_path(days: Column, borrow_rate: Column) -> Column:
    """Fold one segment's days into rows of (pos, value before, cash income, borrow, value after)."""
    def step(acc: Column, d: Column) -> Column:
        v = acc["value"]
        income = F.greatest(F.lit(0.0), v - d["gross0"]) * d["cash"]
        borrow = d["short0"] * borrow_rate
        after = v + d["pnl"] + income - borrow
        row = F.struct(d["pos"].alias("pos"), v.alias("before"), d["pnl"].alias("pnl"), income.alias("income"),
                       borrow.alias("borrow"), after.alias("after"), d["gross1"].alias("gross1"))
        return F.struct(F.when(after > 0, after).otherwise(v).alias("value"), F.array_append(acc["rows"], row).alias("rows"))
    empty = F.array().cast("array<struct<pos:bigint,before:double,pnl:double,income:double,borrow:double,"
                           "after:double,gross1:double>>")
    start = F.struct(F.lit(1.0).alias("value"), empty.alias("rows"))
    return F.aggregate(days, start, step, lambda acc: acc["rows"])


def cash_levels(cash: DataFrame, on: Keys = ()) -> DataFrame:
    return running_sum(cash.select(*on, "pos", "cash"), list(on), ["pos"], F.floor(F.col("pos") / 4096), {"cash_level": F.log1p("cash")})


def _long_path(daily: DataFrame, cash: DataFrame, on: Keys = ()) -> DataFrame:
    """Value rows of segments without shorts, in closed form: nothing is gathered, however long they are.

    The part not invested grows with cash; a negative one (gross above 1) earns and pays nothing.
    """
    level = stored(cash_levels(cash, on), "cash-levels")
    rows = (daily.join(level, [*on, "pos"]).withColumn("_f", F.col("seg") + 1)
            .join(level.select(*on, F.col("pos").alias("_f"), F.col("cash_level").alias("_c0")), [*on, "_f"]))
    rest, since = 1 - F.col("invested"), F.col("cash_level") - F.col("_c0")
    late = F.when(rest > 0, rest * F.exp(since)).otherwise(rest)
    early = F.when(rest > 0, rest * F.exp(since - F.log1p("cash"))).otherwise(rest)
    return rows.withColumns({"before": F.col("gross0") + early, "income": late - early, "borrow": F.lit(0.0),
                             "after": F.col("gross1") + late})


def _ruined_path(days: Column, weights: Column, borrow_rate: Column) -> Column:
    """Like :func:`_value_path`, symbol by symbol: on a day whose growth is not positive neither value nor holdings move."""
    def total(of: Column, each) -> Column:
        return F.aggregate(of, F.lit(0.0), lambda a, x: a + each(x))

    def step(acc: Column, d: Column) -> Column:
        v, h = acc["value"], acc["held"]
        pnl = total(F.zip_with(h, d["rets"], lambda x, r: x * r), lambda x: x)
        income = F.greatest(F.lit(0.0), v - total(h, F.abs)) * d["cash"]
        borrow = total(h, lambda x: F.when(x < 0, -x).otherwise(0.0)) * borrow_rate
        after = v + pnl + income - borrow
        held = F.when(after > 0, F.zip_with(h, d["rets"], lambda x, r: x * (1 + r))).otherwise(h)
        row = F.struct(d["pos"].alias("pos"), v.alias("before"), pnl.alias("pnl"), income.alias("income"), borrow.alias("borrow"),
                       after.alias("after"), total(held, F.abs).alias("gross1"), held.alias("held"))
        return F.struct(F.when(after > 0, after).otherwise(v).alias("value"), held.alias("held"), F.array_append(acc["rows"], row).alias("rows"))
    empty = F.array().cast("array<struct<pos:bigint,before:double,pnl:double,income:double,borrow:double,after:double,gross1:double,held:array<double>>>")
    return F.aggregate(days, F.struct(F.lit(1.0).alias("value"), weights.alias("held"), empty.alias("rows")), step, lambda acc: acc["rows"])


def lagged_returns(panel: DataFrame, cash: DataFrame, targets: DataFrame, costs: DataFrame, cost_bp: DataFrame | None = None,
                   keys: Keys = ("scenario",), default_bp: float = 3.0, on: Keys = ()) -> DataFrame:
    """Daily net return and its parts for many scenarios and cost settings in one job.

    ``panel`` (symbol, pos, ret), ``cash`` (pos, cash), ``targets`` (keys, schedule, decision_pos, symbol,
    weight) with every decision present, ``costs`` (cost_mult, borrow_bp), ``cost_bp`` (symbol, bp).  Gross
    profit, idle cash and borrow come from yesterday's weights; a fill's cost is charged on the distance from
    the drifted weights.  Only segments holding shorts are folded day by day: their idle cash depends on the
    value path.  ``broke`` marks rows whose growth is not positive; weights are not drifted there, so segments with such
    a row are folded again, symbol by symbol; in them every symbol needs a row on every day.  A return of -1 ends a holding until the next fill.

    ``on`` names the columns of ``keys`` that tell panels apart: ``panel``, ``cash`` and ``targets`` carry them, each panel has positions
    and a calendar of its own, and all of them are computed at once.
    """
    keys, on = list(keys), list(on)
    pos = [*on, "pos"]
    bk = [*keys, "cost_mult", "borrow_bp"]
    segs = stored(segments(targets, panel, on), "segments")
    rows = stored(segment_rows(panel, segs, on), "segment-rows")
    wanted = (targets.withColumnRenamed("decision_pos", "seg")
              .join(segs.select(*on, "schedule", "seg", "is_first"), [*on, "schedule", "seg"]))
    w = F.col("weight")
    daily = stored(wanted.join(rows, [*on, "schedule", "seg", "symbol"])
             .groupBy(*keys, "schedule", "seg", "next_seg", "stop", "pos").agg(
                 F.sum(w * F.col("g0") * F.col("ret")).alias("pnl"), F.sum(F.abs(w) * F.col("g0")).alias("gross0"),
                 F.sum(F.when(w < 0, -w * F.col("g0")).otherwise(0.0)).alias("short0"),
                 F.sum(F.abs(w) * F.col("g1")).alias("gross1"), F.sum(w).alias("invested"), (F.min(w) < 0).alias("shorts")), "book-days")
    packed = (daily.where("shorts").join(cash.select(*pos, "cash"), pos).groupBy(*keys, "schedule", "seg", "next_seg", "stop")
              .agg(F.sort_array(F.collect_list(F.struct("pos", "pnl", "gross0", "short0", "gross1", "cash"))).alias("days")))
    grid = costs.select(F.collect_list(F.struct("cost_mult", "borrow_bp"))).scalar()
    path = (packed.withColumn("_c", F.explode(grid)).select("*", "_c.*")
            .withColumn("_r", F.explode(_value_path(F.col("days"), F.col("borrow_bp") / 10_000 / 252 * F.col("cost_mult"))))
            .select(*bk, "schedule", "seg", "next_seg", "stop", "_r.*"))
    path = stored(path.unionByName(_long_path(daily.where("not shorts"), cash, on).withColumn("_c", F.explode(grid))
                                   .select("*", "_c.*").select(*path.columns)), "value-path")
    # yesterday's book at each fill: holdings grown over the finished segment, per unit of its closing value
    closing = rows.where((F.col("pos") == F.col("stop")) & F.col("next_seg").isNotNull())
    drifted = (wanted.join(closing.select(*on, "schedule", "seg", "symbol", "next_seg", "g1"), [*on, "schedule", "seg", "symbol"])
               .select(*keys, "schedule", "seg", "next_seg", "symbol", (w * F.col("g1")).alias("_h")))
    ruined = stored(path.where("after <= 0").select(*bk, "schedule", "seg").distinct(), "ruined")
    by = keys
    if not ruined.isEmpty():
        again = (wanted.drop("is_first").join(rows, [*on, "schedule", "seg", "symbol"]).join(ruined, [*keys, "schedule", "seg"])
                 .groupBy(*bk, "schedule", "seg", "next_seg", "stop", "pos").agg(F.array_sort(F.collect_list(F.struct("symbol", "weight", "ret"))).alias("_x"))
                 .join(cash.select(*pos, "cash"), pos).groupBy(*bk, "schedule", "seg", "next_seg", "stop")
                 .agg(F.array_sort(F.collect_list(F.struct("pos", "cash", F.col("_x.ret").alias("rets")))).alias("_days"),
                      F.min_by("_x.symbol", "pos").alias("_names"), F.min_by("_x.weight", "pos").alias("_weights")))
        again = stored(again.withColumn("_r", F.explode(_ruined_path(F.col("_days"), F.col("_weights"), F.col("borrow_bp") / 10_000 / 252 * F.col("cost_mult"))))
                       .select(*bk, "schedule", "seg", "next_seg", "stop", "_names", "_r.*"), "ruined-path")
        path = path.join(ruined, [*bk, "schedule", "seg"], "left_anti").unionByName(again.select(*path.columns))
        ends = again.where((F.col("pos") == F.col("stop")) & F.col("next_seg").isNotNull()).select(
            *bk, "schedule", "seg", "next_seg", F.explode(F.arrays_zip("_names", "held")).alias("_e"))
        drifted = (drifted.withColumn("_c", F.explode(grid)).select("*", "_c.*").join(ruined, [*bk, "schedule", "seg"], "left_anti").drop("_c")
                   .unionByName(ends.select(*bk, "schedule", "seg", "next_seg", F.col("_e._names").alias("symbol"), F.col("_e.held").alias("_h"))))
        wanted = wanted.withColumn("_c", F.explode(grid)).select("*", "_c.*").drop("_c")
        by = bk
    drifted = drifted.drop("seg").withColumnRenamed("next_seg", "seg")
    kept = F.when(F.col("after") > 0, F.col("after")).otherwise(F.col("before"))
    worth = (path.where((F.col("pos") == F.col("stop")) & F.col("next_seg").isNotNull())
             .select(*bk, "schedule", F.col("next_seg").alias("seg"), kept.alias("_end"), F.lit(False).alias("is_first")))
    opening = (wanted.where("is_first").select(*keys, "schedule", "seg").distinct().withColumn("_c", F.explode(grid))
               .select(*keys, "_c.*", "schedule", "seg", F.lit(1.0).alias("_end"), F.lit(True).alias("is_first")))
    moves = wanted.drop("is_first").join(drifted, [*by, "schedule", "seg", "symbol"], "full")
    bp = F.lit(default_bp)
    if cost_bp is not None:
        moves, bp = moves.join(cost_bp, "symbol", "left"), F.coalesce(F.col("bp"), F.lit(default_bp))
    delta = F.coalesce("weight", F.lit(0.0)) - F.coalesce("_h", F.lit(0.0)) / F.col("_end")
    trades = (moves.join(worth.unionByName(opening), [*by, "schedule", "seg"]).groupBy(*bk, "seg", "is_first")
              .agg((F.sum(F.abs(delta) * bp) / 10_000 * F.max("cost_mult")).alias("trade_cost"),
                   F.sum(F.abs(delta)).alias("turnover"))
              .withColumn("pos", F.col("seg") + 1).drop("seg"))
    zero = F.lit(0.0)
    body = path.select(*bk, "pos", (F.col("pnl") / F.col("before")).alias("gross_pnl"),
                       (F.col("income") / F.col("before")).alias("cash_pnl"),
                       (F.col("borrow") / F.col("before")).alias("borrow_cost"),
                       (F.col("after") / F.col("before")).alias("growth"),
                       (F.col("gross1") / kept).alias("gross_exposure"), "before")
    head = (trades.where("is_first").join(cash.select(*pos, "cash"), pos)
            .select(*bk, "pos", zero.alias("gross_pnl"), F.col("cash").alias("cash_pnl"), zero.alias("borrow_cost"),
                    (1 + F.col("cash")).alias("growth"), zero.alias("gross_exposure"), F.lit(1.0).alias("before")))
    out = body.unionByName(head).join(trades.select(*bk, "pos", "trade_cost", "turnover"), [*bk, "pos"], "left")
    out = out.na.fill(0.0, ["trade_cost", "turnover"])
    return (out.withColumn("net", F.col("gross_pnl") + F.col("cash_pnl") - F.col("trade_cost") - F.col("borrow_cost"))
            .withColumn("broke", F.col("growth") <= 0))


def book_totals(daily: DataFrame, keys: Keys) -> DataFrame:
    """Turnover, rebalances, largest gross and cost sums per scenario."""
    return daily.groupBy(*keys).agg(
        F.sum("turnover").alias("total_turnover"), F.count_if(F.col("turnover") > 0).alias("n_rebalances"),
        F.max("gross_exposure").alias("max_daily_gross"), F.sum("trade_cost").alias("trade_cost_sum"),
        F.sum("borrow_cost").alias("borrow_cost_sum"))


def contributions(panel: DataFrame, targets: DataFrame, daily: DataFrame, keys: Keys = ("scenario",)) -> DataFrame:
    """Sum of yesterday's weight times today's return per symbol; ``daily`` of one cost setting."""
    keys = list(keys)
    segs = segments(targets, panel)
    held = targets.withColumnRenamed("decision_pos", "seg").join(segment_rows(panel, segs), ["schedule", "seg", "symbol"])
    return (held.join(daily.select(*keys, "pos", "before"), [*keys, "pos"]).groupBy(*keys, "symbol")
            .agg(F.sum(F.col("weight") * F.col("g0") * F.col("ret") / F.col("before")).alias("contribution")))


def _post_fee(growth: Column, pairs: Column, rate: Column) -> Column:
    """Value x after fees, the root of x + rate * sum|target * x - holding| = growth.

    The left side is piecewise linear and rises with x, as the targets sum to at most 1 and the rate is below 1.  Its kinks are
    at holding / target.  Kinks at or below the root are passed in order, with the sums of their targets and holdings; the piece
    after the last of them holds the root.
    """
    kinks = F.array_sort(F.transform(F.filter(pairs, lambda p: p["t"] > 0), lambda p: F.struct(
        (p["h"] / p["t"]).alias("at"), p["t"].alias("t"), p["h"].alias("h"))))
    zero = F.lit(0.0)
    all_t = F.aggregate(pairs, zero, lambda a, p: a + p["t"])
    all_h = F.aggregate(pairs, zero, lambda a, p: a + p["h"])

    def slope(passed: Column) -> Column:
        return 1 + rate * (2 * passed["t"] - all_t)

    def rest(passed: Column) -> Column:
        return growth - rate * (all_h - 2 * passed["h"])

    def step(passed: Column, kink: Column) -> Column:
        below = kink["at"] * slope(passed) <= rest(passed)
        return F.struct(F.when(below, passed["t"] + kink["t"]).otherwise(passed["t"]).alias("t"),
                        F.when(below, passed["h"] + kink["h"]).otherwise(passed["h"]).alias("h"))

    return F.aggregate(kinks, F.struct(zero.alias("t"), zero.alias("h")), step, lambda s: rest(s) / slope(s))


def _refused(name: str, note: str) -> Column:
    value = F.col(name).cast("double")
    return F.when((value <= -1) | F.isnan(value), F.raise_error(F.lit(note)).cast("double")).otherwise(value)


def self_financing(panel: DataFrame, cash: DataFrame, targets: DataFrame, cost_bps: Sequence[float],
                   keys: Keys = ("scenario",)) -> DataFrame:
    """Long/cash value with fees paid out of the book: net, cost, turnover and gross per row.

    Targets are not negative and sum to at most 1; weights refer to the value after fees.  Between fills the
    value is in closed form: holdings grow with their symbol, the rest with cash.  Returns and cash rates of -1 or less and
    costs outside [0, 10000) are errors.
    """
    keys = list(keys)
    if not all(0 <= b < 10_000 for b in cost_bps):
        raise ValueError("costs must be at least 0 and below 10000 basis points")
    panel = panel.withColumn("ret", _refused("ret", "a return is -1 or less, or no number"))
    cash = cash.withColumn("cash", _refused("cash", "a cash rate is -1 or less, or no number"))
    bad = targets.groupBy(*keys, "schedule", "decision_pos").agg(F.min("weight").alias("_m"), F.sum("weight").alias("_s"))
    ok = bad.withColumn("invested", F.when((F.col("_m") < 0) | (F.col("_s") > 1 + 1e-10), F.raise_error(
        F.lit("targets must be long-only and sum to at most 1")).cast("double")).otherwise(F.col("_s"))).drop("_m", "_s")
    cash_level = cash_levels(cash)
    segs = segments(targets, panel)
    rows = stored(segment_rows(panel, segs), "segment-rows")
    held = targets.withColumnRenamed("decision_pos", "seg").join(rows, ["schedule", "seg", "symbol"])
    w = F.col("weight")
    sums = held.groupBy(*keys, "schedule", "seg", "pos").agg(
        F.sum(w * F.col("g0")).alias("_h0"), F.sum(w * F.col("g1")).alias("_h1"))
    start = cash_level.select(F.col("pos").alias("fill"), F.col("cash_level").alias("_c0"))
    rest = F.greatest(F.lit(0.0), 1 - F.col("invested"))
    since = F.col("cash_level") - F.col("_c0")
    value = (sums.join(segs.select("schedule", "seg", "fill", "next_seg", "stop"), ["schedule", "seg"]).join(start, "fill")
             .join(cash_level, "pos").join(ok.withColumnRenamed("decision_pos", "seg"), [*keys, "schedule", "seg"])
             .withColumn("_v0", F.col("_h0") + rest * F.exp(since - F.log1p("cash")))
             .withColumn("_v1", F.col("_h1") + rest * F.exp(since)))
    value = stored(value, "value")
    quiet = value.where((F.col("pos") < F.col("stop")) | F.col("next_seg").isNull()).select(
        *keys, "pos", (F.col("_v1") / F.col("_v0")).alias("growth"), (F.col("_h1") / F.col("_v1")).alias("gross"))
    before = (targets.join(segs.where("is_first").select("schedule", F.col("fill").alias("_first")), "schedule")
              .groupBy(*keys, "schedule").agg(F.max("_first").alias("_first")))
    head = before.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), "_first"))).join(cash.select("pos", "cash"), "pos")
    quiet = quiet.unionByName(head.where(F.col("pos") < F.col("_first")).select(
        *keys, "pos", (1 + F.col("cash")).alias("growth"), F.lit(0.0).alias("gross")))
    wanted = (targets.withColumnRenamed("decision_pos", "seg").join(segs.select("schedule", "seg"), ["schedule", "seg"], "left_semi")
              .select(*keys, "schedule", "seg", "symbol", w.alias("t")))
    closing = value.where((F.col("pos") == F.col("stop")) & F.col("next_seg").isNotNull())
    ends = (held.select(*keys, "schedule", "seg", "symbol", "pos", (w * F.col("g1")).alias("_h"))
            .join(closing.select(*keys, "schedule", "seg", "pos", "_v0", F.col("next_seg").alias("_next")), [*keys, "schedule", "seg", "pos"])
            .select(*keys, "schedule", F.col("_next").alias("seg"), "symbol", (F.col("_h") / F.col("_v0")).alias("h")))
    pairs = (wanted.join(ends, [*keys, "schedule", "seg", "symbol"], "full").groupBy(*keys, "schedule", "seg")
             .agg(F.collect_list(F.struct(F.coalesce("t", F.lit(0.0)).alias("t"), F.coalesce("h", F.lit(0.0)).alias("h"))).alias("pairs"),
                  F.sum(F.coalesce("t", F.lit(0.0))).alias("gross")))
    growth_at = (closing.select(*keys, "schedule", F.col("next_seg").alias("seg"), "pos", (F.col("_v1") / F.col("_v0")).alias("growth"))
                 .unionByName(head.where(F.col("pos") == F.col("_first")).select(
                     *keys, "schedule", (F.col("pos") - 1).alias("seg"), "pos", (1 + F.col("cash")).alias("growth"))))
    fills = pairs.join(growth_at, [*keys, "schedule", "seg"])
    each = F.explode(F.array(*[F.lit(float(b)) for b in cost_bps]))
    fills = (fills.withColumn("cost_bp", each)
             .withColumn("_x", _post_fee(F.col("growth"), F.col("pairs"), F.col("cost_bp") / 10_000))
             .withColumn("turnover", F.aggregate("pairs", F.lit(0.0), lambda a, p: a + F.abs(p["t"] * F.col("_x") - p["h"])))
             .select(*keys, "cost_bp", "pos", "growth", "gross", (F.col("growth") - F.col("_x")).alias("cost"), "turnover"))
    quiet = quiet.withColumn("cost_bp", each).withColumn("cost", F.lit(0.0)).withColumn("turnover", F.lit(0.0))
    return fills.unionByName(quiet.select(*fills.columns)).withColumn("net", F.col("growth") - F.col("cost") - 1)


def spread_cost_pnl(positions: DataFrame, slippage_bp: float = 0.0) -> DataFrame:
    """Return of a given position series marked at mid, paying half the spread on each change."""
    def cols(w) -> dict[str, Column]:
        before = F.coalesce(F.lag("position").over(w), F.lit(0.0))
        mid = (F.col("bid") + F.col("ask")) / 2
        move = F.coalesce(mid / F.lag(mid).over(w) - 1, F.lit(0.0))
        cost = F.abs(F.col("position") - before) * ((F.col("ask") - F.col("bid")) / 2 / mid + slippage_bp / 1e4)
        return {"position_delta": F.col("position") - before, "slippage_cost": cost, "realized_return": before * move - cost}
    return per_symbol(positions, cols, 1)


class DeadBand:
    """Keep the executed weight until the target is at least ``threshold`` away from it; a NaN target is taken over and comes out as NULL."""

    outputs = "executed double"

    def __init__(self, threshold: float = 0.05):
        self.threshold, self.start = threshold, [0.0]

    def run(self, state: list[float], rows: pd.DataFrame) -> tuple[list[float], dict[str, list]]:
        held, out = state[0], []
        for target in rows["weight"].tolist():
            if not abs(target - held) < self.threshold:
                held = target
            out.append(held)
        return [held], {"executed": out}


def dead_band(weights: DataFrame, threshold: float = 0.05, keys: Keys = ("symbol",), pos: str = "pos", **blocks) -> DataFrame:
    """Executed weight per row, from position to position; ``blocks`` goes to ``speculated``."""
    return speculated(weights, keys, DeadBand(threshold), pos, **blocks)


class Overlay:
    """A raw target behind a rest after losses, a volatility gate, a dead band and a step limit, fed by its own returns.

    The state is (position, last mid price or NaN, rows of rest left, newest returns ...).  A step that can reach its goal lands on
    it exactly, so that two runs that start apart meet.
    """

    outputs = "position double, realized_return double"

    def __init__(self, max_step: float = 0.3, max_sigma: float | None = None, loss_limit: float = -0.05, lookback: int = 20,
                 cooldown: int = 10, threshold: float = 0.0, slippage_bp: float = 0.0):
        self.max_step, self.threshold, self.slippage = max_step, threshold, slippage_bp / 1e4
        self.max_sigma = math.inf if max_sigma is None else max_sigma
        self.loss_limit, self.lookback, self.cooldown = loss_limit, lookback, cooldown
        self.start = [0.0, math.nan, 0.0]

    def wanted(self, position: float, target: float, sigma: float) -> float:
        goal = 0.0 if sigma > self.max_sigma else target
        gap = goal - position
        if abs(gap) < self.threshold:
            return position
        return position + math.copysign(self.max_step, gap) if abs(gap) > self.max_step else goal

    def run(self, state: list[float], rows: pd.DataFrame) -> tuple[list[float], dict[str, list]]:
        position, last, rest, recent = state[0], state[1], int(state[2]), deque(state[3:], maxlen=self.lookback)
        positions, gains = [], []
        for target, sigma, bid, ask in rows[["target", "sigma", "bid", "ask"]].itertuples(index=False, name=None):
            new = 0.0 if rest > 0 else self.wanted(position, target, sigma)
            rest = max(rest - 1, 0)
            mid = (bid + ask) / 2
            moved = 0.0 if math.isnan(last) else position * (mid - last) / last
            gain = moved - abs(new - position) * ((ask - bid) / 2 / mid + self.slippage)
            recent.append(gain)
            if rest == 0 and sum(recent) <= self.loss_limit:
                rest = self.cooldown
                recent.clear()
            position, last = new, mid
            positions.append(new)
            gains.append(gain)
        return [position, last, float(rest), *recent], {"position": positions, "realized_return": gains}


def risk_overlay(rows: DataFrame, keys: Keys = ("symbol",), pos: str = "pos", blocks: dict | None = None, **limits) -> DataFrame:
    """Position and realised return per row from (target, sigma, bid, ask); ``blocks`` goes to ``speculated``."""
    return speculated(rows, keys, Overlay(**limits), pos, **(blocks or {}))
