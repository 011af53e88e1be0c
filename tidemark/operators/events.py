"""Bar indicators, pullback events, their features, triple-barrier labels and signal persistence."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.quality import bar_tradeable, bar_usable
from .blocks import carried_last, in_blocks
from .calendars import month_ends

WARMUP, SEQUENCE = 260, 60
CONFIRM_BARS, COOLDOWN_BARS, TOUCH_BAND = 3, 10, 0.25
HOLD_BARS, TARGET_MULTIPLE = 10, 1.5


def run_lengths(bars: DataFrame, valid: Column, rows: int = 4096) -> DataFrame:
    """``valid`` and ``run_length``: consecutive valid rows up to here, 0 on an invalid row."""
    df = bars.withColumn("valid", valid)
    df = carried_last(df, ["symbol"], ["pos"], F.floor(F.col("pos") / rows),
                      F.when(~F.col("valid"), F.col("pos")), "_broken")
    return df.withColumn("run_length", F.col("pos") - F.coalesce("_broken", F.lit(-1))).drop("_broken")


def _seeded_ema(n: int, w, centre: Column) -> Column:
    """EMA seeded with the mean of the run's first ``n`` closes.

    A seed close carries weight 1/n and decays from the seed's end; later closes carry alpha.
    """
    alpha = 2 / (n + 1)
    g = F.lit(1 - alpha)
    k = F.col("run_length") - 1
    seed_end = F.col("pos") - k + n - 1
    term = F.when(k < n, F.col("close") / n * F.pow(g, centre - seed_end)).otherwise(
        alpha * F.col("close") * F.pow(g, centre - F.col("pos")))
    total = F.sum(term).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(F.col("run_length") >= n, total * F.pow(g, F.col("pos") - centre))


def indicators(bars: DataFrame, rows: int = 6000) -> DataFrame:
    """ATR20 (plain mean), sigma5/20, efficiency ratio, seeded EMAs 20/50/200 and the uptrend flag.

    Every value starts anew after an invalid bar.  Blocks reach 3,900 rows back, where the slowest EMA's
    weight is below 1e-16.
    """
    history = 3900

    def compute(d: DataFrame, _) -> DataFrame:
        d = d.withColumn("_run", F.when(F.col("valid"), F.col("pos") - F.col("run_length")))
        w = Window.partitionBy("symbol", "_block", "_run").orderBy("pos")
        n, c = F.col("run_length"), F.col("close")
        prev = F.lag("close").over(w)
        some = F.when(F.col("valid") & (n >= 2), True)
        d = d.withColumn("logret", F.when(some, F.log(c / prev))).withColumn("_move", F.when(some, F.abs(c - prev)))
        d = d.withColumn("tr", F.when(some, F.greatest(
            F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))))
        f5, f20 = w.rowsBetween(-4, 0), w.rowsBetween(-19, 0)
        centre = (F.col("_block") + 0.5) * max(rows, history) - history / 2
        ok = F.col("valid")
        d = d.withColumns({
            "atr20": F.when(ok & (n >= 21), F.avg("tr").over(f20)),
            "sigma5": F.when(ok & (n >= 6), F.stddev_samp("logret").over(f5)),
            "sigma20": F.when(ok & (n >= 21), F.stddev_samp("logret").over(f20)),
            "er20": F.when(ok & (n >= 21), F.try_divide(F.abs(c - F.lag("close", 20).over(w)), F.sum("_move").over(f20))),
            **{f"ema{m}": F.when(ok, _seeded_ema(m, w, centre)) for m in (20, 50, 200)}})
        before = F.lag("ema50", 10).over(w)
        d = d.withColumn("up", F.coalesce(
            (F.col("ema50") > F.col("ema200")) & (F.col("ema50") > before) & (c > F.col("ema50")), F.lit(False)))
        lagged = {f"{x}_1": F.lag(x).over(w) for x in ("close", "high", "atr20", "sigma5", "sigma20", "ema20", "ema50", "up")}
        d = d.withColumns({**lagged, "ema50_11": F.lag("ema50", 11).over(w), "close_5": F.lag("close", 5).over(w),
                           "close_20": F.lag("close", 20).over(w), "high_20": F.max("high").over(w.rowsBetween(-20, -1)),
                           "lows": F.array(*[F.lag("low", i).over(w) if i else F.col("low") for i in range(CONFIRM_BARS + 1)])})
        return d.drop("_run", "_move")

    return in_blocks(run_lengths(bars, bar_usable()), ["symbol"], compute, history, rows=rows)


def setup_flags(ind: DataFrame) -> DataFrame:
    """Row predicates of the event rule, packed as bits: 1 usable, 2 touch, 4 confirm, 8 broken."""
    usable = (F.col("valid") & (F.col("run_length") >= WARMUP) & F.col("atr20_1").isNotNull()
              & F.col("ema20_1").isNotNull() & F.col("ema50_1").isNotNull())
    band = TOUCH_BAND * F.col("atr20_1")
    touch = (F.col("up_1") & (F.col("close_1") > F.col("ema20_1")) & (F.col("close") < F.col("close_1"))
             & (F.col("low") <= F.col("ema20_1") + band) & (F.col("high") >= F.col("ema20_1") - band)
             & (F.col("close") > F.col("ema50_1")))
    confirm = F.col("up") & (F.col("close") > F.col("high_1"))
    broken = F.col("close") <= F.col("ema50_1")
    bits = [(usable, 1), (touch, 2), (confirm, 4), (broken, 8)]
    return ind.withColumn("flags", sum((F.when(F.coalesce(b, F.lit(False)), v).otherwise(0) for b, v in bits), F.lit(0)))


# States of the event rule before a row: 0 idle, 1-3 rows since the touch, 3 + r with r blocked rows left.
_BLOCKED = CONFIRM_BARS + COOLDOWN_BARS


def _has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def _fires(state: Column, flags: Column) -> Column:
    return state.between(1, CONFIRM_BARS) & _has(flags, 1) & ~_has(flags, 8) & _has(flags, 4)


def _next_state(state: Column, flags: Column) -> Column:
    waiting = state.between(1, CONFIRM_BARS)
    return (F.when(state > CONFIRM_BARS, F.when(state == CONFIRM_BARS + 1, 0).otherwise(state - 1))
            .when(~_has(flags, 1), 0)
            .when(_fires(state, flags), _BLOCKED)
            .when(waiting & (_has(flags, 8) | (state == CONFIRM_BARS)), 0)
            .when(waiting, state + 1)
            .when(_has(flags, 2), 1).otherwise(0))


def pullback_events(flagged: DataFrame, rows: int = 2048) -> DataFrame:
    """(symbol, t, setup_start) of confirmed pullbacks.

    The rule has 14 states, so a block of rows is a map from entry state to exit state.  Blocks are mapped in
    parallel, the maps are chained per symbol, and each block is then replayed from its true entry state.
    """
    block = F.floor(F.col("pos") / rows)
    packed = (flagged.select("symbol", "pos", "flags").groupBy("symbol", block.alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct("pos", "flags"))).alias("rows")))
    identity = F.array(*[F.lit(s) for s in range(_BLOCKED + 1)])
    mapped = packed.withColumn("exit", F.aggregate(
        "rows", identity, lambda m, r: F.transform(m, lambda s: _next_state(s, r["flags"]))))
    chain = (mapped.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("block", "exit"))).alias("blocks"))
             .withColumn("entries", F.aggregate(
                 "blocks", F.struct(F.lit(0).alias("s"), F.array().cast("array<struct<block:bigint,state:int>>").alias("out")),
                 lambda a, b: F.struct(F.element_at(b["exit"], a["s"] + 1).alias("s"), F.array_append(
                     a["out"], F.struct(b["block"].alias("block"), a["s"].alias("state"))).alias("out")),
                 lambda a: a["out"]))
             .select("symbol", F.explode("entries").alias("e")).select("symbol", "e.*"))
    empty = F.array().cast("array<struct<t:bigint,setup_start:bigint>>")

    def replay(a: Column, r: Column) -> Column:
        event = F.struct(r["pos"].alias("t"), (r["pos"] - a["s"]).alias("setup_start"))
        return F.struct(_next_state(a["s"], r["flags"]).alias("s"), F.when(
            _fires(a["s"], r["flags"]), F.array_append(a["out"], event)).otherwise(a["out"]).alias("out"))

    return (packed.join(chain, ["symbol", "block"])
            .withColumn("e", F.explode(F.aggregate(
                "rows", F.struct(F.col("state").alias("s"), empty.alias("out")), replay, lambda a: a["out"])))
            .select("symbol", "e.*"))


def event_records(events: DataFrame, ind: DataFrame) -> DataFrame:
    """Events with risk unit R, target multiple, holding rows and the context values."""
    at_t = ind.select("symbol", F.col("pos").alias("t"), F.col("ts").alias("signal_time"), F.col("atr20_1").alias("R"),
                      "close", "high_1", "lows")
    at_p = ind.select("symbol", F.col("pos").alias("setup_start"), F.col("atr20_1").alias("_anchor"), F.col("high_20").alias("_high"))
    e = events.join(at_t, ["symbol", "t"]).join(at_p, ["symbol", "setup_start"])
    age = F.col("t") - F.col("setup_start")
    lowest = F.array_min(F.slice("lows", 1, (age + 1).cast("int")))
    context = F.array((age / 3.0), F.try_divide(F.col("_high") - lowest, F.col("_anchor")),
                      F.try_divide(F.col("close") - F.col("high_1"), F.col("R")), F.try_divide(F.col("R"), F.col("close")))
    return e.select("symbol", "t", "signal_time", "setup_start", F.lit(1).alias("side"), "R",
                    F.lit(TARGET_MULTIPLE).alias("q"), F.lit(HOLD_BARS).alias("N"), (F.col("t") + 1).alias("earliest_entry_bar"),
                    F.lit("point_in_time").alias("share_basis"), context.alias("context"))


CHANNELS = ("ret1", "ret5", "ret20", "from_ema20", "from_ema50", "ema50_slope", "range", "vol_ratio", "efficiency", "close_place")


def event_channels(ind: DataFrame) -> DataFrame:
    """The ten per-bar channels of the event tensor; NULL where a normaliser is missing or not positive."""
    a, s, c = F.col("atr20_1"), F.col("sigma20_1"), F.col("close")
    ok = (a > 0) & (s > 0)
    span = F.col("high") - F.col("low")
    values = [F.col("logret") / s, F.log(c / F.col("close_5")) / (s * math.sqrt(5)), F.log(c / F.col("close_20")) / (s * math.sqrt(20)),
              (c - F.col("ema20_1")) / a, (c - F.col("ema50_1")) / a, (F.col("ema50_1") - F.col("ema50_11")) / a, F.col("tr") / a,
              F.col("sigma5_1") / s, F.col("er20"), F.when(span > 0, (c - F.col("low")) / span).otherwise(0.5)]
    return ind.select("symbol", "pos", *[F.when(ok, v).alias(n) for n, v in zip(CHANNELS, values)])


def event_tensors(records: DataFrame, channels: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """Attach the last ``length`` rows of channels; an incomplete tensor is kept out and named in ``feature_error``."""
    wanted = records.select("symbol", "t", F.explode(F.sequence(
        F.greatest(F.col("t") - length + 1, F.lit(0)), F.col("t"))).alias("pos"))
    step = F.array(*[F.col(x) for x in CHANNELS])
    whole = F.lit(True)
    for x in CHANNELS:
        whole = whole & F.col(x).isNotNull()
    rows = wanted.join(channels, ["symbol", "pos"]).groupBy("symbol", "t").agg(
        F.sort_array(F.collect_list(F.struct("pos", step.alias("v")))).alias("_s"), F.count_if(whole).alias("_n"),
        F.min(F.when(~whole, F.col("pos"))).alias("_bad"))
    out = records.join(rows, ["symbol", "t"], "left")
    short = (F.col("t") - length + 1 - 20 < 0) | (F.col("setup_start") - 20 < 0)
    gap = ~F.forall("context", lambda v: v.isNotNull())
    error = (F.when(short, F.lit("insufficient history"))
             .when(F.coalesce("_n", F.lit(0)) < length, F.concat(F.lit("undefined value at bar "), F.coalesce("_bad", "t").cast("string")))
             .when(gap, F.lit("undefined context")))
    return (out.withColumn("feature_error", error)
            .withColumn("sequence", F.when(F.col("feature_error").isNull(), F.transform("_s", lambda r: r["v"])))
            .withColumn("context", F.when(F.col("feature_error").isNull(), F.col("context"))).drop("_s", "_n", "_bad"))


def barrier_labels(records: DataFrame, bars: DataFrame, actions: DataFrame, half_spread: float, commission: float,
                   tie: str = "stop_first") -> DataFrame:
    """Outcome of a long trade per event under stop, target and time barriers.

    Each event meets its at most N forward bars in an equi-join on (symbol, pos).  Splits after the entry
    rescale shares, stop and target through a running product; the first failing or exiting bar decides.
    """
    if tie not in ("stop_first", "target_first"):
        raise ValueError("tie must be stop_first or target_first")
    if not (0 <= half_spread < 1 and 0 <= commission < 1):
        raise ValueError("cost parameters out of range")
    b, f = half_spread, commission
    market = (bars.withColumn("_ok", bar_tradeable()).join(actions.select("symbol", "ts", "split", "dividend"), ["symbol", "ts"], "left")
              .select("symbol", F.col("pos").alias("k"), "ts", "open", "high", "low", "close", "_ok", "split", "dividend"))
    held = (records.select("symbol", "t", "R", "q", "N")
            .withColumn("e", F.col("t") + 1)
            .withColumn("k", F.explode(F.when(F.col("N") > 0, F.sequence(F.col("t") + 1, F.col("t") + F.col("N")))))
            .join(market, ["symbol", "k"], "left"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good_split = F.coalesce(finite(F.col("split")) & (F.col("split") > 0), F.lit(False))
    good_dividend = F.coalesce(finite(F.col("dividend")) & (F.col("dividend") >= 0), F.lit(False))
    w = Window.partitionBy("symbol", "t").orderBy("k")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    later = F.col("k") > F.col("e")
    factor = F.when(later & good_split, F.col("split")).otherwise(1.0)
    held = (held.withColumn("_first", F.first(F.struct("open", "split", "_ok")).over(run))
            .withColumn("shares", F.exp(F.sum(F.log(factor)).over(run)))
            .withColumn("entry", F.col("_first.open") * (1 + b))
            .withColumn("risk", F.try_divide(F.col("R"), F.col("_first.split"))))
    held = (held.withColumn("paid", F.sum(F.when(later & good_dividend, F.col("shares") * F.col("dividend")).otherwise(0.0)).over(run))
            .withColumn("stop", (F.col("entry") - F.col("risk")) / F.col("shares"))
            .withColumn("target", (F.col("entry") + F.col("q") * F.col("risk")) / F.col("shares")))
    op, stop, target = F.col("open"), F.col("stop"), F.col("target")
    hit_stop, hit_target = F.col("low") <= stop, F.col("high") >= target
    stop_wins = hit_stop & (F.lit(tie == "stop_first") | ~hit_target)
    priced = F.coalesce((F.col("entry") > 0) & (F.col("risk") > 0) & finite(F.col("entry")) & finite(F.col("risk")), F.lit(False))
    failure = (F.when(~F.coalesce(F.col("_ok"), F.lit(False)), "CENSORED").when(~good_split, "ACTION_UNSUPPORTED")
               .when(~later & ~priced, "DATA_ERROR").when(~good_dividend, "ACTION_UNSUPPORTED"))
    field = F.when(failure == "ACTION_UNSUPPORTED", F.when(~good_split, "split").otherwise("dividend"))
    reason = (F.when(op <= stop, "GAP_STOP").when(op >= target, "GAP_TARGET").when(stop_wins, "STOP").when(hit_target, "TARGET")
              .when(F.col("k") == F.col("t") + F.col("N"), "TIME"))
    held = held.withColumn("_fail", failure).withColumn("_field", field).withColumn("_reason", F.when(failure.isNull(), reason))
    level = (F.when(F.col("_reason").isin("GAP_STOP", "GAP_TARGET"), op).when(F.col("_reason") == "STOP", stop)
             .when(F.col("_reason") == "TARGET", target).otherwise(F.col("close")))
    done = held.where(F.col("_fail").isNotNull() | F.col("_reason").isNotNull())
    exit_row = done.groupBy("symbol", "t").agg(F.min_by(F.struct(
        "k", "ts", "_fail", "_field", "_reason", level.alias("level"), "shares", "paid", "entry", "risk",
        (hit_stop & hit_target & F.col("_reason").isin("STOP", "TARGET")).alias("ambiguous")), "k").alias("x"))
    out = records.join(exit_row, ["symbol", "t"], "left")
    failed = F.coalesce(F.col("x._fail"), F.when(F.col("x").isNull(), F.lit("CENSORED")))
    exit_price = F.col("x.level") * (1 - b)
    notional = F.col("x.shares") * exit_price
    net = notional - F.col("x.entry") + F.col("x.paid") - f * F.col("x.entry") - f * notional
    fine = failed.isNull()
    kind = F.when(F.col("x._reason").endswith("STOP"), -1).when(F.col("x._reason").endswith("TARGET"), 1).otherwise(0)
    unsupported = failed == "ACTION_UNSUPPORTED"
    return out.select(
        "symbol", "t", "signal_time", F.coalesce(failed, F.lit("OK")).alias("status"),
        F.when(unsupported, F.col("x.k")).alias("bar"), F.when(unsupported, F.col("x._field")).alias("field"),
        F.when(fine, kind).alias("barrier_class"), F.when(fine, (net > 0).cast("int")).alias("meta_label"),
        F.when(fine, net / F.col("x.risk")).alias("net_R"), F.when(fine, F.col("x.entry")).alias("entry"),
        F.when(fine, exit_price).alias("exit"), F.when(fine, F.col("x.k")).alias("exit_bar"),
        F.when(fine, F.col("x._reason")).alias("reason"), F.when(fine, F.coalesce("x.ambiguous", F.lit(False))).alias("ambiguous"),
        F.when(fine, F.col("x.entry") - F.col("x.risk") <= 0).alias("nonpositive_stop"),
        F.when(fine, F.col("x.ts")).alias("label_available_after"))


def census(labels: DataFrame) -> DataFrame:
    """Counts per symbol, year, status and reason."""
    return labels.groupBy("symbol", F.year("signal_time").alias("year"), "status", F.coalesce("reason", F.lit("-")).alias("reason")).agg(
        F.count(F.lit(1)).alias("events"), F.sum("net_R").alias("net_R"))


def tie_sensitivity(stop_first: DataFrame, target_first: DataFrame) -> DataFrame:
    """Share of ambiguous bars and the change in mean net R when the target wins ties."""
    a = stop_first.where("status = 'OK'").select("symbol", "t", F.col("net_R").alias("_a"), "ambiguous")
    c = target_first.where("status = 'OK'").select("symbol", "t", F.col("net_R").alias("_b"))
    return a.join(c, ["symbol", "t"]).agg(
        F.count(F.lit(1)).alias("events"), F.avg(F.col("ambiguous").cast("double")).alias("ambiguous_share"),
        F.avg(F.col("_b") - F.col("_a")).alias("mean_net_R_change"))


def persistent_signals(monthly: DataFrame, min_confirm: int = 2, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Keep the effective sign until a new one repeats in ``min_confirm`` consecutive months.

    One row per key and month: a few hundred rows per key.  A row confirms its sign when it starts after a
    NULL or lies ``min_confirm`` months into an unbroken stretch of that sign; the last confirmed sign holds,
    and the last value carrying the held sign is the effective signal.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("ts")
    n = F.year("ts") * 12 + F.month("ts")
    sign = F.signum("signal")
    df = (monthly.withColumn("_n", n).withColumn("_s", sign)
          .withColumn("_null", F.sum(F.when(F.col("signal").isNull(), 1).otherwise(0)).over(w)))
    part = Window.partitionBy(*keys, "_null").orderBy("ts")
    df = df.withColumn("_fresh", F.col("signal").isNotNull() & (F.lag("signal").over(w).isNull()))
    broken = (F.lag("_s").over(w) != F.col("_s")) | F.lag("_s").over(w).isNull() | (F.lag("_n").over(w) != F.col("_n") - 1)
    df = df.withColumn("_stretch", F.sum(F.when(F.coalesce(broken, F.lit(True)), 1).otherwise(0)).over(w))
    df = df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_stretch").orderBy("ts")))
    confirmed = F.when(F.col("signal").isNotNull() & (F.col("_fresh") | (F.col("_k") >= min_confirm)), F.col("_s"))
    upto = part.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_held", F.last(confirmed, ignorenulls=True).over(upto))
    carried = F.last(F.when(F.col("_s") == F.col("_held"), F.col("signal")), ignorenulls=True).over(upto)
    return df.withColumn("effective", F.when(F.col("signal").isNotNull(), carried)).drop(
        "_n", "_s", "_null", "_fresh", "_stretch", "_k", "_held")


def daily_persistent(panel: DataFrame, calendar: DataFrame, min_confirm: int = 2, signal: str = "signal") -> DataFrame:
    """Sample at finished month ends, filter, and hold each month's value until the next month end."""
    ends = month_ends(calendar, drop_partial_last=True).select("ts")
    monthly = panel.select("symbol", "ts", F.col(signal).alias("signal")).join(ends, "ts", "left_semi")
    eff = persistent_signals(monthly, min_confirm)
    flagged = calendar.select("ts", "pos").join(ends.withColumn("_is", F.lit(True)), "ts", "left")
    marked = carried_last(flagged, [], ["pos"], F.floor(F.col("pos") / 4096),
                          F.when(F.col("_is"), F.col("ts")), "month_end").drop("_is")
    return (marked.where(F.col("month_end").isNotNull())
            .join(eff.select("symbol", F.col("ts").alias("month_end"), "effective"), "month_end"))
