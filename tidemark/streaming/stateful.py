"""The live forms of the batch features, sizing, news windows, outcomes and books.

Rows come in any order inside the allowed ``delay``; results are the same for every cut into micro-batches.
What a key carries is typed state of bounded size; windows are evaluated as arrays over the rows that are due.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.accounting import Overlay
from .eventtime import Carry, after_watermark, in_event_time, watermarked

FEATURES = ("log_return", "realized_vol", "orderbook_imbalance", "spread_norm", "vwap_deviation", "trade_intensity", "mid_price_return")
BAR = ("price", "volume", "trade_count", "bid", "ask", "bid_volume", "ask_volume")


#: Groups of symbols that share a state, so that what Spark spends on a key is not spent on every symbol.
SHARDS = 512


def quoted_bars(rows: DataFrame, delay: str | None = "0 seconds", idle_ms: int | None = None) -> DataFrame:
    """Latest quote at or before each bar of one stream of (symbol, ts, is_bar, id, value).

    Of quotes of the same moment the largest id counts; bars before the first quote are dropped.  The last quote of each symbol is
    carried; after ``idle_ms`` without a row of its symbol it is forgotten.  Symbols are dealt over ``SHARDS`` keys.
    """
    idle = None if idle_ms is None else idle_ms * 1000

    def advance(carry: Carry, due: pd.DataFrame) -> tuple[Carry, pd.DataFrame]:
        held = carry[0] if carry else ([], [], [], [])
        symbol, us, ids = (np.append(np.array(h, dtype=np.int64), due[c].to_numpy(dtype=np.int64)) for h, c in zip(held, ("symbol", "us", "id")))
        values = np.append(np.array(held[3], dtype=float), due["value"].to_numpy(dtype=float))
        bar = np.append(np.zeros(len(held[0]), dtype=bool), due["is_bar"].to_numpy(dtype=bool))
        order = np.argsort(symbol, kind="stable")
        symbol, us, ids, values, bar = (x[order] for x in (symbol, us, ids, values, bar))
        at = np.arange(len(us))
        fresh = np.append(True, symbol[1:] != symbol[:-1])
        ends = np.append(np.flatnonzero(fresh)[1:] - 1, len(us) - 1)
        if idle is not None:
            fresh[1:] |= us[1:] - us[:-1] >= idle
        last = np.maximum.accumulate(np.where(bar, -1, at))
        known = last >= np.maximum.accumulate(np.where(fresh, at, 0))
        hit = np.flatnonzero(bar & known)
        quote = last[hit]
        out = pd.DataFrame({"symbol": symbol[hit], "event_id": ids[hit], "value": values[hit], "quote_id": ids[quote], "quote_value": values[quote]})
        ends = ends[known[ends] if idle is None else known[ends] & (us[ends] + idle > us.max())]
        kept = last[ends]
        return [(symbol[ends].tolist(), us[ends].tolist(), ids[kept].tolist(), values[kept].tolist())] if len(ends) else [], out

    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("symbol"), F.lit(SHARDS)) + F.lit(0) * F.col("symbol"))
    return in_event_time(sharded, ["symbol", "is_bar", "id", "value"], advance,
                         "symbol array<bigint>, us array<bigint>, id array<bigint>, value array<double>",
                         "symbol long, event_id long, value double, quote_id long, quote_value double", key="shard", delay=delay, order=("is_bar", "id"))


def _windows(x: np.ndarray, n: int) -> np.ndarray:
    """Rolling windows that end at rows n-1, n, ... along the first axis."""
    return sliding_window_view(x, n, axis=0) if len(x) >= n else np.empty((0, *x.shape[1:], n))


def feature_vectors(bars: pd.DataFrame, vol_rows: int = 30, vwap_rows: int = 20, trade_rows: int = 50, eps: float = 1e-8) -> np.ndarray:
    """The seven features of all bars from number ``max(rows)`` on; the first bar only seeds the returns."""
    seed = max(vol_rows, vwap_rows, trade_rows)
    n = len(bars) - seed
    if n <= 0:
        return np.empty((0, len(FEATURES)))
    price, volume, count, bid, ask, bv, av = (bars[c].to_numpy(dtype=float) for c in BAR)
    mid = (bid + ask) / 2
    r = np.diff(np.log(price))
    vwap = _windows((price * volume)[1:], vwap_rows).sum(-1) / (_windows(volume[1:], vwap_rows).sum(-1) + eps)
    deviation = (price[vwap_rows:] - vwap) / (vwap + eps)
    intensity = count[trade_rows:] / (_windows(count[1:], trade_rows).mean(-1) + eps)
    columns = (r, _windows(r, vol_rows).std(-1, ddof=1), (bv - av) / (bv + av + eps), (ask - bid) / (mid + eps), deviation, intensity,
               np.diff(np.log(mid)))
    return np.column_stack([c[-n:] for c in columns])


def scaled_vectors(vectors: np.ndarray, window: int, eps: float = 1e-8) -> np.ndarray:
    """Z-scores of all vectors from number ``window - 1`` on; a window holds the current vector."""
    held = _windows(vectors, window)
    return (vectors[window - 1:] - held.mean(-1)) / (held.std(-1, ddof=1) + eps) if len(held) else vectors[:0]


def live_features(bars: DataFrame, scaled: tuple[str, ...] = FEATURES, vol_rows: int = 30, vwap_rows: int = 20, trade_rows: int = 50,
                  window: int = 100, steps: int = 30, delay: str | None = "0 seconds", idle_ms: int | None = None) -> DataFrame:
    """Raw features, their scaled values and the sequence of scaled vectors, each when it is ready.

    The newest ``max(rows) + window + steps - 2`` bars are carried: every output is a function of them and the bars that are due.
    A missing value in a sequence is an error.
    """
    seed = max(vol_rows, vwap_rows, trade_rows)
    keep = seed + window + steps - 2
    picked = [FEATURES.index(n) for n in scaled]

    def advance(carry: Carry, due: pd.DataFrame) -> tuple[Carry, pd.DataFrame]:
        names = ["us", *BAR]
        fresh = len(due)
        rows = pd.concat([pd.DataFrame(carry, columns=names), due], ignore_index=True) if carry else due
        held = list(rows.iloc[-keep:][names].itertuples(index=False, name=None))
        vectors = feature_vectors(rows, vol_rows, vwap_rows, trade_rows)
        scores = scaled_vectors(vectors[:, picked], window)
        n = min(fresh, len(vectors))
        out = pd.DataFrame(vectors[len(vectors) - n:], columns=list(FEATURES))
        out.insert(0, "us", rows["us"].to_numpy()[len(rows) - n:])
        ready = min(n, len(scores))
        for j, name in enumerate(scaled):
            out[f"{name}_z"] = [None] * (n - ready) + scores[len(scores) - ready:, j].tolist()
        stacked = _windows(scores, steps).transpose(0, 2, 1)
        whole = min(n, len(stacked))
        stacked = stacked[len(stacked) - whole:]
        if np.isnan(stacked).any():
            raise ValueError("a feature is missing")
        out["seq"] = [None] * (n - whole) + [s.tolist() for s in stacked]
        return held, out.astype({f"{name}_z": float for name in scaled})

    schema = ", ".join(["symbol string", "us long", *[f"{n} double" for n in FEATURES], *[f"{n}_z double" for n in scaled], "seq array<array<double>>"])
    numbers = [F.col(n).cast("double").alias(n) for n in BAR]
    return in_event_time(bars.select("symbol", "ts", *numbers), list(BAR), advance, ", ".join(["us long", *[f"{n} double" for n in BAR]]), schema,
                         delay=delay, idle_ms=idle_ms)


def live_news(news: DataFrame, bars: DataFrame, minutes: int = 240, delay: str | None = "0 seconds") -> DataFrame:
    """News count and mean score in (t - minutes, t] for each bar: an outer interval join of two streams, summed per bar.

    News (symbol, created_at, score) stay in state for ``minutes`` after the watermark; a bar is emitted once the watermark of
    both sides has passed it, so news may come after the bar inside the delay.  Bars are distinct by (symbol, ts).  The join key
    of the news is never NULL by form: a filter on it would be moved below the watermark.
    """
    named = F.col("symbol").isNotNull()
    n = after_watermark(watermarked(news, "created_at", delay), named, "created_at").select(
        F.coalesce("symbol", F.lit("")).alias("_symbol"), F.col("created_at").alias("_at"), "score")
    b = after_watermark(watermarked(bars, "ts", delay), named).select("symbol", "ts")
    inside = ((F.col("symbol") == F.col("_symbol")) & (F.col("_at") <= F.col("ts"))
              & (F.col("_at") > F.col("ts") - F.expr(f"INTERVAL {int(minutes)} MINUTES")))
    per_bar = b.join(n, inside, "left_outer").groupBy("symbol", "ts").agg(F.count("score").alias("_n"), F.sum("score").alias("_s"))
    return per_bar.select("symbol", F.unix_micros("ts").alias("us"), F.log1p(F.col("_n").cast("double")).alias("news_intensity"),
                          F.coalesce(F.try_divide("_s", "_n"), F.lit(0.0)).alias("news_sentiment"))


def live_sizing(rows: DataFrame, delay: str | None = "0 seconds", idle_ms: int | None = None, **limits) -> DataFrame:
    """The risk overlay on a stream of (target, sigma, bid, ask); position, mid, recent returns and rest are carried."""
    overlay = Overlay(**limits)

    def advance(carry: Carry, due: pd.DataFrame) -> tuple[Carry, pd.DataFrame]:
        state, values = overlay.run(list(carry[0][0]) if carry else list(overlay.start), due)
        return [([float(v) for v in state],)], pd.DataFrame({"us": due["us"], **values})

    return in_event_time(rows, ["target", "sigma", "bid", "ask"], advance, "state array<double>",
                         "symbol string, us long, position double, realized_return double", delay=delay, idle_ms=idle_ms)


def live_outcomes(bars: DataFrame, horizon: int, newest: int = 5000, batch: int = 256, least: int = 64,
                  delay: str | None = "0 seconds", idle_ms: int | None = None) -> DataFrame:
    """Log return from each bar to the one ``horizon`` bars later, emitted when it becomes known.

    The last ``horizon`` bars and the newest outcomes are carried.  ``n_ready`` counts the matured outcomes held (``newest`` at
    most); from ``least`` of them on ``batch_mean`` and ``batch_sd`` describe the newest ``batch``.  Steps are counted in bars,
    so a gap of any length in time loses no outcome; a join on time ranges would.
    """
    def advance(carry: Carry, due: pd.DataFrame) -> tuple[Carry, pd.DataFrame]:
        held, ready, past = carry[0] if carry else ([], 0, [])
        us = np.append(np.array([h[0] for h in held], dtype=np.int64), due["us"].to_numpy())
        price = np.append(np.array([h[1] for h in held], dtype=float), due["price"].to_numpy(dtype=float))
        n = max(len(us) - horizon, 0)
        outcome = np.log(price[horizon:]) - np.log(price[:n])
        series = np.append(np.array(past, dtype=float), outcome)
        counts = np.minimum(ready + 1 + np.arange(n), newest)
        parts = [series[max(0, len(past) + i + 1 - batch):len(past) + i + 1] if counts[i] >= least else None for i in range(n)]
        out = pd.DataFrame({"us": us[:n], "entry_price": price[:n], "outcome": outcome, "n_ready": counts,
                            "batch_mean": [None if p is None else p.mean() for p in parts],
                            "batch_sd": [None if p is None or len(p) < 2 else p.std(ddof=1) for p in parts]})
        tail = [(int(a), float(b)) for a, b in zip(us[n:], price[n:])]
        return [(tail, int(min(ready + n, newest)), series[-batch:].tolist())], out.astype({"batch_mean": float, "batch_sd": float})

    return in_event_time(bars.withColumn("price", F.col("price").cast("double")), ["price"], advance,
                         "held array<struct<us:bigint,price:double>>, ready int, past array<double>",
                         "symbol string, us long, entry_price double, outcome double, n_ready long, batch_mean double, batch_sd double",
                         delay=delay, idle_ms=idle_ms)


def live_book(rows: DataFrame, symbols: int, n_long: int, n_short: int, zone: int, delay: str | None = "0 seconds",
              gross: float = 1.0) -> DataFrame:
    """Hysteresis book of each universe from a stream of (universe, symbol, ts, edge), in one query.

    A bar counts once all ``symbols`` have reported it and the watermark has passed it; incomplete bars are skipped.  The
    complete bars feed a second stateful step that carries each symbol's side: entry in the strict top or bottom, exit on
    leaving the wider zone, a held long before a new short where the zones overlap.  Equal edges keep the order of symbols.
    """
    if zone < n_long or zone < n_short:
        raise ValueError("zone must cover both entry counts")
    timed = after_watermark(watermarked(rows, "ts", delay), F.col("universe").isNotNull())
    members = F.sort_array(F.collect_list(F.struct("symbol", "edge")))
    whole = (timed.groupBy("universe", "ts").agg(F.count(F.lit(1)).alias("n"), members.alias("m")).where(F.col("n") == symbols)
             .select("universe", "ts", F.col("m.symbol").alias("symbols"), F.col("m.edge").alias("edges")))

    def advance(carry: Carry, due: pd.DataFrame) -> tuple[Carry, pd.DataFrame]:
        side = dict(carry)
        parts = []
        for us, names, edges in due.itertuples(index=False, name=None):
            place = np.empty(len(names), dtype=int)
            place[np.argsort(-np.asarray(edges, dtype=float), kind="stable")] = np.arange(1, len(names) + 1)
            low = len(names) - place + 1
            before = np.array([side.get(s, 0) for s in names])
            long = (place <= n_long) | (before == 1) & (place <= zone)
            short = (low <= n_short) | (before == -1) & (low <= zone)
            now = np.where(long & (~short | (before == 1)), 1, np.where(short, -1, 0))
            side = dict(zip(names, now.tolist()))
            count = {1: max((now == 1).sum(), 1), -1: max((now == -1).sum(), 1), 0: 1}
            parts.append(pd.DataFrame({"us": us, "symbol": names, "side": now, "weight": [s * gross / 2 / count[s] for s in now.tolist()]}))
        return list(side.items()), pd.concat(parts)

    return in_event_time(whole, ["symbols", "edges"], advance, "symbol string, side int",
                         "universe string, us long, symbol string, side int, weight double", key="universe", delay=None)
