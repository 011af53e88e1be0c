"""Features and labels over one series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import headline_score
from ..operators import blocks, ranking, rolling
from ..sources import tables
from . import ctes as c
from . import panels
from .registry import query

W = c.W


_aligned = panels.aligned
_bars = panels.quoted_bars


@query("returns_simple_log", "W1 W2 J2", "symbol:s ts:t ret:d log_ret:d", f"""
WITH {c.flag('day')}, {c.aligned()}
SELECT symbol, ts, price / lag(price) OVER {W} - 1 AS ret, ln(price) - ln(lag(price) OVER {W}) AS log_ret FROM p""")
def returns_simple_log(spark, folder):
    return rolling.returns(_aligned(spark, folder))


@query("trend_signs", "W3 W4", "symbol:s ts:t mom63:d mom126:d mom252:d combo:d", f"""
WITH {c.flag('day')}, {c.aligned()}, s AS (SELECT symbol, ts,
 sign(price / lag(price, 63) OVER {W} - 1) AS mom63, sign(price / lag(price, 126) OVER {W} - 1) AS mom126,
 sign(price / lag(price, 252) OVER {W} - 1) AS mom252 FROM p)
SELECT *, (mom63 + mom126 + mom252) / 3.0 AS combo FROM s""")
def trend_signs(spark, folder):
    return rolling.trend_signs(_aligned(spark, folder))


def ewma_sql(span: int = 63, src: str = "r", x: str = "ret") -> str:
    g = 1 - 2 / (span + 1)
    w = f"CASE WHEN {x} IS NOT NULL THEN pow({g!r}, 1500 - pos) END"
    u = "(PARTITION BY symbol ORDER BY pos)"
    return f"""SELECT *, CASE WHEN n >= {span} THEN sqrt(greatest(sxx / sw - pow(sx / sw, 2), 0) * sw * sw
 / (sw * sw - sww)) * sqrt(252.0) END AS vol FROM (SELECT {src}.*, sum({w}) OVER {u} AS sw,
 sum(({w}) * {x}) OVER {u} AS sx, sum(({w}) * {x} * {x}) OVER {u} AS sxx,
 sum(pow({w}, 2)) OVER {u} AS sww, count({x}) OVER {u} AS n FROM {src})"""


@query("ewma_volatility", "W5", "symbol:s ts:t vol:d", f"""
WITH {c.flag('day')}, {c.aligned()},
r AS (SELECT symbol, ts, pos, price / lag(price) OVER {W} - 1 AS ret FROM p) {ewma_sql()}""")
def ewma_volatility(spark, folder):
    return rolling.ewma_vol(rolling.returns(_aligned(spark, folder)))


def bar_features_sql(src: str = "b") -> str:
    return f"""f1 AS (SELECT *, (bid + ask) / 2 AS mid, ln(price) - ln(lag(price) OVER {W}) AS log_return FROM {src}),
feat AS (SELECT symbol, ts, pos, price, bid, ask, log_return, {c.full('stddev_samp', 'log_return', 30)} AS realized_vol,
 (bid_volume - ask_volume) / (bid_volume + ask_volume + 1e-8) AS orderbook_imbalance,
 (ask - bid) / (mid + 1e-8) AS spread_norm,
 CASE WHEN count(price) OVER {c.frame(20)} = 20 THEN (price - sum(price * volume) OVER {c.frame(20)} / sum(volume) OVER {c.frame(20)})
  / (sum(price * volume) OVER {c.frame(20)} / sum(volume) OVER {c.frame(20)} + 1e-8) END AS vwap_deviation,
 trade_count / ({c.full('avg', 'trade_count', 50)} + 1e-8) AS trade_intensity,
 ln(mid) - ln(lag(mid) OVER {W}) AS mid_price_return FROM f1)"""


BAR_COLUMNS = "symbol:s ts:t log_return:d realized_vol:d orderbook_imbalance:d spread_norm:d " \
              "vwap_deviation:d trade_intensity:d mid_price_return:d"


@query("bar_features", "W2 W6 W8 W9 P17 S10", BAR_COLUMNS, f"""
WITH {c.bars()}, {c.quoted()}, {c.own_pos('q', 'b')}, {bar_features_sql()} SELECT * FROM feat""")
def bar_features(spark, folder):
    return rolling.bar_features(_bars(spark, folder))


def zscore_sql(cols, src="feat", n=100):
    f = c.frame(n)
    return ", ".join(f"CASE WHEN count({x}) OVER {f} = {n} THEN ({x} - avg({x}) OVER {f}) / "
                     f"(stddev_samp({x}) OVER {f} + 1e-8) END AS {x}_z" for x in cols)


Z_COLUMNS = list(rolling.BAR_FEATURES)


@query("scaled_bar_features", "W10 M8 W19", "symbol:s ts:t " + " ".join(f"{n}_z:d" for n in Z_COLUMNS) + " target:d", f"""
WITH {panels.BOOKED_BARS}, {bar_features_sql()}
SELECT symbol, ts, {zscore_sql(Z_COLUMNS)}, ln(lead(price, 1) OVER {W}) - ln(price) AS target FROM feat""")
def scaled_bar_features(spark, folder):
    feats = rolling.bar_features(panels.booked_bars(spark, folder))
    return rolling.forward_log_return(rolling.rolling_zscore(feats, Z_COLUMNS), 1)


def channels_sql(src="p"):
    m = ", ".join(f"(price / lag(price, {h}) OVER {W} - 1) / vol / sqrt({h}.0) AS m{h}" for h in rolling.HORIZONS)
    return f"""c0 AS (SELECT *, price / lag(price) OVER {W} - 1 AS ret FROM {src}),
c1 AS (SELECT *, CASE WHEN count(ret) OVER {c.frame(63)} = 63 THEN greatest(stddev_samp(ret) OVER {c.frame(63)}, 1e-6) END AS vol FROM c0),
ch AS (SELECT *, {m}, coalesce(price / lag(price, 126) OVER {W} - 1 > 0, false) AS reference,
 {c.clip(f'lead(ret, 2) OVER {W} / vol')} AS y FROM c1)"""


@query("daily_channels", "W7 W11 W16 W17", "symbol:s ts:t vol:d m1:d m5:d m21:d m63:d m126:d reference:b y:d", f"""
WITH {c.flag('day')}, {c.aligned()}, {channels_sql()} SELECT * FROM ch""")
def daily_channels(spark, folder):
    return rolling.daily_channels(_aligned(spark, folder))


EXT_SQL = f"""e1 AS (SELECT ch.*, mk.ret AS mret FROM ch LEFT JOIN (SELECT pos, ret FROM ch WHERE symbol = 'AF') mk USING (pos)),
e2 AS (SELECT *, (lag(price, 21) OVER {W} / lag(price, 147) OVER {W} - 1) / vol / sqrt(126.0) AS skip_momentum,
 CASE WHEN count(ret) OVER {c.frame(126)} = 126 THEN ln(greatest(stddev_samp(ret) OVER {c.frame(21)}, 1e-6)
  / greatest(stddev_samp(ret) OVER {c.frame(126)}, 1e-6)) END AS vol_ratio,
 (price / ({c.full('max', 'price', 252)}) - 1) / vol / sqrt(252.0) AS drawdown,
 CASE WHEN count(ret + mret) OVER {c.frame(63)} = 63 THEN greatest(-1, least(1, corr(ret, mret) OVER {c.frame(63)})) END AS market_corr FROM e1),
e3 AS (SELECT *, CASE WHEN skip_momentum IS NOT NULL THEN rank() OVER (PARTITION BY ts, skip_momentum IS NULL ORDER BY skip_momentum)
 + (count(*) OVER (PARTITION BY ts, skip_momentum) - 1) / 2.0 END AS rk, count(skip_momentum) OVER (PARTITION BY ts) AS nn FROM e2),
ext AS (SELECT *, CASE WHEN nn > 1 THEN 2 * (rk - 1) / (nn - 1) - 1 END AS cross_rank FROM e3)"""


def extended_frame(panel):
    base = rolling.daily_channels(panel)
    extra = rolling.extended_channels(panel, "AF").select(
        "symbol", "pos", "skip_momentum", "vol_ratio", "drawdown", "market_corr")
    return ranking.centred_rank(base.join(extra, ["symbol", "pos"]), "skip_momentum")


@query("extended_channels", "W12 W13 W14 W15 X2",
       "symbol:s ts:t skip_momentum:d cross_rank:d vol_ratio:d drawdown:d market_corr:d", f"""
WITH {c.flag('day')}, {c.aligned()}, {channels_sql()}, {EXT_SQL} SELECT * FROM ext""")
def extended_channels(spark, folder):
    return extended_frame(_aligned(spark, folder))


@query("holding_labels", "W18 S8", "symbol:s ts:t h1:d h5:d h21:d", f"""
WITH {c.flag('day')}, {c.aligned()}, {channels_sql()}
SELECT symbol, ts, """ + ", ".join(
    c.clip(f"(lead(price, {h + 1}) OVER {W} / lead(price, 1) OVER {W} - 1) / (vol * sqrt({h}.0))") + f" AS h{h}"
    for h in (1, 5, 21)) + " FROM ch")
def holding_labels(spark, folder):
    df = rolling.daily_channels(_aligned(spark, folder))
    for h in (1, 5, 21):
        df = rolling.holding_label(df, h, out=f"h{h}")
    return df


@query("forward_log_return", "W19", "symbol:s ts:t target:d", f"""
WITH {c.bars()}, {c.own_pos('bars', 'b')} SELECT symbol, ts, ln(lead(price, 5) OVER {W}) - ln(price) AS target FROM b""")
def forward_log_return(spark, folder):
    return rolling.forward_log_return(_bars(spark, folder), 5)


@query("trailing_percentile", "W27", "symbol:s ts:t percentile:d", f"""
WITH {c.bars()}, {c.own_pos('bars', 'b')}, h AS (SELECT symbol, ts, price, list(price) OVER
 (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING) AS past FROM b)
SELECT symbol, ts, CASE WHEN coalesce(len(past), 0) > 0 THEN len(list_filter(past, lambda v: v <= price))::DOUBLE / len(past)
 ELSE 0.5 END AS percentile FROM h""")
def trailing_percentile(spark, folder):
    return rolling.trailing_percentile(_bars(spark, folder), "price", 500)


@query("trailing_function", "W34", "symbol:s ts:t spread20:d", f"""
WITH {c.flag('day')}, {c.own_pos()} SELECT symbol, ts, CASE WHEN count(price) OVER {c.frame(20)} = 20 THEN
 max(price) OVER {c.frame(20)} - min(price) OVER {c.frame(20)} END AS spread20 FROM p""")
def trailing_function(spark, folder):
    p = blocks.numbered(tables.flag_panel(spark, folder, "day"), ["symbol"])
    return rolling.trailing_apply(p, "price", 20, lambda a: F.array_max(a) - F.array_min(a), "spread20")


@query("bar_momentum_scores", "W28", "symbol:s ts:t momentum:d reversal:d", f"""
WITH {c.bars()}, {c.own_pos('bars', 'b')}, s AS (SELECT symbol, ts, (price - lag(price, 20) OVER {W}) / lag(price, 20) OVER {W} AS momentum FROM b)
SELECT *, -momentum AS reversal FROM s WHERE momentum IS NOT NULL""")
def bar_momentum_scores(spark, folder):
    return rolling.bar_momentum(_bars(spark, folder), 20)


NET = panels.NET
EQ = "(PARTITION BY scenario ORDER BY ts)"


@query("equity_and_drawdown", "W29 W30 W31", "scenario:s ts:t equity:d dd_start:d dd_path:d", f"""
WITH {NET}, e AS (SELECT *, exp(sum(ln(1 + net)) OVER {EQ}) AS equity FROM net)
SELECT scenario, ts, equity, equity / greatest(1.0, max(equity) OVER {EQ}) - 1 AS dd_start,
 equity / max(equity) OVER {EQ} - 1 AS dd_path FROM e""")
def equity_and_drawdown(spark, folder):
    e = rolling.equity(panels.net_weekly(spark, folder))
    return e.withColumnsRenamed({"drawdown": "dd_start", "path_drawdown": "dd_path"})


@query("headline_sentiment", "P18", "doc_id:i score:d", f"""
SELECT doc_id, {c.words('text')} AS score FROM documents""")
def headline_sentiment(spark, folder):
    return tables.table(spark, folder, "documents").select("doc_id", headline_score(F.col("text")).alias("score"))


@query("momentum_buckets", "X1", "symbol:s ts:t pct_rank:d signal:d", f"""
WITH {c.brand('week')}, {c.own_pos()}, t AS (SELECT symbol, ts, lag(price, 4) OVER {W} / lag(price, 52) OVER {W} - 1 AS trail FROM p),
k AS (SELECT *, CASE WHEN trail IS NOT NULL THEN (rank() OVER (PARTITION BY ts, trail IS NULL ORDER BY trail)
 + (count(*) OVER (PARTITION BY ts, trail) - 1) / 2.0) / count(trail) OVER (PARTITION BY ts) END AS pct_rank FROM t)
SELECT symbol, ts, pct_rank, CASE WHEN trail IS NULL THEN NULL WHEN pct_rank <= 0.3 THEN -1.0
 WHEN pct_rank > 1 - 0.3 THEN 1.0 ELSE 0.0 END AS signal FROM k""")
def momentum_buckets(spark, folder):
    p = blocks.numbered(tables.brand_panel(spark, folder), ["symbol"])
    return ranking.momentum_buckets(p, lookback=48, skip=4)

