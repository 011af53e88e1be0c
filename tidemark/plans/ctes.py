"""SQL fragments that build the same panels in DuckDB."""

from __future__ import annotations

KEY = "l_returnflag || l_linestatus"
MEAN = "sum(floor(l_extendedprice / l_quantity * 100 + 0.5)) / count(*) / 100.0"
TS = "CAST(date_trunc('{unit}', {col}) AS TIMESTAMP)"


def flag(unit: str = "week", name: str = "panel") -> str:
    ts = TS.format(unit=unit, col="l_shipdate")
    return (f"{name} AS (SELECT {KEY} AS symbol, {ts} AS ts, "
            f"{MEAN} AS price FROM lineitem GROUP BY 1, 2)")


def brand(unit: str = "week", name: str = "panel") -> str:
    ts = TS.format(unit=unit, col="l_shipdate")
    return (f"{name} AS (SELECT p_brand AS symbol, {ts} AS ts, "
            f"{MEAN} AS price "
            f"FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)")


def ohlc(unit: str = "week", name: str = "ohlc") -> str:
    ts = TS.format(unit=unit, col="l_shipdate")
    o = "ROW(l_shipdate, l_orderkey, l_linenumber)"
    p = "floor(l_extendedprice / l_quantity * 100 + 0.5) / 100.0"
    return (f"{name} AS (SELECT {KEY} AS symbol, {ts} AS ts, arg_min({p}, {o}) AS open, "
            f"max({p}) AS high, min({p}) AS low, arg_max({p}, {o}) AS close "
            f"FROM lineitem GROUP BY 1, 2)")


def bars(unit: str = "hour", name: str = "bars") -> str:
    ts = TS.format(unit=unit, col="ts")
    return (f"{name} AS (SELECT event_type AS symbol, {ts} AS ts, sum(floor(value * 100 + 0.5)) / count(*) / 100.0 + 100.0 AS price, "
            f"sum(floor(value * 100 + 0.5)) / 100.0 AS volume, CAST(count(*) AS DOUBLE) AS trade_count FROM events GROUP BY 1, 2)")


def quoted(src: str = "bars", name: str = "q") -> str:
    half = "price * (2.0 / 1e4) / 2"
    return (f"{name} AS (SELECT *, price - {half} AS bid, price + {half} AS ask, volume / 2 AS bid_volume, "
            f"volume / 2 AS ask_volume FROM {src})")


def booked(unit: str = "hour", name: str = "q") -> str:
    ts, money = TS.format(unit=unit, col="ts"), "floor(value * 100 + 0.5)"
    return (f"{name} AS (SELECT *, price - spread / 2 AS bid, price + spread / 2 AS ask FROM (SELECT event_type AS symbol, {ts} AS ts, "
            f"sum({money}) / count(*) / 100.0 + 100.0 AS price, sum({money}) / 100.0 AS volume, CAST(count(*) AS DOUBLE) AS trade_count, "
            f"(max({money}) - min({money})) / 1e5 + 0.01 AS spread, sum(CASE WHEN user_id % 2 = 0 THEN {money} ELSE 0 END) / 100.0 AS bid_volume, "
            f"sum(CASE WHEN user_id % 2 = 0 THEN 0 ELSE {money} END) / 100.0 AS ask_volume FROM events GROUP BY 1, 2))")


def aligned(src: str = "panel", name: str = "p") -> str:
    return (f"{name}_cal AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM {src} GROUP BY ts "
            f"HAVING count(*) = (SELECT count(DISTINCT symbol) FROM {src})), "
            f"{name} AS (SELECT {src}.*, pos FROM {src} JOIN {name}_cal USING (ts))")


def own_pos(src: str = "panel", name: str = "p") -> str:
    return (f"{name} AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos FROM {src})")


def news(name: str = "news") -> str:
    names = "['click', 'error', 'purchase', 'signup', 'view']"
    return (f"{name} AS (SELECT {names}[doc_id % 5 + 1] AS symbol, TIMESTAMP '2024-01-01 00:00:00' "
            f"+ to_minutes(CAST((doc_id % 1160) * 37 AS INTEGER)) AS created_at, doc_id, text AS headline FROM documents)")


def words(column: str = "headline") -> str:
    from ..functions.scalars import NEGATIVE_WORDS, POSITIVE_WORDS
    tok = f"list_distinct(regexp_extract_all(lower({column}), '([a-z'']+)', 1))"
    pos = "[" + ", ".join(f"'{w}'" for w in POSITIVE_WORDS) + "]"
    neg = "[" + ", ".join(f"'{w}'" for w in NEGATIVE_WORDS) + "]"
    p, n = f"len(list_intersect({tok}, {pos}))", f"len(list_intersect({tok}, {neg}))"
    return f"(CASE WHEN {p} + {n} > 0 THEN ({p} - {n})::DOUBLE / ({p} + {n}) ELSE 0.0 END)"


def uniform(*parts: str, which: int = 0) -> str:
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(CAST('0x' || substr(md5({text}), {1 + 8 * which}, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0)"


W = "(PARTITION BY symbol ORDER BY pos)"


def frame(n: int, partition: str = "symbol", order: str = "pos") -> str:
    return f"(PARTITION BY {partition} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int, partition: str = "symbol", order: str = "pos") -> str:
    f = frame(n, partition, order)
    return f"CASE WHEN count({x}) OVER {f} = {n} THEN {agg}({x}) OVER {f} END"


def clip(x: str, limit: float = 10) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(-{limit}.0, least({limit}.0, {x})) END"
