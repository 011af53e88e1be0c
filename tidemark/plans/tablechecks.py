"""Panel storage, fingerprints, checks and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, calendars
from ..sources import quality, records, tables
from . import ctes as c
from . import panels
from .registry import query

W = c.W
DIGEST_COLUMNS = ["symbol", "us", "nano"]


def _digestible(panel):
    return panel.withColumn("us", blocks.micros("ts")).withColumn("nano", F.floor(F.col("price") * 1e9).cast("long"))


DIGEST_SQL = f"""{c.flag('week')}, h AS (SELECT symbol, ts, CAST(CAST('0x' || substr(md5(symbol || '|' || CAST(epoch_us(ts) AS VARCHAR) || '|' ||
 CAST(CAST(floor(price * 1e9) AS BIGINT) AS VARCHAR)), 1, 12) AS UBIGINT) AS BIGINT) AS d FROM panel),
f AS (SELECT symbol, count(*) AS rows, sum(d) AS digest_sum, bit_xor(d) AS digest_xor, min(ts) AS first_ts, max(ts) AS last_ts FROM h GROUP BY 1)"""


@query("stored_panel", "S1 S2", "symbol:s ts:t price:d", f"WITH {c.flag('week')} SELECT * FROM panel")
def stored_panel(spark, folder):
    path = quality.scratch(spark, "panel")
    quality.build_or_load(spark, path, lambda: tables.flag_panel(spark, folder), ["symbol"])
    return quality.load_panel(spark, path)


@query("table_manifest", "S3 S4", "symbol:s rows:i digest_sum:s digest_xor:i first_ts:t last_ts:t", f"WITH {DIGEST_SQL} SELECT * FROM f")
def table_manifest(spark, folder):
    panel = _digestible(tables.flag_panel(spark, folder))
    return quality.manifest(panel, quality.row_digest(DIGEST_COLUMNS))


@query("table_fingerprint", "S3", "content_sha256:s", f"""
WITH {DIGEST_SQL}, t AS (SELECT CAST(CAST('0x' || substr(md5(symbol || '|' || rows::VARCHAR || '|' || digest_sum::VARCHAR || '|' || digest_xor::VARCHAR), 1, 12) AS UBIGINT) AS BIGINT) AS h FROM f)
SELECT sha256(count(*)::VARCHAR || '|' || sum(h)::VARCHAR || '|' || bit_xor(h)::VARCHAR) AS content_sha256 FROM t""")
def table_fingerprint(spark, folder):
    return quality.table_fingerprint(_digestible(tables.flag_panel(spark, folder)), quality.row_digest(DIGEST_COLUMNS))


@query("panel_faults", "S5", "symbol:s rule:s n:i", f"""
WITH {c.flag('week')}, {panels.cash_sql('week')}, dup AS (SELECT symbol, ts, CASE WHEN day(ts) = 8 THEN NULL WHEN day(ts) = 9 THEN -price ELSE price END AS price FROM panel
 UNION ALL SELECT symbol, ts, price FROM panel WHERE symbol = 'AF' AND month(ts) = 5),
cs AS (SELECT ts, rate_pa_pct * CASE WHEN month(ts) = 12 THEN 10 ELSE 1 END AS rate_pa_pct FROM cash)
SELECT * FROM (SELECT symbol, 'duplicate_ts' AS rule, count(*) - count(DISTINCT ts) AS n FROM dup GROUP BY 1
UNION ALL SELECT symbol, 'missing_price', count(*) FILTER (price IS NULL) FROM dup GROUP BY 1
UNION ALL SELECT symbol, 'nonpositive_price', count(*) FILTER (price <= 0) FROM dup GROUP BY 1
UNION ALL SELECT 'cash', 'rate_out_of_range', count(*) FILTER (rate_pa_pct > 25 OR rate_pa_pct < -1) FROM cs) WHERE n > 0
UNION ALL SELECT 'panel', 'short_calendar', n FROM (SELECT count(*) AS n FROM (SELECT ts FROM dup GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM dup))) WHERE n < 4800""")
def panel_faults(spark, folder):
    p = tables.flag_panel(spark, folder)
    day = F.dayofmonth("ts")
    bad = (p.withColumn("price", F.when(day == 8, None).when(day == 9, -F.col("price")).otherwise(F.col("price")))
           .unionByName(p.where((F.col("symbol") == "AF") & (F.month("ts") == 5))))
    cash = panels.cash(spark, folder, "week").withColumn(
        "rate_pa_pct", F.col("rate_pa_pct") * F.when(F.month("ts") == 12, 10).otherwise(1))
    return quality.panel_faults(bad, cash, 4800)


@query("index_faults", "S8", "symbol:s rows:i duplicates:i bad_prices:i contiguous:b", f"""
WITH {c.brand('day')}, d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM (SELECT DISTINCT ts FROM panel))
SELECT symbol, count(*) AS rows, count(*) - count(DISTINCT ts) AS duplicates, count(*) FILTER (price IS NULL OR price <= 0) AS bad_prices,
 max(pos) - min(pos) + 1 = count(DISTINCT pos) AS contiguous FROM panel JOIN d USING (ts) GROUP BY 1""")
def index_faults(spark, folder):
    return calendars.index_faults(tables.brand_panel(spark, folder, "day"))


@query("covered_symbols", "S9", "symbol:s rows:i", f"""
WITH {c.brand('day')} SELECT symbol, count(*) AS rows FROM panel GROUP BY 1 HAVING count(*) >= floor((SELECT count(DISTINCT ts) FROM panel) * 0.62::DOUBLE)""")
def covered_symbols(spark, folder):
    return calendars.coverage(tables.brand_panel(spark, folder, "day"), 0.62)


@query("bar_validity", "S6 S7", "symbol:s ts:t usable:b tradeable:b", f"""
WITH {c.ohlc()}, b AS (SELECT symbol, ts, open, CASE WHEN day(ts) = 6 THEN low * 0.5 ELSE high END AS high, low, CASE WHEN day(ts) = 13 THEN high * 2 WHEN day(ts) = 20 THEN NULL WHEN day(ts) = 27 THEN -close ELSE close END AS close FROM ohlc)
SELECT symbol, ts, coalesce(open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= low, false) AS usable,
 coalesce(open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= low AND low <= least(open, close) AND greatest(open, close) <= high, false) AND close IS NOT NULL AS tradeable FROM b""")
def bar_validity(spark, folder):
    day = F.dayofmonth("ts")
    b = tables.ohlc_panel(spark, folder)
    b = (b.withColumn("close", F.when(day == 13, F.col("high") * 2).when(day == 20, None).when(day == 27, -F.col("close")).otherwise(F.col("close")))
         .withColumn("high", F.when(day == 6, F.col("low") * 0.5).otherwise(F.col("high"))))
    return b.withColumn("usable", quality.bar_usable()).withColumn("tradeable", quality.bar_tradeable())


@query("quote_approximation", "S10 P17", "symbol:s ts:t bid:d ask:d bid_volume:d ask_volume:d", f"WITH {c.bars()}, {c.quoted()} SELECT * FROM q")
def quote_approximation(spark, folder):
    return panels.quoted_bars(spark, folder)


@query("stored_results", "S11 S14", "scenario:s rows:i total:d", f"""
WITH {panels.NET} SELECT scenario, count(*) AS rows, sum(net) AS total FROM net GROUP BY 1""")
def stored_results(spark, folder):
    path = quality.scratch(spark, "net")
    stored = records.write_scenarios(panels.net_weekly(spark, folder), path, "scenario")
    return stored.groupBy("scenario").agg(F.count(F.lit(1)).alias("rows"), F.sum("net").alias("total"))


@query("resumed_units", "S14 S11", "scenario:s rows:i total:d runs:i", f"""
WITH {panels.NET} SELECT scenario, count(*) AS rows, sum(net) AS total, CASE WHEN scenario = (SELECT max(scenario) FROM net) THEN 2 ELSE 1 END AS runs FROM net GROUP BY 1""")
def resumed_units(spark, folder):
    """The first pass breaks on the last scenario; the second takes up that one alone."""
    net, path, ledger = panels.net_weekly(spark, folder), quality.scratch(spark, "units"), quality.scratch(spark, "ledger")
    units, last = net.select("scenario").distinct(), net.agg(F.max("scenario").alias("_last"))

    def breaking(batch):
        bad = F.col("scenario") == F.col("_last")
        return net.join(batch.join(last, bad, "left"), "scenario").withColumn("net", F.when(
            F.col("_last").isNotNull(), F.raise_error(F.lit("broken unit")).cast("double")).otherwise(F.col("net"))).drop("_last")

    records.run_units(units, ["scenario"], breaking, path, ledger)
    tries = records.run_units(units, ["scenario"], lambda batch: net.join(batch, "scenario"), path, ledger)
    runs = tries.groupBy("scenario").agg(F.count(F.lit(1)).alias("runs"))
    sums = spark.read.parquet(path).groupBy("scenario").agg(F.count(F.lit(1)).alias("rows"), F.sum("net").alias("total"))
    return sums.join(runs, "scenario")


def _audit_sql(hit: str) -> str:
    return f"""rec AS (SELECT l_returnflag AS world, l_suppkey AS seed, v, {hit} AS hit, count(*) AS n
 FROM (SELECT *, 'q' || l_linenumber AS v FROM lineitem) GROUP BY 1, 2, 3),
runs AS (SELECT world, seed, count(*) AS tests, count(*) FILTER (hit) AS hits, max(CASE WHEN hit AND n > 8 THEN v END) AS candidate FROM rec GROUP BY 1, 2)"""


AUDIT_SQL = _audit_sql("avg(l_discount) > 0.0515")
EXACT_AUDIT_SQL = _audit_sql("sum(CAST(floor(l_discount * 1e6 + 0.5) AS BIGINT)) > 51500 * count(l_discount)")


def audit_frame(spark, folder, exact=False):
    """Replication records in the stored shape: world, seed, candidate and a map of variant -> passed.

    A variant passes if its mean discount is above 0.0515.  ``exact`` compares sums of whole millionths; a mean of doubles that
    stands at 0.0515 falls to either side by the order of its rows.
    """
    millionths = F.floor(F.col("l_discount") * 1e6 + 0.5).cast("long")
    hit = F.sum(millionths) > 51500 * F.count("l_discount") if exact else F.avg("l_discount") > 0.0515
    rows = (tables.table(spark, folder, "lineitem")
            .groupBy(F.col("l_returnflag").alias("world"), F.col("l_suppkey").alias("seed"),
                     F.concat(F.lit("q"), F.col("l_linenumber").cast("string")).alias("v"))
            .agg(hit.alias("hit"), F.count(F.lit(1)).alias("n")))
    return rows.groupBy("world", "seed").agg(
        F.max(F.when(F.col("hit") & (F.col("n") > 8), F.col("v"))).alias("candidate"),
        F.map_from_entries(F.collect_list(F.struct("v", "hit"))).alias("gate_a"))


def stored_audit(spark, folder, exact=False):
    path = quality.scratch(spark, "audit")
    audit_frame(spark, folder, exact).write.mode("errorifexists").json(path)
    return records.read_audit(spark, path)


@query("audit_record_rows", "S13", "world:s seed:i variant:s hit:b", f"WITH {EXACT_AUDIT_SQL} SELECT world, seed, v AS variant, hit FROM rec")
def audit_record_rows(spark, folder):
    return records.gate_rows(stored_audit(spark, folder, exact=True))


RATES_SQL = f"""{AUDIT_SQL}, ra AS (SELECT world, count(*) AS replications, sum(tests) AS tests, sum(hits) AS variant_hits, count(candidate) AS pipeline_hits FROM runs GROUP BY 1),
rates AS (SELECT *, variant_hits / tests AS fa_variant, pipeline_hits / replications AS fa_pipeline FROM ra)"""


def wilson_sql(h: str, n: str) -> tuple[str, str]:
    z = "1.959963984540054"
    d, p = f"(1 + {z}*{z}/{n})", f"({h}/{n})"
    centre = f"(({p} + {z}*{z}/(2*{n})) / {d})"
    half = f"({z} * sqrt({p}*(1-{p})/{n} + {z}*{z}/(4.0*{n}*{n})) / {d})"
    return f"greatest(0.0, {centre} - {half})", f"least(1.0, {centre} + {half})"


VL, VH = wilson_sql("variant_hits", "tests")
PL, PH = wilson_sql("pipeline_hits", "replications")


@query("false_alarm_rates", "A22 A23 A25 B8", "world:s replications:i tests:i fa_variant:d variant_low:d variant_high:d fa_pipeline:d "
       "pipeline_low:d pipeline_high:d calibrated:b selection_inflated:b reading:s", f"""
WITH {RATES_SQL} SELECT *, {VL} AS variant_low, {VH} AS variant_high, {PL} AS pipeline_low, {PH} AS pipeline_high,
 fa_variant BETWEEN 0.025 AND 0.10 AS calibrated, fa_pipeline > 0.15 AS selection_inflated,
 CASE WHEN fa_variant > 0.10 THEN 'miscalibrated' WHEN fa_variant < 0.025 THEN 'conservative' WHEN fa_pipeline > 0.15 THEN 'selection inflated' ELSE 'passed' END AS reading FROM rates""")
def false_alarm_rates(spark, folder):
    return records.false_alarm_rates(stored_audit(spark, folder))


@query("clustered_rates", "A24", "world:s replications:i rate:d standard_error:d low:d high:d", f"""
WITH {AUDIT_SQL}, m AS (SELECT world, hits / tests AS r FROM runs), g AS (SELECT world, count(*) AS replications, avg(r) AS rate, stddev_samp(r) / sqrt(count(*)) AS standard_error FROM m GROUP BY 1)
SELECT *, rate - 1.959963984540054 * standard_error AS low, rate + 1.959963984540054 * standard_error AS high FROM g""")
def clustered_rates(spark, folder):
    return records.clustered_rates(records.gate_rows(stored_audit(spark, folder)))


@query("clustered_rate_z", "A24", "world:s main_rate:d control_rate:d z:d", f"""
WITH {EXACT_AUDIT_SQL}, m AS (SELECT world, seed % 3 = 0 AS control, hits / tests AS r FROM runs),
g AS (SELECT world, control, avg(r) AS rate, stddev_samp(r) / sqrt(count(*)) AS se FROM m GROUP BY 1, 2)
SELECT a.world, a.rate AS main_rate, b.rate AS control_rate, (a.rate - b.rate) / sqrt(a.se * a.se + b.se * b.se) AS z
FROM g a JOIN g b ON a.world = b.world AND NOT a.control AND b.control""")
def clustered_rate_z(spark, folder):
    rows = records.gate_rows(stored_audit(spark, folder, exact=True))
    control = F.col("seed") % 3 == 0
    return records.rate_difference(rows.where(~control), rows.where(control))


