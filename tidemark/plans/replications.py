"""The screening over (world, seed) panels cut from the line items, and the false alarms of its records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, replications
from ..operators.blocks import numbered
from ..session import stored
from ..sources import records, tables
from . import accounting as acc
from . import ctes as c
from . import panels
from .alignment import SLEEVE_SQL
from .registry import query
from .tablechecks import PH, PL, VH, VL

ON = ("world", "seed")
WORLDS = {"odd_lines": 1, "even_lines": 0}
SEEDS = (0, 1)
SCALE = 200.0


def world_panels(spark, folder):
    """(world, seed, symbol, ts, price): weekly means of the flag pairs, by parity of the line number and of the supplier."""
    items = tables.table(spark, folder, "lineitem")
    world = F.when(F.col("l_linenumber") % 2 == 1, "odd_lines").otherwise("even_lines")
    return (items.groupBy(world.alias("world"), (F.col("l_suppkey") % 2).cast("long").alias("seed"), F.concat("l_returnflag", "l_linestatus").alias("symbol"),
                          F.date_trunc("week", "l_shipdate").cast("timestamp_ntz").alias("ts"))
            .agg(tables.mean_of_cents(tables.unit_price()).alias("price")))


def screened(spark, folder):
    def build():
        p = stored(world_panels(spark, folder), "world-panels")
        cash = stored(align.cash_rate(numbered(p.select("ts").distinct(), []), stored(panels.cash(spark, folder, "week"), "world-rates"), causal=False), "world-cash")
        # the returns of one world are turned round, so that variants pass there and none does in the other
        scale = F.when(F.col("world") == "odd_lines", -SCALE).otherwise(SCALE)
        bp = F.when(F.col("asset") < "NF", 1.5).otherwise(3.0)
        return replications.screen(p, cash, ON, acc.LOOK, acc.WARM, acc.SPAN, acc.TRAIL, scale=scale, bp=bp, n_boot=acc.N_BOOT, seed=acc.SEED, **acc.WIDE_LIMITS)
    return tables.kept(spark, ("screened_worlds", folder), build)


def _panel_sql(odd: int, seed: int) -> str:
    flag = c.flag("week").replace("FROM lineitem", f"FROM lineitem WHERE l_linenumber % 2 = {odd} AND l_suppkey % 2 = {seed}")
    days = c.aligned().split(", p AS (")[0].replace("p_cal AS (", "p_all AS (", 1)
    return f"""{flag}, {days}, p_end AS (SELECT max(ts) AS dev_end FROM (SELECT max(ts) AS ts FROM p_all GROUP BY date_trunc('month', ts))
 WHERE ts <= (SELECT ts FROM p_all WHERE pos = (SELECT floor(count(*) * 0.8::DOUBLE)::BIGINT FROM p_all) - 1)), p_cal AS (SELECT p_all.* FROM p_all, p_end WHERE ts <= dev_end),
p AS (SELECT panel.*, pos FROM panel JOIN p_cal USING (ts))"""


def _screened_sql() -> str:
    """Each panel alone, by the SQL of one panel."""
    one = acc._all_gates_sql().replace(f" UNION ALL SELECT 'loo_sleeve_' || sleeve, symbol FROM {SLEEVE_SQL}", "")
    parts = []
    for world, odd in WORLDS.items():
        for seed in SEEDS:
            text = one.replace(panels.ALIGNED_WEEK, _panel_sql(odd, seed))
            text = text.replace("- 1) / -50 AS ret", f"- 1) / {'-' if odd else ''}{SCALE} AS ret")
            parts.append(f"""SELECT '{world}' AS world, {seed}::BIGINT AS seed, * FROM (WITH RECURSIVE {text}
 SELECT g6.*, (SELECT dev_end FROM p_end) AS dev_end, (SELECT variant FROM g6 WHERE passed_all ORDER BY monthly_excess_sharpe DESC, variant LIMIT 1) AS candidate FROM g6)""")
    return " UNION ALL ".join(parts)


@query("screening_replications", "B8 A16 X14 P3", "world:s seed:i dev_end:t variant:s ann_lower_95:d dd_base:d dd_stress:d cagr_stress:d monthly_excess_sharpe:d years_ok:b loo_ok:b "
       "gate_a:b gate_d:b passed_abc:b passed_all:b candidate:s", _screened_sql())
def screening_replications(spark, folder):
    return screened(spark, folder)


@query("replication_false_alarms", "B8 A22 A23 A25", "world:s replications:i tests:i fa_variant:d variant_low:d variant_high:d fa_pipeline:d "
       "pipeline_low:d pipeline_high:d calibrated:b selection_inflated:b reading:s", f"""
WITH ga AS ({_screened_sql()}), runs AS (SELECT world, seed, count(*) AS tests, count(*) FILTER (gate_a) AS hits, max(candidate) AS candidate FROM ga GROUP BY 1, 2),
ra AS (SELECT world, count(*) AS replications, sum(tests) AS tests, sum(hits) AS variant_hits, count(candidate) AS pipeline_hits FROM runs GROUP BY 1),
rates AS (SELECT *, variant_hits / tests AS fa_variant, pipeline_hits / replications AS fa_pipeline FROM ra)
SELECT *, {VL} AS variant_low, {VH} AS variant_high, {PL} AS pipeline_low, {PH} AS pipeline_high,
 fa_variant BETWEEN 0.025 AND 0.10 AS calibrated, fa_pipeline > 0.15 AS selection_inflated,
 CASE WHEN fa_variant > 0.10 THEN 'miscalibrated' WHEN fa_variant < 0.025 THEN 'conservative' WHEN fa_pipeline > 0.15 THEN 'selection inflated' ELSE 'passed' END AS reading FROM rates""")
def replication_false_alarms(spark, folder):
    return records.false_alarm_rates(replications.audit_records(screened(spark, folder)))
