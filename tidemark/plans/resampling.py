"""Bootstrap and permutation queries; the SQL draws the same md5 counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resampling, statistics
from . import crosssection, ctes as c
from . import statistics as st
from .registry import query

DRAWS, DAY_DRAWS = 10_000, 2_000


def boot_sql(src: str, seed: int, n_boot: int, lens: str, value: str = "log_ret", order: str = "month", key: str = "scenario") -> str:
    u1, u2 = c.uniform(str(seed), "b", "i"), c.uniform(str(seed), "b", "i", which=1)
    return f"""ix AS (SELECT {key}, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n FROM {src}),
ln AS (SELECT n, bl FROM (SELECT DISTINCT n FROM ix), (SELECT unnest({lens}) AS bl)),
st0 AS (SELECT n, bl, b, i FROM ln, (SELECT unnest(range(1, {n_boot + 1})) AS b), (SELECT unnest(range(0, (SELECT max(n) FROM ix))) AS i) WHERE i < n),
st1 AS (SELECT *, CASE WHEN i = 0 OR {u1} < 1 / bl THEN i END AS began, CASE WHEN i = 0 OR {u1} < 1 / bl THEN floor({u2} * n)::BIGINT END AS origin FROM st0),
st2 AS (SELECT n, bl, b, (last_value(origin IGNORE NULLS) OVER w + i - last_value(began IGNORE NULLS) OVER w) % n AS i FROM st1 WINDOW w AS (PARTITION BY n, bl, b ORDER BY i)),
bm AS (SELECT {key}, bl, b, exp(12 * sum(v) / max(ix.n)) - 1 AS ann FROM st2 JOIN ix ON ix.n = st2.n AND ix.i = st2.i GROUP BY 1, 2, 3),
bs AS (SELECT {key}, bl AS block_len, quantile_cont(ann, 0.05) AS ann_lower_95, quantile_cont(ann, 0.025) AS ci_low_95, quantile_cont(ann, 0.975) AS ci_high_95,
 (count(*) FILTER (ann <= {resampling.ZERO}) + 1) / (count(*) + 1) AS p_leq_zero FROM bm GROUP BY 1, 2),
pt AS (SELECT {key}, avg(v) AS mean_monthly, count(*) AS n_months FROM ix GROUP BY 1),
boot AS (SELECT *, exp(12 * mean_monthly) - 1 AS ann_geom FROM bs JOIN pt USING ({key}))"""


BOOT_COLUMNS = "scenario:s block_len:d mean_monthly:d ann_geom:d ann_lower_95:d ci_low_95:d ci_high_95:d p_leq_zero:d n_months:i"


@query("stationary_bootstrap", "R1 R2 R6", BOOT_COLUMNS, f"""
WITH {st.EXCESS}, {boot_sql('ex', 7, DRAWS, '[3.0::DOUBLE, 6.0::DOUBLE, 12.0::DOUBLE]')} SELECT * FROM boot""")
def stationary_bootstrap(spark, folder):
    return resampling.stationary_bootstrap(st.excess(spark, folder), block_lens=(3.0, 6.0, 12.0), n_boot=DRAWS, seed=7)


@query("interval_verdict", "A18", "intervals:i excluding_zero:i above_zero:i all_below_band:b reading:s", f"""
WITH {st.EXCESS}, {boot_sql('ex', 7, DRAWS, '[6.0::DOUBLE]')}, q AS (SELECT count(*) AS intervals, count(*) FILTER (ci_low_95 > 0 OR ci_high_95 < 0) AS excluding_zero,
 count(*) FILTER (ci_low_95 > 0) AS above_zero, bool_and(ci_high_95 < 0.5) AS all_below_band FROM boot)
SELECT *, CASE WHEN excluding_zero = 0 THEN 'null result' WHEN excluding_zero = 1 THEN 'hint, not evidence' ELSE 'check axis consistency' END AS reading FROM q""")
def interval_verdict(spark, folder):
    return statistics.interval_verdict(resampling.stationary_bootstrap(st.excess(spark, folder), n_boot=DRAWS, seed=7), 0.5)


def flip_sql(src: str, key: str, value: str, order: str, seed: int, n: int, add: int) -> str:
    sign = f"CASE WHEN {c.uniform(str(seed), 'b', 'i', chr(39) + 'sign' + chr(39))} < 0.5 THEN -1 ELSE 1 END"
    return f"""fx AS (SELECT {key}, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS i FROM {src}),
fs AS (SELECT b, i, {sign} AS s FROM (SELECT unnest(range(1, {n + 1})) AS b), (SELECT DISTINCT i FROM fx)),
fm AS (SELECT {key}, b, avg(v * s) AS m, avg(v) AS o, count(*) AS n FROM fx JOIN fs USING (i) GROUP BY 1, 2)
SELECT {key}, max(o) AS observed, max(n) AS n_periods, (count(*) FILTER (abs(m) >= abs(o) - 1e-12 * abs(o)) + {add}) / (count(*) + {add}) AS p_two_sided,
 (count(*) FILTER (m >= o - 1e-12 * abs(o)) + {add}) / (count(*) + {add}) AS p_greater_zero FROM fm GROUP BY 1"""


@query("monthly_sign_flip", "R3", "scenario:s observed:d n_periods:i p_two_sided:d p_greater_zero:d", f"""
WITH {st.EXCESS}, {flip_sql('ex', 'scenario', 'log_ret', 'month', 3, DRAWS, 1)}""")
def monthly_sign_flip(spark, folder):
    return resampling.sign_flip(st.excess(spark, folder), n_perm=DRAWS, seed=3)


DAYS_SQL = f"""{crosssection.PER_BAR_SQL}, dy AS (SELECT variant, CAST(ts AS DATE) AS day, sum(ic) AS s, count(ic) AS k, avg(ic) AS day_mean FROM pb WHERE ic IS NOT NULL GROUP BY 1, 2)"""


@query("day_block_bootstrap", "R4", "variant:s mean:d ci_low_95:d ci_high_95:d p_leq_zero:d n_days:i", f"""
WITH {DAYS_SQL}, ix AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY variant) AS n FROM dy),
dr AS (SELECT n, b, floor({c.uniform('5', 'b', 'k', chr(39) + 'day' + chr(39))} * n)::BIGINT AS i FROM (SELECT DISTINCT n FROM ix), (SELECT unnest(range(1, {DAY_DRAWS + 1})) AS b), (SELECT unnest(range(0, (SELECT max(n) FROM ix))) AS k) WHERE k < n),
m AS (SELECT variant, b, sum(s) / sum(ix.k) AS m FROM dr JOIN ix ON ix.n = dr.n AND ix.i = dr.i GROUP BY 1, 2)
SELECT variant, (SELECT sum(s) / sum(k) FROM dy WHERE dy.variant = m.variant) AS mean, quantile_cont(m, 0.025) AS ci_low_95, quantile_cont(m, 0.975) AS ci_high_95,
 avg(CASE WHEN m <= {resampling.ZERO} THEN 1.0 ELSE 0 END) AS p_leq_zero, (SELECT count(*) FROM dy WHERE dy.variant = m.variant) AS n_days FROM m GROUP BY 1""")
def day_block_bootstrap(spark, folder):
    return resampling.day_bootstrap(crosssection.per_bar(spark, folder), n_boot=DAY_DRAWS, seed=5)


@query("day_sign_flip", "R5", "variant:s observed:d n_periods:i p_two_sided:d p_greater_zero:d", f"""
WITH {DAYS_SQL}, {flip_sql('dy', 'variant', 'day_mean', 'day', 5, DAY_DRAWS, 0)}""")
def day_sign_flip(spark, folder):
    return resampling.day_sign_flip(crosssection.per_bar(spark, folder), n_perm=DAY_DRAWS, seed=5)


