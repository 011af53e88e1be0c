"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The headline word lists.
POSITIVE_WORDS = """
beat beats beating surge surges surging soar soars soaring rally rallies upgrade upgraded upgrades
record growth strong outperform outperforms bullish gain gains profit profits profitable buy positive
rise rises rising jump jumps boost boosts boosted win wins winning breakthrough expand expands expansion
optimistic
""".split()
NEGATIVE_WORDS = """
miss misses missing plunge plunges plunging crash crashes crashing downgrade downgraded downgrades weak
weakness underperform underperforms bearish loss losses sell selloff negative fall falls falling drop
drops dropping decline declines declining concern concerns warning warns cut cuts lawsuit investigation
recall layoff layoffs fraud probe slump slumps
""".split()


def digest(*parts: Column) -> Column:
    """md5 text of the parts: the same on every machine and in SQL."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))


def unit_draw(md5_text: Column, which: int = 0) -> Column:
    """One of the four numbers in [0, 1) that a digest holds."""
    return F.conv(F.substring(md5_text, 1 + 8 * which, 8), 16, 10).cast("double") / 4294967296.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return unit_draw(digest(*parts))


def headline_score(text: Column) -> Column:
    """(positive - negative) / (positive + negative) over distinct lower-case words, 0 without hits."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z']+)"), F.lit(1)))
    pos = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in POSITIVE_WORDS])))
    neg = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in NEGATIVE_WORDS])))
    return F.when(pos + neg > 0, (pos - neg) / (pos + neg)).otherwise(0.0)


def edge(mu: Column, sigma: Column, eps: float = 1e-6, limit: float | None = None) -> Column:
    """mu / (sigma^2 + eps); negative sigma is an error."""
    ratio = F.when(sigma < 0, F.raise_error(F.lit("sigma must not be negative")).cast("double")).otherwise(
        mu / (sigma * sigma + eps))
    return ratio if limit is None else F.greatest(F.lit(-limit), F.least(F.lit(limit), ratio))


def target_position(mu: Column, sigma: Column, k: Column | float, maximum: float = 1.0) -> Column:
    return F.greatest(F.lit(-maximum), F.least(F.lit(maximum), k * edge(mu, sigma)))


def wilson(hits: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson 95% interval of a rate; (0, 0) without observations."""
    p = hits / total
    denom = 1 + z * z / total
    centre = (p + z * z / (2 * total)) / denom
    half = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / denom
    low = F.when(total > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0)
    high = F.when(total > 0, F.least(F.lit(1.0), centre + half)).otherwise(0.0)
    return low, high


def trade_cost(deltas: Column, bp: Column | float, multiplier: Column | float = 1.0) -> Column:
    """Aggregate: one-way turnover times basis points."""
    return F.sum(F.abs(deltas) * bp / 10_000.0) * multiplier


def borrow_cost(weights: Column, bp_pa: Column | float = 50.0, multiplier: Column | float = 1.0) -> Column:
    """Aggregate: daily borrow on the short side."""
    return F.sum(F.when(weights < 0, -weights).otherwise(0.0)) * bp_pa / 10_000.0 / 252.0 * multiplier


def gaussian_nll(y: Column, mu: Column, sigma: Column) -> Column:
    var = sigma * sigma
    return 0.5 * F.log(2 * math.pi * var) + (y - mu) * (y - mu) / (2 * var)


def binary_cross_entropy(p: Column, hit: Column) -> Column:
    """Log terms bounded at -100, as usual for a probability of exactly 0 or 1."""
    floor = F.lit(-100.0)
    lp = F.when(p > 0, F.greatest(F.log(p), floor)).otherwise(floor)
    lq = F.when(p < 1, F.greatest(F.log(1 - p), floor)).otherwise(floor)
    return -F.when(hit, lp).otherwise(lq)
