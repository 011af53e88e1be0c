"""Rules whose state depends on their own earlier output, without one task per key.

A series is cut into blocks of consecutive positions.  Each block guesses its entry state by running the rule over the
``warmup`` rows before it, then runs its own rows.  One row per block tells the guess and the state at its end; blocks whose
entry is not the end of the block before are replayed from that end, until none is left.  Rules that forget their start (a dead
band, an overlay with a bounded memory) agree after the warm-up almost always, so few blocks are replayed.  Every result is exact:
guesses are only kept where they equal the true state.  If blocks still disagree after ``rounds`` replays, the rest of those keys,
from the first such block on, runs in order (``_in_order``), with constant memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

BLOCK_ROWS = 4096
WARMUP_ROWS = 256
REPLAYS = 6
State = list[float]


class Rule(Protocol):
    """``run(state, rows)`` gives the next state and a list of values per output column; a state is a list of numbers."""

    start: State
    outputs: str

    def run(self, state: State, rows: pd.DataFrame) -> tuple[State, dict[str, list]]: ...


def _fields(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _state(cells) -> State:
    """Arrow turns NaN inside lists into NULL."""
    return [math.nan if v is None else float(v) for v in cells]


def _run_blocks(rows: DataFrame, keys: list[str], pos: str, rule: Rule, version: int, names: list[str], schema: str) -> DataFrame:
    """Each (key, block) group from ``_given``, or from a guess over the rows that belong to the block before."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(pos, kind="stable")
        own = part["_own"].to_numpy(dtype=bool)
        given = part["_given"].iloc[-1]
        mine = part[own]
        if mine.empty:
            return pd.DataFrame()
        entry = rule.run(list(rule.start), part[~own])[0] if given is None else _state(given)
        ends, values = rule.run(list(entry), mine)
        blank = [None] * (len(mine) - 1)
        return mine[names].assign(**values, _block=mine["_block"], _version=version, _entry=[*blank, entry], _exit=[*blank, ends])

    return rows.groupBy(*keys, "_block").applyInPandas(run, schema)


def speculated(df: DataFrame, keys: Sequence[str], rule: Rule, pos: str = "pos", rows: int = BLOCK_ROWS, warmup: int = WARMUP_ROWS,
               rounds: int = REPLAYS, replays: list[int] | None = None) -> DataFrame:
    """``df`` with the rule's outputs, its rows taken in order of ``pos`` per key; ``replays`` collects the blocks replayed per round.

    Positions are whole numbers, distinct per key; gaps are allowed.  A task holds ``rows`` + ``warmup`` rows of one key.
    """
    if not 0 <= warmup <= rows:
        raise ValueError("the warm-up must not be longer than a block")
    keys, names = list(keys), df.columns
    schema = f"{_fields(df)}, {rule.outputs}, _block long, _version int, _entry array<double>, _exit array<double>"
    own = F.floor(F.col(pos) / rows)
    spread = (df.withColumn("_block", F.explode(F.sequence(own, F.floor((F.col(pos) + warmup) / rows))))
              .withColumn("_own", F.col("_block") == own).withColumn("_given", F.lit(None).cast("array<double>")))
    parts = [stored(_run_blocks(spread, keys, pos, rule, 0, names, schema), "speculated")]
    ends = _ends(parts[0], keys)
    order = Window.partitionBy(*keys).orderBy("_block")
    for version in range(1, rounds + 2):
        linked = ends.withColumn("_given", F.lag("_exit").over(order))
        wrong = linked.where(F.col("_given").isNotNull() & ~F.col("_entry").eqNullSafe(F.col("_given")))
        wrong = stored(wrong.select(*keys, "_block", "_given"), "wrong-blocks")
        left = wrong.count()
        if left == 0:
            break
        if version > rounds:
            first = wrong.groupBy(*keys).agg(F.min_by("_given", "_block").alias("_given"), F.min("_block").alias("_from"))
            rest = df.join(first, keys).where(own >= F.col("_from"))
            done = _joined(parts, ends, keys).join(first.select(*keys, "_from"), keys, "left").where(
                F.col("_from").isNull() | (F.col("_block") < F.col("_from")))
            return done.select(*names, *_outputs(rule)).unionByName(_in_order(rest, keys, pos, rule, names, _fields(df)))
        if replays is not None:
            replays.append(left)
        again = df.withColumn("_block", own).join(wrong, [*keys, "_block"]).withColumn("_own", F.lit(True))
        parts.append(stored(_run_blocks(again, keys, pos, rule, version, names, schema), "replayed"))
        new = _ends(parts[-1], keys)
        ends = stored(ends.join(new, [*keys, "_block"], "left_anti").unionByName(new), "block-ends")
    return _joined(parts, ends, keys).select(*names, *_outputs(rule))


def _outputs(rule: Rule) -> list[str]:
    return [f.split()[0] for f in rule.outputs.split(", ")]


def _ends(part: DataFrame, keys: list[str]) -> DataFrame:
    return part.where(F.col("_exit").isNotNull()).select(*keys, "_block", "_version", "_entry", "_exit")


def _joined(parts: list[DataFrame], ends: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each block's last run."""
    if len(parts) == 1:
        return parts[0]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.drop("_entry", "_exit").join(ends.select(*keys, "_block", "_version"), [*keys, "_block", "_version"])


def _in_order(df: DataFrame, keys: list[str], pos: str, rule: Rule, names: list[str], fields: str) -> DataFrame:
    """Each key's rows in order from ``_given``, an Arrow batch at a time: memory holds one batch and one state."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            codes = pd.Series(list(pdf[keys].itertuples(index=False, name=None)), index=pdf.index)
            starts = [i for i in range(len(codes)) if i == 0 or codes.iloc[i] != codes.iloc[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(codes)]):
                part = pdf.iloc[a:b]
                if codes.iloc[a] != current:
                    current, state = codes.iloc[a], _state(part["_given"].iloc[0])
                state, values = rule.run(state, part)
                yield part[names].assign(**values)

    ordered = df.select(*names, "_given").repartition(*keys).sortWithinPartitions(*keys, pos)
    return ordered.mapInPandas(run, f"{fields}, {rule.outputs}")
