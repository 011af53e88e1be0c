"""Each operator on odd rows, on no rows and on tables with clashing columns."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import forest, grammar, linefilter, lookup, packing, suffixes, templates, toxicity
from tidemark.session import scratch


def _model():
    import numpy as np
    return toxicity.Model(np.zeros(1 << toxicity.BITS, dtype=np.float32), -1.0)


def _grammar(df):
    path = scratch(df.sparkSession, "test-grammar")
    grammar.write(df, path)
    return grammar.read(df.sparkSession, path).drop("ids")


def _leaks(df):
    items = df.sparkSession.createDataFrame([(7, "no such item text anywhere in these rows at all"), (None, None), (8, "")], "item_id long, text string")
    return templates.matches(df, items)


PER_ROW = {"toxicity": lambda d: toxicity.score(d, _model()), "lines": linefilter.assess, "grammar": _grammar, "forest": forest.near_duplicates,
           "suffixes": suffixes.deduplicated, "lookup": lambda d: lookup.place(d, F.col("doc_id"), ["a", "b", "c"], 101, spread=F.col("text"))}
ALL = PER_ROW | {"packing": packing.pack, "leaks": _leaks}
KEEPERS = {"toxicity": lambda d: toxicity.not_toxic(d, _model()), "forest": forest.one_of_each, "suffixes": suffixes.without_repeats,
           "leaks": lambda d: templates.clean(d, d.sparkSession.createDataFrame([(7, "no such text")], "item_id long, text string"))}


def _rows(df, columns):
    return sorted(map(repr, df.select(*columns).collect()))


@pytest.mark.parametrize("name", ALL)
def test_odd_rows_and_clashing_columns(name, odd_docs, clashing, no_docs):
    run = ALL[name]
    got = run(odd_docs)
    own = [c for c in got.columns if c not in clashing.columns or c in ("doc_id", "slot", "shard", "text_key", "score")]
    stable = [c for c in own if c not in ("sequence_id", "offset", "capacity", "sequence_cost", "start")]
    if name in PER_ROW:
        assert got.count() == odd_docs.count()
    assert _rows(got, stable) == _rows(run(clashing), stable)
    assert run(no_docs).count() == 0


@pytest.mark.parametrize("name", KEEPERS)
def test_filters_keep_columns(name, clashing, no_docs):
    got = KEEPERS[name](clashing)
    assert got.columns == clashing.columns and 0 < got.count() <= clashing.count()
    assert KEEPERS[name](no_docs).count() == 0
