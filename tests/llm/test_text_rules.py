import tracemalloc
import zlib

import numpy as np
import pytest

import __spark_entry__ as contract
from tidemark.llm import lookup, queries, templates, toxicity
from tools.compare import difference, oracle_connection

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    assert difference(got, oracle_connection(FOLDER).execute(queries.ORACLES[name]).df()) is None


def test_all_operators_and_the_pipeline_are_registered():
    names = set(contract.queries())
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} and "pipeline" in names


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id)
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit >= 0.85 * (got.toxic == 1).sum() and hit >= 0.95 * (got.predicted == 1).sum()


def test_repeated_ids_take_no_places_of_the_other_class(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    once = toxicity.train(docs, labels, 40, 60)
    twice = toxicity.train(docs.union(docs), labels, 40, 60)
    assert once.weights.any() and np.array_equal(once.weights, twice.weights) and once.bias == twice.bias
    # an id of the sample that a third of all rows share: it fills the free places of its own class only, after every other id
    mild = min(r["doc_id"] for r in docs.join(labels, "doc_id").where("toxic = 0").where(~toxicity.held_out(labels["doc_id"])).select("doc_id").collect())
    few = docs.join(labels.where("toxic = 1"), "doc_id").select(*docs.columns).union(docs.where(f"doc_id = {mild}"))
    hot = few.union(spark.range(3_000).selectExpr(f"{mild} as doc_id", "concat('quiet words number ', id) as text"))
    got = toxicity.train(hot, labels.where(f"toxic = 1 or doc_id = {mild}"), 40, 60)
    assert got.weights.any()


def test_sample_holds_every_id_before_any_second_text(spark):
    keys = spark.createDataFrame([(1, 0, k) for k in range(500)] + [(d, 0, d) for d in range(2, 12)] + [(50, 1, 1), (50, 1, 2)], "doc_id long, label int, _key long")
    got = toxicity.one_text_first(keys, {1: 5, 0: 20}).collect()
    assert len(got) == len(set(got)) == 22 and {r["doc_id"] for r in got} == {*range(1, 12), 50} and sum(r["label"] for r in got) == 2


def test_the_driver_never_holds_the_sample(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    tracemalloc.start()
    try:
        model = toxicity.train(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.weights.any() and peak < 3 * model.weights.nbytes


def test_constant_model_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = toxicity.train(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    assert toxicity.score(docs, none).where("score between 0 and 1").count() == 2


def test_table_is_even_and_steady():
    names = [f"s{k}" for k in range(10)]
    full = np.array(lookup.fill(names, 1009))
    counts = np.bincount(full)
    assert counts.max() - counts.min() <= 1
    fewer = np.array(lookup.fill(names[:-1], 1009))
    assert (full[full < 9] != fewer[full < 9]).mean() < 0.1
    assert np.bincount(lookup.fill(names, 1009, {"s0": 3}))[0] > 2.5 * counts[1] * 10 / 12
    with pytest.raises(ValueError):
        lookup.fill(names, 1000)


def test_reparameterised_items_are_found_and_slots_must_agree(spark):
    item = "when Alice buys 12 apples for 3 dollars and then sells 12 apples to Bob what does Alice keep"
    docs = [(1, "Filler words go first. when Carol buys 40 apples for 7 euros and then sells 40 apples to Dan what does Carol keep and so on"),
            (2, "when Carol buys 40 apples for 7 euros and then sells 41 apples to Dan what does Carol keep"),
            (3, "nothing of the kind is said here, only that apples were sold by Alice to Bob for 12 dollars"), (4, item)]
    got = templates.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item), (10, item)], "item_id long, text string"))
    found = {(r["doc_id"], r["item_id"]): r["changed_slots"] for r in got.collect()}
    assert set(found) == {(1, 9), (4, 9)} and found[1, 9] > 0 and found[4, 9] == 0


def test_short_items_are_found_wherever_they_stand(spark):
    nine, five = "What is the capital city of France and Spain", "Name 3 red fruits quickly"
    items = [(1, nine), (2, five), (3, "42"), (4, "Paris"), (5, "Days go by and nobody ever counts them here")]
    docs = [(1, f"and as shown here {nine} we say"), (2, f"as shown here {five} and so on"), (3, "here 7 more and Berlin too"), (4, "so 42 it is"),
            (5, "we went to Paris once"), (6, nine), (7, "please, name 8 red fruits quickly or go"), (8, "all 12 Days go by and nobody ever counts them here"),
            (9, "here Give 3 red fruits quickly"), (10, None)]
    got = templates.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): (r["n_windows"], r["changed_slots"]) for r in got} == {
        (1, 1): (2, 0), (2, 2): (1, 0), (4, 3): (1, 0), (5, 4): (1, 0), (6, 1): (2, 0), (7, 2): (1, 1), (8, 5): (2, 0)}


def test_the_join_beyond_the_broadcast_bound_gives_the_same(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    want = sorted(map(tuple, templates.matches(docs, items).collect()))
    monkeypatch.setattr(templates, "BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, templates.matches(docs, items).collect())) == want
