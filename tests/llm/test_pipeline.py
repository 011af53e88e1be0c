"""Every stage of the pipeline against a brute-force version on its own input."""

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark import session
from tidemark.llm import forest, oracles, toxicity
from tidemark.llm.tokens import vocabulary

from .test_duplicates import _brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The input of each stage, and the last result, as pandas frames; the first text of the table is NULL."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas().sort_values("doc_id", ignore_index=True)
    docs.loc[0, "text"] = None
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, spark.createDataFrame(frames[-1]), FOLDER).toPandas())
    return frames


def test_stages_are_named_and_ordered():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["drop_toxic", "one_of_each_class", "cut_repeats", "drop_leaks", "pack_sequences"]


def test_columns_stay(steps):
    assert all(list(f.columns) == list(steps[0].columns) for f in steps[:-1])


def test_toxic_documents_go(spark, steps):
    model = toxicity.train(spark.createDataFrame(steps[0]), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = {d for d, t in zip(steps[0].doc_id, steps[0].text) if model.score([t or ""])[0] < toxicity.THRESHOLD}
    assert set(steps[1].doc_id) == want and 0 < len(want) < len(steps[0])


def test_one_of_each_class_stays(steps):
    shingler = forest.Shingler()
    before = steps[1].sort_values("doc_id", ignore_index=True)
    texts = [t if isinstance(t, str) else "" for t in before.text]
    links = forest.linked([shingler.shingles(t) for t in texts], 0.8)
    links |= np.array([[a == b for b in texts] for a in texts])
    assert set(steps[2].doc_id) == set(before.doc_id[np.unique(forest._heads(links))]) and len(steps[2]) < len(before)


def test_repeated_strings_are_cut(steps):
    texts = [t if isinstance(t, str) else "" for t in steps[2].text]
    sizes = {d: n - gone for d, (n, gone, _, _) in zip(steps[2].doc_id, _brute([t.encode() for t in texts], 200))}
    assert {d: len((t or "").encode()) for d, t in zip(steps[3].doc_id, steps[3].text.where(steps[3].text.notna(), None))} == pytest.approx(sizes, abs=6)
    assert all(n == len(t) for n, t in zip(steps[3].n_chars, steps[3].text) if isinstance(t, str))


def test_leaks_go(steps):
    con = duckdb.connect()
    con.register("documents", steps[3])
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{FOLDER}/benchmark.parquet')")
    leaks = set(con.execute(oracles.SQL["op4_template_leaks"]).df().doc_id)
    assert set(steps[4].doc_id) == set(steps[3].doc_id) - leaks


def test_packed_pieces_hold_every_token(steps):
    tokenizer = Tokenizer.from_file(vocabulary())
    want = {d: len(tokenizer.encode(t if isinstance(t, str) else "", add_special_tokens=False).ids) + 1 for d, t in zip(steps[4].doc_id, steps[4].text)}
    assert steps[5].groupby("doc_id").length.sum().to_dict() == want
    assert steps[5].groupby("sequence_id").length.sum().max() <= 4096


def test_run_applies_all_stages(spark, steps):
    got = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert isinstance(got, pd.DataFrame) and set(got.columns) == set(steps[5].columns) and len(got)


def test_stages_hand_texts_to_python_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    def probe(spark, docs, folder):
        return docs.select(docs["text"]).mapInArrow(sizes, "n long")

    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('abcdefgh', 1000) AS text")
    got = [r.n for r in corpus_pipeline.in_small_batches(probe)(spark, docs, FOLDER).collect()]
    assert sum(got) > 3000 * 8000 and max(got) < 2 * session.BATCH_BYTES
    spark.conf.set(name, "1000000")
    session.small_batches(spark)
    assert spark.conf.get(name) == "1000000"
    spark.conf.unset(name)
