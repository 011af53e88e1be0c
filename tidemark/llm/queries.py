"""Registered queries of the text operators, with their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, stored
from . import extraction, forest, grammar, linefilter, lookup, oracles, packing, resync, signatures, spellings, suffixes, templates, toxicity, warc
from .common import table
from .tokens import vocabulary

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = oracles.SQL


def query(run: Run) -> Run:
    QUERIES[run.__name__] = run
    return run


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, folder, "labels")))


@query
def op2_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return linefilter.assess(table(spark, folder, "documents"))


@query
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query
def op4_template_leaks(spark: SparkSession, folder: str) -> DataFrame:
    found = templates.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "changed_slots")


@query
def op5_grammar_shards(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "grammar")
    grammar.write(table(spark, folder, "documents"), path)
    return grammar.read(spark, path).drop("ids")


@query
def op7_warc_salvage(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(table(spark, folder, "pages"), path)
    return (warc.read(spark, path, payloads=False).where("kind = 'record'")
            .select(F.col("record_id").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                    F.col("refers_to").try_cast("long").alias("refers_to")))


@query
def op9_lookup_placement(spark: SparkSession, folder: str) -> DataFrame:
    names = [f"shard-{k:02d}" for k in range(lookup.SHARDS)]
    placed = lookup.place(table(spark, folder, "documents"), F.col("doc_id"), names, spread=F.col("text"))
    return placed.select("doc_id", "slot", "shard")


@query
def op10_block_labeller(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return extraction.extract(pages, extraction.train(pages))


@query
def op8_minhash_forest(spark: SparkSession, folder: str) -> DataFrame:
    found = forest.near_duplicates(table(spark, folder, "documents"))
    named = stored(found.groupBy("class_key").agg(F.min("doc_id").alias("class_id")), "class-names")
    return found.join(named, "class_key").select("doc_id", "class_id", "n_links")


@query
def op6_suffix_merge(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, folder, "documents"))


@query
def op11_bloom_slices(spark: SparkSession, folder: str) -> DataFrame:
    return signatures.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op12_trie_frontier(spark: SparkSession, folder: str) -> DataFrame:
    return spellings.group(table(spark, folder, "documents"))


@query
def op13_resync_counts(spark: SparkSession, folder: str) -> DataFrame:
    return resync.count(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))
