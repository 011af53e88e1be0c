"""Benchmark decontamination by template: finds benchmark items in documents even if their numbers, names and units were changed.

Tokens are words and numbers.  In the template of a token a number is ``<num>``, a word of :data:`UNITS` after a number ``<unit>``,
a capitalised word inside a sentence ``<name>``, and any other word its lower case.  Windows of ``width`` template tokens are hashed
and joined with those of the benchmark.  Matches of one document and item on one diagonal (document position less item position) are
counted; with ``least`` of them (or all the windows the item has) the item is in the document, provided the slots
agree: along the diagonal, a value of the item always stands for the same value in the document.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import unused

WIDTH = 8
LEAST = 3
BROADCAST_WINDOWS = 500_000
ENDERS = ".!?:\n"
TOKEN = r"(?:[.!?:\n][^\p{L}\p{N}]*)?(?:\p{L}+|\p{N}+(?:[.,]\p{N}+)*)"
UNITS = ("mm cm m km g kg mg lb lbs oz ml l cl s sec seconds minute minutes min h hour hours day days week weeks month months year years "
         "inch inches foot feet ft yard yards mile miles percent dollar dollars euro euros cent cents degree degrees litre litres liter liters "
         "meter meters metre metres gram grams kilogram kilograms kilometer kilometers kilometre kilometres pound pounds").split()


def tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``_template`` and ``_slots`` (the raw token where the template has a placeholder, else NULL), arrays of one length."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    opens = "ascii(t) in (46, 33, 63, 58, 10)"
    first_digit = "ascii(w) between 48 and 57 or (ascii(w) > 127 and w rlike '^\\\\p{N}')"
    previous = "get(_words, i - 1)"
    previous_digit = f"ascii({previous}) between 48 and 57 or (ascii({previous}) > 127 and {previous} rlike '^\\\\p{{N}}')"
    template = f"""transform(_words, (w, i) -> case
        when {first_digit} then '<num>'
        when i > 0 and ({previous_digit}) and lower(w) in ({units}) then '<unit>'
        when i > 0 and not get(_starts, i) and length(w) > 1 and lower(w) != w and lower(substr(w, 2)) = substr(w, 2) then '<name>'
        else lower(w) end)"""
    return (df.withColumn("_found", F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)))
            .withColumn("_starts", F.expr(f"transform(_found, t -> {opens})"))
            .withColumn("_words", F.expr("transform(_found, (t, i) -> if(get(_starts, i), regexp_replace(t, '^[^\\\\p{L}\\\\p{N}]+', ''), t))"))
            .withColumn("_template", F.expr(template))
            .withColumn("_slots", F.expr("transform(_template, (t, i) -> if(ascii(t) = 60, get(_words, i), null))"))
            .drop("_found", "_starts", "_words"))


def windows(df: DataFrame, *keys: str, width: int = WIDTH, shorter: list[int] | None = None) -> DataFrame:
    """(keys, position, window hash, slot values of the window or NULL if it has none), a row for each window of each text.

    The windows are of ``width`` tokens and of each of the lengths ``shorter``.
    """
    made = ", ".join(f"""transform(if(size(_template) >= {n}, sequence(1, size(_template) - {n - 1}), array()), i -> struct(
        cast(i - 1 as int) as at, xxhash64(slice(_template, i, {n})) as window,
        if(size(_some) > 0, array_compact(slice(_slots, i, {n})), null) as slots))""" for n in [width, *(shorter or [])])
    return (tokens(df).withColumn("_some", F.array_compact("_slots"))
            .select(*keys, F.explode(F.expr(f"concat({made})" if shorter else made)).alias("_w"))
            .select(*keys, F.col("_w.at").alias("at"), F.col("_w.window").alias("window"), F.col("_w.slots").alias("slots")))


def item_tokens(items: DataFrame) -> DataFrame:
    """(item_id, _template, _slots, _n, _first) of (item_id, text), written once: many windows read the tokens of an item."""
    made = tokens(items).withColumn("_n", F.size("_template")).where("_n > 0").withColumn("_first", F.regexp_extract("text", r"\p{L}+|\p{N}+", 0))
    return stored(made.drop("text"), "item-tokens")


def asked_windows(made: DataFrame, width: int, least: int) -> DataFrame:
    """(item_id, item_at, window, item_slots, item_windows, verbatim) of the items' tokens: the windows to look for.

    An item shorter than ``width`` has one window of its full length.  Where all windows of an item must match, its first one is there in
    each form the first word can take behind other text (plain, ``<name>``, ``<unit>``), as one position.  The first ``verbatim`` slots
    must be the item's own: in an item shorter than ``width`` those of a window without any plain word, and the first word.
    """
    units = ", ".join(f"'{u}'" for u in UNITS)
    made = made.withColumn("_width", F.least(F.lit(width), F.col("_n"))).withColumn("item_windows", F.col("_n") - F.col("_width") + 1)
    strict = made.select("item_id", "item_windows", "_width", "_n", F.posexplode(F.expr("transform(sequence(1, item_windows), i -> struct(slice(_template, i, _width) as t, slice(_slots, i, _width) as s))")).alias("item_at", "_w"))
    others = (made.where((F.col("item_windows") <= least) & (F.element_at("_template", 1) != "<num>"))
              .withColumn("_form", F.explode(F.expr(f"""array_compact(array(
                  if(length(_first) > 1 and lower(_first) != _first and lower(substr(_first, 2)) = substr(_first, 2), '<name>', null),
                  if(lower(_first) in ({units}), '<unit>', null)))""")))
              .select("item_id", "item_windows", "_width", "_n", F.lit(0).alias("item_at"), F.expr(
                  """struct(concat(array(_form), slice(_template, 2, _width - 1)) as t, concat(array(_first), slice(_slots, 2, _width - 1)) as s)""").alias("_w"), F.lit(1).alias("_lead")))
    bare = F.forall("_w.t", lambda t: F.ascii(t) == 60)
    verbatim = F.when(F.col("_n") >= width, 0).when(bare, F.col("_n")).otherwise(F.col("_lead"))
    return (strict.withColumn("_lead", F.lit(0)).unionByName(others)
            .select("item_id", "item_at", F.xxhash64("_w.t").alias("window"), F.array_compact("_w.s").alias("item_slots"), F.col("item_windows").cast("long"),
                    verbatim.cast("int").alias("verbatim")))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def matches(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """(doc_id, text_key, item_id, n_windows, changed_slots): documents that hold a benchmark item or a re-parameterised one.

    Items with one text are taken as one, under their smallest id.  Items of fewer than ``width`` tokens are found by one window of their
    length, items without any token never.  NULL texts hold nothing, ids may be NULL, repeated documents are reported once for each
    distinct (doc_id, text), further columns are ignored, an empty table on either side gives no rows.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = (benchmark.where(F.col("text").isNotNull()).groupBy(F.col("text").cast("string").alias("text"))
             .agg(F.min(F.col("item_id").cast("long")).alias("item_id")))
    made = item_tokens(items)
    asked = stored(asked_windows(made, width, least), "item-windows")
    shorter = sorted(r["_n"] for r in made.where(F.col("_n") < width).select("_n").distinct().collect())
    if asked.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        asked = F.broadcast(asked)
    hits = windows(docs, "doc_id", "text_key", width=width, shorter=shorter).join(asked, "window")
    if shorter:
        hits = hits.where((F.col("verbatim") == 0) | (F.slice("item_slots", 1, F.col("verbatim")) == F.slice("slots", 1, F.col("verbatim"))))
    same = ["doc_id", "text_key", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")]
    pairs = F.when(F.col("slots").isNotNull() & (F.size("slots") > 0), F.arrays_zip(F.col("item_slots").alias("asked"), F.col("slots").alias("given")))
    runs = (hits.groupBy(*same).agg(F.count_distinct("at").alias("n_windows"), F.max("item_windows").alias("item_windows"),
                                    F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
            .where(F.col("n_windows") >= F.least(F.lit(least), F.col("item_windows")))
            .where(F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["asked"])))))
    return (runs.groupBy("doc_id", "text_key", "item_id")
            .agg(F.max("n_windows").alias("n_windows"),
                 F.min(F.size(F.filter("pairs", lambda p: p["asked"] != p["given"]))).cast("long").alias("changed_slots")))


def clean(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """``documents`` without those that hold a benchmark item, with the same columns; every copy of such a document goes."""
    doc, key = unused(documents, "_doc", "_key")
    found = matches(documents, benchmark, width, least).select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (text_key(F.col("text")) == F.col(key))
    return documents.join(found, same, "left_anti")
