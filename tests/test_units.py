"""Units of work that fail, are recorded, and are taken up again."""

from pyspark.sql import functions as F

from tidemark.session import scratch
from tidemark.sources import records


def test_a_broken_unit_is_skipped_and_rerun(spark):
    rows = spark.createDataFrame([(v, s, float(10 * s + i)) for v in "ab" for s in range(5) for i in range(3)], "variant string, seed long, x double")
    units = rows.select("variant", "seed").distinct()
    path, ledger, ran = scratch(spark, "units"), scratch(spark, "ledger"), []

    def run(broken):
        def each(batch):
            ran.append(batch.count())
            bad = (F.col("variant") == "b") & F.col("seed").isin(broken)
            return rows.join(batch, ["variant", "seed"]).withColumn("x", F.when(bad, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("x")))
        return records.run_units(units, ["variant", "seed"], each, path, ledger)

    first = {(r["variant"], r["seed"]): (r["finished"], r["error"]) for r in run([1, 3]).collect()}
    assert len(first) == 10 and {k for k, v in first.items() if not v[0]} == {("b", 1), ("b", 3)}
    assert all("broken" in v[1] for v in first.values() if not v[0])
    assert spark.read.parquet(path).count() == 24
    ran.clear()
    assert run([]).where("finished").count() == 10 and ran == [2]
    assert sorted(r["x"] for r in spark.read.parquet(path).collect()) == sorted(r["x"] for r in rows.collect())
    ran.clear()
    run([])
    assert ran == []
