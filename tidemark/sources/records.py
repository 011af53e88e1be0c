"""Scenario outputs and replication records."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import wilson
from ..session import stored

# Bands of the calibration reading.
VARIANT_LOW, VARIANT_HIGH, PIPELINE_LIMIT = 0.025, 0.10, 0.15

AUDIT_SCHEMA = ("world string, seed bigint, candidate string, gate_a map<string,boolean>, "
                "passed_all map<string,boolean>, excess_lower95 map<string,double>, dev_end string, elapsed_s double")


def write_scenarios(df: DataFrame, path: str, *by: str) -> DataFrame:
    """One folder per scenario; a repeated run replaces only the scenarios it holds."""
    (df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by).parquet(path))
    return df.sparkSession.read.parquet(path)


def run_units(units: DataFrame, keys: list[str], run: Callable[[DataFrame], DataFrame], path: str, ledger: str) -> DataFrame:
    """Run ``run(units) -> rows with the unit's keys`` for every unit that the ledger does not call finished; returns the ledger.

    Pending units run as one job, written as one folder per unit.  If the job fails, its units are split in two by the hash of
    their keys and each part runs alone, down to the unit that fails; that one is recorded with its error and skipped, all others
    are kept.  A later call takes up failed and missing units only.  Rows are written before the ledger, and a repeated unit
    replaces its own folder, so a lost driver costs the units of one job.  Units are distinct by their keys and no key is NULL.
    """
    spark = units.sparkSession
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.select(*keys).schema) + ", finished boolean, error string"
    spark.createDataFrame([], schema).write.mode("append").parquet(ledger)
    done = spark.read.schema(schema).parquet(ledger).where("finished").select(*keys)
    pending = stored(units.join(done, keys, "left_anti").withColumn("_hash", F.xxhash64(*keys)), "pending-units")
    parts = [(-2**63, 2**63 - 1)]
    while parts:
        low, high = parts.pop()
        batch = pending.where(F.col("_hash").between(low, high)).drop("_hash")
        n = batch.count()
        if n == 0:
            continue
        error = None
        try:
            write_scenarios(run(batch), path, *keys)
        except (PySparkException, Py4JJavaError) as failure:
            if n > 1 and low < high:
                middle = (low + high) // 2
                parts += [(middle + 1, high), (low, middle)]
                continue
            error = str(failure)[:2000]
        batch.select(*keys, F.lit(error is None).alias("finished"), F.lit(error).cast("string").alias("error")).write.mode("append").parquet(ledger)
    return spark.read.schema(schema).parquet(ledger)


def read_audit(spark: SparkSession, path: str, wrapped: bool = False) -> DataFrame:
    """Replication records: JSON lines, or whole files holding {"records": [...]}."""
    if not wrapped:
        return spark.read.schema(AUDIT_SCHEMA).json(path)
    whole = spark.read.schema(f"records array<struct<{_struct(AUDIT_SCHEMA)}>>").option("multiLine", True).json(path)
    return whole.select(F.explode("records").alias("r")).select("r.*")


def _struct(schema: str) -> str:
    fields, depth, start = [], 0, 0
    for i, ch in enumerate(schema + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = schema[start:i].strip().split(" ", 1)
            fields.append(f"{name}:{kind}")
            start = i + 1
    return ",".join(fields)


def gate_rows(audit: DataFrame) -> DataFrame:
    return audit.select("world", "seed", "candidate", F.explode("gate_a").alias("variant", "hit"))


def false_alarm_rates(audit: DataFrame) -> DataFrame:
    """Rates per variant test and per replication, with Wilson intervals and the calibration reading."""
    per_run = audit.select("world", F.size("gate_a").cast("long").alias("_tests"),
                           F.size(F.filter(F.map_values("gate_a"), lambda v: v)).cast("long").alias("_hits"), "candidate")
    r = per_run.groupBy("world").agg(
        F.count(F.lit(1)).alias("replications"), F.sum("_tests").alias("tests"),
        F.sum("_hits").alias("variant_hits"), F.count("candidate").alias("pipeline_hits"))
    vl, vh = wilson(F.col("variant_hits"), F.col("tests"))
    pl, ph = wilson(F.col("pipeline_hits"), F.col("replications"))
    r = r.withColumns({
        "fa_variant": F.when(F.col("tests") > 0, F.col("variant_hits") / F.col("tests")).otherwise(0.0),
        "fa_pipeline": F.when(F.col("replications") > 0, F.col("pipeline_hits") / F.col("replications")).otherwise(0.0),
        "variant_low": vl, "variant_high": vh, "pipeline_low": pl, "pipeline_high": ph})
    v, p = F.col("fa_variant"), F.col("fa_pipeline")
    return r.withColumns({
        "calibrated": v.between(VARIANT_LOW, VARIANT_HIGH), "selection_inflated": p > PIPELINE_LIMIT,
        "reading": F.when(v > VARIANT_HIGH, "miscalibrated").when(v < VARIANT_LOW, "conservative")
        .when(p > PIPELINE_LIMIT, "selection inflated").otherwise("passed")})


def clustered_rates(rows: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """Rate interval with the replication as the cluster: spread of the per-seed means."""
    per_seed = rows.groupBy("world", "seed").agg(F.avg(F.col("hit").cast("double")).alias("_r"))
    out = per_seed.groupBy("world").agg(
        F.count(F.lit(1)).alias("replications"), F.avg("_r").alias("rate"),
        (F.stddev_samp("_r") / F.sqrt(F.count(F.lit(1)))).alias("standard_error"))
    return (out.withColumn("low", F.col("rate") - z * F.col("standard_error"))
            .withColumn("high", F.col("rate") + z * F.col("standard_error")))


def rate_difference(main: DataFrame, control: DataFrame) -> DataFrame:
    a = clustered_rates(main).select("world", F.col("rate").alias("main_rate"), F.col("standard_error").alias("_a"))
    b = clustered_rates(control).select("world", F.col("rate").alias("control_rate"), F.col("standard_error").alias("_b"))
    return a.join(b, "world").withColumn("z", F.try_divide(
        F.col("main_rate") - F.col("control_rate"), F.sqrt(F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b"))))
