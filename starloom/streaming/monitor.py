"""Energy of snapshot files as they arrive: a file stream, one aggregate per snapshot, exactly once per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "step int, id bigint, x double, y double, z double, vx double, vy double, vz double, mass double"


def snapshot_stream(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(path)


def kinetic(stream: DataFrame) -> DataFrame:
    """(step, n, kinetic), kept up to date over all files of a step; state is one row a step."""
    v2 = F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz")
    return stream.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("mass") * v2 / 2).alias("kinetic"))


def monitor(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the table of every finished batch to ``out``/batch=i and ends when all files there are are read."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    q = kinetic(snapshot_stream(spark, path)).writeStream.outputMode("complete").foreachBatch(write)
    return q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
