"""Snapshots: Parquet, ORC, JSON and CSV with a metadata table beside them; spectra as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv")


def export_snapshot(df: DataFrame, path: str, fmt: str = "parquet", meta: dict[str, float] | None = None, by: list[str] | None = None) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"formats are {', '.join(FORMATS)}")
    w = df.write.mode("overwrite")
    if by:
        w = w.partitionBy(*by)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(f"{path}/data")
    rows = [(k, float(v)) for k, v in (meta or {}).items()]
    df.sparkSession.createDataFrame(rows, "key string, value double").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def import_snapshot(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """The rows, under the schema given: nothing is inferred."""
    r = spark.read.schema(schema)
    return (r.option("header", True) if fmt == "csv" else r).format(fmt).load(f"{path}/data")


def metadata(spark: SparkSession, path: str) -> dict[str, float]:
    return {r["key"]: r["value"] for r in spark.read.schema("key string, value double").json(f"{path}/meta").collect()}


def save_spectrum(ps: DataFrame, path: str, box: float, n: int, shot: float) -> None:
    """Text with four comment lines, then k, power, modes and error of every bin with modes; bins are few."""
    head = ["# k [h/Mpc]  P(k) [(Mpc/h)^3]  N_modes  Error", f"# Box size: {box} Mpc/h", f"# Grid size: {n}", f"# Shot noise: {shot}"]
    spark = ps.sparkSession
    top = spark.createDataFrame([(i - len(head), v) for i, v in enumerate(head)], "o int, value string")
    rows = ps.where("modes > 0").select(F.col("bin").alias("o"), F.format_string("%.12g %.12g %d %.12g", "k", "power", "modes", F.col("power") / F.sqrt("modes")).alias("value"))
    top.unionByName(rows).orderBy("o").coalesce(1).select("value").write.mode("overwrite").text(path)


def load_spectrum(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("k double, power double, modes long, error double").option("sep", " ").option("comment", "#").csv(path)
