"""Session, table reading and scratch tables that cut long lineages.

Scratch tables are Parquet, written through Spark's commit protocol below the folder named by
``spark.checkpoint.dir``: they survive the loss of any executor, and reading them is columnar.
Only in a local session without that setting (tests, a laptop) a folder of this process is used instead; on a
cluster it is an error.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
_RUNS: list[Scratch] = []
_SHIPPED: set[str] = set()


def session(master: str = "local[8]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(master)
        .appName("starloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application, so that functions run
    on Arrow batches find it wherever the driver was started."""
    sc = spark.sparkContext
    here = Path(__file__).parent
    if sc.applicationId in _SHIPPED or not here.is_dir():
        return
    _SHIPPED.add(sc.applicationId)
    folder = tempfile.mkdtemp(prefix="starloom-code-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/{here.name}.zip", "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"{here.name}/{f.relative_to(here)}")
    sc.addPyFile(f"{folder}/{here.name}.zip")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="starloom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return f"file://{_LOCAL[0]}"


class Scratch:
    """Tables of one operator run. ``keep`` writes and reads back; ``drop`` deletes a superseded one. What is left
    is what results still read; it goes with :func:`clear`, at the latest when the process ends."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/starloom-{what}-{uuid.uuid4().hex[:12]}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        self._n = 0
        ship(spark)
        _RUNS.append(self)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self._n}"
        self._n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def keep_counted(self, df: DataFrame, where: Column | None = None) -> tuple[DataFrame, int]:
        """The kept table and its number of rows (under a condition), counted while it is written."""
        seen = Observation()
        out = self.keep(df.observe(seen, F.count(F.lit(1) if where is None else F.when(where, 1)).alias("n")))
        return out, int(seen.get["n"])

    def together(self, tables: list[DataFrame]) -> DataFrame:
        """Kept tables of one schema as a single scan, where a union would plan each of them."""
        return self.spark.read.schema(tables[0].schema).parquet(*[self._paths[id(t)][1] for t in tables])

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            if id(t) in self._paths:
                path = jvm.org.apache.hadoop.fs.Path(self._paths.pop(id(t))[1])
                path.getFileSystem(conf).delete(path, True)

    def drop_all(self) -> None:
        self.drop(*[t for t, _ in self._paths.values()])


@atexit.register
def clear() -> None:
    """Deletes the scratch tables of all runs so far; results not yet written can't be read any more."""
    while _RUNS:
        run = _RUNS.pop()
        try:
            jvm = run.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(run.base)
            path.getFileSystem(run.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the session may have ended
            pass


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
