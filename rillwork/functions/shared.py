"""What executors share with the driver: tables that cut a plan's lineage, and this package's code."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Applications whose executors have this package.
_shipped: set[str] = set()
#: Folders that go when the driver ends.
_scratch: set[str] = set()
#: For each scope of `freed` that is open, the tables cut in it.
_scopes: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("_scopes", default=())


#: Rows that go to a Python worker at a time where the session has Spark's own setting: of texts these are some megabytes.
ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Pieces in which a write with `parts` reads files and merges partitions.
_SMALL = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m", "spark.sql.files.maxPartitionBytes": "16m"}
#: Whether a query's shuffle files go when it has ended, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once an application: their Python workers needn't have it installed.

    Also sets the rows of an Arrow batch to ROWS, unless the session has a setting of its own.
    """
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, ROWS)
    sc, top = spark.sparkContext, Path(__file__).resolve().parents[1]
    if sc.applicationId not in _shipped:
        path = Path(tempfile.mkdtemp(prefix="rillwork-")) / f"{top.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where the setting is absent (local tests) a folder of this machine is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="rillwork-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if path not in _scratch:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _scratch.add(path)
    return path


@contextmanager
def freed() -> Iterator[None]:
    """The tables that are cut within go at its end, but for those that stay; also a decorator. A result that is lazy may read only these."""
    made: list[tuple[SparkSession, str]] = []
    before = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(before)
        for spark, path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, compression: str = "snappy", parts: int | None = None, stay: bool = False) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back.

    A lost executor then costs a reread of files, never a rerun of what made them. Whole texts take half as much with zstd.
    The shuffle files of the write go with its end, as nothing reads them any more. parts is a least number of partitions of the
    write's shuffles; they are then merged, and files are read, in small pieces only, so a task's share doesn't grow with the table.
    A table that is to stay outlives the scope of `freed` that it is made in, and goes with the next outer one, if any.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    for scope in _scopes.get()[: -1 if stay else None][-1:]:
        scope.append((spark, path))
    held = {_CLEANUP: "true"}
    if parts:
        held |= {"spark.sql.shuffle.partitions": str(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))), **_SMALL}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        df.write.option("compression", compression).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)
