"""Partitioned tables whose partitions are replaced in one step.

A write goes to a folder of its own first. The commit then adds a manifest, which names the version of every partition, by
renaming one file: before that a reader sees the old state, after it the new one, whatever fails between. Readers take the
newest manifest, so they never see a part of a write; older manifests stay readable until `vacuum`.

A table has one writer at a time; a second one that commits from the same manifest fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import date, timedelta
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rillwork.functions.columns import named

_FOLDER, _VERSION, _NONE = "_manifest", "_version", "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Manifest:
    """One state of a table: the version that holds each partition, and what its writer noted."""

    number: int
    by: str
    schema: str
    parts: dict[str, str]
    notes: dict[str, Any] = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, at = _fs(spark, f"{path}/{_FOLDER}")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def manifest(spark: SparkSession, path: str, number: int | None = None) -> Manifest | None:
    """The newest manifest, or that of a number; None if there is none."""
    found = _numbers(spark, path)
    if not found or (number is not None and number not in found):
        return None
    name = f"{path}/{_FOLDER}/{number or found[-1]:012d}.json"
    fs, at = _fs(spark, name)
    stream = fs.open(at)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Manifest(**json.loads(text))


def _put(spark: SparkSession, path: str, new: Manifest) -> None:
    folder = f"{path}/{_FOLDER}"
    fs, target = _fs(spark, f"{folder}/{new.number:012d}.json")
    _, draft = _fs(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(draft)
    try:
        out.write(json.dumps(new.__dict__).encode())
    finally:
        out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise FileExistsError(f"another writer has committed number {new.number} of {path}")


@dataclass(frozen=True)
class Staged:
    """A version that is written but not part of the table yet."""

    path: str
    by: str
    schema: str
    version: str
    parts: tuple[str, ...]
    rows: int


def stage(df: DataFrame, path: str, by: str) -> Staged:
    """Writes df as a version of its own, partitioned by one column."""
    version, seen = f"v{uuid.uuid4().hex}", Observation()
    value = F.coalesce(named(by).cast("string"), F.lit(_NONE))
    held = df.observe(seen, F.count(F.lit(1)).alias("n"), F.collect_set(value).alias("parts"))  # at most the partitions written
    held.write.partitionBy(by).parquet(f"{path}/{_VERSION}={version}")
    return Staged(path, by, df.schema.json(), version, tuple(sorted(seen.get["parts"])), seen.get["n"])


def commit(spark: SparkSession, new: Staged, replaced: Iterable[date | str] | None = None, notes: dict[str, Any] | None = None) -> Manifest:
    """Makes a staged version part of the table, in one step.

    The partitions in `replaced` that it has no rows for are emptied; None replaces the whole table. The partitions that it
    has rows for are replaced in any case. notes are added to those of the manifest before.
    """
    old = manifest(spark, new.path)
    kept = {} if old is None or replaced is None else {p: v for p, v in old.parts.items() if p not in {str(x) for x in replaced}}
    parts = kept | dict.fromkeys(new.parts, new.version)
    made = Manifest((old.number if old else 0) + 1, new.by, new.schema, parts, (old.notes if old else {}) | (notes or {}))
    _put(spark, new.path, made)
    return made


def replace(df: DataFrame, path: str, by: str, replaced: Iterable[date | str] | None = None, notes: dict[str, Any] | None = None) -> int:
    """Stages and commits df; returns its number of rows."""
    new = stage(df, path, by)
    commit(df.sparkSession, new, replaced, notes)
    return new.rows


def days_of(since: date, until: date) -> list[date]:
    return [since + timedelta(k) for k in range((until - since).days)]


def read(spark: SparkSession, path: str, of: Manifest | None = None, parts: Iterable[str] | None = None) -> DataFrame:
    """The table as of a manifest (None: the newest), or some partitions of it; a filter on the partition column prunes."""
    state = of or manifest(spark, path)
    if state is None:
        raise FileNotFoundError(f"no manifest in {path}")
    schema = StructType.fromJson(json.loads(state.schema))
    wanted = state.parts if parts is None else {p: state.parts[p] for p in parts if p in state.parts}
    if not wanted:
        return spark.createDataFrame([], schema)
    whole = StructType([*schema.fields, StructField(_VERSION, StringType())])
    places = [f"{path}/{_VERSION}={v}/{state.by}={p}" for p, v in sorted(wanted.items())]
    return spark.read.schema(whole).option("basePath", path).parquet(*places).select(*[named(f.name) for f in schema.fields])


def vacuum(spark: SparkSession, path: str, keep: int = 3) -> int:
    """Deletes all but the newest `keep` manifests and the versions that none of these names; returns how many versions went."""
    numbers = _numbers(spark, path)
    held = {v for n in numbers[-keep:] for v in manifest(spark, path, n).parts.values()}
    for n in numbers[:-keep]:
        fs, at = _fs(spark, f"{path}/{_FOLDER}/{n:012d}.json")
        fs.delete(at, False)
    fs, at = _fs(spark, path)
    old = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith(f"{_VERSION}=") and s.getPath().getName().removeprefix(f"{_VERSION}=") not in held]
    for p in old:
        fs.delete(p, True)
    return len(old)
