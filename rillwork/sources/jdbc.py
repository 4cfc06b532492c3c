"""A relational database as sink, for those who serve the gold tables from one."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Database:
    url: str
    properties: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_env(cls) -> Database:
        """From DB_URL, DB_USER, DB_PASSWORD and DB_DRIVER."""
        of = {"user": "DB_USER", "password": "DB_PASSWORD", "driver": "DB_DRIVER"}
        return cls(os.environ["DB_URL"], {k: os.environ[v] for k, v in of.items() if v in os.environ})

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.jdbc(self.url, table, properties=self.properties)

    def replace(self, df: DataFrame, table: str) -> None:
        """New rows in the same table, so that views on it stay valid."""
        df.write.option("truncate", "true").jdbc(self.url, table, mode="overwrite", properties=self.properties)

    def append(self, df: DataFrame, table: str) -> None:
        df.write.jdbc(self.url, table, mode="append", properties=self.properties)
