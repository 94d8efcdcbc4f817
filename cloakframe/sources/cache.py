"""A persistent key-value cache with expiry on Parquet: (key, value, expires_at).

Every write makes a new version of the table and then names it current, so readers always
see a whole version. One writer at a time. Reads are joins, so keys are DataFrames where
there may be many. An expiry of null is never; a falsy ttl is no expiry.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, value binary, expires_at double"
KEY_LENGTH = 512


class TableCache:
    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.path, self.clock = spark, path.rstrip("/"), clock
        jvm = spark.sparkContext._jvm
        self._folder = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._path = jvm.org.apache.hadoop.fs.Path

    # ------------------------------------------------------------ versions

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._folder)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self._fs.exists(self._path(f"{self.path}/{n}/_SUCCESS")))

    def create(self) -> None:
        """Make an empty table, unless there is one."""
        if not self._versions():
            self._write(self.spark.createDataFrame([], SCHEMA))

    def table(self) -> DataFrame:
        """All entries, expired ones too."""
        versions = self._versions()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v{versions[-1]}") if versions else self.spark.createDataFrame([], SCHEMA)

    def _write(self, rows: DataFrame) -> None:
        versions = self._versions()
        new = versions[-1] + 1 if versions else 0
        rows.select("key", "value", "expires_at").write.mode("overwrite").parquet(f"{self.path}/v{new}")
        for old in versions[:-1]:  # the one before stays for readers that have begun
            self._fs.delete(self._path(f"{self.path}/v{old}"), True)

    def _live(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("expires_at").isNull() | (F.col("expires_at") > self.clock()))

    def _expiry(self, ttl: float | None):
        return F.lit(self.clock() + ttl).cast("double") if ttl else F.lit(None).cast("double")

    # ------------------------------------------------------------ tables

    def get_all(self, keys: DataFrame) -> DataFrame:
        """`keys` (with a column key) with their value, null for misses and expired entries."""
        return keys.join(self._live(self.table()).select("key", "value"), "key", "left")

    def put_all(self, rows: DataFrame, ttl: float | None = None) -> None:
        """Insert or replace (key, value)."""
        new = rows.select("key", F.col("value").cast("binary").alias("value")).dropDuplicates(["key"]).withColumn("expires_at", self._expiry(ttl))
        self._write(self._live(self.table()).join(new, "key", "left_anti").unionByName(new))

    def purge(self) -> None:
        """Drop expired entries."""
        self._write(self._live(self.table()))

    # ------------------------------------------------------------ single keys

    def _frame(self, rows: Iterable[tuple]) -> DataFrame:
        rows = list(rows)
        for k, _ in rows:
            if len(k) > KEY_LENGTH:
                raise ValueError(f"keys have at most {KEY_LENGTH} characters")
        return self.spark.createDataFrame([(k, bytes(v)) for k, v in rows], "key string, value binary")

    def get(self, key: str) -> bytes | None:
        row = self._live(self.table()).where(F.col("key") == key).first()
        return None if row is None else bytes(row.value)

    def multi_get(self, keys: list[str]) -> list[bytes | None]:
        """In the order of the keys, None for misses."""
        asked = self.spark.createDataFrame(list(enumerate(keys)), "i int, key string")
        found = {r.i: r.value for r in self.get_all(asked).collect()}
        return [None if found[i] is None else bytes(found[i]) for i in range(len(keys))]

    def set(self, key: str, value: bytes, ttl: float | None = None, expected: bytes | None = None) -> int:
        """1, or 0 if `expected` is given and isn't there."""
        if expected is not None and self.get(key) != expected:
            return 0
        self.put_all(self._frame([(key, value)]), ttl)
        return 1

    def multi_set(self, pairs: Iterable[tuple[str, bytes]], ttl: float | None = None) -> None:
        self.put_all(self._frame(pairs), ttl)

    def add(self, key: str, value: bytes, ttl: float | None = None) -> None:
        """Raises ValueError if the key is there, expired or not."""
        if self.table().where(F.col("key") == key).take(1):
            raise ValueError(f"the key is there already: {key}")
        self.set(key, value, ttl)

    def exists(self, key: str) -> bool:
        return self.get(key) is not None

    def increment(self, key: str, delta: int = 1) -> int:
        """Of a decimal number; a missing one counts as 0. The expiry goes. Raises TypeError for other values."""
        old = self.get(key)
        try:
            new = int(old or b"0") + delta
        except ValueError:
            raise TypeError(f"not a number: {key}") from None
        self.set(key, str(new).encode())
        return new

    def expire(self, key: str, ttl: float | None) -> bool:
        """Set the expiry; False for an unknown key."""
        if not self.exists(key):
            return False
        self._write(self._live(self.table()).withColumn("expires_at", F.when(F.col("key") == key, self._expiry(ttl)).otherwise(F.col("expires_at"))))
        return True

    def delete(self, key: str) -> int:
        there = self.table().where(F.col("key") == key).count()
        if there:
            self._write(self.table().where(F.col("key") != key))
        return there

    def release(self, key: str, value: bytes) -> bool:
        """Delete the key if it holds this value."""
        return self.get(key) == value and self.delete(key) > 0

    def clear(self, namespace: str = "") -> None:
        """Drop the keys that begin with `namespace`; all without one."""
        self._write(self.table().where(~F.startswith(F.col("key"), F.lit(namespace))))
