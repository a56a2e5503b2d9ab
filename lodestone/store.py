"""Tables that change, as append-only logs in a folder: an upsert or a deletion adds rows, a read takes the latest of each key.

Writing costs the new rows alone; a read is one aggregation on the key, which ``compact`` takes over into the stored rows
from time to time. Every row carries the time of its writing in nanoseconds, of which the last wins.
"""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .operators.tables import upsert
from .session import shared_root

AT, GONE = "written_at_", "gone_"


class Store:
    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, root or f"{shared_root(spark)}/store-{time.time_ns()}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def append(self, name: str, rows: DataFrame, gone: bool = False) -> None:
        rows.withColumns({AT: F.lit(time.time_ns()), GONE: F.lit(gone)}).write.mode("append").option("compression", "zstd").parquet(self.path(name))

    def log(self, name: str) -> DataFrame:
        """All rows as written; later columns are null in earlier rows."""
        return self.spark.read.option("mergeSchema", "true").parquet(self.path(name))

    def read(self, name: str, *key: str) -> DataFrame:
        """The rows that hold now, one a key."""
        rows = self.log(name)
        rest = [c for c in rows.columns if c not in (*key, AT)]
        last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(AT)).alias("r"))
        return last.where(~F.col(f"r.{GONE}")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest if c != GONE])

    def upsert(self, name: str, rows: DataFrame, key: str, changing: list[str] | None = None) -> None:
        """Write ``rows``; of a key that is there only the ``changing`` columns are taken over, all if none are named."""
        if changing and self.exists(name):
            old = self.read(name, key).join(rows.select(key), key, "left_semi")
            rows = upsert(old, rows.select(old.columns), key, changing)
        self.append(name, rows)

    def insert_missing(self, name: str, rows: DataFrame, key: str) -> None:
        """Write the rows whose key is not there yet."""
        self.append(name, rows.join(self.read(name, key).select(key), key, "left_anti") if self.exists(name) else rows)

    def delete(self, name: str, key: str, where: Column) -> None:
        """Take out the rows for which ``where`` holds."""
        if self.exists(name):
            self.append(name, self.read(name, key).where(where), gone=True)

    def compact(self, name: str, key: str) -> None:
        """Write the rows that hold to a new folder, which then takes the place of the log."""
        self.read(name, key).withColumns({AT: F.lit(time.time_ns()), GONE: F.lit(False)}).write.mode("overwrite").parquet(f"{self.path(name)}-new")
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        old, new = hadoop.Path(self.path(name)), hadoop.Path(f"{self.path(name)}-new")
        fs = old.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(old, True)
        fs.rename(new, old)

    def fetch(self, sql: str, **args: Any) -> list[Row]:
        """Rows of a statement over views, with named parameters."""
        return self.spark.sql(sql, args=args).collect()

    def fetchrow(self, sql: str, **args: Any) -> Row | None:
        return self.spark.sql(sql, args=args).first()

    def fetchval(self, sql: str, **args: Any) -> Any:
        row = self.fetchrow(sql, **args)
        return row[0] if row else None

    # a cache of keys that expire

    def put(self, name: str, rows: DataFrame, seconds: int) -> None:
        """Cache ``rows`` (key, value) for so many seconds."""
        self.append(name, rows.select("key", "value").withColumn("expires_at", F.current_timestamp() + F.make_dt_interval(secs=F.lit(seconds))))

    def get(self, name: str, key: str) -> str | None:
        """The value of a key that has not expired; anything that fails is a miss."""
        try:
            row = self.read(name, "key").where((F.col("key") == key) & (F.col("expires_at") > F.current_timestamp())).first()
        except Exception:
            return None
        return row.value if row else None
