"""Session helpers: a session with the engine's defaults, and the library made importable on every executor."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_OWN: dict[str, str] = {}


def session(app: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once per application; the file server of the driver distributes it.

    Unions do not report their partitioning: where adaptive execution coalesces one side of a join on such a union,
    Spark 4.1 fails with "Can't zip RDDs with unequal numbers of partitions".
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        fd, name = tempfile.mkstemp(prefix="lodestone-", suffix=".zip")
        with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
            for p in sorted(p for kind in ("*.py", "*.json") for p in root.rglob(kind)):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(name)
        _SHIPPED.add(app)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a folder of our own on this machine, but in local mode only: elsewhere every executor would write
    to its own disk.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _OWN:
        holder = tempfile.TemporaryDirectory(prefix="lodestone-")
        atexit.register(holder.cleanup)
        _OWN["dir"] = holder.name
    return _OWN["dir"]
