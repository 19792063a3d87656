"""Session defaults, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import io
import os
import re
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "loomline", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the operators assume (UTC, AQE, Arrow)."""
    cpus = cpus or os.cpu_count() or 4
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application, by way of the shared folder.

    A cluster need not have it installed, nor start its workers where the driver was started.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the archive's times are UTC, wherever the driver runs
    root = Path(__file__).parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    path = f"{shared_folder(spark)}/{sc.applicationId}/loomline.zip"
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(path)
    atexit.register(_remove, spark, path)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``base`` (a file or a directory of parts)."""
    ship_package(spark)
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for written intermediates: the cluster's, or where that is unset, one of this machine, in local mode alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        named = tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/loomline"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and return the table, which has no lineage.

    All executors can read the folder, so losing one of them loses nothing. The table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(schema).parquet(path)
    _WRITTEN[id(out)] = (weakref.ref(out), path)
    return out


_WRITTEN: dict[int, tuple[weakref.ref[DataFrame], str]] = {}


def forget(df: DataFrame) -> None:
    """Removes the table that :func:`cut_lineage` wrote for ``df``, which nothing may read any more."""
    ref, path = _WRITTEN.pop(id(df), (lambda: None, ""))
    if ref() is df:
        _remove(df.sparkSession, path)
