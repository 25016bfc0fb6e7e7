"""The folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_ROOTS: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once an application, for clusters whose workers lack it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="gridloom-"), "gridloom.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), os.path.dirname(top)))
    sc.addPyFile(out)


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a folder of our own, which only local mode may use."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _ROOTS.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="gridloom-shared-"))


def own_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, which goes when the driver's JVM ends: what is read from it is read by then."""
    path = f"{shared_root(spark)}/gridloom-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in a folder of its own, where nothing lies yet."""
    return f"{own_folder(spark)}/{name}"
