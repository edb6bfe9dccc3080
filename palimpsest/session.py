"""Session factory, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import io
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: str | int = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session with the settings the library is tested under.

    On a cluster the caller's own session is used; nothing here is required for results.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("palimpsest")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once per context, however the driver came to import it."""
    sc = spark.sparkContext
    if getattr(sc, "_palimpsest_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    path = os.path.join(tempfile.mkdtemp(prefix="palimpsest-code-"), "palimpsest.zip")  # read by the driver's own file server only
    with open(path, "wb") as f:
        f.write(held.getvalue())
    sc.addPyFile(path)
    sc._palimpsest_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset a private one is made, which only a local session may do: elsewhere executors couldn't see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        atexit.register(shutil.rmtree, found[7:], True)
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Writes `df` once to the shared folder and reads it back.

    Cuts the lineage: later stages survive the loss of any executor, and a branch used several times is computed
    once. The folder goes when nothing on the driver refers to the table or to a frame made of it any more,
    at the latest with the session.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"cut-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _sweep(spark)
    # The JVM's plan of the table, which every plan made of it holds, is watched by a weak reference.
    jvm = spark.sparkContext._jvm
    held = out._jdf.queryExecution().analyzed()
    leaf = held.collectLeaves().head()
    _CUTS.append((jvm.java.lang.ref.WeakReference(leaf.relation() if "LogicalRelation" in leaf.getClass().getName() else leaf), path))
    return out


#: Weak references to the tables of `cut` and their folders.
_CUTS: list[tuple] = []


def _sweep(spark: SparkSession) -> None:
    """Deletes the folders of `cut` whose tables the JVM has collected."""
    jvm = spark.sparkContext._jvm
    live = []
    for ref, path in _CUTS:
        try:
            if not ref.refersTo(None):  # a get() would keep it alive
                live.append((ref, path))
                continue
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # a reference of a session that has ended
            continue
    _CUTS[:] = live
