"""Session construction and the two cluster helpers every operator shares.

``ship`` sends this package to the executors once per application, so Python workers on other
machines can import it. ``materialise`` cuts a lineage by writing a table under the shared folder
of ``spark.checkpoint.dir`` and reading it back; it survives the loss of any executor.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_local_folder: list[str] = []


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gaugeflow")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Makes the package importable in Python workers; does nothing the second time."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="gaugeflow-")
    target = os.path.join(folder, "gaugeflow_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for at, dirs, names in os.walk(top):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    z.write(path, os.path.join("gaugeflow", os.path.relpath(path, top)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one on one machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="gaugeflow-checkpoint-"))
    return "file://" + _local_folder[0]


RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str = "table", wide: bool = False, release: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and returns a scan of it, whose size the planner knows.

    A narrow table is dealt to as many files as the cluster has cores, not to one for each of its maybe
    many small partitions; a ``wide`` one is written as it lies. ``discard`` removes it when nothing reads it any more.
    With ``release`` the write's shuffle files go as it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gaugeflow/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(RELEASE, None)
    if release:
        spark.conf.set(RELEASE, "true")
    try:
        (df if wide else df.repartition(spark.sparkContext.defaultParallelism)).write.parquet(path)
    finally:
        if release:
            spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the files of materialised tables. Only for tables that no later result reads, not even to make up for a lost executor; anything else given is left alone."""
    for table in tables:
        path = getattr(table, "written_to", None)
        if path:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
