"""Session helpers: building a local session, shipping the package, cutting lineage.

Loops must not grow their plan without end and must survive lost executors, so
every intermediate result that a loop needs again is written as a parquet table
into the shared folder named by ``spark.checkpoint.dir``.  Only when that setting
is absent (tests, notebooks) does a session get a folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Spark's setting for deleting a query's shuffle files when the query ends.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int = 4, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("matchloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="matchloom-"), "matchloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("matchloom", os.path.relpath(path, root)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; ``spark.checkpoint.dir`` where it is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        own = "file://" + tempfile.mkdtemp(prefix="matchloom-shared-")
    else:  # the file system all nodes see, never a folder of one machine
        jvm = sc._jvm
        fs = jvm.org.apache.hadoop.fs.FileSystem.get(sc._jsc.hadoopConfiguration())
        own = fs.getHomeDirectory().toString() + "/.matchloom-shared"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Scratch:
    """Named intermediate tables of one operator call in the shared folder.

    ``put(name, df)`` writes ``df`` and returns it read back; an older table of the
    same name is deleted after the new one is complete, so loops keep one generation.
    What is left is deleted when the JVM ends.  A ``lean`` one also deletes the shuffle files of each
    table once it is written (Spark keeps them until the driver collects its garbage) and packs the tables by zstd.
    """

    def __init__(self, spark: SparkSession, label: str, lean: bool = False):
        self.spark = spark
        self.lean = lean
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._at: dict[str, str] = {}
        self._n = 0
        path = self._path(self.base)
        self._fs(path).deleteOnExit(path)

    def _path(self, at: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self._n += 1
        at = f"{self.base}/{name}-{self._n}"
        if self.lean:
            before = self.spark.conf.get(FILE_CLEANUP, None)
            self.spark.conf.set(FILE_CLEANUP, "true")
            try:
                df.write.mode("overwrite").option("compression", "zstd").parquet(at)
            finally:
                self.spark.conf.unset(FILE_CLEANUP) if before is None else self.spark.conf.set(FILE_CLEANUP, before)
        else:
            df.write.mode("overwrite").parquet(at)
        self.drop(name)
        self._at[name] = at
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        old = self._at.pop(name, None)
        if old:
            path = self._path(old)
            self._fs(path).delete(path, True)
