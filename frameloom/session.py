"""Session settings and the shared scratch folder that long plans cut their lineage with."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


#: Folders made for sessions that name none, and all scratch folders, by application.
_own: dict[str, str] = {}
_roots: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is absent (local tests) a folder of our own is made;
    that is refused on a cluster, where executors could not see it.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if path:
        return path
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = path = tempfile.mkdtemp(prefix="frameloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return _own[context.applicationId]


def _file_system(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


class Scratch:
    """Tables in the shared folder: written once, read as often as needed, replicated by the store.

    A written table survives the loss of executors and cuts the lineage, which a
    cached or locally checkpointed one does not. Operators drop what only they read; the tables that a result still
    reads stay until ``release`` or the end of the driver, which removes them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        #: Names of the tables written so far.
        self.made: list[str] = []
        self.root = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
        _roots.setdefault(spark.sparkContext.applicationId, []).append(self.root)
        system, path = _file_system(spark, self.root)
        system.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        self.made.append(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def write_counted(self, df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
        """``write`` that also gives the row count ``n`` and other counts, taken while writing."""
        seen = Observation()
        asked = [F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in counts.items()]]
        made = self.write(df.observe(seen, *asked), name)
        # A plan found empty while it ran may leave nothing to observe.
        got = seen.get or made.agg(*asked).first().asDict()
        return made, {k: v or 0 for k, v in got.items()}

    def drop(self, name: str) -> None:
        """Remove a table nothing reads any more."""
        system, path = _file_system(self.spark, self.path(name))
        system.delete(path, True)


def release(spark: SparkSession) -> None:
    """Remove all scratch tables of this application; results that read them must have been consumed."""
    for root in _roots.pop(spark.sparkContext.applicationId, []):
        system, path = _file_system(spark, root)
        system.delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(df: DataFrame) -> int:
    """Row count; on bare Parquet scans it comes from the footers alone."""
    return df.count()


def local_session(cores: str = "8", memory: str = "12g") -> SparkSession:
    """A session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("frameloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )

