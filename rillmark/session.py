"""Session settings and shared scratch storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job of this package relies on.  The group-limit
# threshold lets Spark drop rows beyond the rollback size before the shuffle
# for windows larger than its default of 1,000 rows.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows with large binaries reach Python in batches of bounded size.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    The few Python functions in tasks import it by name, wherever the driver
    was started.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="rillmark-package-"), "rillmark.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def tune(spark: SparkSession) -> SparkSession:
    """Prepare an existing session: runtime settings and the package for its workers."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


SPREAD_BELOW = 64


def spread(table: DataFrame) -> DataFrame:
    """Give a small table read from few file splits to all cores.

    Meant for plain scans in front of CPU-heavy row work.  A table with as many
    splits as cores, or with 64 or more, is left alone, so large inputs are
    never shuffled for it.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.isStreaming or table.rdd.getNumPartitions() >= min(cores, SPREAD_BELOW):
        return table
    return table.repartition(cores)


# In how many parts a key's rows are reduced before they meet.
HOT_KEY_PARTS = 16


def estimated_splits(df: DataFrame) -> float:
    """Full file splits that the optimizer's size estimate of ``df`` makes up.

    Nothing runs for it.  Rows whose size is not known (streams, RDDs) count as
    many splits.
    """
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) / conf.filesMaxPartitionBytes()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    without that setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="rillmark-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/rillmark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where several aggregates and a join need the same expensive rows: the
    written table cuts the lineage, survives lost executors and gives each
    reader column pruning.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
