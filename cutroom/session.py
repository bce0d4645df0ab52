"""Session helpers shared by every part of the library."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cutroom", cores: str = "*", **conf: str) -> SparkSession:
    """A session with the settings this library is written for (UTC clock, adaptive plans)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; any path that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt to as many tasks as a shuffle has, for work that is large beside the bytes that are read: files are split by their size alone."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


#: Rows that a task sorts or groups, about, where more than a shuffle's own tasks are needed for it.
ROWS = 500_000


def tasks(df: DataFrame) -> int:
    """As many tasks as a shuffle has, or more so that none holds many more than ROWS of these rows; counts them."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // ROWS + 1)


#: Rows of an Arrow batch where the session leaves Spark's own 10,000: whole texts are long, and both sides hold a batch.
RECORDS, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, for tasks that import it, and bound their Arrow batches."""
    context = spark.sparkContext
    if not context.getConf().contains(RECORDS) and spark.conf.get(RECORDS) == "10000":
        spark.conf.set(RECORDS, str(BATCH))
    if getattr(context, "_cutroom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="cutroom-"))
    archive = os.path.join(folder, "cutroom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for top, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.join("cutroom", os.path.relpath(full, here)))
    context.addPyFile(archive)
    context._cutroom_shipped = True


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder all executors share.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; a folder of our own
    is set only where that is unset and all tasks run in this process, as in tests on one machine.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), f"cutroom-{uuid.uuid4().hex}"))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage, on which Spark's cleaner deletes shuffle files that no lineage needs any more.

    Worth a call after settle() in jobs of several large steps; else the files stay until the driver happens to collect.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
