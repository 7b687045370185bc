"""Session defaults and the shared folder in which lineage is cut."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", partitions: int = 8, memory: str = "8g", folder: str = "/tmp/caskwise-checkpoints") -> SparkSession:
    """A local session for tests and the bench, with its checkpoints in `folder`; a cluster brings its own session and shared folder."""
    return (
        SparkSession.builder.master(master)
        .appName("caskwise")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", folder)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share: the session's `spark.checkpoint.dir`.

    Where that is unset, a session of one machine (master local, as in tests) gets a temporary folder; a cluster without it is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="caskwise-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def slices(spark: SparkSession) -> int:
    """Partitions for stages whose work is in the rows rather than their bytes, which adaptive execution would put together."""
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    return df.repartition(slices(df.sparkSession))


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and cut its lineage; the files survive the loss of any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
