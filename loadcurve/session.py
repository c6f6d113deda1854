"""Session helpers: a tuned local session, and the shared folder for cut lineage and scratch tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, memory: str = "8g", app: str = "loadcurve") -> SparkSession:
    """A session for tests and the bench. On a cluster the session comes from spark-submit."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (`spark.checkpoint.dir`); a private one only for a local session without it."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="loadcurve-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def let_workers_import(spark: SparkSession) -> None:
    """Python workers find this package where the driver has it, unless the session says otherwise; other machines need it shipped (`--py-files`)."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))


_scratch: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table written and read back within a job."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def remove_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables of this session, at the end of a job when no result is read any more; their number."""
    own = [path for s, path in _scratch if s is spark]
    _scratch[:] = [(s, path) for s, path in _scratch if s is not spark]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in own:
        where = hadoop(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return len(own)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let reliable checkpoints work where the cluster has not set their folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later branches read the same stored rows, also after executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
