"""Durable checkpoints for iterative operators."""

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make one only for a local session without it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        # One machine, and nothing else to put them: gone when the session's process ends.
        folder = tempfile.mkdtemp(prefix="dayloom-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` durably so that later rounds survive the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = 2_000_000


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Let the session send its rows to Python in batches of at most about `size` bytes; a smaller limit of its own stays.

    Spark's own limit is 64 MB and 10,000 rows, so a task's texts are a single batch, which the executor
    and each of the Python workers in a chain hold whole. A row that is larger is a batch of its own.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    # As Spark shows it: a number with or without b for bytes, or with a larger unit.
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(limit))
    if not now or int(now[1]) > size:
        spark.conf.set(limit, f"{size}b")


#: Rows of a few hashes that a file should hold at the least; they take about 10 MB.
FILE_ROWS = 200_000


def rest(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write `df` into the checkpoint folder and read it back, for rounds that join what earlier rounds made.

    A checkpoint hands on the planner's guess of its size, and a join's guess is the product of its
    sides: over rounds it gets a number of millions of digits, which the driver can't hold. A file's
    size is known. With `rows`, about how many it has, it goes into one file for each FILE_ROWS at the
    most: where tasks are many and rows few, files by the thousand cost more than the rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/rest-{uuid.uuid4().hex}"
    few = df if rows is None else df.coalesce(1 + rows // FILE_ROWS)
    few.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
