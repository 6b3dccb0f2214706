"""Session helpers: a local session for tests, durable cut points and the shared folder.

Lineage is cut only with ``checkpoint()`` into the folder that the cluster names in
``spark.checkpoint.dir``; where none is named (tests on one machine), a folder of our
own is set once per session.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: rows in an Arrow batch, where a session allows more: rows hold whole texts, and batches are copied on both sides
BATCH_ROWS = 2000


def share_code(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, and bound Arrow batches.

    The path is enough where workers see it; a cluster that doesn't gets the package by ``--py-files``.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, as tests and bench.py use it."""
    return share_code(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quarryspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of this session; sets a temporary one where none is configured."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quarryspark-"))
    return sc.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there: it survives lost executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``materialize``, and how many rows there are, counted as they are written."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores at least.

    A small file of one row group is one partition, and what is computed of its rows one
    task; larger tables have more partitions than cores and stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def give_back() -> None:
    """Return freed memory of a Python worker to the system; workers are reused by later stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh URI under the shared folder, for files that an operator writes itself."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def other_columns(df: DataFrame, taken: list[str]) -> list[str]:
    """Columns of ``df`` that don't clash, case aside, with the names in ``taken``."""
    names = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in names]


def extended(schema: StructType, more: str) -> StructType:
    """``schema`` and after it the fields of a DDL string; names may hold any character."""
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


def quoted(names: list[str]) -> list[str]:
    """Column names as references that hold for any character."""
    return ["`" + n.replace("`", "``") + "`" for n in names]
