"""Work under a deadline: jobs are cancelled by a tag of their own, and what was finished stays.

Rows are written partition by partition to the shared folder, each visible as soon as its
task commits, so a deadline cuts off what is unfinished and keeps the rest, whatever machine
it ran on. A partition that runs again replaces nothing: Spark lets one attempt commit.
"""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from quarryspark.functions.failures import PipelineTimeout
from quarryspark.runtime import materialize, shared_folder

log = logging.getLogger(__name__)


@contextmanager
def time_limit(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Spark jobs started inside are cancelled after ``seconds``; PipelineTimeout then.

    The jobs carry a tag that no other limit has, so limits that run at once, in several
    threads or nested, only ever cancel their own.
    """
    sc, tag = spark.sparkContext, f"quarryspark-{uuid.uuid4().hex}"
    sc.addJobTag(tag)
    over, done = threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(seconds):
            over.set()
        while not done.wait(0.2):  # jobs that start late are cancelled too
            sc.cancelJobsWithTag(tag)

    threading.Thread(target=watch, daemon=True).start()
    try:
        yield
    except Exception as e:
        if over.is_set():
            raise PipelineTimeout(f"timed out after {seconds} s") from e
        raise
    finally:
        done.set()
        sc.removeJobTag(tag)


def within[T](spark: SparkSession, deadline: float | None, step: Callable[[], T]) -> T:
    """What ``step`` gives; PipelineTimeout where the deadline, of ``time.monotonic``, passes first."""
    if deadline is None:
        return step()
    left = deadline - time.monotonic()
    if left <= 0:
        raise PipelineTimeout("the time ran out")
    with time_limit(spark, left):
        return step()


def rows_in_time(df: DataFrame, deadline: float | None) -> tuple[DataFrame, bool]:
    """(the rows of ``df`` whose partitions were finished in time, whether that is not all of them).

    How much a deadline can save depends on the partitions: what is slow should be dealt to
    many. Without a deadline all rows are materialized.
    """
    spark = df.sparkSession
    if deadline is None:
        return materialize(df), False
    folder, late = shared_folder(spark, "partial"), False
    try:
        # committed task by task and not only at the end of the job
        writer = df.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        within(spark, deadline, lambda: writer.parquet(folder))
    except PipelineTimeout as e:
        log.warning("%s, going on with what is there", e)
        late = True
    try:
        return spark.read.schema(df.schema).parquet(folder), late
    except AnalysisException as e:
        if late and e.getCondition() == "PATH_NOT_FOUND":  # the time ran out before the first task
            return spark.createDataFrame([], df.schema), True
        raise
