"""Items as a stream: the first of each normalized address within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryspark.functions.urls import normalize_url


def first_of_address(items: DataFrame, *, time_col: str = "ts", delay: str = "1 hour", extra_tracking: tuple[str, ...] = ()) -> DataFrame:
    """Streaming or batch ``items`` (url, time) with normalized_url; state is kept for ``delay`` only.

    In a batch the earliest item of an address stays, of equal ones the least address.
    """
    keyed = items.withColumn("normalized_url", normalize_url("url", extra_tracking)).filter("normalized_url IS NOT NULL")
    if not items.isStreaming:
        order = F.struct(*[c for c in (time_col, "url") if c in items.columns])
        return keyed.groupBy("normalized_url").agg(F.min_by(F.struct(*keyed.columns), order).alias("first")).select("first.*")
    return keyed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["normalized_url"])
