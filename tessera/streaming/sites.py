"""Site counts over arriving calls. Counts are sums, so batches merge; overlap and depth rules need whole columns and stay in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import calling


def running_counts(called: DataFrame) -> DataFrame:
    """calling.site_counts() of a stream of calls; for output modes update and complete."""
    return calling.site_counts(called)


def windowed_counts(called: DataFrame, at: str, width: str, late: str) -> DataFrame:
    """Counts by context in event-time windows of a stream with a timestamp column; later rows than `late` are left out."""
    w = called.withWatermark(at, late).groupBy(F.window(at, width), "tri")
    return w.agg(F.count_if(F.col("call") == 0).alias("t"), F.count_if(F.col("call") == 1).alias("c"))
