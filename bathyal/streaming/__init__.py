"""Soundings that arrive while a survey runs: cell statistics that are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bathyal.functions.expressions import cell as cell_of


def live_cells(stream: DataFrame, cell: float, every: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Per window of time and cell: soundings, mean, shoalest and deepest. stream: ts (timestamp), x, y, z.

    The same plan serves batches and streams; the watermark bounds the state to cells of recent windows.
    """
    timed = stream.withWatermark("ts", late)
    keys = [F.window("ts", every).alias("span"), cell_of("y", cell).alias("row"), cell_of("x", cell).alias("col")]
    return timed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean"), F.max("z").alias("shoalest"), F.min("z").alias("deepest")).select(
        F.col("span.start").alias("start"), "row", "col", "n", "mean", "shoalest", "deepest"
    )
