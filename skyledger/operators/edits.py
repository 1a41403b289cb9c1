"""Which frames a header edit may touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.operators.expression import Refused  # noqa: F401  what a refused edit raises


def gated(targets: DataFrame) -> DataFrame:
    """(id, location_id, reason) of frames an edit may touch: one present, uncompressed, known copy."""
    copies = targets.where("present = 1").groupBy("frame_id").agg(F.count("*").alias("n"), F.min_by(F.struct("location_id", "compressed", "header_hash"), "location_id").alias("c"))
    rows = targets.select("frame_id").distinct().join(copies, "frame_id", "left")
    reason = F.when(F.col("n").isNull(), "no present copy").when(F.col("n") > 1, "several copies").when(F.col("c.compressed") == 1, "compressed").when(F.col("c.header_hash").isNull(), "no header hash")
    return rows.select(F.col("frame_id").alias("id"), F.col("c.location_id").alias("location_id"), reason.alias("reason"))
