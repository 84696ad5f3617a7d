"""Streaming: SAM text files that arrive in a folder, to running pileup counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import pileup
from ..sources.sam import parse_sam


def live_depth(spark: SparkSession, folder: str, contigs: DataFrame, window: int | None = None) -> DataFrame:
    """Streaming (contig, pos or window, depth): each arriving read adds to its positions, or to the windows of ``window`` positions that hold them.

    Parsing and expansion are stateless; the only state is one counter for each position or window.  For use in update mode.
    """
    reads = parse_sam(spark.readStream.text(folder).withColumn("read_id", F.lit(0).cast("long")), contigs)
    rows = pileup(reads, keep=(), payload=False)
    if window:
        rows = rows.withColumn("pos", (F.floor(F.col("pos") / window) * window).cast("int"))
    return rows.groupBy("contig", "pos").agg(F.count("*").alias("depth"))
