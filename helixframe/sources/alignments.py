"""One entry for all alignment files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import bam, cram, sam


def read_alignments(spark: SparkSession, path: str, **options) -> DataFrame:
    """reads of SAM text (plain or gzip), BAM or CRAM (with reference=, a FASTA file).  A local path goes by its first bytes, any other by its name."""
    if os.path.isfile(path):
        kind = bam.detect(path)
    else:
        kind = "bam" if path.endswith(".bam") or os.path.isdir(path) and any(n.endswith(".bam") for n in os.listdir(path)) else "cram" if path.endswith(".cram") else "sam"
    if kind == "bam":
        return bam.read_bam(spark, path, **options)
    if kind in ("sam", "sam.gz"):
        return sam.read_sam(spark, path, **options)
    if kind == "cram":
        return cram.read_cram(spark, path, **options)
    raise ValueError(f"{path!r} holds {kind}, not alignments that can be read")
