"""Column types of the two representations, wide ``reads`` and long ``pileup``, and the flag bits."""

from __future__ import annotations

from pyspark.sql import types as T

CIGAR = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("len", T.IntegerType())]))
AUX_VALUE = T.StructType([T.StructField("type", T.StringType()), T.StructField("i", T.LongType()), T.StructField("f", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("a", T.ArrayType(T.DoubleType()))])
AUX = T.MapType(T.StringType(), AUX_VALUE)

READS = T.StructType([
    T.StructField("read_id", T.LongType()), T.StructField("qname", T.StringType()), T.StructField("flags", T.IntegerType()), T.StructField("tid", T.IntegerType()),
    T.StructField("contig", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType()), T.StructField("mapq", T.IntegerType()),
    T.StructField("cigar", CIGAR), T.StructField("seq", T.StringType()), T.StructField("qual", T.ArrayType(T.IntegerType())), T.StructField("matching_bases", T.IntegerType()),
    T.StructField("indel_bases", T.IntegerType()), T.StructField("seq_len", T.IntegerType()), T.StructField("next_tid", T.IntegerType()), T.StructField("next_pos", T.IntegerType()),
    T.StructField("template_len", T.IntegerType()), T.StructField("aux", AUX), T.StructField("strand", T.StringType()),
])
CONTIGS = T.StructType([T.StructField("tid", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("length", T.LongType())])

#: Bits of a read's flags.
FLAGS = {
    "paired": 0x1, "proper_pair": 0x2, "unmapped": 0x4, "mate_unmapped": 0x8, "reverse": 0x10, "mate_reverse": 0x20, "first_in_template": 0x40,
    "second_in_template": 0x80, "secondary": 0x100, "failed_qc": 0x200, "duplicate": 0x400, "supplementary": 0x800,
}
#: Unmapped, secondary, failed QC, duplicate, supplementary.
STANDARD_EXCLUDE = 0xF04
NO_QUALITY = 255
