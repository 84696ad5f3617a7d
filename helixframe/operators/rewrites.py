"""Row rewrites, order and de-duplication of reads, and mates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import reads as R


def with_derived(reads: DataFrame) -> DataFrame:
    """end_pos, matching_bases, indel_bases, seq_len and strand recomputed from pos, cigar, seq and flags."""
    cigar = F.col("cigar")
    return reads.withColumns({
        "end_pos": R.end_pos(F.col("pos"), cigar), "matching_bases": R.matching_bases(cigar), "indel_bases": R.indel_bases(cigar),
        "seq_len": F.length("seq"), "strand": R.strand(F.col("flags")),
    })


def set_alignment(reads: DataFrame, pos: Column, cigar: Column, owned: bool = False) -> DataFrame:
    """reads with a new pos and cigar; a row keeps its old alignment, and ``rejected`` is true, if the query length differs from the sequence's or there are over 65535 ops.

    owned: the query length of unmapped reads and of reads without a sequence is free.
    """
    free = R.is_set(F.col("flags"), "unmapped") | (F.col("seq_len") == 0) if owned else F.lit(False)
    fits = F.coalesce((free | (R.query_length(cigar) == F.col("seq_len"))) & (F.size(cigar) <= 65535), F.lit(False))
    out = reads.withColumns({"__p": pos, "__c": cigar, "__ok": fits})
    out = out.withColumns({"pos": F.when(F.col("__ok"), F.col("__p")).otherwise(F.col("pos")), "cigar": F.when(F.col("__ok"), F.col("__c")).otherwise(F.col("cigar")), "rejected": ~F.col("__ok")})
    return with_derived(out.drop("__p", "__c", "__ok"))


def _replaced(reads: DataFrame, column: str, value: Column, sound: Column) -> DataFrame:
    """reads with a new column where the value is sound; others keep theirs, and ``rejected`` is true."""
    out = reads.withColumns({"__v": value, "__ok": F.coalesce(sound, F.lit(False))})
    out = out.withColumns({column: F.when(F.col("__ok"), F.col("__v")).otherwise(F.col(column)), "rejected": ~F.col("__ok")})
    return out.drop("__v", "__ok")


def set_sequence(reads: DataFrame, seq: Column) -> DataFrame:
    """reads with new bases; a mapped read with a CIGAR keeps its own, and is rejected, if their number is not the CIGAR's query length."""
    free = R.is_set(F.col("flags"), "unmapped") | (F.size("cigar") == 0)
    return with_derived(_replaced(reads, "seq", seq, free | (R.query_length(F.col("cigar")) == F.length(seq))))


def set_quality(reads: DataFrame, qual: Column) -> DataFrame:
    """reads with new qualities: none, or one for each base."""
    return _replaced(reads, "qual", qual, (F.size(qual) == 0) | (F.size(qual) == F.length("seq")))


def set_flags(reads: DataFrame, flags: Column) -> DataFrame:
    """reads with new flags, 16 bits, and the strand that follows from them."""
    return with_derived(_replaced(reads, "flags", flags, flags.between(0, 65535)))


def set_template_length(reads: DataFrame, length: Column) -> DataFrame:
    return reads.withColumn("template_len", length.cast("int"))


def set_mate(reads: DataFrame, tid: Column, pos: Column) -> DataFrame:
    """reads with the mate's contig number and position; -1 for none."""
    return reads.withColumns({"next_tid": tid.cast("int"), "next_pos": pos.cast("int")})


def numbered(reads: DataFrame, out: str, shift: int = 14) -> DataFrame:
    """reads with their number, from 1, in coordinate order (unplaced ones last).

    Rows are numbered inside cells of 2^shift positions; only the cells' counts are summed in one task, a row for each cell of the genome.
    """
    place = F.when(F.col("tid").isNull() | (F.col("tid") < 0), F.lit(2**31 - 1)).otherwise(F.col("tid"))
    celled = reads.withColumns({"__t": place, "__c": F.shiftright("pos", shift)})
    counts = celled.groupBy("__t", "__c").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__t", "__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__t", "__c", before.alias("__before"))
    own = F.row_number().over(Window.partitionBy("__t", "__c").orderBy("pos", "read_id"))
    return celled.join(starts, ["__t", "__c"]).withColumn(out, (F.col("__before") + own).cast("long")).drop("__t", "__c", "__before")


def soft_clip_start(pos: Column, cigar: Column, min_match: int, clip: int) -> Column:
    """struct(pos, cigar): a leading M of min_match and more than clip gives its first ``clip`` bases to a soft clip."""
    first = F.try_element_at(cigar, F.lit(1))
    does = F.coalesce((first["op"] == "M") & (first["len"] >= min_match) & (first["len"] > clip), F.lit(False))
    op = lambda o, n: F.struct(F.lit(o).alias("op"), n.cast("int").alias("len"))
    new = F.concat(F.array(op("S", F.lit(clip)), op("M", first["len"] - clip)), F.slice(cigar, F.lit(2), F.greatest(F.size(cigar) - 1, F.lit(0))))
    return F.struct(F.when(does, pos + clip).otherwise(pos).alias("pos"), F.when(does, new).otherwise(cigar).alias("cigar"))


def coordinate_sorted(reads: DataFrame) -> DataFrame:
    """Globally sorted by (tid, pos, read_id), by range partitioning; unplaced reads last."""
    return reads.orderBy(F.col("tid").isNull() | (F.col("tid") < 0), "tid", "pos", "read_id")


def drop_adjacent_duplicates(reads: DataFrame, *within: str) -> DataFrame:
    """Without rows that equal the row before in (pos, flags, qname), in order of (pos, read_id) within ``within``."""
    w = Window.partitionBy(*within).orderBy("pos", "read_id")
    same = F.lit(True)
    for c in ("pos", "flags", "qname"):
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    return reads.withColumn("__same", same & (F.row_number().over(w) > 1)).where(~F.col("__same")).drop("__same")


def mates(reads: DataFrame) -> DataFrame:
    """reads with mate_tid, mate_pos and tlen from the other primary read of the qname: the outer distance, positive for the leftmost (ties to the first in template)."""
    primary = reads.where(F.col("flags").bitwiseAND(F.lit(0x900)) == 0)
    w = Window.partitionBy("qname")
    order = w.orderBy("pos", F.when(R.is_set(F.col("flags"), "first_in_template"), 0).otherwise(1), "read_id")
    span = F.max("end_pos").over(w) - F.min("pos").over(w) + 1
    paired = (F.count("*").over(w) == 2) & (F.min("tid").over(w) == F.max("tid").over(w))
    other = lambda c: F.coalesce(F.lead(c).over(order), F.lag(c).over(order))
    pair = F.count("*").over(w) == 2
    return primary.withColumns({
        "mate_tid": F.when(pair, other("tid")).otherwise(-1), "mate_pos": F.when(pair, other("pos")).otherwise(-1),
        "tlen": F.when(paired, F.when(F.row_number().over(order) == 1, span).otherwise(-span)).otherwise(0),
    })


def customize(reads: DataFrame, keep_raw: Column | None = None, compute: dict[str, Column] | None = None, keep: Column | None = None) -> DataFrame:
    """User code on reads: a predicate before, derived columns, and a predicate that may use them.  Stateless: rows are independent."""
    out = reads if keep_raw is None else reads.where(keep_raw)
    out = out.withColumns(compute or {})
    return out if keep is None else out.where(keep)
