"""Operators on pileup rows: reference bases, depth caps, mate de-duplication, aggregates, text, calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import reads as R
from ..functions import variants as V


def with_reference(rows: DataFrame, reference: DataFrame, chunk: int, pos_col: str = "pos", out: str = "ref_base") -> DataFrame:
    """rows with the reference base of their position; N outside the reference.  An equi-join on the chunk of the position."""
    chunks = reference.select(F.col("contig"), (F.col("chunk_start") / chunk).cast("int").alias("__c"), F.col("bases").alias("__b"))
    joined = rows.withColumn("__c", F.floor(F.col(pos_col) / chunk).cast("int")).join(chunks, ["contig", "__c"], "left")
    base = F.substring(F.col("__b"), F.col(pos_col) % chunk + 1, F.lit(1))
    return joined.withColumn(out, F.when(F.coalesce(F.length(base), F.lit(0)) == 0, "N").otherwise(R.normalize_bases(base))).drop("__c", "__b")


def try_reference(rows: DataFrame, reference: DataFrame, chunk: int, pos_col: str = "pos", out: str = "ref_base") -> DataFrame:
    """As with_reference, but null outside the reference."""
    done = with_reference(rows.withColumn("__p", F.col(pos_col)), reference, chunk, pos_col, "__any")
    chunks = reference.select("contig", "chunk_start", F.length("bases").alias("__n"))
    done = done.withColumn("chunk_start", F.floor(F.col(pos_col) / chunk).cast("int") * chunk).join(chunks, ["contig", "chunk_start"], "left")
    return done.withColumn(out, F.when(F.col(pos_col) - F.col("chunk_start") < F.coalesce("__n", F.lit(0)), F.col("__any"))).drop("__any", "__p", "__n", "chunk_start")


def reference_ranges(rows: DataFrame, reference: DataFrame, chunk: int, length: int) -> DataFrame:
    """rows (contig, pos, ...) with ref_bases, the ``length`` bases from pos; null if any lies outside the reference."""
    keys = rows.select("contig", "pos").distinct().withColumn("p", F.explode(F.sequence(F.col("pos"), F.col("pos") + length - 1)))
    bases = try_reference(keys, reference, chunk, "p", "b")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "b"))), lambda x: x["b"]), "")
    whole = bases.groupBy("contig", "pos").agg(F.when(F.count("b") == length, text).alias("ref_bases"))
    return rows.join(whole, ["contig", "pos"], "left")


def cap_depth(rows: DataFrame, most: int, read_pos: str = "read_pos") -> DataFrame:
    """At each position the first ``most`` reads by start and read_id."""
    rank = F.row_number().over(Window.partitionBy("contig", "pos").orderBy(read_pos, "read_id"))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")


def dedup_mates(rows: DataFrame, prefer_insertion: bool = False) -> DataFrame:
    """At each position one read of a qname: one with a base over one without, then the first in template, then the first.

    prefer_insertion: when the bases agree, a read that carries an insertion goes before the first in template.
    """
    w = Window.partitionBy("contig", "pos", "qname")
    order = [F.col("qpos").isNull(), ~R.is_set(F.col("flags"), "first_in_template"), F.col("read_id")]
    if prefer_insertion:
        base = F.coalesce("base", F.lit("-"))
        rows = rows.withColumn("__agree", F.min(base).over(w) == F.max(base).over(w))
        order.insert(1, F.when(F.col("__agree"), F.col("insert_len") == 0).otherwise(F.lit(False)))
    return rows.withColumn("__rank", F.row_number().over(w.orderBy(*order))).where("__rank = 1").drop("__rank", "__agree")


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def column_counts(rows: DataFrame, *more: str) -> DataFrame:
    """Per position: depth, match_depth, n_del, n_refskip, n_ins; a complex indel counts as deletion and insertion."""
    op = F.col("op")
    return rows.groupBy("contig", "pos", *more).agg(
        F.count("*").alias("depth"), F.count("qpos").alias("match_depth"), _count(op.isin("deletion", "complex_indel")).alias("n_del"),
        _count(F.col("is_refskip")).alias("n_refskip"), _count(op.isin("insertion", "complex_indel")).alias("n_ins"),
    )


def base_counts(rows: DataFrame, *more: str) -> DataFrame:
    """Per position: a, c, g, t, n, and total of the first four."""
    counts = {b.lower(): _count(F.col("base") == b) for b in "ACGTN"}
    return rows.where("qpos is not null").groupBy("contig", "pos", *more).agg(*(c.alias(k) for k, c in counts.items())).withColumn("total", F.expr("a + c + g + t"))


def best_alternative(counts: DataFrame, ref: str = "ref_base") -> DataFrame:
    """counts with alt and alt_count, the most frequent base but the reference's; ties to A, C, G, T in this order.  Null where the reference is N or no other base stands."""
    options = F.array(*(F.struct(F.when(F.col(ref) == b, 0).otherwise(F.col(b.lower())).alias("n"), F.lit(-k).alias("k"), F.lit(b).alias("b")) for k, b in enumerate("ACGT")))
    best = F.array_max(options)
    found = (F.col(ref) != "N") & (best["n"] > 0)
    return counts.withColumn("alt", F.when(found, best["b"])).withColumn("alt_count", F.when(found, best["n"]))


def call_snvs(rows: DataFrame, reference: DataFrame, chunk: int, min_mapq: int = 20, min_depth: int = 5, min_af: float = 0.1, hom_af: float = 0.8) -> DataFrame:
    """(contig, pos, ref_base, alt, depth, af, gt): standard reads of enough mapping quality, counted by base, with an alternative of enough share."""
    good = rows.where((F.col("mapq") >= min_mapq) & (F.col("flags").bitwiseAND(F.lit(0xF04)) == 0))
    counts = with_reference(base_counts(good).where(F.col("total") >= min_depth), reference, chunk)
    called = best_alternative(counts).where("alt is not null").withColumn("af", F.col("alt_count") / F.col("total")).where(F.col("af") >= min_af)
    gt = F.when(F.col("af") >= hom_af, "1/1").otherwise("0/1")
    return called.select("contig", "pos", "ref_base", "alt", F.col("total").alias("depth"), "af", gt.alias("gt"))


def vcf_lines(calls: DataFrame) -> DataFrame:
    """(contig, pos, line) of calls: INFO DP and AF, FORMAT GT and DP."""
    depth = F.col("depth").cast("string")
    info = V.info_text(("DP", depth), ("AF", V.float_text(F.col("af").cast("float").cast("double"))))
    line = V.vcf_line(F.col("contig"), F.col("pos") + 1, F.col("ref_base"), F.col("alt"), F.lit(None).cast("double"), F.array(F.lit("PASS")), info, "GT:DP", [F.concat(F.col("gt"), F.lit(":"), depth)])
    return calls.select("contig", "pos", line.alias("line"))


def read_group_tallies(rows: DataFrame, group: str = "rg") -> DataFrame:
    """Per position: read groups with counts, most first (ties by first read), and the mean aligned share of the reads.  A missing group is a dot."""
    named = rows.withColumn("__g", F.coalesce(F.col(group), F.lit(".")))
    first = named.groupBy("contig", "pos", "__g").agg(F.count("*").alias("n"), F.min("read_id").alias("seen"), F.sum("aligned_share").alias("s"))
    tally = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "seen", "__g")))
    text = F.array_join(F.transform(tally, lambda x: F.concat(x["__g"], F.lit(":"), (-x["k"]).cast("string"))), ",")
    return first.groupBy("contig", "pos").agg(F.sum("n").alias("depth"), text.alias("tallies"), (F.sum("s") / F.sum("n")).alias("mean_aligned"))


def mpileup_text(rows: DataFrame) -> DataFrame:
    """(contig, pos1, ref_base, depth, bases, quals) in mpileup notation.

    rows: pileup rows with ref_base, read_pos, read_end and inserted.  ^ and the mapping quality open a read, $ closes it at its last
    position; . and , stand for the reference base by direction, +n and bases for insertions, * for deletions, > and < for skips.
    """
    back = R.is_set(F.col("flags"), "reverse")
    case = lambda x: F.when(back, F.lower(x)).otherwise(F.upper(x))
    same = F.when(back, ",").otherwise(".")
    base = F.when(F.col("base") == F.col("ref_base"), same).otherwise(case(F.col("base")))
    inserted = F.concat(F.lit("+"), F.col("insert_len").cast("string"), case(F.col("inserted")))
    body = (
        F.when(F.col("op") == "match", base).when(F.col("op") == "insertion", F.concat(base, inserted)).when(F.col("op") == "deletion", "*")
        .when((F.col("op") == "complex_indel") & ~F.col("is_refskip"), F.concat(F.lit("*"), inserted)).otherwise(F.when(back, "<").otherwise(">"))
    )
    start = F.when(F.col("pos") == F.col("read_pos"), F.concat(F.lit("^"), F.char(F.least(F.col("mapq"), F.lit(93)) + 33))).otherwise("")
    stop = F.when(F.col("pos") == F.col("read_end"), "$").otherwise("")
    qual = F.when(F.col("qual").isNull() | (F.col("qual") == 255), "~").otherwise(F.char(F.least(F.col("qual"), F.lit(93)) + 33))
    parts = F.sort_array(F.collect_list(F.struct("read_pos", "read_id", F.concat(start, body, stop).alias("b"), qual.alias("q"))))
    made = rows.groupBy("contig", "pos", "ref_base").agg(F.count("*").alias("depth"), parts.alias("p"))
    join = lambda c: F.array_join(F.transform("p", lambda x: x[c]), "")
    return made.select("contig", (F.col("pos") + 1).alias("pos1"), "ref_base", "depth", join("b").alias("bases"), join("q").alias("quals"))
