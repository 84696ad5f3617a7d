"""Generators over CIGARs: alignment events, pileup rows, and the per-read folds NM and MD.

All of them expand a read inside its own row, so none shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import reads as R
from ..schema import NO_QUALITY


def ops(reads: DataFrame, keep: tuple[str, ...] = ("read_id",)) -> DataFrame:
    """One row for each CIGAR op: (*keep, idx, op, len, ref_start, q_start, next_ins)."""
    return reads.select(*keep, F.explode(R.with_offsets(F.col("pos"), F.col("cigar"))).alias("o")).select(*keep, "o.*")


def aligned_pairs(reads: DataFrame, keep: tuple[str, ...] = ("read_id",), soft_clips: bool = False, full: bool = False, matches_only: bool = False) -> DataFrame:
    """CIGAR events: (*keep, kind, op, qpos, rpos, len).

    M, = and X give a row for each base; I, D and N one for each op; S with soft_clips; P with full; H and ops of length 0 never.
    qpos is null for D, N and P, rpos for I, S and P.
    """
    kinds = ["M", "=", "X"] + ([] if matches_only else ["I", "D", "N"] + ["S"] * (soft_clips or full) + ["P"] * full)
    rows = ops(reads, keep).where(F.col("op").isin(*kinds) & (F.col("len") > 0))
    match = F.col("op").isin("M", "=", "X")
    steps = F.when(match, F.sequence(F.lit(0), F.col("len") - 1)).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("step", F.explode(steps))
    kind = F.when(match, "match").when(F.col("op") == "I", "insertion").when(F.col("op") == "D", "deletion").when(F.col("op") == "N", "refskip").when(F.col("op") == "S", "soft_clip").otherwise("padding")
    return rows.select(
        *keep, kind.alias("kind"), "op",
        F.when(F.col("op").isin(*R.QUERY_OPS), F.col("q_start") + F.col("step")).alias("qpos"),
        F.when(F.col("op").isin(*R.REF_OPS), F.col("ref_start") + F.col("step")).alias("rpos"),
        F.when(match, 1).otherwise(F.col("len")).alias("len"),
    )


def pairs_with_read(reads: DataFrame, keep: tuple[str, ...] = ("read_id",), **options) -> DataFrame:
    """aligned_pairs with bases (the base, or the inserted or clipped bases) and quals; only reads whose SEQ and QUAL fit their CIGAR."""
    fits = (R.query_length(F.col("cigar")) == F.length("seq")) & F.size("qual").isin(F.lit(0), F.length("seq"))
    more = tuple(k for k in ("seq", "qual") if k not in keep)
    rows = aligned_pairs(reads.where(fits), (*keep, *more), **options)
    has = F.col("qpos").isNotNull()
    bases = F.when(has, F.substring(F.col("seq"), F.col("qpos") + 1, F.col("len")))
    quals = F.when(has & (F.size("qual") > 0), F.slice(F.col("qual"), F.col("qpos") + 1, F.col("len")))
    return rows.withColumn("bases", bases).withColumn("quals", quals).drop(*more)


def pileup(reads: DataFrame, start: int | None = None, end: int | None = None, keep: tuple[str, ...] = ("read_id", "mapq", "flags"), payload: bool = True, q_next: bool = False, inserted: bool = False, ref: bool = False) -> DataFrame:
    """One row for each read and reference position that it covers: (contig, pos, *keep, op, qpos, base, qual, insert_len, del_len, is_refskip).

    Unmapped reads are dropped.  The interval [start, end] is applied before positions are expanded.  The last position of
    M, = or X before an insertion is an insertion, that of D or N a complex indel.  payload=False leaves base and qual out;
    q_next=True adds q_next (bases of the read used before the op) and seq; inserted=True adds inserted, the bases of an insertion that follows.
    ref=True adds ref_base from the reads' own reference window (ref_seq, see with_reference_window), N outside it.  Neither carries whole sequences on.
    """
    low = F.col("ref_start") if start is None else F.greatest("ref_start", F.lit(start))
    last = F.col("ref_start") + F.col("len") - 1
    high = last if end is None else F.least(last, F.lit(end))
    source = reads.where(~R.is_set(F.col("flags"), "unmapped"))
    if start is not None:
        source = source.where(F.col("end_pos") >= start)
    if end is not None:
        source = source.where(F.col("pos") <= end)
    more = ("contig", *keep, *(("seq", "qual") if payload else ("seq",) if inserted or q_next else ()), *(("ref_seq", "__start") if ref else ()))
    source = source.withColumn("__start", F.col("pos")) if ref else source
    rows = ops(source, more).where(F.col("op").isin(*R.REF_OPS) & (F.col("len") > 0)).withColumn("low", low).withColumn("high", high).where("low <= high")
    rows = rows.withColumn("pos", F.explode(F.sequence("low", "high")))
    edge = (F.col("pos") == last) & (F.col("next_ins") > 0)
    match, gap = F.col("op").isin("M", "=", "X"), F.col("op").isin("D", "N")
    kind = F.when(match & edge, "insertion").when(match, "match").when(edge, "complex_indel").when(F.col("op") == "D", "deletion").otherwise("refskip")
    qpos = F.when(match, F.col("q_start") + F.col("pos") - F.col("ref_start"))
    columns = [
        "contig", "pos", *keep, kind.alias("op"), qpos.alias("qpos"), F.when(edge, F.col("next_ins")).otherwise(0).alias("insert_len"),
        F.when(gap & ((F.col("op") == "D") | edge), F.col("len")).otherwise(0).alias("del_len"), (F.col("op") == "N").alias("is_refskip"),
    ]
    if q_next:
        columns += [F.col("q_start").alias("q_next"), "seq"]
    if inserted:
        after = F.when(match, qpos + 2).otherwise(F.col("q_start") + 1)
        columns.append(F.when(edge, F.substring(F.col("seq"), after, F.col("next_ins"))).alias("inserted"))
    if ref:
        own = F.substring(F.col("ref_seq"), F.col("pos") - F.col("__start") + 1, F.lit(1))
        columns.append(F.when(F.coalesce(F.length(own), F.lit(0)) == 0, "N").otherwise(own).alias("ref_base"))
    if payload:
        at = qpos + 1
        columns.append(F.when(match, F.when(F.length("seq") == 0, "N").otherwise(F.substring(F.col("seq"), at, F.lit(1)))).alias("base"))
        columns.append(F.when(match, F.when(F.size("qual") == 0, NO_QUALITY).otherwise(F.try_element_at(F.col("qual"), at))).alias("qual"))
    return rows.select(*columns)


def with_reference_window(reads: DataFrame, reference: DataFrame, chunk: int) -> DataFrame:
    """reads with ref_seq, the reference bases from pos to end_pos; N where the reference has none.

    reference: (contig, chunk_start, bases) in chunks of ``chunk`` positions.  Reads meet the few chunks they span by an equi-join.
    """
    need = reads.select("read_id", "contig", "pos", "end_pos", F.explode(F.sequence(F.floor(F.col("pos") / chunk).cast("int"), F.floor(F.col("end_pos") / chunk).cast("int"))).alias("c"))
    parts = need.join(reference.select("contig", (F.col("chunk_start") / chunk).cast("int").alias("c"), "bases"), ["contig", "c"], "left")
    padded = F.rpad(F.coalesce("bases", F.lit("")), chunk, "N")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c", padded.alias("b")))), lambda x: x["b"]), "")
    windows = parts.groupBy("read_id", "pos", "end_pos").agg(text.alias("w"))
    windows = windows.select("read_id", R.normalize_bases(F.substring(F.col("w"), F.col("pos") % chunk + 1, F.col("end_pos") - F.col("pos") + 1)).alias("ref_seq"))
    return reads.join(windows, "read_id", "left")


def _blocks(cigar_ops: Column) -> Column:
    return F.filter(cigar_ops, lambda o: o["op"].isin("M", "=", "X", "D", "I") & (o["len"] > 0))


def edit_distance(pos: Column, cigar: Column, seq: Column, ref_seq: Column) -> Column:
    """NM: mismatches of M, = and X bases (N differs from everything but N), plus inserted and deleted bases.  ref_seq starts at pos."""

    def cost(n, o):
        q, r = F.substring(seq, o["q_start"] + 1, o["len"]), F.substring(ref_seq, o["ref_start"] - pos + 1, o["len"])
        pairs = F.zip_with(F.split(q, ""), F.split(r, ""), lambda a, b: F.when(a == b, 0).otherwise(1))
        return n + F.when(o["op"].isin("I", "D"), o["len"]).otherwise(F.aggregate(pairs, F.lit(0), lambda s, x: s + x))

    return F.aggregate(_blocks(R.with_offsets(pos, cigar)), F.lit(0), cost)


def walk_counts(pos: Column, cigar: Column, seq: Column, qual: Column, ref_seq: Column, least_quality: int) -> Column:
    """struct(insertions, inserted, deletions, deleted, ct, snv) of a read: events and bases of insertions and deletions, and its bases of enough quality that are T for a C
    or differ from the reference.  All 0 where SEQ or QUAL does not fit the CIGAR.  ref_seq starts at pos."""
    names = ("insertions", "inserted", "deletions", "deleted", "ct", "snv")
    none = F.struct(*(F.lit(0).alias(n) for n in names))

    def step(a, o):
        q, r = (F.split(F.substring(s, at + 1, o["len"]), "") for s, at in ((seq, o["q_start"]), (ref_seq, o["ref_start"] - pos)))
        good = F.filter(F.transform(F.zip_with(q, r, lambda x, y: F.struct(x.alias("q"), y.alias("r"))), lambda x, i: F.when(F.get(qual, o["q_start"] + i) >= least_quality, x)), lambda x: x.isNotNull())
        match = o["op"].isin("M", "=", "X")
        more = {
            "insertions": F.when(o["op"] == "I", 1), "inserted": F.when(o["op"] == "I", o["len"]), "deletions": F.when(o["op"] == "D", 1), "deleted": F.when(o["op"] == "D", o["len"]),
            "ct": F.when(match, F.size(F.filter(good, lambda x: (x["r"] == "C") & (x["q"] == "T")))), "snv": F.when(match, F.size(F.filter(good, lambda x: (x["r"] != x["q"]) & (x["q"] != "N")))),
        }
        return F.struct(*((a[n] + F.coalesce(more[n], F.lit(0))).alias(n) for n in names))

    fits = (R.query_length(cigar) == F.length(seq)) & F.size(qual).isin(F.lit(0), F.length(seq))
    return F.when(fits, F.aggregate(_blocks(R.with_offsets(pos, cigar)), none, step)).otherwise(none)


def mismatch_text(pos: Column, cigar: Column, seq: Column, ref_seq: Column) -> Column:
    """MD: run lengths of matches, reference bases at mismatches, and ^bases for deletions; adjacent deletions are parted by 0."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("run"))

    def op_step(acc, o):
        r = F.substring(ref_seq, o["ref_start"] - pos + 1, o["len"])
        q = F.substring(seq, o["q_start"] + 1, o["len"])
        pairs = F.zip_with(F.split(q, ""), F.split(r, ""), lambda a, b: F.struct(a.alias("q"), b.alias("r")))

        def base(a, x):
            same = x["q"] == x["r"]
            return F.struct(F.when(same, a["out"]).otherwise(F.concat(a["out"], a["run"].cast("string"), x["r"])).alias("out"), F.when(same, a["run"] + 1).otherwise(0).alias("run"))

        deleted = F.struct(F.concat(acc["out"], acc["run"].cast("string"), F.lit("^"), r).alias("out"), F.lit(0).alias("run"))
        return F.when(o["op"] == "D", deleted).when(o["op"] == "I", acc).otherwise(F.aggregate(pairs, acc, base))

    return F.aggregate(_blocks(R.with_offsets(pos, cigar)), start, op_step, lambda a: F.concat(a["out"], a["run"].cast("string")))
