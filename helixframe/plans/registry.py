"""Queries over the synthetic reads, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reads as R
from ..functions import tags as X
from ..functions import variants as V
from ..operators import basemods, events, intervals, pileups, rewrites
from ..schema import FLAGS, STANDARD_EXCLUDE
from ..sources import sam
from .synthetic import CHUNK, LAST_POS, READS_SQL, REF_SQL, contigs, reads, reference

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, with_reads: bool = True):
    """Registers a query under its function's name; sql is its oracle, after the reads tables unless with_reads is false."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (READS_SQL if with_reads else "") + sql
        return f

    return register


def _int(c) -> F.Column:
    return c.cast("int")


# --- scalar functions


@query("SELECT read_id, " + ", ".join(f"cast(flags & {m} <> 0 as int) AS is_{n}" for n, m in FLAGS.items()) + ", flags | 1024 AS marked, flags & ~1024 AS unmarked FROM reads")
def fn_flags(spark, sf):
    flags = F.col("flags")
    return reads(spark, sf).select("read_id", *(_int(R.is_set(flags, n)).alias(f"is_{n}") for n in FLAGS), R.with_flags(flags, 1024).alias("marked"), R.without_flags(flags, 1024).alias("unmarked"))


@query("""SELECT read_id, CASE WHEN flags & 1 = 0 OR flags & 64 <> 0 THEN CASE WHEN flags & 16 <> 0 THEN 'OB' ELSE 'OT' END
  WHEN flags & 128 <> 0 THEN CASE WHEN flags & 32 <> 0 THEN 'OB' ELSE 'OT' END ELSE 'NA' END AS strand FROM reads""")
def fn_strand(spark, sf):
    return reads(spark, sf).select("read_id", "strand")


@query("""SELECT r.read_id, any_value(cigar_text) AS cigar_text, count(*) AS n_ops, any_value(qlen) AS query_len, cast(sum(CASE WHEN op IN ('M', 'D', 'N') THEN len ELSE 0 END) as int) AS ref_len,
  cast(sum(CASE WHEN op = 'M' THEN len ELSE 0 END) as int) AS matching, cast(sum(CASE WHEN op = 'M' THEN len ELSE 0 END) as int) AS aligned, cast(sum(CASE WHEN op IN ('I', 'D') THEN len ELSE 0 END) as int) AS indel, any_value(end_pos) AS end_pos
  FROM opr r JOIN (SELECT read_id, cigar_text FROM reads) c ON c.read_id = r.read_id GROUP BY r.read_id""")
def fn_cigar(spark, sf):
    c = F.col("cigar")
    return reads(spark, sf).select(
        "read_id", R.cigar_format(c).alias("cigar_text"), F.size(c).cast("long").alias("n_ops"), R.query_length(c).alias("query_len"), R.reference_length(c).alias("ref_len"),
        R.matching_bases(c).alias("matching"), R.aligned_bases(c).alias("aligned"), R.indel_bases(c).alias("indel"), "end_pos",
    )


@query("SELECT read_id, idx, cast(len * 16 + instr('MIDNSHP=X', op) - 1 as int) AS packed, op, len FROM opr")
def fn_cigar_pack(spark, sf):
    rows = events.ops(reads(spark, sf)).withColumn("packed", R.cigar_pack(F.col("op"), F.col("len")))
    return rows.withColumn("u", R.cigar_unpack(F.col("packed"))).select("read_id", "idx", "packed", "u.op", "u.len")


@query("""SELECT read_id, translate(seq, 'ACGT', 'TGCA') AS complement, reverse(translate(seq, 'ACGT', 'TGCA')) AS reverse_complement,
  cast(nullif(instr('ACGT', left(seq, 1)), 0) - 1 as int) AS first_index, regexp_replace(replace(seq, 'A', 'R'), '[^ACGT]', 'N', 'g') AS normalized, CASE WHEN length(seq) = 1 THEN seq END AS strict FROM reads""")
def fn_bases(spark, sf):
    s = F.col("seq")
    return reads(spark, sf).select("read_id", R.complement(s).alias("complement"), R.reverse_complement(s).alias("reverse_complement"), R.base_index(s).alias("first_index"),
                                   R.normalize_bases(F.replace(s, F.lit("A"), F.lit("r"))).alias("normalized"), R.strict_base(s).alias("strict"))


@query("""SELECT read_id, array_to_string(list_transform(qual, lambda x: chr(cast(x + 33 as int))), '') AS text, cast(list_sum(qual) as int) AS total,
  cast(CASE WHEN p % 100 = 0 THEN 0 ELSE least(99, greatest(0, round(-10 * log10((p % 100) / 100.0)))) END as int) AS phred FROM reads""")
def fn_quality(spark, sf):
    df = reads(spark, sf).withColumn("text", R.encode_quality(F.col("qual"))).withColumn("back", R.decode_quality(F.col("text"), F.col("seq_len")))
    q = R.phred_from_probability(F.col("p") % 100 / F.lit(100.0))
    return df.select("read_id", "text", F.aggregate("back", F.lit(0), lambda a, x: a + x).alias("total"), F.when(F.col("p") % 100 == 0, 0).otherwise(R.phred_int(q)).alias("phred"))


_BIN = "CASE " + " ".join(f"WHEN b >> {14 + 3 * (5 - k)} = e >> {14 + 3 * (5 - k)} THEN {((1 << 3 * k) - 1) // 7} + (b >> {14 + 3 * (5 - k)})" for k in range(5, 0, -1)) + " ELSE 0 END"


@query(f"""SELECT id, cast({_BIN} as int) AS bin, cast(1 + {' + '.join(f'(e >> {14 + 3 * (5 - k)}) - (b >> {14 + 3 * (5 - k)}) + 1' for k in range(1, 6))} as int) AS n_bins,
  cast(CASE WHEN {_BIN} >= 4681 THEN 5 WHEN {_BIN} >= 585 THEN 4 WHEN {_BIN} >= 73 THEN 3 WHEN {_BIN} >= 9 THEN 2 WHEN {_BIN} >= 1 THEN 1 ELSE 0 END as int) AS level
  FROM (SELECT o_orderkey AS id, (o_orderkey * 7919) % 500000000 AS b, (o_orderkey * 7919) % 500000000 + cast(floor(o_totalprice) as bigint) % 100000 AS e FROM orders)""", with_reads=False)
def fn_bins(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS id", "(o_orderkey * 7919) % 500000000 AS b", "(o_orderkey * 7919) % 500000000 + cast(floor(o_totalprice) as bigint) % 100000 AS e")
    one = R.reg2bin(F.col("b"), F.col("e") + 1)
    return o.select("id", one.alias("bin"), F.size(R.reg2bins(F.col("b"), F.col("e") + 1)).alias("n_bins"), _int(R.bin_level(one)).alias("level"))


@query("""SELECT read_id, contig AS name, pos + 1 AS start_1, end_pos + 1 AS end_1, tid FROM reads""")
def fn_region(spark, sf):
    text = F.concat("contig", F.lit(":"), (F.col("pos") + 1).cast("string"), F.lit("-"), (F.col("end_pos") + 1).cast("string"))
    r = intervals.region_columns(text)
    rows = reads(spark, sf).select("read_id", r["contig"].alias("name"), r["start"].alias("start_1"), r["end"].alias("end_1"))
    return rows.join(contigs(spark).select("name", "tid"), "name").select("read_id", "name", "start_1", "end_1", "tid")


@query("""SELECT read_id, rg, p AS nm, CASE WHEN p > 1000 THEN 'out_of_range' ELSE 'ok' END AS state, CASE WHEN rg IS NULL THEN 1 ELSE 2 END + 2 AS n_tags, cast(p % 7 as double) / 2 AS xf, CASE WHEN p <= 255 THEN 'C' WHEN p <= 65535 THEN 'S' ELSE 'I' END AS width FROM reads""")
def fn_aux(spark, sf):
    fields = F.filter(F.array(F.concat(F.lit("RG:Z:"), "rg"), F.concat(F.lit("NM:i:"), F.col("p").cast("string")), F.concat(F.lit("XF:f:"), (F.col("p") % 7 / 2).cast("string")), F.lit("bad"), F.lit("XH:H:1AE3")), lambda x: x.isNotNull())
    df = reads(spark, sf).withColumn("aux", X.sam_tags(fields))
    df = df.withColumn("aux", X.remove_tag(X.set_tag(X.set_tag(F.col("aux"), "XX", X.tag_value("i", i=F.lit(1))), "XX", X.tag_value("Z", s=F.lit("new"))), "XX"))
    return df.select("read_id", X.tag_text(F.col("aux"), "RG").alias("rg"), X.tag_int(F.col("aux"), "NM").alias("nm"), X.tag_int_state(F.col("aux"), "NM", 0, 1000).alias("state"),
                     F.size("aux").alias("n_tags"), X.tag_float(F.col("aux"), "XF").alias("xf"), X.integer_type(F.col("p")).alias("width"))


@query("SELECT read_id, 'NM' AS tag, p AS i FROM reads UNION ALL SELECT read_id, 'RG', NULL FROM reads WHERE rg IS NOT NULL")
def gen_aux(spark, sf):
    fields = F.filter(F.array(F.concat(F.lit("RG:Z:"), "rg"), F.concat(F.lit("NM:i:"), F.col("p").cast("string"))), lambda x: x.isNotNull())
    return reads(spark, sf).select("read_id", F.explode(X.sam_tags(fields)).alias("tag", "v")).select("read_id", "tag", F.col("v.i").alias("i"))


_ALLELES = """(SELECT read_id, CASE p % 5 WHEN 0 THEN 'reference' WHEN 1 THEN 'snv' WHEN 2 THEN 'insertion' WHEN 3 THEN 'deletion' ELSE 'complex' END AS kind, left(seq, CASE WHEN p % 5 = 4 THEN 3 ELSE 1 END) AS r,
  substr(seq, 2, cast(p % 3 as int)) AS ch, [substr(seq, 3, 1), substr(seq, 5, 1)] AS alts FROM reads)"""


@query(f"""SELECT read_id, kind, CASE WHEN kind = 'deletion' THEN r || ch ELSE r END AS ref, CASE kind WHEN 'reference' THEN '.' WHEN 'insertion' THEN r || ch WHEN 'deletion' THEN r ELSE array_to_string(alts, ',') END AS alt,
  cast(CASE kind WHEN 'snv' THEN alts[1] <> r AND alts[2] <> r AND alts[1] <> alts[2] WHEN 'insertion' THEN length(ch) > 0 WHEN 'deletion' THEN length(ch) > 0 ELSE true END as int) AS valid,
  cast(CASE kind WHEN 'deletion' THEN 1 + length(ch) WHEN 'complex' THEN length(r) ELSE 1 END as int) AS rlen, CASE kind WHEN 'reference' THEN 1 WHEN 'snv' THEN 3 WHEN 'complex' THEN 3 ELSE 2 END AS n_allele FROM {_ALLELES}""")
def fn_alleles(spark, sf):
    df = reads(spark, sf).selectExpr(
        "read_id", "CASE p % 5 WHEN 0 THEN 'reference' WHEN 1 THEN 'snv' WHEN 2 THEN 'insertion' WHEN 3 THEN 'deletion' ELSE 'complex' END AS kind", "left(seq, CASE WHEN p % 5 = 4 THEN 3 ELSE 1 END) AS r",
        "substr(seq, 2, cast(p % 3 as int)) AS ch", "array(substr(seq, 3, 1), substr(seq, 5, 1)) AS alts")
    k, r, ch, a = (F.col(c) for c in ("kind", "r", "ch", "alts"))
    return df.select("read_id", "kind", V.ref_text(k, r, ch).alias("ref"), V.alt_text(k, r, ch, a).alias("alt"), _int(V.allele_is_valid(k, r, ch, a)).alias("valid"), V.record_length(k, r, ch).alias("rlen"), V.allele_count(k, a).alias("n_allele"))


@query("SELECT read_id, replace(replace(replace(replace(cigar_text || '%;' || rg, '%', '%25'), ';', '%3B'), '=', '%3D'), ':', '%3A') AS encoded, CASE WHEN p % 3 = 0 THEN '.' ELSE cast(p % 3 as varchar) END || CASE WHEN p % 2 = 0 THEN '|' ELSE '/' END || '1' AS gt FROM reads")
def fn_vcf_text(spark, sf):
    gt = V.genotype_text(F.array(F.when(F.col("p") % 3 != 0, F.col("p") % 3), F.lit(1).cast("long")), F.col("p") % 2 == 0)
    return reads(spark, sf).select("read_id", V.percent_encode(F.concat("cigar_text", F.lit("%;"), "rg")).alias("encoded"), gt.alias("gt"))


@query("""SELECT read_id, CASE WHEN p % 1000 = 0 THEN '0' ELSE rtrim(rtrim(printf('%.6f', (p % 1000) / 8000.0 ), '0'), '.') END AS small_text, cast(p as varchar) AS whole_text,
  '0.' || repeat('0', cast(8 + p % 17 as int)) || (1 + p % 9) AS tiny_text FROM reads""")
def fn_float_text(spark, sf):
    tiny = (F.col("p") % 9 + 1).cast("double") / F.pow(F.lit(10.0), 9 + F.col("p") % 17)
    return reads(spark, sf).select("read_id", V.float_text(F.col("p") % 1000 / 8000.0).alias("small_text"), V.float_text(F.col("p").cast("double")).alias("whole_text"), V.float_text(tiny).alias("tiny_text"))


@query("SELECT tid, count(*) AS n, round(coalesce(sqrt(avg(mapq * mapq)), 0), 6) AS rms FROM reads GROUP BY tid")
def agg_rms(spark, sf):
    return reads(spark, sf).groupBy("tid").agg(F.count("*").alias("n"), F.round(R.root_mean_square(F.col("mapq")), 6).alias("rms"))


# --- filters, projections, sources


@query("SELECT read_id, pos, end_pos FROM reads WHERE contig = 'chr1' AND pos <= 2000 AND end_pos >= 1000")
def flt_overlap(spark, sf):
    return intervals.overlapping(reads(spark, sf), "chr1", 1000, 2000).select("read_id", "pos", "end_pos")


@query("SELECT read_id, flags FROM reads WHERE flags & 4 = 0 AND flags & 3844 = 0 AND mapq >= 20")
def flt_standard(spark, sf):
    df = reads(spark, sf).where(~R.is_set(F.col("flags"), "unmapped") & ~R.is_set(F.col("flags"), STANDARD_EXCLUDE))
    return df.where("mapq >= 20").select("read_id", "flags")


@query("SELECT read_id, qlen * 10 + mapq AS extra FROM reads WHERE mapq > 5 AND (qlen * 10 + mapq) % 3 = 0")
def prj_extra(spark, sf):
    return rewrites.customize(reads(spark, sf), F.col("mapq") > 5, {"extra": F.col("seq_len") * 10 + F.col("mapq")}, F.col("extra") % 3 == 0).select("read_id", "extra")


@query("SELECT contig, count(*) AS fetched, cast(count(*) FILTER (WHERE mapq >= 20) as bigint) AS kept FROM reads WHERE flags & 4 = 0 GROUP BY contig")
def src_counts(spark, sf):
    return reads(spark, sf).where(~R.is_set(F.col("flags"), "unmapped")).groupBy("contig").agg(F.count("*").alias("fetched"), F.count_if(F.col("mapq") >= 20).alias("kept"))


@query("""SELECT qname, flags, contig, tid, pos, end_pos, mapq, cigar_text, seq, cast(list_sum(qual) as int) AS qual_sum, rg FROM reads WHERE flags & 4 = 0""")
def src_sam(spark, sf):
    df = reads(spark, sf)
    lines = sam.sam_lines(df.withColumn("aux", X.sam_tags(F.filter(F.array(F.concat(F.lit("RG:Z:"), "rg")), lambda x: x.isNotNull()))).withColumns({"next_contig": F.lit("*"), "next_pos": F.lit(-1), "template_len": F.lit(0)}))
    back = sam.parse_sam(lines, contigs(spark))
    return back.select("qname", "flags", "contig", "tid", "pos", "end_pos", "mapq", R.cigar_format(F.col("cigar")).alias("cigar_text"), "seq", F.aggregate("qual", F.lit(0), lambda a, x: a + x).alias("qual_sum"), X.tag_text(F.col("aux"), "RG").alias("rg"))


# --- generators


_PILE = "contig, pos, read_id, op, qpos, base, qual, insert_len, del_len, cast(is_refskip as int) AS is_refskip"


@query(f"SELECT {_PILE} FROM pile")
def gen_pileup(spark, sf):
    return events.pileup(reads(spark, sf)).select("contig", "pos", "read_id", "op", "qpos", "base", "qual", "insert_len", "del_len", _int(F.col("is_refskip")).alias("is_refskip"))


@query("SELECT contig, pos, read_id, op FROM pile WHERE contig = 'chr2' AND pos BETWEEN 500 AND 900")
def gen_pileup_region(spark, sf):
    return events.pileup(intervals.overlapping(reads(spark, sf), "chr2", 500, 900), 500, 900, payload=False).select("contig", "pos", "read_id", "op")


_PAIRS = """pairs AS (SELECT read_id, contig, CASE op WHEN 'M' THEN 'match' WHEN 'I' THEN 'insertion' WHEN 'D' THEN 'deletion' WHEN 'N' THEN 'refskip' ELSE 'soft_clip' END AS kind, op, seq, qual,
  CASE WHEN op IN ('M', 'I', 'S') THEN q_start + k END AS qpos, CASE WHEN op IN ('M', 'D', 'N') THEN ref_start + k END AS rpos, CASE WHEN op = 'M' THEN 1 ELSE len END AS len
  FROM (SELECT *, cast(unnest(range(0, CASE WHEN op = 'M' THEN len ELSE 1 END)) as int) AS k FROM off))"""


@query(f", {_PAIRS} SELECT read_id, kind, qpos, rpos, len FROM pairs WHERE kind <> 'soft_clip'")
def gen_pairs(spark, sf):
    return events.aligned_pairs(reads(spark, sf)).select("read_id", "kind", "qpos", "rpos", "len")


@query(f", {_PAIRS} SELECT read_id, kind, qpos, rpos, len FROM pairs")
def gen_pairs_soft(spark, sf):
    return events.aligned_pairs(reads(spark, sf), full=True).select("read_id", "kind", "qpos", "rpos", "len")


@query(f", {_PAIRS} SELECT read_id, qpos, rpos FROM pairs WHERE kind = 'match'")
def gen_pairs_match(spark, sf):
    return events.aligned_pairs(reads(spark, sf), matches_only=True).select("read_id", "qpos", "rpos")


@query(f", {_PAIRS} SELECT read_id, kind, qpos, substr(seq, qpos + 1, len) AS bases, cast(list_sum(qual[qpos + 1 : qpos + len]) as int) AS qual_sum FROM pairs")
def gen_pairs_read(spark, sf):
    return events.pairs_with_read(reads(spark, sf), soft_clips=True).select("read_id", "kind", "qpos", "bases", F.aggregate("quals", F.lit(0), lambda a, x: a + x).alias("qual_sum"))


@query(f", {_PAIRS} SELECT read_id, rpos, {REF_SQL.replace('tid', 'cast(right(contig, 1) as int)').replace('pos', 'rpos')} AS ref_base FROM pairs WHERE kind = 'match'")
def gen_pairs_ref(spark, sf):
    rows = events.aligned_pairs(reads(spark, sf), ("read_id", "contig"), matches_only=True)
    return pileups.with_reference(rows, reference(spark), CHUNK, "rpos").select("read_id", "rpos", "ref_base")


@query("SELECT read_id, cast(idx as int) AS idx, op, len, ref_start, q_start, next_ins FROM off")
def win_offsets(spark, sf):
    return events.ops(reads(spark, sf))


_TILES = f"SELECT 'chr' || t AS contig, s AS core_start, least(s + 499, {LAST_POS - 1}) AS core_end, greatest(s - 50, 0) AS tile_start, least(s + 499 + 50, {LAST_POS - 1}) AS tile_end FROM range(4) a(t), range(0, {LAST_POS}, 500) b(s)"


@query(f"SELECT contig, cast(core_start as int) AS core_start, cast(core_end as int) AS core_end, cast(tile_start as int) AS tile_start, cast(tile_end as int) AS tile_end FROM ({_TILES})", with_reads=False)
def gen_tiles(spark, sf):
    return intervals.tiles(intervals.resolve(contigs(spark), None), 500, 50)


@query(f", tiles AS ({_TILES}) SELECT read_id, cast(core_start as int) AS core_start FROM reads r JOIN tiles t ON t.contig = r.contig AND r.pos <= t.tile_end AND r.end_pos >= t.tile_start")
def jn_interval(spark, sf):
    return intervals.interval_join(reads(spark, sf).select("read_id", "contig", "pos", "end_pos"), gen_tiles(spark, sf), 256).select("read_id", "core_start")


@query("SELECT contig, pos, count(*) AS depth FROM pile GROUP BY contig, pos")
def flt_core(spark, sf):
    joined = intervals.interval_join(reads(spark, sf), gen_tiles(spark, sf), 256)
    rows = events.pileup(joined, keep=("read_id", "core_start", "core_end"), payload=False).where("pos BETWEEN core_start AND core_end")
    return rows.groupBy("contig", "pos").agg(F.count("*").alias("depth"))


# --- pileup aggregates


@query("""SELECT contig, pos, count(*) AS depth, count(qpos) AS match_depth, count(*) FILTER (WHERE op IN ('deletion', 'complex_indel')) AS n_del, count(*) FILTER (WHERE is_refskip) AS n_refskip,
  count(*) FILTER (WHERE op IN ('insertion', 'complex_indel')) AS n_ins FROM pile GROUP BY contig, pos""")
def pileup_depth(spark, sf):
    return pileups.column_counts(events.pileup(reads(spark, sf), keep=("read_id",), payload=False))


@query(f"SELECT contig, pos, read_id, {REF_SQL} AS ref_base FROM pile")
def jn_refbase(spark, sf):
    df = events.with_reference_window(reads(spark, sf), reference(spark), CHUNK)
    return events.pileup(df, keep=("read_id",), payload=False, ref=True).select("contig", "pos", "read_id", "ref_base")


@query(f"""SELECT contig, pos, CASE WHEN pos + 7 <= {LAST_POS} THEN array_to_string(list_transform(range(pos, pos + 7), lambda k: {REF_SQL.replace('pos', 'k')}), '') END AS ref_bases FROM (SELECT DISTINCT contig, tid, pos + 100 AS pos FROM reads)""")
def jn_refrange(spark, sf):
    return pileups.reference_ranges(reads(spark, sf).select("contig", (F.col("pos") + 100).alias("pos")).distinct(), reference(spark), CHUNK, 7)


_COUNTS = ", counts AS (SELECT contig, tid, pos, " + ", ".join(f"count(*) FILTER (WHERE base = '{b}') AS {b.lower()}" for b in "ACGTN") + " FROM pile WHERE qpos IS NOT NULL {where} GROUP BY contig, tid, pos)"


@query(_COUNTS.format(where="") + " SELECT contig, pos, a, c, g, t, n, a + c + g + t AS total FROM counts")
def agg_basecount(spark, sf):
    return pileups.base_counts(events.pileup(reads(spark, sf), keep=("read_id",)))


_BEST = f""", refd AS (SELECT *, a + c + g + t AS total, {REF_SQL} AS ref_base FROM counts),
best AS (SELECT *, CASE WHEN ref_base = 'A' THEN 0 ELSE a END AS na, CASE WHEN ref_base = 'C' THEN 0 ELSE c END AS nc, CASE WHEN ref_base = 'G' THEN 0 ELSE g END AS ng, CASE WHEN ref_base = 'T' THEN 0 ELSE t END AS nt FROM refd),
alt AS (SELECT *, greatest(na, nc, ng, nt) AS m FROM best),
called AS (SELECT contig, pos, ref_base, total, CASE WHEN m = 0 THEN NULL WHEN na = m THEN 'A' WHEN nc = m THEN 'C' WHEN ng = m THEN 'G' ELSE 'T' END AS alt, nullif(m, 0) AS alt_count FROM alt)"""


@query(_COUNTS.format(where="") + _BEST + " SELECT contig, pos, ref_base, alt, alt_count FROM called")
def agg_bestalt(spark, sf):
    counts = pileups.with_reference(pileups.base_counts(events.pileup(reads(spark, sf), keep=("read_id",))), reference(spark), CHUNK)
    return pileups.best_alternative(counts).select("contig", "pos", "ref_base", "alt", "alt_count")


_SNV = _COUNTS.format(where="AND mapq >= 20 AND flags & 3844 = 0") + _BEST


@query(_SNV + """ SELECT contig, pos, ref_base, alt, total AS depth, round(alt_count / total, 9) AS af, CASE WHEN alt_count / total >= 0.8 THEN '1/1' ELSE '0/1' END AS gt FROM called
  WHERE total >= 5 AND alt IS NOT NULL AND alt_count / total >= 0.1""")
def qry_snv(spark, sf):
    return pileups.call_snvs(events.pileup(reads(spark, sf)), reference(spark), CHUNK).withColumn("af", F.round("af", 9))


_VCF_LINE = """contig || chr(9) || (pos + 1) || chr(9) || '.' || chr(9) || ref_base || chr(9) || alt || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || 'DP=' || total || ';AF=' || format('{:g}', cast(cast(alt_count / total as float) as double))
  || chr(9) || 'GT:DP' || chr(9) || CASE WHEN alt_count / total >= 0.8 THEN '1/1' ELSE '0/1' END || ':' || total"""


@query(_SNV + f""" SELECT contig, pos, {_VCF_LINE} AS line FROM called WHERE total >= 5 AND alt IS NOT NULL AND alt_count / total >= 0.1""")
def snk_vcf(spark, sf):
    return pileups.vcf_lines(pileups.call_snvs(events.pileup(reads(spark, sf)), reference(spark), CHUNK))


@query("""SELECT contig, pos, read_id FROM (SELECT contig, pos, read_id, row_number() OVER (PARTITION BY contig, pos ORDER BY read_pos, read_id) AS k FROM pile) WHERE k <= 5""")
def win_maxdepth(spark, sf):
    rows = events.pileup(reads(spark, sf).withColumn("read_pos", F.col("pos")), keep=("read_id", "read_pos"), payload=False)
    return pileups.cap_depth(rows, 5).select("contig", "pos", "read_id")


@query("""SELECT contig, pos, qname, read_id FROM (SELECT *, row_number() OVER (PARTITION BY contig, pos, qname ORDER BY qpos IS NULL, flags & 64 = 0, read_id) AS k FROM pile) WHERE k = 1""")
def win_dedup_mate(spark, sf):
    return pileups.dedup_mates(events.pileup(reads(spark, sf), keep=("read_id", "qname", "flags"))).select("contig", "pos", "qname", "read_id")


@query("""SELECT g.contig, cast(g.p as int) AS pos, count(pile.read_id) AS depth FROM (SELECT 'chr' || t AS contig, p FROM range(4) a(t), range(0, 4100) b(p)) g
  LEFT JOIN pile ON pile.contig = g.contig AND pile.pos = g.p GROUP BY g.contig, g.p""")
def win_gaps_dense(spark, sf):
    grid = contigs(spark).select(F.col("name").alias("contig"), F.explode(F.sequence(F.lit(0), F.col("length").cast("int") - 1)).alias("pos"))
    depth = events.pileup(reads(spark, sf), keep=("read_id",), payload=False).groupBy("contig", "pos").agg(F.count("*").alias("depth"))
    return grid.join(depth, ["contig", "pos"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


@query("""SELECT contig, pos, cast(sum(n) as bigint) AS depth, string_agg(g || ':' || n, ',' ORDER BY n DESC, seen) AS tallies, round(sum(s) / sum(n), 9) AS mean_aligned
  FROM (SELECT contig, pos, coalesce(p.rg, '.') AS g, count(*) AS n, min(read_id) AS seen, sum(share) AS s FROM pile p JOIN (SELECT read_id, (m1 + m2) / qlen AS share FROM reads) USING (read_id) GROUP BY contig, pos, g) GROUP BY contig, pos""")
def qry_extras(spark, sf):
    df = reads(spark, sf).withColumn("aligned_share", F.col("matching_bases") / F.col("seq_len"))
    return pileups.read_group_tallies(events.pileup(df, keep=("read_id", "rg", "aligned_share"), payload=False)).withColumn("mean_aligned", F.round("mean_aligned", 9))


def _mpileup_sql() -> str:
    low = "flags & 16 <> 0"
    case = lambda x: f"CASE WHEN {low} THEN lower({x}) ELSE {x} END"
    base = f"CASE WHEN base = ref_base THEN CASE WHEN {low} THEN ',' ELSE '.' END ELSE {case('base')} END"
    ins = f"'+' || insert_len || {case('substr(seq, coalesce(qpos + 2, q_next + 1), insert_len)')}"
    body = f"CASE op WHEN 'match' THEN {base} WHEN 'insertion' THEN {base} || {ins} WHEN 'deletion' THEN '*' ELSE CASE WHEN op = 'complex_indel' AND NOT is_refskip THEN '*' || {ins} ELSE CASE WHEN {low} THEN '<' ELSE '>' END END END"
    return f""", m AS (SELECT *, {REF_SQL} AS ref_base FROM pile)
SELECT contig, pos + 1 AS pos1, ref_base, count(*) AS depth,
  string_agg(CASE WHEN pos = read_pos THEN '^' || chr(cast(mapq + 33 as int)) ELSE '' END || {body} || CASE WHEN pos = read_end THEN '$' ELSE '' END, '' ORDER BY read_pos, read_id) AS bases,
  string_agg(CASE WHEN qual IS NULL THEN '~' ELSE chr(cast(qual + 33 as int)) END, '' ORDER BY read_pos, read_id) AS quals
FROM m GROUP BY contig, pos, ref_base"""


@query(_mpileup_sql())
def qry_mpileup(spark, sf):
    df = events.with_reference_window(reads(spark, sf).withColumns({"read_pos": F.col("pos"), "read_end": F.col("end_pos")}), reference(spark), CHUNK)
    return pileups.mpileup_text(events.pileup(df, keep=("read_id", "mapq", "flags", "read_pos", "read_end"), inserted=True, ref=True))


# --- read-level folds


_NM = f""", ev AS (SELECT read_id, tid, op, len, seq, q_start, ref_start, unnest(range(0, CASE WHEN op = 'M' THEN len ELSE 1 END)) AS k FROM off WHERE op IN ('M', 'I', 'D'))
SELECT read_id, cast(sum(CASE WHEN op = 'M' THEN CASE WHEN substr(seq, cast(q_start + k + 1 as int), 1) = {REF_SQL.replace('pos', '(ref_start + k)')} THEN 0 ELSE 1 END ELSE len END) as int) AS nm FROM ev GROUP BY read_id"""


@query(_NM)
def agg_nm(spark, sf):
    df = events.with_reference_window(reads(spark, sf), reference(spark), CHUNK)
    return df.select("read_id", events.edit_distance(F.col("pos"), F.col("cigar"), F.col("seq"), F.col("ref_seq")).alias("nm"))


_MD = f""", ev AS (SELECT read_id, tid, idx, op, len, seq, q_start, ref_start, unnest(range(0, CASE WHEN op = 'M' THEN len ELSE 1 END)) AS k FROM off WHERE op IN ('M', 'D')),
b AS (SELECT *, {REF_SQL.replace('pos', '(ref_start + k)')} AS rb, substr(seq, cast(q_start + k + 1 as int), 1) AS qb FROM ev),
t AS (SELECT *, op = 'M' AND qb = rb AS same, CASE WHEN op = 'D' THEN '^' || array_to_string(list_transform(range(ref_start, ref_start + len), lambda x: {REF_SQL.replace('pos', 'x')}), '') ELSE rb END AS mark FROM b),
g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY read_id ORDER BY idx, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp FROM t),
r AS (SELECT read_id, coalesce(grp, 0) AS grp, count(*) FILTER (WHERE same) AS run, coalesce(max(CASE WHEN NOT same THEN mark END), '') AS mark, min(idx * 10000 + k) AS o FROM g GROUP BY read_id, coalesce(grp, 0))
SELECT read_id, string_agg(run || mark, '' ORDER BY o) || CASE WHEN last(mark ORDER BY o) <> '' THEN '0' ELSE '' END AS md FROM r GROUP BY read_id"""


@query(_MD)
def agg_md(spark, sf):
    df = events.with_reference_window(reads(spark, sf), reference(spark), CHUNK)
    return df.select("read_id", events.mismatch_text(F.col("pos"), F.col("cigar"), F.col("seq"), F.col("ref_seq")).alias("md"))


@query(f""", ev AS (SELECT * FROM off WHERE flags & 4 = 0), m AS (SELECT contig, read_id, substr(seq, cast(q_start + k + 1 as int), 1) AS qb, qual[cast(q_start + k + 1 as int)] AS q, {REF_SQL.replace('pos', '(ref_start + k)')} AS rb FROM (SELECT *, unnest(range(0, len)) AS k FROM ev WHERE op = 'M')),
a AS (SELECT contig, count(DISTINCT read_id) AS records, count(*) FILTER (WHERE op = 'I') AS insertions, cast(coalesce(sum(len) FILTER (WHERE op = 'I'), 0) as bigint) AS inserted, count(*) FILTER (WHERE op = 'D') AS deletions, cast(coalesce(sum(len) FILTER (WHERE op = 'D'), 0) as bigint) AS deleted FROM ev GROUP BY contig)
SELECT a.*, ct, snv FROM a JOIN (SELECT contig, count(*) FILTER (WHERE rb = 'C' AND qb = 'T' AND q >= 20) AS ct, count(*) FILTER (WHERE rb <> qb AND qb <> 'N' AND q >= 20) AS snv FROM m GROUP BY contig) USING (contig)""")
def qry_walk(spark, sf):
    df = events.with_reference_window(reads(spark, sf).where(~R.is_set(F.col("flags"), "unmapped")), reference(spark), CHUNK)
    walked = df.select("contig", events.walk_counts(F.col("pos"), F.col("cigar"), F.col("seq"), F.col("qual"), F.col("ref_seq"), 20).alias("w"))
    sums = ("insertions", "inserted", "deletions", "deleted", "ct", "snv")
    return walked.groupBy("contig").agg(F.count("*").alias("records"), *(F.sum(F.col(f"w.{n}").cast("long")).alias(n) for n in sums))


# --- base modifications


_MODS = """, base AS (SELECT read_id, contig, flags, p, ml0, ml1, q.b AS b, q.i AS i, flags & 16 <> 0 AS back, qlen FROM (SELECT *, unnest(list_transform(range(0, qlen), lambda x: {'i': x, 'b': substr(seq, cast(x + 1 as int), 1)})) AS q FROM reads WHERE p % 4 <> 0)),
ord AS (SELECT *, CASE WHEN back THEN translate(b, 'ACGT', 'TGCA') ELSE b END AS fb, row_number() OVER (PARTITION BY read_id, b ORDER BY CASE WHEN back THEN -i ELSE i END) - 1 AS k FROM base),
want AS (SELECT * FROM (VALUES (1, 'C', 'm', 0, 0, 'implicit'), (1, 'C', 'm', 2, 1, 'implicit'), (2, 'C', 'm', 1, 0, 'ambiguous'), (2, 'A', 'a', 0, 1, 'unmodified'), (3, 'C', 'm', 0, 0, 'implicit'), (3, 'C', 'h', 0, 1, 'implicit')) w(kind, cb, code, k, mi, mode)),
hit AS (SELECT r.read_id, r.contig, o.i AS qpos, w.code, CASE WHEN w.mi = 0 THEN r.ml0 ELSE r.ml1 END AS probability, w.cb, w.mode FROM reads r JOIN want w ON w.kind = r.p % 4 LEFT JOIN ord o ON o.read_id = r.read_id AND o.fb = w.cb AND o.k = w.k),
bad AS (SELECT DISTINCT read_id FROM hit WHERE qpos IS NULL),
mods AS (SELECT * FROM hit WHERE read_id NOT IN (SELECT read_id FROM bad))"""


@query(_MODS + " SELECT read_id, cast(qpos as int) AS qpos, code, probability, cb AS canonical_base, mode, NULL AS error FROM mods UNION ALL SELECT read_id, NULL, NULL, NULL, NULL, NULL, 'call outside the sequence' FROM bad")
def gen_mods(spark, sf):
    return basemods.modifications(reads(spark, sf)).select("read_id", "qpos", "code", "probability", "canonical_base", "mode", "error")


_PLACED = _MODS + ", placed AS (SELECT m.*, cast(o.ref_start + m.qpos - o.q_start as int) AS pos FROM mods m JOIN off o ON o.read_id = m.read_id AND o.op = 'M' AND m.qpos BETWEEN o.q_start AND o.q_start + o.len - 1)"


@query(_PLACED + " SELECT read_id, contig, pos, code, probability FROM placed")
def jn_mods(spark, sf):
    return basemods.placed_modifications(reads(spark, sf)).select("read_id", "contig", "pos", "code", "probability")


@query(_PLACED + " SELECT contig, pos, code, count(*) FILTER (WHERE probability >= 128) AS modified, count(*) FILTER (WHERE probability < 128) AS unmodified, round(count(*) FILTER (WHERE probability >= 128) / count(*), 9) AS frequency FROM placed GROUP BY contig, pos, code")
def qry_methyl(spark, sf):
    return basemods.methylation(basemods.placed_modifications(reads(spark, sf))).withColumn("frequency", F.round("frequency", 9))


_LETTERS = "(SELECT *, unnest(list_transform(range(0, qlen), lambda x: {'i': x, 'b': substr(seq, cast(x + 1 as int), 1)})) AS q FROM reads)"


@query(f"SELECT read_id, cast(q.i as int) AS qpos, q.b AS base, cast(row_number() OVER (PARTITION BY read_id, q.b ORDER BY CASE WHEN flags & 16 <> 0 THEN -q.i ELSE q.i END) - 1 as int) AS ordinal FROM {_LETTERS} WHERE q.b <> 'N'")
def win_ordinal(spark, sf):
    return basemods.base_ordinals(reads(spark, sf))


@query(_MODS + f"""
SELECT l.read_id, cast(l.q.i as int) AS qpos, l.q.b AS base, CASE WHEN EXISTS (SELECT 1 FROM mods m WHERE m.read_id = l.read_id AND m.qpos = l.q.i) THEN false WHEN l.p % 4 = 2 AND CASE WHEN l.flags & 16 <> 0 THEN translate(l.q.b, 'ACGT', 'TGCA') ELSE l.q.b END = 'A' THEN true END AS unmodified
FROM {_LETTERS} l WHERE l.p % 4 <> 0 AND l.q.b <> 'N' AND l.read_id NOT IN (SELECT read_id FROM bad)""")
def fn_unmodified(spark, sf):
    return basemods.unmodified(reads(spark, sf))


# --- rewrites, order, mates


_CLIP = """(SELECT read_id, s, m1, m2, i, d, n, p, qlen, rlen, CASE WHEN s = 0 AND m1 >= 8 THEN pos + 3 ELSE pos END AS pos, pos + rlen - 1 AS end_pos, CASE WHEN s = 0 AND (m1 >= 8 OR (i = 0 AND d = 0 AND n = 0 AND m1 >= 8)) THEN '3S' || (m1 - 3) || 'M' || substr(cigar_text, length(cast(m1 as varchar)) + 2) ELSE cigar_text END AS cigar_text FROM reads)"""


@query(f"SELECT read_id, pos, end_pos, cigar_text, 0 AS rejected FROM {_CLIP}")
def qry_realign(spark, sf):
    df = reads(spark, sf).withColumn("new", rewrites.soft_clip_start(F.col("pos"), F.col("cigar"), 8, 3))
    out = rewrites.set_alignment(df, F.col("new.pos"), F.col("new.cigar"))
    return rewrites.coordinate_sorted(out).select("read_id", "pos", "end_pos", R.cigar_format(F.col("cigar")).alias("cigar_text"), _int(F.col("rejected")).alias("rejected"))


@query("SELECT read_id, pos, p % 2 = 0 AS rejected, CASE WHEN p % 2 = 0 THEN cigar_text ELSE qlen || 'M' END AS cigar_text, CASE WHEN p % 2 = 0 THEN end_pos ELSE pos + qlen - 1 END AS end_pos FROM reads")
def mut_align(spark, sf):
    new = R.cigar_parse(F.concat((F.col("qlen") + F.when(F.col("p") % 2 == 0, 1).otherwise(0)).cast("string"), F.lit("M")))
    out = rewrites.set_alignment(reads(spark, sf), F.col("pos"), new)
    return out.select("read_id", "pos", "rejected", R.cigar_format(F.col("cigar")).alias("cigar_text"), "end_pos")


@query("SELECT tid, pos, read_id, row_number() OVER (ORDER BY tid, pos, read_id) AS k FROM reads")
def srt_pos(spark, sf):
    return rewrites.numbered(rewrites.coordinate_sorted(reads(spark, sf).select("tid", "pos", "read_id")), "k")


@query("""SELECT tid, read_id, pos, f, q FROM (SELECT *, lag(struct_pack(a := pos, b := f, c := q)) OVER (PARTITION BY tid ORDER BY pos, read_id) AS was FROM (SELECT tid, read_id, cast(pos - pos % 40 as int) AS pos, cast(flags & 16 as int) AS f, 'q' || (read_id % 3) AS q FROM reads)) WHERE was IS NULL OR was <> struct_pack(a := pos, b := f, c := q)""")
def ddp_adjacent(spark, sf):
    df = reads(spark, sf).selectExpr("tid", "read_id", "cast(pos - pos % 40 as int) AS pos", "cast(flags & 16 as int) AS flags", "concat('q', cast(read_id % 3 as string)) AS qname")
    return rewrites.drop_adjacent_duplicates(df, "tid").select("tid", "read_id", "pos", F.col("flags").alias("f"), F.col("qname").alias("q"))


@query("""SELECT read_id, CASE WHEN n = 2 THEN coalesce(nt, lt) ELSE -1 END AS mate_tid, CASE WHEN n = 2 THEN coalesce(np, lp) ELSE -1 END AS mate_pos, CASE WHEN n = 2 AND t0 = t1 THEN CASE WHEN k = 1 THEN span ELSE -span END ELSE 0 END AS tlen
FROM (SELECT read_id, count(*) OVER w AS n, min(tid) OVER w AS t0, max(tid) OVER w AS t1, max(end_pos) OVER w - min(pos) OVER w + 1 AS span, row_number() OVER o AS k, lead(tid) OVER o AS nt, lag(tid) OVER o AS lt, lead(pos) OVER o AS np, lag(pos) OVER o AS lp
  FROM reads WHERE flags & 2304 = 0 WINDOW w AS (PARTITION BY qname), o AS (PARTITION BY qname ORDER BY pos, CASE WHEN flags & 64 <> 0 THEN 0 ELSE 1 END, read_id))""")
def jn_mate(spark, sf):
    return rewrites.mates(reads(spark, sf)).select("read_id", "mate_tid", "mate_pos", "tlen")


@query("""SELECT contig, min(pos) AS pos, max(end_pos) AS end_pos FROM (SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY pos, end_pos, read_id) AS g FROM (
  SELECT *, CASE WHEN pos > max(end_pos) OVER (PARTITION BY contig ORDER BY pos, end_pos, read_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM reads)) GROUP BY contig, g""")
def prn_merge(spark, sf):
    return intervals.merge_intervals(reads(spark, sf).select("contig", "pos", "end_pos"), "contig", "pos", "end_pos")
