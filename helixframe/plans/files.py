"""Queries that write the synthetic reads, reference and calls to files of each format and read them back, and their SQL."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reads as R
from ..functions import tags as X
from ..functions import variants as V
from ..operators import events, intervals, pileups, rewrites
from ..sources import alignments, bam, bcf, bgzf, cram, fasta, index, sam, vcf
from .registry import _SNV, _VCF_LINE, query
from .synthetic import CHUNK, LAST_POS, REF_SQL, contigs, reads, reference

CONTIGS = [(f"chr{k}", LAST_POS) for k in range(4)]
HEADER = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in CONTIGS)
LINE = 60


def _scratch(spark: SparkSession) -> str:
    """A fresh folder that driver and workers mount: in the one that spark.checkpoint.dir names, else, in a session of one machine, an own one that goes with the process."""
    root = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://").removeprefix("file:")
    if root and "://" not in root:
        os.makedirs(root, exist_ok=True)
        return os.path.join(root, f"files-{uuid.uuid4().hex}")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a mounted folder")
    made = tempfile.mkdtemp(prefix="helixframe-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return os.path.join(made, "out")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """The synthetic reads with all columns of the files."""
    aux = X.sam_tags(F.filter(F.array(F.concat(F.lit("RG:Z:"), "rg"), F.concat(F.lit("NM:i:"), (F.col("p") % 300).cast("string")), F.concat(F.lit("XF:f:"), (F.col("p") % 7 / 2).cast("string"))), lambda x: x.isNotNull()))
    return reads(spark, sf).withColumns({"aux": aux, "next_tid": F.lit(-1), "next_pos": F.lit(-1), "next_contig": F.lit("*"), "template_len": (F.col("p") % 100).cast("int")})


_COLUMNS = "qname, flags, contig, tid, pos, end_pos, mapq, cigar_text, seq, cast(list_sum(qual) as int) AS qual_sum, rg, p % 300 AS nm, cast(p % 7 as double) / 2 AS xf, cast(p % 100 as int) AS tlen"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(
        "qname", "flags", "contig", "tid", "pos", "end_pos", "mapq", R.cigar_format(F.col("cigar")).alias("cigar_text"), "seq", F.aggregate("qual", F.lit(0), lambda a, x: a + x).alias("qual_sum"),
        X.tag_text(F.col("aux"), "RG").alias("rg"), X.tag_int(F.col("aux"), "NM").alias("nm"), X.tag_float(F.col("aux"), "XF").alias("xf"), F.col("template_len").alias("tlen"),
    )


def _written(spark: SparkSession, sf: str, **options) -> str:
    path = _scratch(spark)
    bam.write_bam(_records(spark, sf), path, CONTIGS, HEADER, partitions=4, **options)
    return path


# --- alignments


@query(f"SELECT {_COLUMNS} FROM reads WHERE flags & 4 = 0")
def src_bam(spark, sf):
    return _shown(bam.read_bam(spark, _written(spark, sf)))


@query(f"SELECT {_COLUMNS} FROM reads")
def snk_bam(spark, sf):
    return _shown(bam.read_bam(spark, _written(spark, sf, level=1), keepUnmapped="true"))


@query("SELECT qname, flags, pos FROM reads WHERE flags & 4 = 0 AND contig = 'chr2' AND pos <= 1500 AND end_pos >= 1200")
def prn_query(spark, sf):
    return intervals.overlapping(bam.read_bam(spark, _written(spark, sf), chunkBytes="4096"), "chr2", 1200, 1500).select("qname", "flags", "pos")


@query("SELECT contig, count(*) AS n, cast(sum(pos) as bigint) AS places FROM reads WHERE flags & 4 = 0 GROUP BY contig")
def src_bulk(spark, sf):
    df = bam.read_bam(spark, _written(spark, sf, index="false"))
    return df.groupBy("contig").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))


@query("SELECT qname, flags, pos, cigar_text FROM reads WHERE flags & 4 = 0")
def src_inmem(spark, sf):
    path = _written(spark, sf)
    parts = [n for n in sorted(os.listdir(path)) if n.endswith(".bam")]
    made = None
    for name in parts:
        with open(os.path.join(path, name), "rb") as f:
            part = bam.read_bytes(spark, f.read())
        made = part if made is None else made.unionByName(part)
    return made.select("qname", "flags", "pos", R.cigar_format(F.col("cigar")).alias("cigar_text"))


@query(f"SELECT {_COLUMNS} FROM reads WHERE flags & 4 = 0")
def src_sam_file(spark, sf):
    path = _scratch(spark)
    sam.write_sam(_records(spark, sf), HEADER, path)
    return _shown(sam.read_sam(spark, f"{path}/*", malformed="fail"))


def _sam_blocks(spark: SparkSession, sf: str) -> str:
    """A blocked SAM file of the synthetic reads with a .tbi index."""
    path = _scratch(spark) + ".sam.gz"
    sam.write_sam_blocks(_records(spark, sf), HEADER, path, [n for n, _ in CONTIGS])
    return path


@query(f"SELECT {_COLUMNS} FROM reads WHERE flags & 4 = 0")
def src_sam_blocks(spark, sf):
    return _shown(sam.read_sam_blocks(spark, _sam_blocks(spark, sf)))


@query("SELECT qname, flags, pos FROM reads WHERE flags & 4 = 0 AND contig = 'chr3' AND pos <= 900 AND end_pos >= 700")
def prn_tbi(spark, sf):
    return sam.read_sam_blocks(spark, _sam_blocks(spark, sf), "chr3", 700, 900).select("qname", "flags", "pos")


@query("SELECT contig, 2 * count(*) AS n FROM reads WHERE flags & 4 = 0 GROUP BY contig")
def src_unified(spark, sf):
    text = _scratch(spark)
    sam.write_sam(_records(spark, sf), HEADER, text)
    both = [alignments.read_alignments(spark, p).select("contig") for p in (_written(spark, sf), f"{text}/*")]
    return both[0].unionByName(both[1]).groupBy("contig").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('bam'), ('sam'), ('sam.gz'), ('cram'), ('vcf'), ('error')) t(kind)", with_reads=False)
def src_detect(spark, sf):
    path = _scratch(spark)
    os.makedirs(path)
    files = {"bam": bgzf.encode_block(b"BAM\x01" + bytes(12)), "sam": b"@HD\tVN:1.6\n", "sam.gz": bgzf.encode_block(b"@HD\tVN:1.6\n"), "cram": b"CRAM\x03\x00", "vcf": b"##fileformat=VCFv4.3\n", "error": b"ab"}
    found = []
    for name, data in files.items():
        with open(os.path.join(path, name), "wb") as f:
            f.write(data)
        try:
            found.append((bam.detect(os.path.join(path, name)),))
        except ValueError:
            found.append(("error",))
    return spark.createDataFrame(found, "kind string")


@query("SELECT * FROM (VALUES (0, 'chr0', 4100), (1, 'chr1', 4100), (2, 'chr2', 4100), (3, 'chr3', 4100)) t(tid, name, length)", with_reads=False)
def src_header(spark, sf):
    lines = spark.createDataFrame([(x,) for x in HEADER.splitlines()], "value string").coalesce(1)
    return sam.header_contigs(lines).select("tid", "name", F.col("length").cast("int").alias("length"))


def _cram(spark: SparkSession, sf: str, embed: bool = False) -> tuple[str, str]:
    """A CRAM file of the mapped synthetic reads, 500 to a slice, and its reference; written by the driver from the small table."""
    path, fasta_path, chunks = _scratch(spark) + ".cram", _fasta(spark, plain=True), reference(spark).orderBy("contig", "chunk_start").collect()
    texts = ["".join(r["bases"] for r in chunks if r["contig"] == n) for n, _ in CONTIGS]
    rows = _records(spark, sf).where("flags & 4 = 0").orderBy("tid", "pos", "read_id").select("tid", "flags", "pos", "end_pos", "mapq", "qname", "cigar", "seq", "qual", "rg", "next_tid", "next_pos", "template_len")
    groups = ["rg0", "rg1", "rg2"]
    methods = (cram.RAW, cram.GZIP, cram.BZIP2, cram.LZMA, cram.RANS)
    with open(path, "wb") as f:
        f.write(cram.file_start(HEADER + "".join(f"@RG\tID:{g}\n" for g in groups)))
        held, counter = [], 0

        def flush():
            nonlocal counter
            if held:
                f.write(cram.encode_slice(held, held[0]["tid"], texts[held[0]["tid"]], counter, groups, methods[counter // 500 % len(methods)], embed))
                counter += len(held)
                held.clear()

        for r in rows.toLocalIterator():
            if held and (held[0]["tid"] != r["tid"] or len(held) == 500):
                flush()
            held.append(r.asDict() | {"cigar": [(o["op"], o["len"]) for o in r["cigar"]]})
        flush()
        f.write(cram.file_end())
    return path, fasta_path


#: The format does not tell two neighbouring M from one.
_JOINED = "CASE WHEN i = 0 AND d = 0 AND n = 0 THEN CASE WHEN s > 0 THEN s || 'S' ELSE '' END || (m1 + m2) || 'M' ELSE cigar_text END AS cigar_text"
_CRAM_COLUMNS = f"qname, flags, contig, tid, pos, end_pos, mapq, {_JOINED}, seq, cast(list_sum(qual) as int) AS qual_sum, rg, cast(p % 100 as int) AS tlen"


@query(f"SELECT {_CRAM_COLUMNS} FROM reads WHERE flags & 4 = 0")
def src_cram(spark, sf):
    path, fasta_path = _cram(spark, sf)
    return _shown(cram.read_cram(spark, path, fasta_path)).drop("nm", "xf")


@query(f"SELECT qname, flags, pos, {_JOINED}, seq FROM reads WHERE flags & 4 = 0 AND contig = 'chr2' AND pos <= 1500 AND end_pos >= 1200")
def src_cram_region(spark, sf):
    path, _ = _cram(spark, sf, embed=True)
    return cram.read_cram(spark, path, None, "chr2", 1200, 1500).select("qname", "flags", "pos", R.cigar_format(F.col("cigar")).alias("cigar_text"), "seq")


# --- reference


def _fasta(spark: SparkSession, blocked: bool = False, plain: bool = False) -> str:
    """A FASTA file of the reference with its .fai, with lower-case letters and other codes unless plain."""
    path, at, fai = _scratch(spark) + ".fa", 0, []
    rows = reference(spark).orderBy("contig", "chunk_start").collect()
    text = []
    for name, _ in CONTIGS:
        bases = "".join(r["bases"] for r in rows if r["contig"] == name)
        bases = bases if plain else bases.replace("T", "t").replace("GA", "RA")
        head = f">{name} made\n"
        body = "".join(bases[k : k + LINE] + "\n" for k in range(0, len(bases), LINE))
        fai.append(f"{name}\t{len(bases)}\t{at + len(head)}\t{LINE}\t{LINE + 1}")
        at += len(head) + len(body)
        text.append(head + body)
    raw = "".join(text).encode()
    if blocked:
        gzi, done = [], 0
        with open(path, "wb") as f:
            for k in range(0, len(raw), 5000):
                if k:
                    gzi.append((done, k))
                done += f.write(bgzf.encode_block(raw[k : k + 5000]))
            f.write(bgzf.EOF_BLOCK)
        with open(path + ".gzi", "wb") as f:
            f.write(len(gzi).to_bytes(8, "little") + b"".join(x.to_bytes(8, "little") for pair in gzi for x in pair))
    else:
        with open(path, "wb") as f:
            f.write(raw)
    with open(path + ".fai", "w") as f:
        f.write("\n".join(fai) + "\n")
    return path


def _fasta_sql(known: bool) -> str:
    base = REF_SQL.replace("tid", "t").replace("pos", "k")
    change = "replace(b, 'GA', 'NA')" if known else "replace(b, 'GA', 'RA')"
    return f"""SELECT contig, cast(s as int) AS chunk_start, substr(b, cast(s + 1 as int), 1000) AS bases FROM (SELECT contig, {change} AS b FROM (
  SELECT 'chr' || t AS contig, array_to_string(list_transform(range(0, {LAST_POS}), lambda k: {base}), '') AS b FROM range(4) a(t))), range(0, {LAST_POS}, 1000) c(s)"""


@query(_fasta_sql(True), with_reads=False)
def src_fasta(spark, sf):
    return fasta.read_fasta(spark, _fasta(spark), 1000)


@query(_fasta_sql(False), with_reads=False)
def src_fasta_base(spark, sf):
    return fasta.read_fasta(spark, _fasta(spark), 1000, bases=False)


@query(_fasta_sql(True), with_reads=False)
def src_fasta_indexed(spark, sf):
    path = _fasta(spark)
    return fasta.read_fasta_indexed(spark, path, fasta.read_fai(spark, path + ".fai"), 1000)


@query(_fasta_sql(True), with_reads=False)
def src_gzi(spark, sf):
    path = _fasta(spark, blocked=True)
    with open(path + ".gzi", "rb") as f:
        return fasta.read_fasta_indexed(spark, path, fasta.read_fai(spark, path + ".fai"), 1000, gzi=f.read())


@query(f"""SELECT 'chr' || t AS name, cast({LAST_POS} as bigint) AS length, cast(t * ({LAST_POS} + 69 + 11) + 11 as bigint) AS "offset", cast(60 as bigint) AS linebases, cast(61 as bigint) AS linewidth,
  cast(t * ({LAST_POS} + 69 + 11) + 11 + 61 * 2 + 5 as bigint) AS at125 FROM range(4) a(t)""", with_reads=False)
def src_fai(spark, sf):
    return fasta.read_fai(spark, _fasta(spark) + ".fai").withColumn("at125", fasta.byte_offset(F.lit(125)).cast("long"))


# --- variants


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    return pileups.call_snvs(events.pileup(reads(spark, sf)), reference(spark), CHUNK)


def _vcf_header(samples: list[str]) -> list[str]:
    infos = [("DP", "1", "Integer", "Depth"), ("AF", "A", "Float", "Share")]
    formats = [("GT", "1", "String", "Genotype"), ("DP", "1", "Integer", "Depth")]
    return V.header_text(CONTIGS, infos=infos, formats=formats, samples=samples)


@query(_SNV + f" SELECT contig, cast(pos + 1 as int) AS pos1, {_VCF_LINE} AS line FROM called WHERE total >= 5 AND alt IS NOT NULL AND alt_count / total >= 0.1")
def snk_vcfgz(spark, sf):
    path = _scratch(spark) + ".vcf.gz"
    vcf.write_vcf(pileups.vcf_lines(_calls(spark, sf)), _vcf_header(["s"]), path, [n for n, _ in CONTIGS], partitions=4)
    lines = spark.read.text(f"{path}/*.vcf.gz").where(~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    return lines.select(F.get(f, F.lit(0)).alias("contig"), F.get(f, F.lit(1)).cast("int").alias("pos1"), F.col("value").alias("line"))


@query(_SNV + f" SELECT contig, cast(pos + 1 as int) AS pos1, {_VCF_LINE} AS line FROM called WHERE total >= 5 AND alt IS NOT NULL AND alt_count / total >= 0.1")
def snk_vcf_text(spark, sf):
    path = _scratch(spark) + ".vcf"
    vcf.write_vcf(pileups.vcf_lines(_calls(spark, sf)), _vcf_header(["s"]), path, [n for n, _ in CONTIGS], partitions=4)
    f = F.split("value", "\t")
    return spark.read.text(f"{path}/records").select(F.get(f, F.lit(0)).alias("contig"), F.get(f, F.lit(1)).cast("int").alias("pos1"), F.col("value").alias("line"))


@query(_SNV + """ SELECT contig, pos, ref_base AS ref, alt, CAST(total AS integer) AS dp, cast(alt_count / total as float) AS af, CASE WHEN alt_count / total >= 0.8 THEN '1/1' ELSE '0/1' END AS gt
  FROM called WHERE total >= 5 AND alt IS NOT NULL AND alt_count / total >= 0.1""")
def snk_bcf(spark, sf):
    path, header = _scratch(spark) + ".bcf", _vcf_header(["s"])
    bcf.write_bcf(bcf.call_rows(_calls(spark, sf)), header, path, [n for n, _ in CONTIGS], partitions=4)
    back = bcf.read_bcf(spark, path)
    info = lambda key: F.get(F.filter("info", lambda e: e["key"] == key), F.lit(0))
    gt = F.array_join(F.transform(F.get("genotypes", F.lit(0))["alleles"], lambda a: a.cast("string")), "/")
    return back.select("contig", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"), F.get(info("DP")["ints"], F.lit(0)).alias("dp"), F.get(info("AF")["floats"], F.lit(0)).cast("float").alias("af"), gt.alias("gt"))


@query("""SELECT cast(k as int) AS k, line FROM (VALUES (0, '##fileformat=VCFv4.3'), (1, '##FILTER=<ID=PASS,Description="All filters passed">'), (2, '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">'),
  (3, '##INFO=<ID=AF,Number=A,Type=Float,Description="Share">'), (4, '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">'), (5, '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">'),
  (6, '##contig=<ID=chr0,length=4100>'), (7, '##contig=<ID=chr1,length=4100>'), (8, '##contig=<ID=chr2,length=4100>'), (9, '##contig=<ID=chr3,length=4100>'),
  (10, '#CHROM' || chr(9) || 'POS' || chr(9) || 'ID' || chr(9) || 'REF' || chr(9) || 'ALT' || chr(9) || 'QUAL' || chr(9) || 'FILTER' || chr(9) || 'INFO' || chr(9) || 'FORMAT' || chr(9) || 's')) t(k, line)""", with_reads=False)
def snk_header(spark, sf):
    return spark.createDataFrame(list(enumerate(_vcf_header(["s"]))), "k int, line string")


@query("SELECT * FROM (VALUES ('a.vcf', 'vcf'), ('a.vcf.gz', 'vcf.gz'), ('a.bcf', 'bcf'), ('a.txt', 'error')) t(path, kind)", with_reads=False)
def snk_format(spark, sf):
    found = []
    for p in ("a.vcf", "a.vcf.gz", "a.bcf", "a.txt"):
        try:
            found.append((p, vcf.output_format(p)))
        except ValueError:
            found.append((p, "error"))
    return spark.createDataFrame(found, "path string, kind string")


# --- functions and rewrites that no file is needed for


_AT = "cast(r.pos + r.p % (r.rlen + 3) as int)"


@query(f"""SELECT r.read_id, {_AT} AS at, l.op AS kind, l.qpos, l.insert_len, l.del_len, cast(l.is_refskip as int) AS is_refskip FROM reads r LEFT JOIN pile l ON l.read_id = r.read_id AND l.pos = {_AT} WHERE r.flags & 4 = 0""")
def fn_position_info(spark, sf):
    df = reads(spark, sf).where(~R.is_set(F.col("flags"), "unmapped")).withColumn("at", (F.col("pos") + F.col("p") % (F.col("end_pos") - F.col("pos") + 4)).cast("int"))
    i = R.position_info(F.col("at"), F.col("pos"), F.col("cigar"))
    return df.withColumn("i", i).select("read_id", "at", "i.kind", "i.qpos", "i.insert_len", "i.del_len", F.col("i.is_refskip").cast("int").alias("is_refskip"))


@query("""SELECT read_id, CASE WHEN p % 3 = 0 OR flags & 4 <> 0 THEN reverse(seq) || CASE WHEN p % 3 = 0 THEN '' ELSE 'A' END ELSE seq END AS seq, p % 3 <> 0 AND flags & 4 = 0 AS rejected FROM reads""")
def mut_seq(spark, sf):
    new = F.concat(F.reverse("seq"), F.when(F.col("p") % 3 == 0, "").otherwise("A"))
    return rewrites.set_sequence(reads(spark, sf), new).select("read_id", "seq", "rejected")


@query("""SELECT read_id, cast(CASE p % 3 WHEN 0 THEN 0 WHEN 1 THEN 30 * qlen ELSE list_sum(qual) END as int) AS total, p % 3 = 2 AS rejected FROM reads""")
def mut_qual(spark, sf):
    new = F.when(F.col("p") % 3 == 0, F.expr("cast(array() as array<int>)")).when(F.col("p") % 3 == 1, F.array_repeat(F.lit(30), F.col("seq_len"))).otherwise(F.array(F.lit(1)))
    return rewrites.set_quality(reads(spark, sf), new).select("read_id", F.aggregate("qual", F.lit(0), lambda a, x: a + x).alias("total"), "rejected")


@query("""SELECT read_id, CASE WHEN p % 5 = 0 THEN flags ELSE 16 END AS flags, CASE WHEN p % 5 <> 0 THEN 'OB' WHEN flags & 1 = 0 OR flags & 64 <> 0 THEN CASE WHEN flags & 16 <> 0 THEN 'OB' ELSE 'OT' END
  WHEN flags & 128 <> 0 THEN CASE WHEN flags & 32 <> 0 THEN 'OB' ELSE 'OT' END ELSE 'NA' END AS strand, cast(p % 50 as int) AS tlen, 1 AS next_tid, cast(p % 9 as int) AS next_pos FROM reads""")
def mut_flags_mate(spark, sf):
    df = rewrites.set_flags(reads(spark, sf), F.when(F.col("p") % 5 == 0, 70000).otherwise(16))
    df = rewrites.set_mate(rewrites.set_template_length(df, F.col("p") % 50), F.lit(1), F.col("p") % 9)
    return df.select("read_id", "flags", "strand", F.col("template_len").alias("tlen"), "next_tid", "next_pos")


@query("SELECT read_id, flags & 4 = 0 AND p % 2 = 0 AS rejected, CASE WHEN flags & 4 = 0 AND p % 2 = 0 THEN cigar_text ELSE (qlen + CASE WHEN p % 2 = 0 THEN 1 ELSE 0 END) || 'M' END AS cigar_text FROM reads")
def mut_align_owned(spark, sf):
    new = R.cigar_parse(F.concat((F.col("qlen") + F.when(F.col("p") % 2 == 0, 1).otherwise(0)).cast("string"), F.lit("M")))
    return rewrites.set_alignment(reads(spark, sf), F.col("pos"), new, owned=True).select("read_id", "rejected", R.cigar_format(F.col("cigar")).alias("cigar_text"))


@query("SELECT read_id, CASE WHEN p % 1000 <= 900 THEN (p % 1000) / 900.0 END AS probability, p + 100 AS moved, upper(cigar_text) AS x FROM reads")
def fn_numbers(spark, sf):
    return reads(spark, sf).select(
        "read_id", R.probability(F.col("p") % 1000 / F.lit(900.0)).alias("probability"), (R.to_one_based(F.col("p")) + 99).alias("moved"),
        X.hex_bytes(F.hex(F.col("cigar_text").cast("binary"))).cast("string").alias("x"),
    )


@query("SELECT * FROM (VALUES ('chr1', 10, 19), ('chr2', 99, 4099), ('chr3', 0, 4099)) t(contig, start, \"end\")", with_reads=False)
def gen_target(spark, sf):
    c = contigs(spark)
    parts = [intervals.resolve(c, t) for t in (("chr1", 10, 19), "chr2:100", 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("contig", "start", "end")


@query("SELECT kind, n FROM (SELECT 'bam' AS kind, count(*) AS n FROM reads WHERE contig = 'chr1' AND pos <= 2000 AND end_pos >= 1000 UNION ALL SELECT 'split', 1)")
def prn_annot(spark, sf):
    """Every read of the region lies in some annotated chunk, and the near and distant chunks together are the query's."""
    path, found, same = _written(spark, sf), 0, True
    for name in sorted(n for n in os.listdir(path) if n.endswith(".bam")):
        file = os.path.join(path, name)
        with open(file + ".bai", "rb") as f:
            own = index.Index(f.read())
        rows = own.annotated(1, 1000, 2000)
        near, far = own.query_split(1, 1000, 2000)
        same &= index.merge([c for c, _, _ in rows]) == own.query(1, 1000, 2000) == index.merge(near + far) and all(own.depth >= level >= 0 for _, _, level in rows)
        with open(file, "rb") as f:
            r = bgzf.Reader(f)
            names = bam.Header.read(r).contigs
            for start, stop in own.query(1, 1000, 2000):
                r.seek(start)
                while r.tell() < stop:
                    size = int.from_bytes(r.read(4), "little")
                    row = bam.decode(r.read(size), names, 0)
                    found += row[3] == 1 and row[5] <= 2000 and row[6] >= 1000
    return spark.createDataFrame([("bam", found), ("split", int(same))], "kind string, n long")
