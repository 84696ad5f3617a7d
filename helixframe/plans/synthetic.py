"""Reads made from the orders table: one deterministic integer mapping, for Spark and as SQL for the oracle.

Read bases follow the reference except where a hash says otherwise; both are functions of integers, so that no reference file is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reads as R

CHUNK = 64
LAST_POS = 4100
_REF = "substr('ACGT', cast(1 + (11 * {tid} + 5 * ({pos}) + ({pos}) {div} 3) % 4 as int), 1)"


def ref_base(tid: str, pos: str, div: str) -> str:
    return _REF.format(tid=tid, pos=pos, div=div)


def _base(div: str) -> str:
    q = "(pos + q)"
    return (
        f"CASE WHEN (read_id + q) % 29 = 0 THEN 'N' WHEN (read_id * 13 + q * 7) % 10 < 2 THEN substr('ACGT', cast(1 + (read_id + q) % 4 as int), 1) "
        f"ELSE {ref_base('tid', q, div)} END"
    )


_PIECES = {
    "read_id": "o_orderkey",
    "p": "cast(floor(o_totalprice) as bigint)",
    "tid": "cast(o_custkey % 4 as int)",
    "pos": "cast((37 * o_custkey + 101 * o_orderkey) % 4000 as int)",
}
_LENGTHS = {
    "s": "CASE WHEN p % 5 = 0 THEN 3 ELSE 0 END",
    "m1": "5 + p % 11",
    "i": "CASE WHEN p % 7 < 3 THEN p % 3 ELSE 0 END",
    "d": "CASE WHEN p % 6 < 3 THEN p % 4 ELSE 0 END",
    "n": "CASE WHEN p % 13 = 0 THEN 6 ELSE 0 END",
    "m2": "4 + p % 9",
}


def _op(name: str, letter: str) -> str:
    return f"CASE WHEN {name} > 0 THEN concat(cast({name} as string), '{letter}') ELSE '' END"


_TEXTS = {
    "cigar_text": f"concat({_op('s', 'S')}, {_op('m1', 'M')}, CASE WHEN p % 2 = 0 THEN concat({_op('i', 'I')}, {_op('d', 'D')}) ELSE concat({_op('d', 'D')}, {_op('i', 'I')}) END, {_op('n', 'N')}, {_op('m2', 'M')})",
    "qname": "concat('q', cast(read_id {div} 2 as string))",
    "contig": "concat('chr', cast(tid as string))",
    "flags": "cast(1 + CASE WHEN read_id % 2 = 0 THEN 64 ELSE 128 END + 16 * (p % 2) + 32 * ((p {div} 2) % 2) + CASE WHEN p % 23 = 0 THEN 4 ELSE 0 END"
    " + CASE WHEN p % 29 = 0 THEN 256 ELSE 0 END + CASE WHEN p % 31 = 0 THEN 1024 ELSE 0 END + CASE WHEN p % 37 = 0 THEN 2048 ELSE 0 END + CASE WHEN p % 41 = 0 THEN 512 ELSE 0 END as int)",
    "mapq": "cast(p % 61 as int)",
    "qlen": "cast(s + m1 + i + m2 as int)",
    "rlen": "cast(m1 + d + n + m2 as int)",
    "rg": "CASE WHEN p % 10 = 0 THEN NULL ELSE concat('rg', cast(p % 3 as string)) END",
    "mm": "CASE p % 4 WHEN 0 THEN NULL WHEN 1 THEN 'C+m,0,1;' WHEN 2 THEN 'C+m?,1;A+a.,0;' ELSE 'C+mh,0;' END",
    "ml0": "cast(p % 256 as int)",
    "ml1": "cast((p * 7) % 256 as int)",
}


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads DataFrame, with rg, mm and ml columns besides those of the schema."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    df = orders.selectExpr(*(f"{e} AS {n}" for n, e in _PIECES.items()))
    df = df.selectExpr("*", *(f"cast({e} as int) AS {n}" for n, e in _LENGTHS.items()))
    df = df.selectExpr("read_id", "p", "tid", "pos", *(f"{e.format(div='div')} AS {n}" for n, e in _TEXTS.items()))
    df = df.selectExpr("*", f"array_join(transform(sequence(0, qlen - 1), q -> {_base('div')}), '') AS seq", "transform(sequence(0, qlen - 1), q -> cast((read_id * 3 + q * 7) % 42 as int)) AS qual")
    df = df.withColumn("cigar", R.cigar_parse(F.col("cigar_text"))).withColumn("ml", F.when(F.col("mm").isNotNull(), F.array("ml0", "ml1")))
    return df.withColumns({
        "end_pos": R.end_pos(F.col("pos"), F.col("cigar")), "seq_len": F.col("qlen"), "matching_bases": R.matching_bases(F.col("cigar")),
        "indel_bases": R.indel_bases(F.col("cigar")), "strand": R.strand(F.col("flags")),
    })


def reference(spark: SparkSession) -> DataFrame:
    """(contig, chunk_start, bases) of four contigs."""
    base = ref_base("tid", "chunk_start + k", "div")
    return spark.range(4).selectExpr("cast(id as int) AS tid").selectExpr("tid", f"explode(sequence(0, {LAST_POS - 1}, {CHUNK})) AS chunk_start").selectExpr(
        "concat('chr', cast(tid as string)) AS contig", "chunk_start", f"array_join(transform(sequence(0, least({CHUNK}, {LAST_POS} - chunk_start) - 1), k -> {base}), '') AS bases")


def contigs(spark: SparkSession) -> DataFrame:
    return spark.range(4).selectExpr("cast(id as int) AS tid", "concat('chr', cast(id as string)) AS name", f"cast({LAST_POS} as bigint) AS length")


def _duck(text: str) -> str:
    return text.format(div="//").replace("as string)", "as varchar)")


#: SQL of the tables reads, off (ops with offsets) and pile (pileup rows), to stand before an oracle query.
READS_SQL = f"""
WITH r0 AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _PIECES.items())} FROM orders),
r1 AS (SELECT *, {', '.join(f'cast({e} as int) AS {n}' for n, e in _LENGTHS.items())} FROM r0),
r2 AS (SELECT *, {', '.join(f'{_duck(e)} AS {n}' for n, e in _TEXTS.items())} FROM r1),
reads AS (
  SELECT *, pos + rlen - 1 AS end_pos, array_to_string(list_transform(range(0, qlen), lambda q: {_base('//')}), '') AS seq,
    list_transform(range(0, qlen), lambda q: cast((read_id * 3 + q * 7) % 42 as int)) AS qual FROM r2),
toks AS (SELECT read_id, contig, tid, pos, end_pos, flags, mapq, qname, rg, seq, qual, qlen, unnest(regexp_extract_all(cigar_text, '[0-9]+[MIDNSHP=X]')) AS tok, unnest(range(len(regexp_extract_all(cigar_text, '[0-9]+[MIDNSHP=X]')))) AS idx FROM reads),
opr AS (SELECT *, right(tok, 1) AS op, cast(left(tok, length(tok) - 1) as int) AS len FROM toks),
off AS (
  SELECT *, cast(pos + coalesce(sum(CASE WHEN op IN ('M', 'D', 'N') THEN len ELSE 0 END) OVER w, 0) as int) AS ref_start,
    cast(coalesce(sum(CASE WHEN op IN ('M', 'I', 'S') THEN len ELSE 0 END) OVER w, 0) as int) AS q_start,
    CASE WHEN lead(op) OVER v = 'I' THEN lead(len) OVER v ELSE 0 END AS next_ins
  FROM opr WINDOW w AS (PARTITION BY read_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY read_id ORDER BY idx)),
pile0 AS (SELECT *, pos AS read_pos, cast(unnest(range(ref_start, ref_start + len)) as int) AS rpos FROM off WHERE op IN ('M', 'D', 'N') AND flags & 4 = 0),
pile AS (
  SELECT contig, tid, rpos AS pos, read_id, mapq, flags, qname, rg, seq, read_pos, end_pos AS read_end, op AS cop,
    CASE WHEN op = 'M' AND rpos = ref_start + len - 1 AND next_ins > 0 THEN 'insertion' WHEN op = 'M' THEN 'match' WHEN rpos = ref_start + len - 1 AND next_ins > 0 THEN 'complex_indel'
      WHEN op = 'D' THEN 'deletion' ELSE 'refskip' END AS op,
    CASE WHEN op = 'M' THEN q_start + rpos - ref_start END AS qpos,
    CASE WHEN rpos = ref_start + len - 1 THEN next_ins ELSE 0 END AS insert_len,
    CASE WHEN op = 'D' OR (op = 'N' AND rpos = ref_start + len - 1 AND next_ins > 0) THEN len ELSE 0 END AS del_len,
    op = 'N' AS is_refskip,
    CASE WHEN op = 'M' THEN substr(seq, q_start + rpos - ref_start + 1, 1) END AS base,
    CASE WHEN op = 'M' THEN qual[q_start + rpos - ref_start + 1] END AS qual, q_start AS q_next
  FROM pile0)
"""
REF_SQL = _REF.format(tid="tid", pos="pos", div="//")
