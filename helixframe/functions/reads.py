"""Scalar functions on flags, CIGARs, bases, qualities and positions.  All are Columns in, Columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FLAGS, NO_QUALITY

# --- flags


def is_set(flags: Column, mask: int | str) -> Column:
    """Whether any bit of mask (a number or a flag's name) is set."""
    return flags.bitwiseAND(F.lit(FLAGS.get(mask, mask))) != 0


def with_flags(flags: Column, mask: int) -> Column:
    return flags.bitwiseOR(F.lit(mask))


def without_flags(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(~mask))


def strand(flags: Column) -> Column:
    """OT or OB: of an unpaired or first read by its own direction, of a second read by its mate's; NA for a paired read that is neither."""
    own = F.when(is_set(flags, "reverse"), "OB").otherwise("OT")
    mate = F.when(is_set(flags, "mate_reverse"), "OB").otherwise("OT")
    return F.when(~is_set(flags, "paired") | is_set(flags, "first_in_template"), own).when(is_set(flags, "second_in_template"), mate).otherwise("NA")


# --- CIGAR: array<struct<op string, len int>>

REF_OPS, QUERY_OPS = ("M", "D", "N", "=", "X"), ("M", "I", "S", "=", "X")
OP_CODES = "MIDNSHP=X"


def cigar_parse(text: Column) -> Column:
    """Ops of a CIGAR text; empty for ``*``; null if the text is malformed.  Digits without a letter at the end are ignored."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(0))
    ops = F.transform(parts, lambda p: F.struct(F.substring(p, -1, 1).alias("op"), F.regexp_extract(p, r"(\d+)", 1).cast("int").alias("len")))
    empty = F.expr("cast(array() as array<struct<op:string,len:int>>)")
    return F.when(text == "*", empty).when(text.rlike(r"^(\d+[MIDNSHP=X])*\d*$"), ops)


def cigar_format(cigar: Column) -> Column:
    """Text of the ops; the empty text for none (a SAM sink writes ``*`` then)."""
    return F.array_join(F.transform(cigar, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")


def _total(cigar: Column, ops: tuple[str, ...]) -> Column:
    return F.aggregate(cigar, F.lit(0), lambda n, o: n + F.when(o["op"].isin(*ops), o["len"]).otherwise(0))


def query_length(cigar: Column) -> Column:
    return _total(cigar, QUERY_OPS)


def reference_length(cigar: Column) -> Column:
    return _total(cigar, REF_OPS)


def matching_bases(cigar: Column) -> Column:
    """Sum of M only."""
    return _total(cigar, ("M",))


def aligned_bases(cigar: Column) -> Column:
    return _total(cigar, ("M", "=", "X"))


def indel_bases(cigar: Column) -> Column:
    return _total(cigar, ("I", "D"))


def end_pos(pos: Column, cigar: Column) -> Column:
    """Last reference position, inclusive; pos for a read that consumes none."""
    return pos + F.greatest(reference_length(cigar), F.lit(1)) - 1


def cigar_pack(op: Column, length: Column) -> Column:
    return F.shiftleft(length, 4).bitwiseOR(F.instr(F.lit(OP_CODES), op) - 1)


def cigar_unpack(packed: Column) -> Column:
    return F.struct(F.substring(F.lit(OP_CODES), packed.bitwiseAND(F.lit(15)) + 1, F.lit(1)).alias("op"), F.shiftrightunsigned(packed, 4).cast("int").alias("len"))


def with_offsets(pos: Column, cigar: Column) -> Column:
    """Ops with idx, ref_start, q_start, and next_ins: the length of the insertion that follows (P is skipped, consecutive I add up).

    Stays inside the row: no shuffle and no explode.
    """
    start = F.struct(pos.cast("int").alias("r"), F.lit(0).alias("q"), F.expr("cast(array() as array<struct<idx:int,op:string,len:int,ref_start:int,q_start:int>>)").alias("done"))

    def step(acc, o):
        row = F.struct(F.size(acc["done"]).alias("idx"), o["op"].alias("op"), o["len"].alias("len"), acc["r"].alias("ref_start"), acc["q"].alias("q_start"))
        return F.struct(
            (acc["r"] + F.when(o["op"].isin(*REF_OPS), o["len"]).otherwise(0)).alias("r"),
            (acc["q"] + F.when(o["op"].isin(*QUERY_OPS), o["len"]).otherwise(0)).alias("q"),
            F.array_append(acc["done"], row).alias("done"),
        )

    ops = F.aggregate(cigar, start, step, lambda acc: acc["done"])

    def following(o):
        rest = F.slice(cigar, o["idx"] + 2, F.greatest(F.size(cigar) - o["idx"] - 1, F.lit(0)))
        seen = F.aggregate(rest, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct(
            (a["n"] + F.when(a["on"] & (x["op"] == "I"), x["len"]).otherwise(0)).alias("n"), (a["on"] & x["op"].isin("I", "P")).alias("on")))
        return o.withField("next_ins", seen["n"])

    return F.transform(ops, following)


def position_info(at: Column, pos: Column, cigar: Column) -> Column:
    """What a read shows at reference position ``at``: struct(kind, qpos, insert_len, del_len, is_refskip), null where it covers nothing there.

    kind: match or insertion (with qpos), deletion, complex_indel or refskip, as pileup rows have them.
    """
    ops = F.filter(with_offsets(pos, cigar), lambda o: o["op"].isin(*REF_OPS) & (o["ref_start"] <= at) & (at < o["ref_start"] + o["len"]))
    o = F.get(ops, F.lit(0))
    edge = (at == o["ref_start"] + o["len"] - 1) & (o["next_ins"] > 0)
    match, gap = o["op"].isin("M", "=", "X"), (o["op"] == "D") | edge
    kind = F.when(match & edge, "insertion").when(match, "match").when(edge, "complex_indel").when(o["op"] == "D", "deletion").otherwise("refskip")
    info = F.struct(
        kind.alias("kind"), F.when(match, o["q_start"] + at - o["ref_start"]).alias("qpos"), F.when(edge, o["next_ins"]).otherwise(0).alias("insert_len"),
        F.when(~match & gap, o["len"]).otherwise(0).alias("del_len"), (o["op"] == "N").alias("is_refskip"),
    )
    return F.when(o.isNotNull(), info)


# --- bases


def normalize_bases(seq: Column) -> Column:
    """Upper case; every letter but A, C, G, T becomes N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def strict_base(text: Column) -> Column:
    """The one base of a trimmed text in either case, else null."""
    base = F.upper(F.trim(text))
    return F.when(base.rlike("^[ACGTN]$"), base)


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def base_index(base: Column) -> Column:
    """0 to 3 for A, C, G, T, else null."""
    return F.nullif(F.instr(F.lit("ACGT"), F.substring(base, 1, 1)), F.lit(0)) - 1


# --- qualities


def decode_quality(text: Column, seq_len: Column) -> Column:
    """Qualities of a SAM QUAL text; ``*`` gives 255 for each base."""
    known = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: (F.ascii(F.substring(text, i, F.lit(1))) - 33).bitwiseAND(F.lit(255)))
    none = F.expr("cast(array() as array<int>)")
    return F.when(text == "*", F.array_repeat(F.lit(NO_QUALITY), seq_len)).when(F.length(text) == 0, none).otherwise(known)


def encode_quality(qual: Column) -> Column:
    """SAM QUAL text; ``*`` for no qualities or any that is 255."""
    bad = (F.size(qual) == 0) | F.exists(qual, lambda q: q == NO_QUALITY)
    return F.when(bad, "*").otherwise(F.array_join(F.transform(qual, lambda q: F.char(q + 33)), ""))


def phred_from_probability(p: Column) -> Column:
    return -10 * F.log10(p)


def phred_int(q: Column) -> Column:
    """Rounded half away from zero and cut to 0..99; NaN is 0."""
    return F.when(F.isnan(q) | (q <= 0), 0).otherwise(F.least(F.round(q), F.lit(99.0))).cast("int")


def probability(p: Column) -> Column:
    """p if finite and in 0..1, else null."""
    return F.when(~F.isnan(p) & (p >= 0) & (p <= 1), p)


def root_mean_square(x: Column) -> Column:
    """Aggregate: root of the mean square, 0 for no rows."""
    return F.coalesce(F.sqrt(F.avg(x * x)), F.lit(0.0))


# --- positions and bins


def to_one_based(pos: Column) -> Column:
    return pos + 1


def to_zero_based(pos1: Column) -> Column:
    """Null for 0, which is no 1-based position."""
    return F.when(pos1 >= 1, pos1 - 1)


def reg2bin(beg: Column, end: Column, min_shift: int = 14, depth: int = 5) -> Column:
    """Smallest bin that holds [beg, end), end exclusive."""
    last, out = end - 1, F.lit(0)
    for level in range(1, depth + 1):  # the deepest level with one bin for both ends wins
        shift = min_shift + 3 * (depth - level)
        first = ((1 << 3 * level) - 1) // 7
        out = F.when(F.shiftright(beg, shift) == F.shiftright(last, shift), F.shiftright(beg, shift) + first).otherwise(out)
    return out.cast("int")


def reg2bins(beg: Column, end: Column, min_shift: int = 14, depth: int = 5) -> Column:
    """All bins that overlap [beg, end)."""
    parts = [F.array(F.lit(0))]
    for level in range(1, depth + 1):
        shift, first = min_shift + 3 * (depth - level), ((1 << 3 * level) - 1) // 7
        parts.append(F.sequence(F.shiftright(beg, shift).cast("int") + first, F.shiftright(end - 1, shift).cast("int") + first))
    return F.concat(*parts)


def bin_level(b: Column, depth: int = 5) -> Column:
    """0 for the root to depth for the smallest bins, depth + 1 for no bin."""
    out = F.lit(depth + 1)
    for level in range(depth, -1, -1):
        out = F.when((b >= ((1 << 3 * level) - 1) // 7) & (b < ((1 << 3 * (level + 1)) - 1) // 7), level).otherwise(out)
    return out


def bin_span(level: Column, min_shift: int = 14, depth: int = 5) -> Column:
    """Positions that a bin of the level spans."""
    return F.when(level <= depth, F.shiftleft(F.lit(1).cast("long"), (min_shift + 3 * (depth - level)).cast("int")))
