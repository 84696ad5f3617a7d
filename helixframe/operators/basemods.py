"""Base modifications: MM and ML tags to calls, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import reads as R
from .events import aligned_pairs

_ENTRY = r"^([ACGT])([+-])([a-z]+|\d+)([.?]?)((?:,\d+)*)$"


def _called(reads: DataFrame, mm: str, ml: str, keep: tuple[str, ...]) -> DataFrame:
    """(read_id, *keep, seq, entries, calls, error) of the reads with tags: the parsed entries, and the calls of sound ones."""
    mm_text = F.col(mm)
    entries = F.slice(F.split(mm_text, ";"), F.lit(1), F.greatest(F.size(F.split(mm_text, ";")) - 1, F.lit(0)))

    def entry(e):
        codes = F.regexp_extract(e, _ENTRY, 3)
        steps = F.transform(F.filter(F.split(F.regexp_extract(e, _ENTRY, 5), ","), lambda x: x != ""), lambda x: x.cast("int"))
        begin = F.struct(F.lit(-1).alias("at"), F.expr("cast(array() as array<int>)").alias("done"))
        ordinals = F.aggregate(steps, begin, lambda a, x: F.struct((a["at"] + x + 1).alias("at"), F.array_append(a["done"], a["at"] + x + 1).alias("done")), lambda a: a["done"])
        return F.struct(
            e.rlike(_ENTRY).alias("ok"), F.regexp_extract(e, _ENTRY, 1).alias("base"), F.regexp_extract(e, _ENTRY, 2).alias("strand"),
            F.when(codes.rlike(r"^\d"), F.array(codes)).otherwise(F.filter(F.split(codes, ""), lambda x: x != "")).alias("codes"),
            F.when(F.regexp_extract(e, _ENTRY, 4) == "", "implicit").when(F.regexp_extract(e, _ENTRY, 4) == ".", "unmodified").otherwise("ambiguous").alias("mode"),
            ordinals.alias("ordinals"),
        )

    back = R.is_set(F.col("flags"), "reverse")
    rows = reads.where(mm_text.isNotNull() & (mm_text != "")).select("read_id", *keep, "seq", back.alias("back"), F.coalesce(F.col(ml), F.expr("cast(array() as array<int>)")).alias("ml"), mm_text.alias("mm"), F.transform(entries, entry).alias("entries"))
    letters = F.split("seq", "")
    places = lambda base: F.filter(F.transform(letters, lambda x, i: F.when(x == base, i)), lambda x: x.isNotNull())
    # The places of each of the four letters once a read, then each entry takes those of its base.
    rows = rows.withColumn("at", F.create_map(*(x for b in "ACGT" for x in (F.lit(b), F.when(F.col("back"), F.reverse(places(R.complement(F.lit(b))))).otherwise(places(F.lit(b)))))))
    # Number of probabilities before each entry, by one running sum.
    own = lambda e: F.size(e["codes"]) * F.size(e["ordinals"])
    begin = F.struct(F.lit(0).alias("n"), F.expr("cast(array() as array<int>)").alias("done"))
    sums = F.aggregate("entries", begin, lambda a, e: F.struct((a["n"] + own(e)).alias("n"), F.array_append(a["done"], a["n"]).alias("done")))
    rows = rows.withColumn("sums", sums).withColumn("entries", F.transform("entries", lambda e, i: e.withField("places", F.coalesce(F.try_element_at("at", e["base"]), F.expr("cast(array() as array<int>)"))).withField("before", F.get(F.col("sums.done"), i))))
    total = F.col("sums.n")
    error = (
        F.when(~F.col("mm").endswith(";"), "unterminated entry").when(F.exists("entries", lambda e: ~e["ok"]), "malformed entry")
        .when(total != F.size("ml"), "length of ML").when(F.exists("entries", lambda e: F.coalesce(F.array_max(e["ordinals"]), F.lit(-1)) >= F.size(e["places"])), "call outside the sequence")
    )
    rows = rows.withColumn("error", error)
    calls = F.flatten(F.transform("entries", lambda e: F.flatten(F.transform(e["ordinals"], lambda o, j: F.transform(e["codes"], lambda c, k: F.struct(
        F.get(e["places"], o).alias("qpos"), c.alias("code"), F.get(F.col("ml"), e["before"] + j * F.size(e["codes"]) + k).alias("probability"),
        e["base"].alias("canonical_base"), e["strand"].alias("mod_strand"), e["mode"].alias("mode")))))))
    return rows.withColumn("calls", F.when(F.col("error").isNull(), calls))


def modifications(reads: DataFrame, mm: str = "mm", ml: str = "ml", keep: tuple[str, ...] = ()) -> DataFrame:
    """(read_id, *keep, qpos, code, probability, canonical_base, mod_strand, mode, error): a row for each call, or one with an error for a read whose tags are bad.

    MM entries name a canonical base, a strand, codes and the numbers of that base to skip between calls; ML has a probability for each
    entry, call and code, in this order.  Reads on the reverse strand count the complement from the end.
    """
    rows = _called(reads, mm, ml, keep)
    bad = rows.where("error is not null").select("read_id", *keep, *(F.lit(None).cast(t).alias(c) for c, t in (("qpos", "int"), ("code", "string"), ("probability", "int"), ("canonical_base", "string"), ("mod_strand", "string"), ("mode", "string"))), "error")
    good = rows.where("error is null").select("read_id", *keep, F.explode("calls").alias("m"), F.col("error")).select("read_id", *keep, "m.*", "error")
    return good.unionByName(bad)


def placed_modifications(reads: DataFrame, mm: str = "mm", ml: str = "ml") -> DataFrame:
    """Calls with contig and the reference position of their base, from the read's own CIGAR: no join and no shuffle.  Calls in insertions and clips have none and are dropped."""
    with_ops = reads.withColumn("__ops", F.filter(R.with_offsets(F.col("pos"), F.col("cigar")), lambda o: o["op"].isin("M", "=", "X")))
    calls = modifications(with_ops, mm, ml, keep=("contig", "__ops")).where("error is null")
    own = F.get(F.filter("__ops", lambda o: (o["q_start"] <= F.col("qpos")) & (F.col("qpos") < o["q_start"] + o["len"])), F.lit(0))
    return calls.withColumn("pos", own["ref_start"] + F.col("qpos") - own["q_start"]).where("pos is not null").drop("__ops")


def base_ordinals(reads: DataFrame) -> DataFrame:
    """(read_id, qpos, base, ordinal): each A, C, G and T of a read with its number among the same bases, from 0, counted from the end on the reverse strand.

    Counts run along the read inside its row: no shuffle.
    """
    letters, none = F.split("seq", ""), F.expr("cast(array() as array<struct<qpos:int,base:string,n:int>>)")
    begin = F.struct(F.lit(0).alias("i"), *(F.lit(0).alias(b) for b in "ACGT"), none.alias("done"))

    def step(a, x):
        n = F.when(x == "A", a["A"]).when(x == "C", a["C"]).when(x == "G", a["G"]).when(x == "T", a["T"])
        row = F.struct(a["i"].alias("qpos"), x.alias("base"), n.alias("n"))
        return F.struct((a["i"] + 1).alias("i"), *((a[b] + F.when(x == b, 1).otherwise(0)).alias(b) for b in "ACGT"), F.array_append(a["done"], row).alias("done"))

    counted = F.aggregate(F.filter(letters, lambda x: x != ""), begin, step)
    rows = reads.select("read_id", R.is_set(F.col("flags"), "reverse").alias("back"), counted.alias("c")).select("read_id", "back", "c.A", "c.C", "c.G", "c.T", F.explode("c.done").alias("x")).where("x.n is not null")
    last = F.when(F.col("x.base") == "A", F.col("A")).when(F.col("x.base") == "C", F.col("C")).when(F.col("x.base") == "G", F.col("G")).otherwise(F.col("T"))
    return rows.select("read_id", "x.qpos", "x.base", F.when(F.col("back"), last - 1 - F.col("x.n")).otherwise(F.col("x.n")).alias("ordinal"))


def unmodified(reads: DataFrame, mm: str = "mm", ml: str = "ml") -> DataFrame:
    """(read_id, qpos, base, unmodified) of each A, C, G and T of the reads with sound tags: false where a modification is called; else true if any entry
    of its canonical base says that bases without a call are unmodified; else null, unknown."""
    rows = _called(reads, mm, ml, ("flags",)).where("error is null")
    said = F.transform(F.filter("entries", lambda e: e["mode"] == "unmodified"), lambda e: e["base"])
    rows = rows.select("read_id", "flags", F.transform("calls", lambda c: c["qpos"]).alias("called"), said.alias("said"), F.posexplode(F.split("seq", "")).alias("qpos", "base")).where(F.col("base").isin(*"ACGT"))
    canonical = F.when(R.is_set(F.col("flags"), "reverse"), R.complement(F.col("base"))).otherwise(F.col("base"))
    return rows.select("read_id", "qpos", "base", F.when(F.array_contains("called", F.col("qpos")), False).when(F.array_contains("said", canonical), True).alias("unmodified"))


def on_reference(reads: DataFrame, mods: DataFrame) -> DataFrame:
    """Calls with the reference position of their base; calls in insertions and clips have none and are dropped."""
    matches = aligned_pairs(reads, ("read_id", "contig"), matches_only=True).select("read_id", "contig", "qpos", F.col("rpos").alias("pos"))
    return mods.where("error is null").join(matches, ["read_id", "qpos"])


def methylation(placed: DataFrame, min_probability: int = 128) -> DataFrame:
    """Per (contig, pos, code): modified and unmodified calls, and the share of modified ones."""
    high = F.col("probability") >= min_probability
    out = placed.groupBy("contig", "pos", "code").agg(F.sum(F.when(high, 1).otherwise(0)).alias("modified"), F.sum(F.when(high, 0).otherwise(1)).alias("unmodified"))
    return out.withColumn("frequency", F.col("modified") / (F.col("modified") + F.col("unmodified")))
