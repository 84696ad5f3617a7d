import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from helixframe.functions import reads as R
from helixframe.functions import tags as X
from helixframe.functions import variants as V
from helixframe.operators import basemods, events, intervals, pileups, rewrites
from helixframe.sources import sam


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def read(spark, pos, cigar, seq, flags=0, read_id=1, **more):
    df = spark.createDataFrame([Row(read_id=read_id, contig="c", pos=pos, flags=flags, mapq=60, text=cigar, seq=seq, **more)])
    df = df.withColumn("pos", F.col("pos").cast("int")).withColumn("flags", F.col("flags").cast("int")).withColumn("cigar", R.cigar_parse(F.col("text")))
    return df.withColumn("qual", F.array_repeat(F.lit(30), F.length("seq"))).withColumn("end_pos", R.end_pos(F.col("pos"), F.col("cigar")))


def test_end_is_inclusive(spark):
    c = lambda t: R.end_pos(F.lit(100), R.cigar_parse(F.lit(t)))
    assert one(spark, c("50M"), c("10S"), c("*")) == [149, 100, 100]


def test_matching_bases_are_m_only(spark):
    c = R.cigar_parse(F.lit("3M2=1X4I2D"))
    assert one(spark, R.matching_bases(c), R.aligned_bases(c), R.indel_bases(c)) == [3, 6, 6]


def test_cigar_text(spark):
    assert one(spark, R.cigar_format(R.cigar_parse(F.lit("5M2"))), R.cigar_parse(F.lit("5Q")), R.cigar_parse(F.lit("M5"))) == ["5M", None, None]


def test_indel_adjacency(spark):
    rows = {r.pos: (r.op, r.insert_len, r.del_len) for r in events.pileup(read(spark, 10, "2M1P3I2M2D1I2M", "ACGTAACCGT")).collect()}
    assert rows[11] == ("insertion", 3, 0) and rows[14] == ("deletion", 0, 2) and rows[15] == ("complex_indel", 1, 2) and rows[16][0] == "match"


def test_complex_refskip_is_deletion_and_skip(spark):
    r = [r for r in events.pileup(read(spark, 0, "1M3N2I1M", "ACGT")).collect() if r.pos == 3][0]
    assert (r.op, r.is_refskip, r.del_len, r.insert_len) == ("complex_indel", True, 3, 2)
    counts = {c.pos: c for c in pileups.column_counts(events.pileup(read(spark, 0, "1M3N2I1M", "ACGT"))).collect()}
    assert (counts[3].n_del, counts[3].n_refskip, counts[3].n_ins, counts[1].n_refskip) == (1, 1, 1, 1)


def test_reads_without_reference_bases_or_mapping_make_no_rows(spark):
    assert events.pileup(read(spark, 5, "4I", "ACGT")).count() == events.pileup(read(spark, 5, "4M", "ACGT", flags=4)).count() == 0


def test_missing_sequence_gives_n(spark):
    df = read(spark, 5, "2M", "").withColumn("qual", F.expr("cast(array() as array<int>)"))
    assert [(r.base, r.qual) for r in events.pileup(df).collect()] == [("N", 255)] * 2


def test_overlap_is_closed(spark):
    df = read(spark, 99, "4M", "ACGT")
    assert [intervals.overlapping(df, "c", a, b).count() for a, b in ((102, 110), (90, 99), (103, 110), (90, 98))] == [1, 1, 0, 0]


def test_mismatch_text(spark):
    md = lambda cigar, seq, ref: one(spark, events.mismatch_text(F.lit(0), R.cigar_parse(F.lit(cigar)), F.lit(seq), F.lit(ref)))[0]
    assert md("4M", "ACGT", "ACGT") == "4" and md("4M", "ACTT", "ACGT") == "2G1" and md("2M2D2M", "ACGT", "ACTTGT") == "2^TT2"
    assert md("1M1D1D1M", "AT", "ACGT") == "1^C0^G1" and md("2M2I2M", "ACGGGT", "ACGT") == "4" and md("2M", "TT", "AC") == "0A0C0"


def test_edit_distance_is_mismatches_and_indels(spark):
    assert one(spark, events.edit_distance(F.lit(0), R.cigar_parse(F.lit("2M1I2D2M")), F.lit("AGTGT"), F.lit("ACTTGT"))) == [1 + 1 + 2]


@pytest.mark.parametrize("x,text", [(1234567.0, "1234567"), (1e-5, "0.00001"), (0.1, "0.1"), (30.0, "30"), (0.0, "0"), (3.14159265, "3.14159"), (None, ".")])
def test_float_text(spark, x, text):
    assert one(spark, V.float_text(F.lit(x).cast("double"))) == [text]


def test_float_text_rounds_by_the_exact_value(spark):
    """Ties such as 17 / 128 go to the even digit; decimals that no double holds go by what it holds."""
    values = [n / d for d in (128, 256, 2048, 4096) for n in range(1, d, 7)] + [17 / 128, 100000.5 / 8, 12345.25 + 0.5, 99999.95, 9999.995, 0.9999995, 0.99999949999999, 123456.5, 123457.5]
    values += [(2 * k + 1) / 2 * 10.0**-e for k in range(100_000, 999_999, 9_973) for e in range(1, 9)]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", V.float_text(F.col("x")).alias("t"), V.float_text(-F.col("x")).alias("minus")).collect()
    for x, t, minus in rows:
        scientific, power = f"{x:.5e}".split("e")
        wanted = f"{float(scientific + 'e' + power):.{max(0, 5 - int(power))}f}" if int(power) < 5 else f"{x:.0f}"
        wanted = wanted.rstrip("0").rstrip(".") if "." in wanted else wanted
        assert (t, minus) == (wanted, "-" + wanted), x


def test_percent_goes_first(spark):
    assert one(spark, V.percent_encode(F.lit("a%3A:;=,\t"))) == ["a%253A%3A%3B%3D%2C%09"]


def test_tags(spark):
    fields = F.array(*map(F.lit, ["NM:i:5", "NM:i:6", "X", "AB-i:1", "XB:B:c,-1,2", "XQ:q:hm", "XH:H:1AE3", "XZ:Z:a:b"]))
    aux = X.sam_tags(fields)
    got = one(spark, X.tag_int(aux, "NM"), X.tag(aux, "XB"), X.tag(aux, "XQ"), X.tag_hex(aux, "XH"), X.tag_text(aux, "XZ"), F.size(aux))
    assert got[0] == 5 and got[1].a == [-1.0, 2.0] and (got[2].type, got[2].s) == ("Z", "hm") and bytes(got[3]) == b"\x1a\xe3" and got[4] == "a:b" and got[5] == 5


@pytest.mark.parametrize("text", ["chr1:0", "chr1:5-4", "chr1:1,000", "", "a:b:c", "chré"])
def test_bad_regions(text):
    with pytest.raises(ValueError):
        intervals.Region.parse(text)


def test_regions():
    assert intervals.Region.parse(" HLA-A:3-7 ") == intervals.Region("HLA-A", 3, 7) and intervals.Region.parse("chr1") == intervals.Region("chr1")


def test_resolve_errors(spark):
    from helixframe.plans.synthetic import contigs

    table = contigs(spark)
    assert intervals.resolve(table, "chr1:11-20").first()[2:] == (10, 19) and intervals.resolve(table, None).count() == 4
    for bad in ("nope", "chr1:1-999999", ("chr1", 9, 3)):
        with pytest.raises(ValueError):
            intervals.resolve(table, bad)


def test_mate_choice(spark):
    df = spark.createDataFrame([("c", 1, "q", 1, 0x80, 5, "A", 0), ("c", 1, "q", 2, 0x40, 5, "A", 0), ("c", 2, "q", 1, 0x80, 5, "A", 0), ("c", 2, "q", 2, 0x40, None, None, 0), ("c", 3, "q", 1, 0x80, 5, "A", 2), ("c", 3, "q", 2, 0x40, 5, "A", 0)],
                               "contig string, pos int, qname string, read_id long, flags int, qpos int, base string, insert_len int")
    keep = lambda **o: {r.pos: r.read_id for r in pileups.dedup_mates(df, **o).collect()}
    assert keep() == {1: 2, 2: 1, 3: 2} and keep(prefer_insertion=True) == {1: 2, 2: 1, 3: 1}


def test_alternative_ties_go_to_the_first_base(spark):
    df = spark.createDataFrame([("c", 1, 0, 2, 2, 0, 0, 4, "A"), ("c", 2, 1, 1, 0, 0, 0, 2, "N"), ("c", 3, 3, 0, 0, 0, 0, 3, "A")], "contig string, pos int, a long, c long, g long, t long, n long, total long, ref_base string")
    assert {r.pos: r.alt for r in pileups.best_alternative(df).collect()} == {1: "C", 2: None, 3: None}


def test_modification_errors(spark):
    def error(mm, ml, seq="ACCC"):
        df = spark.createDataFrame([(1, 0, seq, mm, ml)], "read_id long, flags int, seq string, mm string, ml array<int>")
        return basemods.modifications(df).first()

    assert error("C+m,0", [1]).error == "unterminated entry" and error("N+m,0;", [1]).error == "malformed entry" and error("C+m,0;", []).error == "length of ML"
    assert error("C+m,5;", [1]).error == "call outside the sequence" and error("C+m,1;", [7])[1:4] == (2, "m", 7) and error("C+27551,0;", [9])[1:3] == (1, "27551")


def test_headers():
    with pytest.raises(ValueError):
        sam.check_sort_order("@HD\tVN:1.6\tSO:queryname\n")
    sam.check_sort_order("@HD\tVN:1.6\n")
    twice = sam.add_program(sam.add_program("@HD\tVN:1.6\n", "tool"), "tool")
    assert twice.splitlines()[1:] == ["@PG\tID:tool\tPN:tool", "@PG\tID:tool.1\tPN:tool\tPP:tool"]


def test_realignment_that_does_not_fit_is_rejected(spark):
    df = rewrites.with_derived(read(spark, 5, "4M", "ACGT"))
    out = rewrites.set_alignment(df, F.lit(7), R.cigar_parse(F.lit("5M"))).first()
    assert out.rejected and out.pos == 5
    out = rewrites.set_alignment(df, F.lit(7), R.cigar_parse(F.lit("1S3M"))).first()
    assert not out.rejected and (out.pos, out.end_pos) == (7, 9)
