import gzip
import io

import pytest
from pyspark.sql import functions as F

from helixframe.functions import reads as R
from helixframe.operators import intervals, pileups
from helixframe.operators.events import pileup
from helixframe.sources import bam, bgzf, fasta, index, sam, vcf
from helixframe.streaming.live_pileup import live_depth

TEXT = (
    "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:c1\tLN:100000\n@SQ\tSN:c2\tLN:500\n"
    "r1\t99\tc1\t100\t60\t3S7M\t=\t40000\t20\tACGTACGTAC\tIIIIIIIIII\tNM:i:1\tRG:Z:a\tXB:B:s,-5,6\r\n"
    "r1\t147\tc1\t40000\t60\t5M2D5M\t=\t100\t-20\tACGTRCGTAC\t*\n"
    "u1\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII\n"
    "x1\t0\tnope\t5\t0\t4M\t*\t0\t0\tACGT\tIIII\n"
    "m1\t0\tc2\t5\t20\t4M\t*\t0\t0\t*\t*\n"
)


@pytest.fixture
def reads(spark, tmp_path):
    (tmp_path / "a.sam").write_text(TEXT)
    return sam.read_sam(spark, str(tmp_path / "a.sam"))


def test_lines_are_parsed_once(spark, small):
    """Filters on parsed columns read them, rather than make and split the line again."""
    from helixframe.plans.registry import QUERIES

    plan = QUERIES["src_sam"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\r$") == 1 and plan.count("concat_ws(") == 1


def test_sam(reads):
    rows = {(r.qname, r.pos): r for r in reads.collect()}
    assert set(rows) == {("r1", 99), ("r1", 39999), ("m1", 4)}
    a, b, m = rows["r1", 99], rows["r1", 39999], rows["m1", 4]
    assert (a.end_pos, a.next_pos, a.next_tid, a.aux["XB"].a, a.qual[0]) == (105, 39999, 0, [-5.0, 6.0], 40)
    assert b.seq == "ACGTNCGTAC" and set(b.qual) == {255} and b.indel_bases == 2 and m.seq == "" and m.qual == []


def test_bam_round_trip_and_regions(spark, reads, tmp_path):
    contigs = [("c1", 100000), ("c2", 500)]
    bam.write_bam(reads, str(tmp_path / "b"), contigs, "@HD\tVN:1.6\tSO:coordinate\n", partitions=2)
    back = bam.read_bam(spark, str(tmp_path / "b"))
    key = lambda df: sorted((r.qname, r.flags, r.contig, r.pos, r.end_pos, r.mapq, str(r.cigar), r.seq, str(r.qual), r.next_tid, r.next_pos, r.template_len, str(sorted(r.aux.items())), r.strand) for r in df.collect())
    assert key(back) == key(reads)
    part = intervals.overlapping(bam.read_bam(spark, str(tmp_path / "b")), "c1", 39_990, 50_000)
    assert [(r.qname, r.pos) for r in part.collect()] == [("r1", 39999)]
    first = next((tmp_path / "b").glob("*.bam"))
    assert bam.detect(str(first)) == "bam"


def test_blocks():
    f = io.BytesIO()
    w = bgzf.Writer(f)
    data = [bytes([k % 251]) * 9000 for k in range(40)]
    at = []
    for d in data:
        at.append(w.tell() if len(w.held) + len(d) <= bgzf.BLOCK else None)
        w.write(d)
    w.close()
    f.seek(0)
    r = bgzf.Reader(f)
    assert r.read(10**7) == b"".join(data) and f.getvalue().endswith(bgzf.EOF_BLOCK)
    for d, v in zip(data, at, strict=True):
        if v is not None:
            assert bgzf.Reader(f, v).read(9000) == d
    broken = bytearray(bgzf.encode_block(b"hello"))
    broken[-8] ^= 1
    with pytest.raises(ValueError):
        bgzf.read_block(io.BytesIO(bytes(broken)))
    assert bgzf.translate([(50, 100), (90, 200)], 150) == 50 << 16 | 50


@pytest.mark.parametrize("kind", ["bai", "csi"])
def test_index_finds_all(kind):
    b = index.Builder(1)
    spans = [(k * 700, k * 700 + 1500 + (k % 7) * 9000) for k in range(300)]
    for k, (s, e) in enumerate(spans):
        b.push(0, s, e, (k * 3) << 16, (k * 3 + 1) << 16)
    found = index.Index(getattr(b, kind)())
    for s, e in ((0, 10), (50_000, 50_001), (100_000, 140_000), (209_000, 300_000)):
        chunks = found.query(0, s, e)
        for k, (x, y) in enumerate(spans):
            if x <= e and y - 1 >= s:
                assert any(a <= (k * 3) << 16 < z for a, z in chunks)
    with pytest.raises(ValueError):
        b.push(0, 5, 9, 1, 2)


def test_bins_agree(spark):
    pairs = [(0, 1), (16383, 16385), (5_000_000, 5_000_100), (0, 1 << 29), (70_000_000, 90_000_000)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", R.reg2bin(F.col("a"), F.col("b")).alias("bin"), R.reg2bins(F.col("a"), F.col("b")).alias("bins"))
    for r in df.collect():
        assert r.bin == index.reg2bin(r.a, r.b) and sorted(r.bins) == sorted(index.reg2bins(r.a, r.b))


def test_crai_is_a_superset():
    rows = index.read_crai(b"0\t101\t50\t1000\t20\t300\n0\t500\t10\t2000\t20\t300\n-2\t0\t0\t3000\t20\t10\n")
    assert [r[3] for r in index.crai_query(rows, 0, 149, 149)] == [1000, 3000]


def test_fasta(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">c1 text\nACGTacgtRR\nAC\n>c2\nGG\n")
    (tmp_path / "r.fai").write_text("c1\t12\t9\t10\t11\nc2\t2\t27\t2\t3\n")
    ref = fasta.read_fasta(spark, str(tmp_path / "r.fa"), 4)
    assert fasta.fetch(ref, "c1", 2, 11, 4) == "GTACGTNNA"
    for bad in (("c1", 5, 5), ("c1", 0, 13), ("zz", 0, 1)):
        with pytest.raises(ValueError):
            fasta.fetch(ref, *bad, 4)
    assert [tuple(r) for r in fasta.fasta_contigs(ref).orderBy("tid").collect()] == [(0, "c1", 12), (1, "c2", 2)]
    fai = fasta.read_fai(spark, str(tmp_path / "r.fai")).where("name = 'c1'").select(fasta.byte_offset(F.lit(11))).first()[0]
    assert fai == 9 + 11 + 1


def test_vcf(spark, tmp_path, small):
    from helixframe.plans.synthetic import CHUNK, contigs, reference
    from helixframe.plans.synthetic import reads as made

    lines = pileups.vcf_lines(pileups.call_snvs(pileup(made(spark, small)), reference(spark), CHUNK))
    names = [r["name"] for r in contigs(spark).orderBy("tid").collect()]
    from helixframe.functions.variants import header_text

    vcf.write_vcf(lines, header_text([(n, 4100) for n in names], samples=["s"]), str(tmp_path / "o.vcf.gz"), names, partitions=2)
    parts = sorted((tmp_path / "o.vcf.gz").glob("*.vcf.gz"))
    got = []
    for p in parts:
        text = bgzf.Reader(p.open("rb")).read(1 << 30).decode().splitlines()
        assert text[0] == "##fileformat=VCFv4.3"
        got += [x for x in text if not x.startswith("#")]
        index.Index(bgzf.Reader((tmp_path / "o.vcf.gz" / (p.name + ".tbi")).open("rb")).read(1 << 30)).query(0, 0, 100)
    assert sorted(got) == sorted(r.line for r in lines.collect())
    assert vcf.output_format("a.bcf") == "bcf"
    with pytest.raises(ValueError):
        vcf.output_format("a.txt")


def test_live_depth(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.sam").write_text(TEXT)
    table = spark.createDataFrame([(0, "c1", 100000), (1, "c2", 500)], "tid int, name string, length long")
    q = live_depth(spark, str(folder), table).writeStream.outputMode("complete").format("memory").queryName("depths").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(depth) from depths").first()[0] == 7 + 12 + 4


def test_alignments_by_content(spark, tmp_path):
    from helixframe.sources.alignments import read_alignments

    (tmp_path / "a.txt").write_text(TEXT)
    assert read_alignments(spark, str(tmp_path / "a.txt")).count() == 3
    (tmp_path / "b.bin").write_bytes(b"CRAM\x03\x00")
    with pytest.raises(ValueError):
        read_alignments(spark, str(tmp_path / "b.bin"))
    (tmp_path / "c.bin").write_bytes(b"xx")
    with pytest.raises(ValueError):
        read_alignments(spark, str(tmp_path / "c.bin"))


def test_bcf(spark, tmp_path, small):
    import struct

    from helixframe.functions.variants import header_text
    from helixframe.plans.synthetic import CHUNK, contigs, reference
    from helixframe.plans.synthetic import reads as made
    from helixframe.sources import bcf

    calls = pileups.call_snvs(pileup(made(spark, small)), reference(spark), CHUNK)
    names = [r["name"] for r in contigs(spark).orderBy("tid").collect()]
    header = header_text([(n, 4100) for n in names], infos=[("DP", "1", "Integer", "d"), ("AF", "A", "Float", "a")], formats=[("GT", "1", "String", "g"), ("DP", "1", "Integer", "d")], samples=["s"])
    bcf.write_bcf(bcf.call_rows(calls), header, str(tmp_path / "o.bcf"), names, partitions=2)
    assert bcf.dictionary(header) == {"PASS": 0, "DP": 1, "AF": 2, "GT": 3}
    got = []
    for p in (tmp_path / "o.bcf").glob("*.bcf"):
        r = bgzf.Reader(p.open("rb"))
        assert r.read(5) == b"BCF\x02\x02"
        assert r.read(struct.unpack("<I", r.read(4))[0]).decode().rstrip("\0").splitlines() == header
        while len(size := r.read(8)) == 8:
            shared, own = struct.unpack("<II", size)
            data = r.read(shared + own)
            tid, pos, rlen, _, counts, samples = struct.unpack_from("<iiiIII", data)
            assert (rlen, counts, samples) == (1, 2 << 16 | 2, 2 << 24 | 1) and data[24:29] == bytes([0x07, 0x17, data[26], 0x17, data[28]])
            gt = data[shared + 3 : shared + 5]
            got.append((names[tid], pos, chr(data[26]), chr(data[28]), {b"\x02\x04": "0/1", b"\x04\x04": "1/1"}[gt]))
        index.Index(bgzf.Reader((p.parent / (p.name + ".csi")).open("rb")).read(1 << 30)).query(0, 0, 100)
    assert sorted(got) == sorted((r.contig, r.pos, r.ref_base, r.alt, r.gt) for r in calls.collect())


def test_bcf_values():
    from helixframe.sources import bcf

    assert bcf.integers([5]) == b"\x11\x05" and bcf.integers([-121])[:1] == b"\x12" and bcf.integers([None, 3]) == b"\x21\x80\x03" and bcf.integers([40000])[:1] == b"\x13"
    assert bcf.vectors([[1], [1, 2]]) == b"\x21\x01\x81\x01\x02" and bcf.text("a" * 20)[:3] == b"\xf7\x11\x14" and bcf.floats([None]) == b"\x15\x01\x00\x80\x7f"


def test_blocked_sam_is_written_by_tasks(spark, reads, tmp_path, monkeypatch):
    """No row comes to the driver; the parts' indexes make one that finds every read."""
    path, header = str(tmp_path / "a.sam.gz"), TEXT[: TEXT.index("r1")]
    monkeypatch.setattr(type(reads), "toLocalIterator", None)
    many = reads.crossJoin(spark.range(3000).toDF("copy")).withColumns({"read_id": F.col("read_id") * 3000 + F.col("copy"), "pos": (F.col("pos") + F.col("copy") % 90).cast("int"), "end_pos": (F.col("end_pos") + F.col("copy") % 90).cast("int")})
    sam.write_sam_blocks(many, header, path, ["c1", "c2"], partitions=5)
    back = sam.read_sam_blocks(spark, path, malformed="fail")
    key = ["qname", "contig", "pos", "end_pos", "seq"]
    assert sorted(map(tuple, back.select(key).collect())) == sorted(map(tuple, many.select(key).collect()))
    with gzip.open(path) as f:
        assert f.read().startswith(header.encode()) and not [n for n in tmp_path.iterdir() if "staging" in n.name]
    near = sam.read_sam_blocks(spark, path, "c1", 40050, 40060)
    assert near.count() == many.where("contig = 'c1' and pos <= 40060 and end_pos >= 40050").count() > 0


def test_reads_of_a_blocked_file_are_not_broadcast(spark, reads, tmp_path):
    """A few runs of blocks hold many reads, which the size of the runs' table does not tell; only the header's contigs may pass through the driver."""
    path, header = str(tmp_path / "a.sam.gz"), TEXT[: TEXT.index("r1")]
    many = reads.crossJoin(spark.range(3000).toDF("copy")).withColumn("read_id", F.col("read_id") * 3000 + F.col("copy"))
    sam.write_sam_blocks(many, header, path, ["c1", "c2"], partitions=5)
    back = sam.read_sam_blocks(spark, path)
    assert len(back.collect()) == 9000

    def below(node):
        children = [node.children().apply(k) for k in range(node.children().size())]
        children += [getattr(node, k)() for k, name in (("executedPlan", "AdaptiveSparkPlan"), ("plan", "QueryStage")) if name in node.nodeName() or name in node.getClass().getSimpleName()]
        return [node, *(n for c in children for n in below(c))]

    sent = [n for n in below(back._jdf.queryExecution().executedPlan()) if n.getClass().getSimpleName() == "BroadcastExchangeExec"]
    assert len(sent) == 2 and all(n.metrics().apply("numOutputRows").value() == 2 for n in sent)


@pytest.mark.parametrize("block", [700, 40_000])
def test_bytes_of_a_bam_file_travel_in_pieces(spark, reads, tmp_path, monkeypatch, block):
    """Records that lie across blocks and pieces come once, and no row holds the whole file."""
    many = reads.crossJoin(spark.range(2000).toDF("copy")).withColumns({"read_id": F.col("read_id") * 2000 + F.col("copy"), "qname": F.concat("qname", F.lit("-"), F.col("copy").cast("string"))})
    bam.write_bam(many, str(tmp_path / "b"), [("c1", 100000), ("c2", 500)], TEXT[: TEXT.index("r1")], partitions=1)
    (file,) = [p for p in (tmp_path / "b").iterdir() if p.name.endswith(".bam")]
    raw = gzip.decompress(file.read_bytes())
    data = b"".join(bgzf.encode_block(raw[k : k + block]) for k in range(0, len(raw), block)) + bgzf.EOF_BLOCK
    monkeypatch.setattr(bam, "PIECE_BYTES", 5000)
    parts = list(bam._pieces(data, 5000))
    assert len(parts) > 3 and max(len(p) for _, _, p in parts) < len(data) / 2
    back = bam.read_bytes(spark, data)
    assert back.rdd.getNumPartitions() == len(parts)
    key = ["qname", "flags", "contig", "pos", "end_pos", "seq", "qual"]
    rows = back.select("read_id", *key).collect()
    assert len({r.read_id for r in rows}) == len(rows)
    assert sorted(tuple(r)[1:] for r in rows) == sorted(map(tuple, many.select(key).collect()))
    head = bgzf.encode_block(raw[: raw.index(b"r1-")][:-36]) + bgzf.EOF_BLOCK
    assert bam.read_bytes(spark, head).count() == 0
