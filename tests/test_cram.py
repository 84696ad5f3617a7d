"""CRAM: numbers, codecs, features, mates and errors.  The files are made by the encoder beside the decoder, or by hand."""

import io
import random
import struct

import pytest

from helixframe.sources import alignments, cram


@pytest.mark.parametrize("value", [0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1, 2**28, 2**31 - 1, -1, -2, -(2**31)])
def test_itf8(value):
    raw = cram.put_itf8(value)
    assert cram.itf8(b"x" + raw + b"zz", 1) == (value, 1 + len(raw))


@pytest.mark.parametrize("value", [0, 127, 128, 2**14, 2**35 - 1, 2**49, 2**56 - 1, 2**56, 2**63 - 1, -1, -(2**63)])
def test_ltf8(value):
    raw = cram.put_ltf8(value)
    assert cram.ltf8(raw + b"zz", 0) == (value, len(raw))


def test_fixed_bytes():
    """Values worked out by hand from the format's description."""
    assert cram.itf8(b"\x81\x00", 0) == (256, 2) and cram.itf8(b"\xff\xff\xff\xff\x0f", 0) == (-1, 5) and cram.itf8(b"\xe0\x45\x4f\x46", 0) == (4542278, 4)
    assert cram.ltf8(b"\x80\x80", 0) == (128, 2) and cram.ltf8(b"\xff" * 9, 0) == (-1, 9)


@pytest.mark.parametrize("order", [0, 1])
def test_rans(order):
    rng = random.Random(order)
    for n in (0, 1, 2, 3, 4, 5, 7, 100, 1001, 9000):
        for letters in (b"a", b"ab", b"ACGT", bytes(range(256)), bytes(range(10, 40))):
            data = bytes(rng.choice(letters) for _ in range(n))
            assert cram.rans_decode(cram.rans_encode(data, order)) == data


def test_bit_encodings():
    def reader(body, core):
        read, _ = cram.encoding(body, 0, "int")
        s = cram._Slice(cram._Bits(core), {})
        return lambda: read(s)

    part = lambda codec, body: cram.put_itf8(codec) + cram.put_itf8(len(body)) + body
    beta = reader(part(6, cram.put_itf8(2) + cram.put_itf8(4)), bytes([0b01011111]))
    assert [beta(), beta()] == [3, 13]
    gamma = reader(part(9, cram.put_itf8(1)), bytes([0b10100110, 0b01000000]))  # 1, 2, 3 and 4
    assert [gamma(), gamma(), gamma(), gamma()] == [0, 1, 2, 3]
    sub = reader(part(7, cram.put_itf8(0) + cram.put_itf8(1)), bytes([0b01100110, 0b11000000]))  # 1; 2; 3 is 10 1; 6
    assert [sub(), sub()] == [1, 2]
    symbols = b"".join(map(cram.put_itf8, (3, 10, 20, 30, 3, 1, 2, 2)))  # codes 0, 10, 11
    huffman = reader(part(3, symbols), bytes([0b10011000]))
    assert [huffman() for _ in range(4)] == [20, 10, 30, 10]
    assert reader(part(3, b"".join(map(cram.put_itf8, (1, 7, 1, 0)))), b"")() == 7
    with pytest.raises(ValueError):
        cram.encoding(part(8, b"\0\0"), 0, "int")


REF = "ACGTACGTAACCGGTTACGTNACGTTGCA" * 4
HEADER = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:c1\tLN:116\n@RG\tID:g\n"


def _read(k, pos, cigar, seq, **more):
    span = sum(n for o, n in cigar if o in "MDN=X")
    return {"flags": 0, "pos": pos, "end_pos": pos + span - 1, "mapq": k, "qname": f"q{k}", "cigar": cigar, "seq": seq, "qual": [(k + j) % 40 for j in range(len(seq))], "rg": "g", "next_tid": -1, "next_pos": -1, "template_len": 0} | more


READS = [
    _read(1, 0, [("M", 8)], "ACGTACGT"), _read(2, 2, [("S", 2), ("M", 4), ("I", 3), ("M", 2), ("D", 2), ("M", 3), ("H", 5)], "GGGTACTTTGTCCG"),
    _read(3, 4, [("M", 3), ("N", 6), ("M", 4)], "ACNTTTT", rg=None), _read(4, 18, [("M", 6)], "GTNACA", flags=99, next_tid=0, next_pos=30, template_len=18),
]


@pytest.mark.parametrize("method", [cram.RAW, cram.GZIP, cram.BZIP2, cram.LZMA, cram.RANS])
@pytest.mark.parametrize("embed", [False, True])
def test_round_trip(spark, tmp_path, method, embed):
    made = tmp_path / "a.cram"
    made.write_bytes(cram.file_start(HEADER) + cram.encode_slice(READS[:2], 0, REF, 0, ["g"], method, embed) + cram.encode_slice(READS[2:], 0, REF, 2, ["g"], method, embed) + cram.file_end())
    (tmp_path / "r.fa").write_text(">c1\n" + "\n".join(REF[k : k + 10] for k in range(0, len(REF), 10)) + "\n")
    (tmp_path / "r.fa.fai").write_text(f"c1\t{len(REF)}\t4\t10\t11\n")
    out = alignments.read_alignments(spark, str(made), reference=None if embed else str(tmp_path / "r.fa")).orderBy("mapq").collect()
    shown = lambda r: (r["flags"], r["pos"], r["end_pos"], r["mapq"], r["qname"], r["seq"], list(r["qual"]), r["next_tid"], r["next_pos"], r["template_len"])
    assert [shown(r) for r in out] == [shown(r) for r in READS]
    assert [[(o.op, o.len) for o in r.cigar] for r in out] == [r["cigar"] for r in READS]
    assert [r.aux["RG"].s if "RG" in r.aux else None for r in out] == ["g", "g", None, "g"] and {r.contig for r in out} == {"c1"}
    part = cram.read_cram(spark, str(made), None if embed else str(tmp_path / "r.fa"), "c1", 17, 30)
    assert [r.qname for r in part.collect()] == ["q4"]
    with pytest.raises(ValueError):
        cram.read_cram(spark, str(made), None, "zz")


def test_wrong_files():
    whole = cram.encode_slice(READS, 0, REF, 0, ["g"])
    (c,) = cram.containers(io.BytesIO(whole + cram.file_end()))
    data = whole[c.offset : c.offset + c.size]
    names, fetch = [("c1", len(REF))], lambda contig, start, stop: REF[start:stop]
    assert len(list(cram.container_rows(data, ["g"], names, fetch))) == 4
    with pytest.raises(ValueError, match="reference"):
        list(cram.container_rows(data, ["g"], names, lambda contig, start, stop: REF[start:stop].replace("A", "C")))
    with pytest.raises(ValueError, match="checksum"):
        list(cram.container_rows(data[:-9] + bytes([data[-9] ^ 1]) + data[-8:], ["g"], names, fetch))
    with pytest.raises(ValueError, match="checksum"):
        list(cram.containers(io.BytesIO(whole[:6] + b"\x05" + whole[7:])))
    with pytest.raises(ValueError, match="tokeniser"):
        raw = bytes([8, 4, 1, 0, 0])
        cram.read_block(raw + struct.pack("<I", cram.zlib.crc32(raw)), 0)
    for start in (b"BAM\1" + bytes(40), b"CRAM\2\1" + bytes(40)):
        with pytest.raises(ValueError):
            cram.read_header(io.BytesIO(start))


def test_mates_of_a_fragment():
    rows = [
        {"qname": None, "tid": 0, "pos": 10, "end_pos": 19, "flags": 0x41, "next_tid": -1, "next_pos": -1, "template_len": 0, "down": 2, "detached": False},
        {"qname": "own", "tid": 0, "pos": 12, "end_pos": 21, "flags": 0, "next_tid": -1, "next_pos": -1, "template_len": 0, "down": None, "detached": True},
        {"qname": None, "tid": 0, "pos": 30, "end_pos": 49, "flags": 0x91, "next_tid": -1, "next_pos": -1, "template_len": 0, "down": None, "detached": False},
    ]
    cram._resolve_mates(rows, 100)
    assert [(r["qname"], r["next_pos"], r["template_len"], r["flags"]) for r in rows] == [("read100", 30, 40, 0x61), ("own", -1, 0, 0), ("read100", 10, -40, 0x91)]
