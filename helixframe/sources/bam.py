"""BAM as a Spark data source in both directions.

Reading plans one input partition for each run of index chunks, so a region reads only its blocks and a whole file is read in parallel;
without an index a file is one partition.  Filters on contig, pos and end_pos are used to choose chunks and are applied again by
Spark.  Writing makes one sorted file with its index for each partition; ``write_bam`` range-partitions by coordinate first.

Paths are opened by the Python workers, so they have to be on a file system that all of them mount.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition, LessThanOrEqual, WriterCommitMessage

from . import bgzf
from .index import Builder, Index, reg2bin
from .sam import check_sort_order
from .staging import StagedWriter

SCHEMA = (
    "read_id bigint, qname string, flags int, tid int, contig string, pos int, end_pos int, mapq int, cigar array<struct<op:string,len:int>>, seq string, qual array<int>,"
    " matching_bases int, indel_bases int, seq_len int, next_tid int, next_pos int, template_len int, aux map<string,struct<type:string,i:bigint,f:double,s:string,a:array<double>>>, strand string"
)
_OPS = "MIDNSHP=X"
_SEQ = "=ACMGRSVTWYHKDBN"
_BASES = "".join(c if c in "ACGT" else "N" for c in _SEQ)
_SIZES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
LARGEST = 2 << 20


@dataclass
class Header:
    text: str
    contigs: list[tuple[str, int]]

    @classmethod
    def read(cls, r: bgzf.Reader) -> Header:
        if r.read(4) != b"BAM\x01":
            raise ValueError("not a BAM file")
        text = r.read(struct.unpack("<i", r.read(4))[0]).rstrip(b"\0").decode()
        found = []
        for _ in range(struct.unpack("<i", r.read(4))[0]):
            name = r.read(struct.unpack("<i", r.read(4))[0])[:-1].decode()
            found.append((name, struct.unpack("<i", r.read(4))[0]))
        return cls(text, found)

    def encode(self) -> bytes:
        text = self.text.encode()
        refs = b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in self.contigs)
        return b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.contigs)) + refs


def detect(path: str) -> str:
    """bam, cram, sam.gz, vcf.gz or gzip by the first bytes; plain SAM and VCF by their text."""
    with open(path, "rb") as f:
        head = f.read(4)
        if len(head) < 4:
            raise ValueError("too short for any format")
        if head == b"CRAM":
            return "cram"
        if head[:2] == b"\x1f\x8b":
            f.seek(0)
            start = (bgzf.read_block(f) or b"")[:16]
            return "bam" if start[:4] == b"BAM\x01" else "bcf" if start[:3] == b"BCF" else "sam.gz" if start[:1] == b"@" else "vcf.gz" if start[:12] == b"##fileformat" else "gzip"
        if head[:1] == b"@":
            return "sam"
        if head == b"##fi":
            return "vcf"
    raise ValueError("unknown format")


def _aux(data: bytes) -> dict[str, tuple]:
    """Tags; a malformed tail ends them."""
    out, at = {}, 0
    try:
        while at + 3 <= len(data):
            key, kind = data[at : at + 2].decode(), chr(data[at + 2])
            at += 3
            if kind in _SIZES:
                value = struct.unpack_from("<" + _SIZES[kind], data, at)[0]
                at += struct.calcsize(_SIZES[kind])
                row = ("f", None, float(value), None, None) if kind == "f" else ("i", int(value), None, None, None)
            elif kind == "A":
                row, at = ("A", None, None, chr(data[at]), None), at + 1
            elif kind == "d":
                row, at = ("d", None, struct.unpack_from("<d", data, at)[0], None, None), at + 8
            elif kind in "ZH":
                end = data.index(b"\0", at)
                row, at = (kind, None, None, data[at:end].decode(), None), end + 1
            elif kind == "B":
                sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
                values = struct.unpack_from(f"<{n}{_SIZES[sub]}", data, at + 5)
                row, at = ("B", None, None, sub, [float(v) for v in values]), at + 5 + n * struct.calcsize(_SIZES[sub])
            else:
                break
            out.setdefault(key, row)
    except (struct.error, ValueError, KeyError, IndexError):
        pass
    return out


def _strand(flags: int) -> str:
    if not flags & 1 or flags & 64:
        return "OB" if flags & 16 else "OT"
    return ("OB" if flags & 32 else "OT") if flags & 128 else "NA"


def decode(data: bytes, contigs: list[tuple[str, int]], read_id: int) -> tuple:
    """The row of a record's bytes."""
    tid, pos, n_name, mapq, _, n_ops, flags, n_seq, next_tid, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32 + n_name
    ops = [(_OPS[x & 15] if x & 15 < 9 else "?", x >> 4) for x in struct.unpack_from(f"<{n_ops}I", data, at)]
    at += 4 * n_ops
    packed = data[at : at + (n_seq + 1) // 2]
    seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:n_seq]
    at += len(packed)
    qual = list(data[at : at + n_seq])
    span = sum(n for o, n in ops if o in "MDN=X")
    return (
        read_id, data[32 : 32 + n_name - 1].decode(), flags, tid, contigs[tid][0] if tid >= 0 else None, pos, pos + max(span, 1) - 1, mapq, ops, seq, qual,
        sum(n for o, n in ops if o == "M"), sum(n for o, n in ops if o in "ID"), n_seq, next_tid, next_pos, tlen, _aux(data[at + n_seq :]), _strand(flags),
    )


def _encode_aux(aux) -> bytes:
    out = []
    for key, v in (aux or {}).items():
        kind = v["type"]
        head = key.encode()
        if kind == "i":
            n = v["i"]
            code = "C" if 0 <= n < 256 else "S" if 0 <= n < 65536 else "I" if n >= 0 else "c" if n >= -128 else "s" if n >= -32768 else "i"
            out.append(head + code.encode() + struct.pack("<" + _SIZES[code], n))
        elif kind in "fd":
            out.append(head + kind.encode() + struct.pack("<" + kind, v["f"]))
        elif kind == "A":
            out.append(head + b"A" + v["s"].encode()[:1])
        elif kind in "ZH":
            out.append(head + kind.encode() + v["s"].encode() + b"\0")
        else:
            code = v["s"]
            out.append(head + b"B" + code.encode() + struct.pack("<i", len(v["a"])) + struct.pack(f"<{len(v['a'])}{_SIZES[code]}", *(x if code == "f" else int(x) for x in v["a"])))
    return b"".join(out)


def encode(row, n_contigs: int) -> bytes:
    """Bytes of a row; raises for a row that no BAM record can hold."""
    name, ops, seq, qual = row["qname"].encode(), row["cigar"] or [], row["seq"], row["qual"] or []
    tid, pos = (row["tid"] if row["tid"] is not None else -1), row["pos"]
    if len(name) > 254 or len(ops) > 65535 or tid >= n_contigs or (qual and len(qual) != len(seq)):
        raise ValueError(f"no BAM record can hold read {row['qname']!r}")
    if tid < 0 and not row["flags"] & 4:
        raise ValueError(f"mapped read {row['qname']!r} without a contig")
    codes = [_SEQ.find(c.upper()) if c.upper() in _SEQ else 15 for c in seq]
    codes += [0] * (len(codes) % 2)
    body = struct.pack("<iiBBHHHiiii", tid, pos, len(name) + 1, row["mapq"], reg2bin(max(pos, 0), max(row["end_pos"], pos, 0) + 1), len(ops), row["flags"], len(seq), row["next_tid"], row["next_pos"], row["template_len"])
    body += name + b"\0" + struct.pack(f"<{len(ops)}I", *(o["len"] << 4 | _OPS.index(o["op"]) for o in ops)) + bytes(codes[k] << 4 | codes[k + 1] for k in range(0, len(codes), 2))
    body += bytes(qual or [255] * len(seq)) + _encode_aux(row["aux"])
    if len(body) > LARGEST:
        raise ValueError(f"record of read {row['qname']!r} is over {LARGEST} bytes")
    return struct.pack("<i", len(body)) + body


def _files(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith(".bam"))
    return [path]


def find_index(path: str) -> str | None:
    return next((p for p in (path + ".csi", os.path.splitext(path)[0] + ".csi", path + ".bai", os.path.splitext(path)[0] + ".bai") if os.path.exists(p)), None)


class _Part(InputPartition):
    def __init__(self, path: str, number: int, chunks: list[tuple[int, int]] | None):
        self.path, self.number, self.chunks = path, number, chunks


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.per_part = options["path"], int(options.get("chunkBytes", 8 << 20))
        self.keep_unmapped = options.get("keepUnmapped", "false").lower() == "true"
        self.any_order = options.get("anyOrder", "false").lower() == "true"
        self.where: dict[str, object] = {}

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if isinstance(f, EqualTo) and name == "contig":
                self.where["contig"] = f.value
            elif isinstance(f, LessThanOrEqual) and name == "pos":
                self.where["end"] = f.value
            elif isinstance(f, GreaterThanOrEqual) and name == "end_pos":
                self.where["start"] = f.value
            yield f  # a chunk also holds other reads: Spark applies all filters

    def partitions(self):
        parts = []
        for number, path in enumerate(_files(self.path)):
            index = find_index(path)
            if index is None:
                with open(path, "rb") as f:
                    if not self.any_order:
                        check_sort_order(Header.read(bgzf.Reader(f)).text)
                parts.append(_Part(path, number, None))
                continue
            with open(path, "rb") as f:
                header = Header.read(bgzf.Reader(f))
            if not self.any_order:
                check_sort_order(header.text)
            with open(index, "rb") as f:
                found = Index(f.read())
            if "contig" in self.where:
                tid = next((k for k, (n, _) in enumerate(header.contigs) if n == self.where["contig"]), None)
                last = header.contigs[tid][1] if tid is not None else 0
                chunks = [] if tid is None else found.query(tid, max(int(self.where.get("start", 0)), 0), min(int(self.where.get("end", last)), max(last, 0)))
            elif self.keep_unmapped:
                parts.append(_Part(path, number, None))  # unplaced reads are in no chunk
                continue
            else:
                chunks = found.all_chunks()
            # Runs of windows of about per_part bytes; every chunk boundary is a record boundary.
            cuts = sorted({v for w in found.windows for v in w if v})
            pieces = []
            for a, b in chunks:
                for v in cuts:
                    if a < v < b and (v >> 16) - (a >> 16) >= self.per_part:
                        pieces.append((a, v))
                        a = v
                pieces.append((a, b))
            run: list = []
            for c in pieces:
                if run and (c[1] >> 16) - (run[0][0] >> 16) > self.per_part:
                    parts.append(_Part(path, number, run))
                    run = []
                run.append(c)
            if run:
                parts.append(_Part(path, number, run))
        return parts or [_Part("", 0, [])]

    def read(self, part):
        if not part.path:
            return
        with open(part.path, "rb") as f:
            r = bgzf.Reader(f)
            header = Header.read(r)
            first = r.tell()
            for start, stop in part.chunks if part.chunks is not None else [(first, 1 << 63)]:
                r.seek(start)
                while r.tell() < stop:
                    here = r.tell()
                    size = r.read(4)
                    if len(size) < 4:
                        break
                    row = decode(r.read(struct.unpack("<i", size)[0]), header.contigs, part.number << 48 | here >> 16 << 16 | here & 0xFFFF)
                    if self.keep_unmapped or not row[2] & 4:
                        yield row


class BamWriter(StagedWriter):
    def __init__(self, options, overwrite):
        super().__init__(options["path"], overwrite, ".bam")
        self.header, self.level, self.index = options.get("header", ""), int(options.get("level", 6)), options.get("index", "true").lower() == "true"
        self.contigs = [(n, int(size)) for n, size in (x.rsplit(":", 1) for x in options["contigs"].split(","))]

    def write(self, iterator) -> WriterCommitMessage:
        own, done = self.begin()
        build = Builder(len(self.contigs))
        with open(own + ".bam", "wb") as f:
            w = bgzf.Writer(f, self.level)
            w.write(Header(self.header, self.contigs).encode())
            w.flush()
            for row in iterator:
                start = w.tell()
                data = encode(row, len(self.contigs))
                if len(w.held) + len(data) > bgzf.BLOCK:
                    w.flush()
                    start = w.tell()
                w.write(data)
                if row["tid"] is None or row["tid"] < 0:
                    build.push_unplaced()
                elif self.index:
                    build.push(row["tid"], row["pos"], row["end_pos"] + 1, start, w.tell(), not row["flags"] & 4)
                done.rows += 1
            w.close()
        if self.index:
            with open(own + ".bam.bai", "wb") as f:
                f.write(build.bai())
            done.files.append((own + ".bam.bai", ".bam.bai"))
        done.files.append((own + ".bam", ".bam"))
        return done


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BamReader(self.options)

    def writer(self, schema, overwrite):
        return BamWriter(self.options, overwrite)


#: Compressed bytes of a piece of a BAM file in memory, and rows that a worker holds while it decodes one.
PIECE_BYTES, PIECE_ROWS = 1 << 20, 2_000


def _pieces(data: bytes, size: int) -> Iterator[tuple[int, int, bytes]]:
    """(first, stop, bytes) of runs of whole blocks of about ``size`` bytes: the virtual offsets of their first record and of the end of their last, and the blocks from first's on."""
    import io

    r = bgzf.Reader(io.BytesIO(data))
    Header.read(r)
    first = r.tell()
    while True:
        r.skip_records()
        head = r.read(4)
        if len(head) == 4:  # a record that goes on in the next block
            r.read(struct.unpack("<i", head)[0])
        here, after = r.tell(), r.f.tell()
        done = len(head) < 4
        if here > first and (done or (here >> 16) - (first >> 16) >= size):
            yield first, here, data[first >> 16 : after]
            first = here
        if done:
            return


def read_bytes(spark: SparkSession, data: bytes, keep_unmapped: bool = False) -> DataFrame:
    """reads of the contents of one BAM file; record numbers are places in it.

    The driver finds where records start; runs of blocks travel as a row each, and workers decode PIECE_ROWS records at a time.
    """
    import io

    names, contigs = T.DataType.fromDDL(SCHEMA).names, Header.read(bgzf.Reader(io.BytesIO(data))).contigs

    def rows(batches):
        import pandas as pd

        for batch in batches:
            for first, stop, raw in zip(batch["first"].tolist(), batch["stop"].tolist(), batch["data"], strict=True):
                base = first >> 16 << 16
                r, found = bgzf.Reader(io.BytesIO(bytes(raw)), first - base), []
                while (here := r.tell() + base) < stop:
                    size = r.read(4)
                    if len(size) < 4:
                        break
                    row = dict(zip(names, decode(r.read(struct.unpack("<i", size)[0]), contigs, here), strict=True))
                    if keep_unmapped or not row["flags"] & 4:
                        row["cigar"] = [{"op": o, "len": n} for o, n in row["cigar"]]
                        row["aux"] = {k: dict(zip(("type", "i", "f", "s", "a"), v, strict=True)) for k, v in row["aux"].items()}
                        found.append(row)
                    if len(found) == PIECE_ROWS:
                        yield pd.DataFrame(found, columns=names)
                        found = []
                if found:
                    yield pd.DataFrame(found, columns=names)

    parts = [(first, stop, bytearray(raw)) for first, stop, raw in _pieces(data, PIECE_BYTES)]
    rdd = spark.sparkContext.parallelize(parts, max(1, len(parts)))
    return spark.createDataFrame(rdd, "first long, stop long, data binary").mapInPandas(rows, SCHEMA)


def read_bam(spark: SparkSession, path: str, **options) -> DataFrame:
    """reads of a BAM file or a folder of them.  Options: keepUnmapped, chunkBytes, anyOrder (else a header that says unsorted is rejected)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").options(**options).load(path)


def write_bam(reads: DataFrame, path: str, contigs: list[tuple[str, int]], header: str = "", partitions: int | None = None, **options) -> None:
    """A folder of sorted, indexed BAM files that follow each other in coordinate order, in place of those of an earlier write.  Options: level, index."""
    spark = reads.sparkSession
    spark.dataSource.register(BamSource)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    unplaced = (F.col("tid").isNull() | (F.col("tid") < 0)).cast("int")
    rows = reads.select(*T.DataType.fromDDL(SCHEMA).names).repartitionByRange(n, unplaced, "tid", "pos").sortWithinPartitions(unplaced, "tid", "pos", "read_id")
    rows.write.format("bam").mode("overwrite").option("header", header).option("contigs", ",".join(f"{a}:{b}" for a, b in contigs)).options(**options).save(path)
