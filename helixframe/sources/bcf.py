"""BCF: typed variant rows to blocked binary parts with a CSI index each, and back; a file is read by one task.

Rows: (contig, pos, rlen, ref, alts array<string>, qual float, filters array<string>, info array<struct<key, ints, floats, text>>,
genotypes array<struct<alleles array<int>, phased>>, formats array<struct<key, ints array<array<int>>>>).  An info entry with none of its
values is a flag.  Null numbers are missing; shorter vectors are ended.
"""

from __future__ import annotations

import os
import re
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, WriterCommitMessage

from . import bgzf
from .index import Builder
from .staging import StagedWriter

SCHEMA = (
    "contig string, pos int, rlen int, ref string, alts array<string>, qual float, filters array<string>, info array<struct<key:string,ints:array<int>,floats:array<double>,text:string>>,"
    " genotypes array<struct<alleles:array<int>,phased:boolean>>, formats array<struct<key:string,ints:array<array<int>>>>"
)
#: Type codes, and by integer type its struct letter, least plain value, missing and end of vector.
INT8, INT16, INT32, FLOAT, CHAR = 1, 2, 3, 5, 7
_INTS = {INT8: ("b", -120, -128, -127), INT16: ("h", -32760, -32768, -32767), INT32: ("i", -2147483640, -2147483648, -2147483647)}
_HIGH = {INT8: 127, INT16: 32767, INT32: 2147483647}
MISSING_FLOAT, END_FLOAT = struct.pack("<I", 0x7F800001), struct.pack("<I", 0x7F800002)


def dictionary(header: list[str]) -> dict[str, int]:
    """Numbers of the FILTER, INFO and FORMAT names in order of appearance; PASS is 0."""
    found = {"PASS": 0}
    for line in header:
        m = re.match(r"##(?:FILTER|INFO|FORMAT)=<ID=([^,>]+)", line)
        if m:
            found.setdefault(m[1], len(found))
    return found


def descriptor(n: int, kind: int) -> bytes:
    return bytes([n << 4 | kind]) if n < 15 else bytes([0xF0 | kind]) + integers([n])


def _width(values) -> int:
    known = [v for v in values if v is not None]
    return next(t for t in (INT8, INT16, INT32) if all(_INTS[t][1] <= v <= _HIGH[t] for v in known))


def _pack(values, kind: int, n: int) -> bytes:
    letter, _, missing, end = _INTS[kind]
    return struct.pack(f"<{n}{letter}", *(missing if v is None else v for v in values), *[end] * (n - len(values)))


def integers(values) -> bytes:
    """A typed vector in the least width that holds it."""
    kind = _width(values)
    return descriptor(len(values), kind) + _pack(values, kind, len(values))


def floats(values) -> bytes:
    return descriptor(len(values), FLOAT) + b"".join(MISSING_FLOAT if v is None else struct.pack("<f", v) for v in values)


def text(value: str) -> bytes:
    raw = value.encode()
    return descriptor(len(raw), CHAR) + raw


def vectors(rows) -> bytes:
    """One vector for each sample, all of one width and length."""
    n = max(map(len, rows), default=0)
    kind = _width([v for r in rows for v in r])
    return descriptor(n, kind) + b"".join(_pack(r, kind, n) for r in rows)


def encode(row, contigs: dict[str, int], names: dict[str, int], samples: int) -> bytes:
    alleles = [row["ref"], *(row["alts"] or [])]
    info, formats = row["info"] or [], row["formats"] or []
    genotypes = row["genotypes"] or []
    if (genotypes or formats) and len(genotypes or formats[0]["ints"]) != samples:
        raise ValueError("a value for each sample is needed")
    if len({len(g["alleles"]) for g in genotypes}) > 1:
        raise ValueError("all samples must have one ploidy")
    qual = MISSING_FLOAT if row["qual"] is None else struct.pack("<f", row["qual"])
    n_format = len(formats) + bool(genotypes)
    shared = struct.pack("<iii", contigs[row["contig"]], row["pos"], row["rlen"]) + qual + struct.pack("<II", len(alleles) << 16 | len(info), n_format << 24 | samples)
    shared += text("") + b"".join(map(text, alleles))
    shared += integers([names[f] for f in row["filters"]]) if row["filters"] else descriptor(0, INT8)
    for e in info:
        shared += integers([names[e["key"]]])
        if e["ints"] is not None:
            shared += integers(e["ints"])
        elif e["floats"] is not None:
            shared += floats(e["floats"])
        else:
            shared += text(e["text"]) if e["text"] is not None else descriptor(0, INT8)
    own = b""
    if genotypes:
        coded = [[((-1 if a is None else a) + 1) << 1 | (bool(g["phased"]) and k > 0) for k, a in enumerate(g["alleles"])] for g in genotypes]
        own += integers([names["GT"]]) + vectors(coded)
    for f in formats:
        own += integers([names[f["key"]]]) + vectors(f["ints"])
    return struct.pack("<II", len(shared), len(own)) + shared + own


def _typed(data: bytes, at: int) -> tuple[int, int, int]:
    """(type, number of values, where they start) of the typed vector at ``at``."""
    kind, n, at = data[at] & 15, data[at] >> 4, at + 1
    if n == 15:
        wide, _, at = _typed(data, at)
        n = struct.unpack_from("<" + _INTS[wide][0], data, at)[0]
        at += struct.calcsize(_INTS[wide][0])
    return kind, n, at


def _values(data: bytes, at: int, kind: int, n: int) -> tuple[list | str, int]:
    """The values of a vector and where it ends: integers or floats (null where missing, short where ended) or a text."""
    if kind == CHAR:
        return data[at : at + n].decode(), at + n
    if kind == FLOAT:
        raw = [data[at + 4 * k : at + 4 * k + 4] for k in range(n)]
        return [None if x == MISSING_FLOAT else struct.unpack("<f", x)[0] for x in raw if x != END_FLOAT], at + 4 * n
    if kind not in _INTS:
        return [], at
    letter, _, missing, end = _INTS[kind]
    found = struct.unpack_from(f"<{n}{letter}", data, at)
    return [None if v == missing else v for v in found if v != end], at + struct.calcsize(f"<{n}{letter}")


def decode(shared: bytes, own: bytes, contigs: list[str], names: list[str]) -> tuple:
    """The row of a record's two parts; names and contigs by number."""
    tid, pos, rlen = struct.unpack_from("<iii", shared)
    qual = None if shared[12:16] == MISSING_FLOAT else struct.unpack_from("<f", shared, 12)[0]
    counts, samples = struct.unpack_from("<II", shared, 16)
    at, alleles = 24, []
    _, at = _values(shared, *[x for k, n, a in [_typed(shared, at)] for x in (a, k, n)])
    for _ in range(counts >> 16):
        kind, n, at = _typed(shared, at)
        allele, at = _values(shared, at, kind, n)
        alleles.append(allele)
    kind, n, at = _typed(shared, at)
    filters, at = _values(shared, at, kind, n)
    info = []
    for _ in range(counts & 0xFFFF):
        kind, n, at = _typed(shared, at)
        (key,), at = _values(shared, at, kind, n)
        kind, n, at = _typed(shared, at)
        value, at = _values(shared, at, kind, n)
        flag = n == 0 and kind != CHAR
        info.append((names[key], value if kind in _INTS and not flag else None, value if kind == FLOAT else None, value if kind == CHAR else None))
    genotypes, formats, at = [], [], 0
    for _ in range(samples >> 24):
        kind, n, at = _typed(own, at)
        (key,), at = _values(own, at, kind, n)
        kind, n, at = _typed(own, at)
        rows = []
        for _ in range(samples & 0xFFFFFF):
            value, at = _values(own, at, kind, n)
            rows.append(value)
        if names[key] == "GT":
            genotypes = [([None if v is None or v >> 1 == 0 else (v >> 1) - 1 for v in r], any(v is not None and v & 1 for v in r[1:])) for r in rows]
        else:
            formats.append((names[key], rows))
    return contigs[tid], pos, rlen, alleles[0], alleles[1:], qual, [names[f] for f in filters], info, genotypes, formats


class BcfReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        files = sorted(os.path.join(self.path, n) for n in os.listdir(self.path) if n.endswith(".bcf")) if os.path.isdir(self.path) else [self.path]
        return [InputPartition(f) for f in files] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        with open(partition.value, "rb") as f:
            r = bgzf.Reader(f)
            if r.read(5) != b"BCF\x02\x02":
                raise ValueError(f"{partition.value!r} is no BCF file")
            lines = r.read(struct.unpack("<I", r.read(4))[0]).rstrip(b"\0").decode().splitlines()
            names = list(dictionary(lines))
            contigs = [m[1] for m in (re.match(r"##contig=<ID=([^,>]+)", line) for line in lines) if m]
            while len(sizes := r.read(8)) == 8:
                shared, own = struct.unpack("<II", sizes)
                yield decode(r.read(shared), r.read(own), contigs, names)


class BcfWriter(StagedWriter):
    def __init__(self, options, overwrite):
        super().__init__(options["path"], overwrite, ".bcf")
        self.header = options["header"].split("\n")
        self.contigs = {n: k for k, n in enumerate(options["contigs"].split(","))}

    def write(self, iterator) -> WriterCommitMessage:
        own, done = self.begin()
        build = Builder(len(self.contigs))
        names, samples = dictionary(self.header), max(0, len(self.header[-1].split("\t")) - 9)
        raw = "\n".join(self.header).encode() + b"\n\0"
        with open(own + ".bcf", "wb") as f:
            w = bgzf.Writer(f)
            w.write(b"BCF\x02\x02" + struct.pack("<I", len(raw)) + raw)
            w.flush()
            for row in iterator:
                data = encode(row, self.contigs, names, samples)
                if len(w.held) + len(data) > bgzf.BLOCK:
                    w.flush()
                start = w.tell()
                w.write(data)
                build.push(self.contigs[row["contig"]], row["pos"], row["pos"] + row["rlen"], start, w.tell())
                done.rows += 1
            w.close()
        with open(own + ".bcf.csi", "wb") as f:
            t = bgzf.Writer(f)
            t.write(build.csi())
            t.close()
        done.files += [(own + ".bcf.csi", ".bcf.csi"), (own + ".bcf", ".bcf")]
        return done


class BcfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bcf_blocks"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BcfReader(self.options)

    def writer(self, schema, overwrite):
        return BcfWriter(self.options, overwrite)


def read_bcf(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a BCF file or a folder of them, as write_bcf takes them.  Formats of integers and floats keep their integers only; texts in formats are not read."""
    spark.dataSource.register(BcfSource)
    return spark.read.format("bcf_blocks").load(path)


def call_rows(calls: DataFrame) -> DataFrame:
    """Rows of called variants (contig, pos, ref_base, alt, depth, af, gt): INFO DP and AF, FORMAT GT and DP."""
    entry = lambda key, ints=None, reals=None: F.struct(F.lit(key).alias("key"), F.lit(None).cast("array<int>").alias("ints") if ints is None else ints.alias("ints"), F.lit(None).cast("array<double>").alias("floats") if reals is None else reals.alias("floats"), F.lit(None).cast("string").alias("text"))
    depth = F.array(F.col("depth").cast("int"))
    alleles = F.transform(F.split("gt", "/"), lambda a: a.cast("int"))
    return calls.select(
        "contig", "pos", F.lit(1).alias("rlen"), F.col("ref_base").alias("ref"), F.array("alt").alias("alts"), F.lit(None).cast("float").alias("qual"), F.array(F.lit("PASS")).alias("filters"),
        F.array(entry("DP", depth), entry("AF", None, F.array("af"))).alias("info"), F.array(F.struct(alleles.alias("alleles"), F.lit(False).alias("phased"))).alias("genotypes"),
        F.array(F.struct(F.lit("DP").alias("key"), F.array(depth).alias("ints"))).alias("formats"),
    )


def write_bcf(rows: DataFrame, header: list[str], path: str, contigs: list[str], partitions: int | None = None) -> None:
    """A folder of BCF parts in coordinate order, each with its CSI index."""
    spark = rows.sparkSession
    spark.dataSource.register(BcfSource)
    order = F.array_position(F.array(*map(F.lit, contigs)), F.col("contig"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, order, "pos").sortWithinPartitions(order, "pos")
    placed.write.format("bcf_blocks").mode("overwrite").option("header", "\n".join(header)).option("contigs", ",".join(contigs)).save(path)
