"""SAM text: header, records in both directions.  Records are parsed and written by DataFrame functions."""

from __future__ import annotations

import os
import pickle
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, WriterCommitMessage

from ..functions import reads as R
from ..functions import tags as X
from . import bgzf
from .index import Builder, Index
from .staging import StagedWriter


def header_contigs(lines: DataFrame) -> DataFrame:
    """(tid, name, length) of the @SQ lines, in file order.  lines: (value) of one file, as spark.read.text gives them.

    Headers are small and stand first in a file; only their lines leave the scan.
    """
    from pyspark.sql import Window

    rows = lines.where(F.col("value").startswith("@SQ\t")).select(
        F.monotonically_increasing_id().alias("at"), F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("name"), F.regexp_extract("value", r"\tLN:(\d+)", 1).try_cast("long").alias("length"))
    return rows.select((F.row_number().over(Window.orderBy("at")) - 1).cast("int").alias("tid"), "name", "length")


def check_sort_order(header: str) -> None:
    """Raises for a header that says unsorted or queryname."""
    for line in header.splitlines():
        if line.startswith("@HD"):
            order = next((f[3:] for f in line.split("\t") if f.startswith("SO:")), None)
            if order in ("unsorted", "queryname"):
                raise ValueError(f"reads must be in coordinate order, the header says {order}")


def add_program(header: str, name: str, version: str = "", command: str = "") -> str:
    """header with a @PG line that follows the last one in the chain; an id in use gets a number."""
    ids = [f[3:] for line in header.splitlines() if line.startswith("@PG") for f in line.split("\t") if f.startswith("ID:")]
    own, k = name, 1
    while own in ids:
        own, k = f"{name}.{k}", k + 1
    fields = ["@PG", f"ID:{own}", f"PN:{name}", *([f"PP:{ids[-1]}"] if ids else []), *([f"VN:{version}"] if version else []), *([f"CL:{command}"] if command else [])]
    return header.rstrip("\n") + ("\n" if header else "") + "\t".join(fields) + "\n"


def _once(*columns) -> F.Column:
    """columns of a select, each computed once for a row: filters that follow read the results, where Spark would else compute the whole chain again in each filter."""
    return F.inline(F.array(F.struct(*columns)))


def parse_sam(lines: DataFrame, contigs: DataFrame, keep_unmapped: bool = False, malformed: str = "drop") -> DataFrame:
    """reads of SAM record lines (value[, read_id]).  Unmapped reads, reads without a contig and those on unknown ones are dropped; carriage returns at line ends are.

    A line with under 11 fields, a number or CIGAR that is none, or a QUAL that does not fit SEQ is dropped, too, or raises with malformed="fail".  contigs is a small dimension table.
    """
    if malformed not in ("drop", "fail"):
        raise ValueError(f"malformed lines can be dropped or fail, not {malformed!r}")
    sound = lambda ok, what: ok if malformed == "drop" else F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("malformed record: "), what)))
    held = ["read_id"] if "read_id" in lines.columns else []
    rows = lines.select(*held, _once("value")).where((F.col("value") != "") & ~F.col("value").startswith("@"))
    if not held:
        rows = rows.withColumn("read_id", F.monotonically_increasing_id())
    rows = rows.select("read_id", _once(F.split(F.regexp_replace("value", r"\r$", ""), "\t").alias("f"))).where(sound(F.size("f") >= 11, F.array_join("f", " ")))
    get = lambda k: F.get("f", F.lit(k))
    rows = rows.select("read_id", _once(
        get(0).alias("qname"), get(1).try_cast("int").alias("flags"), get(2).alias("contig"), (get(3).try_cast("int") - 1).alias("pos"),
        get(4).try_cast("int").alias("mapq"), R.cigar_parse(get(5)).alias("cigar"), F.when(get(6) == "=", get(2)).otherwise(get(6)).alias("next_contig"), (get(7).try_cast("int") - 1).alias("next_pos"),
        get(8).try_cast("int").alias("template_len"), F.when(get(9) == "*", "").otherwise(R.normalize_bases(get(9))).alias("seq"), get(10).alias("q"),
        X.sam_tags(F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0)))).alias("aux"),
    ))
    rows = rows.where(sound(F.expr("cigar is not null and flags is not null and pos is not null and mapq is not null"), F.col("qname"))).where("pos >= 0")
    rows = rows.select("*", _once(R.decode_quality(F.col("q"), F.length("seq")).alias("qual"))).where(sound(F.expr("size(qual) = length(seq)"), F.col("qname"))).drop("q")
    if not keep_unmapped:
        rows = rows.where(~R.is_set(F.col("flags"), "unmapped"))
    rows = rows.where("contig != '*'").join(contigs.select(F.col("name").alias("contig"), "tid"), "contig")
    rows = rows.join(contigs.select(F.col("name").alias("next_contig"), F.col("tid").alias("next_tid")), "next_contig", "left").withColumn("next_tid", F.coalesce("next_tid", F.lit(-1)))
    cigar = F.col("cigar")
    return rows.withColumns({"end_pos": R.end_pos(F.col("pos"), cigar), "matching_bases": R.matching_bases(cigar), "indel_bases": R.indel_bases(cigar), "seq_len": F.length("seq"), "strand": R.strand(F.col("flags"))})


def sam_lines(reads: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(value, read_id, *keep): record lines of reads with next_contig, next_pos, template_len and aux."""
    cigar = R.cigar_format(F.col("cigar"))
    tags = F.transform(F.map_entries("aux"), lambda e: X.sam_field(e["key"], e["value"]))
    star = lambda c: F.when(c == "", "*").otherwise(c)
    fields = [
        "qname", F.col("flags").cast("string"), F.coalesce("contig", F.lit("*")), (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), star(cigar), F.coalesce("next_contig", F.lit("*")),
        (F.col("next_pos") + 1).cast("string"), F.col("template_len").cast("string"), star(F.col("seq")), R.encode_quality(F.col("qual")), tags,
    ]
    return reads.select(F.concat_ws("\t", *fields).alias("value"), "read_id", *keep)


def read_sam(spark: SparkSession, path: str, keep_unmapped: bool = False, malformed: str = "drop", any_order: bool = False) -> DataFrame:
    """reads of SAM text files (plain, or compressed as spark.read.text reads them); splits of a plain file are parsed in parallel.

    A file whose first line says that it is not in coordinate order is rejected unless any_order.
    """
    lines = spark.read.text(path)
    if not any_order:
        check_sort_order("\n".join(r["value"] for r in lines.head(1)))
    return parse_sam(lines, header_contigs(lines), keep_unmapped, malformed)


def read_sam_blocks(spark: SparkSession, path: str, contig: str | None = None, start: int = 0, end: int | None = None, **options) -> DataFrame:
    """reads of a blocked SAM file (.sam.gz) with a .tbi or .csi index: of a region (0-based, inclusive), or of the whole file in parallel.

    The driver reads the header and the index; a task reads each run of blocks.  Options as those of parse_sam.
    The contigs are the side to broadcast: from the few rows of the runs' table Spark would take the reads for the smaller side, and collect them.
    """
    found = next((path + e for e in (".tbi", ".csi") if os.path.exists(path + e)), None)
    if found is None:
        raise ValueError(f"{path!r} has no index")
    with open(found, "rb") as f:
        index = Index(f.read())
    with open(path, "rb") as f:
        r = bgzf.Reader(f)
        head, here = [], r.tell()
        while (line := _line(r)).startswith(b"@"):
            head.append(line.decode().rstrip("\r\n"))
            here = r.tell()
    check_sort_order("\n".join(head))
    contigs = F.broadcast(header_contigs(spark.createDataFrame([(line,) for line in head], "value string").coalesce(1)))
    if contig is not None:
        if contig not in index.names:
            raise ValueError(f"unknown contig {contig!r}; there are {', '.join(index.names[:100])}")
        chunks = index.query(index.names.index(contig), start, (1 << 29) - 2 if end is None else end)
    else:
        chunks = [(here, 1 << 62)] if options.get("keep_unmapped") else index.all_chunks()

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open(path, "rb") as f:
                    r, lines = bgzf.Reader(f), []
                    r.seek(a)
                    while r.tell() < b and (line := _line(r)):
                        lines.append(line.rstrip(b"\r\n").decode())
                        if len(lines) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
                            lines = []
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    runs = spark.createDataFrame(chunks, "start long, stop long").repartition(max(1, min(len(chunks), spark.sparkContext.defaultParallelism * 4)))
    out = parse_sam(runs.mapInArrow(read, "value string"), contigs, **options)
    if contig is None:
        return out
    last = 2**31 - 1 if end is None else end
    return out.where((F.col("contig") == contig) & (F.col("pos") <= last) & (F.col("end_pos") >= start))


def _line(r: bgzf.Reader) -> bytes:
    """The next line with its end, empty at the file's end."""
    parts = []
    while True:
        if r.at >= len(r.data):
            first = r.read(1)
            if not first:
                break
            parts.append(first)
            if first == b"\n":
                break
            continue
        cut = r.data.find(b"\n", r.at)
        stop = len(r.data) if cut < 0 else cut + 1
        parts.append(r.data[r.at : stop])
        r.at = stop
        if cut >= 0:
            break
    return b"".join(parts)


def write_sam(reads: DataFrame, header: str, path: str) -> None:
    """One SAM text folder: the header as a first part, then the records in coordinate order."""
    records = reads.orderBy("tid", "pos", "read_id")
    head = reads.sparkSession.createDataFrame([(line,) for line in header.splitlines()], "value string").coalesce(1)
    head.write.mode("overwrite").text(f"{path}/header")
    sam_lines(records).select("value").write.mode("overwrite").text(f"{path}/records")


class SamBlocksWriter(StagedWriter):
    """One blocked file with its index: tasks write parts, the commit puts these one after the other, each with its index entries moved to where it stands."""

    def __init__(self, options, overwrite):
        super().__init__(options["path"], overwrite, ".sam.gz")
        self.header, self.names = options["header"], options["contigs"].split(",")
        self.staging = f"{self.path}.staging-{self.job}"

    def write(self, iterator) -> WriterCommitMessage:
        own, done = self.begin()
        build = Builder(len(self.names))
        with open(own, "wb") as f:
            w = bgzf.Writer(f)
            for row in iterator:
                data = row["value"].encode() + b"\n"
                if len(w.held) + len(data) > bgzf.BLOCK:
                    w.flush()
                start = w.tell()
                w.write(data)
                if row["tid"] is None or row["tid"] < 0:
                    build.push_unplaced()
                else:
                    build.push(row["tid"], row["pos"], row["end_pos"] + 1, start, w.tell())
                done.rows += 1
            w.flush()
        with open(own + ".index", "wb") as f:
            pickle.dump(build, f)
        done.files += [(own + ".index", ".index"), (own, "")]
        return done

    def commit(self, messages) -> None:
        os.makedirs(self.staging, exist_ok=True)
        whole, build = os.path.join(self.staging, "whole"), Builder(len(self.names))
        with open(whole, "wb") as out:
            w = bgzf.Writer(out)
            w.write(self.header.encode())
            w.flush()
            for m in sorted((m for m in messages if m), key=lambda m: m.partition):
                (entries, _), (part, _) = m.files
                with open(entries, "rb") as f:
                    build.append(pickle.load(f), out.tell())
                with open(part, "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
                os.remove(part)
            out.write(bgzf.EOF_BLOCK)
        with open(whole + ".tbi", "wb") as f:
            t = bgzf.Writer(f)
            t.write(build.tbi(self.names))
            t.close()
        os.replace(whole, self.path)
        os.replace(whole + ".tbi", self.path + ".tbi")
        shutil.rmtree(self.staging, ignore_errors=True)


class SamBlocksSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sam_blocks"

    def schema(self):
        return "value string, tid int, pos int, end_pos int"

    def writer(self, schema, overwrite):
        return SamBlocksWriter(self.options, overwrite)


def write_sam_blocks(reads: DataFrame, header: str, path: str, contigs: list[str], partitions: int | None = None) -> None:
    """One blocked SAM file (.sam.gz) in coordinate order with a .tbi index.  Tasks write its parts; the driver copies their bytes together and sees no row."""
    spark = reads.sparkSession
    spark.dataSource.register(SamBlocksSource)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    unplaced = (F.col("tid").isNull() | (F.col("tid") < 0)).cast("int")
    rows = sam_lines(reads, ("tid", "pos", "end_pos")).repartitionByRange(n, unplaced, "tid", "pos", "read_id").sortWithinPartitions(unplaced, "tid", "pos", "read_id")
    rows.drop("read_id").write.format("sam_blocks").mode("overwrite").option("header", header).option("contigs", ",".join(contigs)).save(path)
