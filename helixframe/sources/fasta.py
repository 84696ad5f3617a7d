"""Reference sequences: FASTA text to fixed chunks, FAI indexes, and range fetches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.reads import normalize_bases
from . import bgzf

FAI = "name string, length bigint, offset bigint, linebases bigint, linewidth bigint"


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """The index rows; raises if one has no bases, a line narrower than its bases, or a name that stands twice.  An index has a row for each contig and is small."""
    rows = spark.read.schema(FAI).option("mode", "FAILFAST").csv(path, sep="\t")
    bad = rows.where("name is null or length is null or length <= 0 or linebases <= 0 or linewidth < linebases or offset is null").limit(1).count()
    if bad or rows.groupBy("name").count().where("count > 1").limit(1).count():
        raise ValueError("malformed FASTA index")
    return rows


def byte_offset(pos):
    """File offset of a 0-based position, a Column over the index columns."""
    return F.col("offset") + F.floor(pos / F.col("linebases")) * F.col("linewidth") + pos % F.col("linebases")


def read_fasta(spark: SparkSession, path: str, chunk: int = 1 << 16, bases: bool = True) -> DataFrame:
    """(contig, chunk_start, bases) of a FASTA text file, upper case, in chunks of ``chunk`` positions; bases=True keeps A, C, G, T and N only.

    Without an index records are read whole (one row each), so a contig has to fit a row; chunks of all contigs are then spread.  read_fasta_indexed has no such bound.
    """
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    name = F.regexp_extract("value", r"^(\S+)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"[\r\n]", ""))
    parsed = records.select(name.alias("contig"), (normalize_bases(seq) if bases else seq).alias("s")).where("length(s) > 0")
    starts = parsed.select("contig", "s", F.explode(F.sequence(F.lit(0), F.length("s") - 1, F.lit(chunk))).alias("chunk_start"))
    return starts.select("contig", "chunk_start", F.substring("s", F.col("chunk_start") + 1, F.lit(chunk)).alias("bases"))


def read_fasta_indexed(spark: SparkSession, path: str, fai: DataFrame, chunk: int = 1 << 16, bases: bool = True, gzi: bytes | None = None) -> DataFrame:
    """As read_fasta, by the index: each task seeks to the bytes of its chunks, so that a contig of any length is read in parallel and never whole.

    fai: rows of read_fai.  gzi: contents of the .gzi index of a blocked file.  The workers open path, or read it by a scheme that pyarrow knows.
    """
    blocks = None if gzi is None else bgzf.read_gzi(gzi)
    starts = fai.withColumn("chunk_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(chunk).cast("long"))))
    stop = F.least(F.col("chunk_start") + chunk, F.col("length"))
    runs = starts.select("name", "chunk_start", byte_offset(F.col("chunk_start")).cast("long").alias("at"), (byte_offset(stop - 1) + 1).cast("long").alias("stop"))

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            names, at, stops = batch.column(0), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            if "://" in path:
                system, inner = fs.FileSystem.from_uri(path)
                f = system.open_input_file(inner)
            else:
                f = open(path, "rb")
            with f:
                r = bgzf.Reader(f) if blocks is not None else None
                texts = []
                for a, b in zip(at, stops, strict=True):
                    if r is None:
                        f.seek(a)
                        raw = f.read(b - a)
                    else:
                        r.seek(bgzf.translate(blocks, a))
                        raw = r.read(b - a)
                    texts.append(raw.translate(None, b"\r\n").decode())
            yield pa.RecordBatch.from_arrays([names, batch.column(1), pa.array(texts, pa.string())], names=["contig", "chunk_start", "bases"])

    spread = runs.repartition(spark.sparkContext.defaultParallelism * 4, "name", "chunk_start")
    rows = spread.mapInArrow(read, "contig string, chunk_start long, bases string")
    text = F.upper("bases")
    return rows.select("contig", F.col("chunk_start").cast("int").alias("chunk_start"), (normalize_bases(text) if bases else text).alias("bases"))


def fasta_contigs(reference: DataFrame) -> DataFrame:
    """(tid, name, length) by name of a chunked reference."""
    sizes = reference.groupBy(F.col("contig").alias("name")).agg(F.max(F.col("chunk_start") + F.length("bases")).cast("long").alias("length"))
    return sizes.select((F.row_number().over(Window.orderBy("name")) - 1).cast("int").alias("tid"), "name", "length")


def fetch(reference: DataFrame, contig: str, start: int, stop: int, chunk: int) -> str:
    """Bases of [start, stop), stop exclusive; raises for an unknown contig (naming the known ones) or a range outside it."""
    own = reference.where(F.col("contig") == contig)
    rows = own.where((F.col("chunk_start") < stop) & (F.col("chunk_start") > start - chunk)).orderBy("chunk_start").collect()
    text = "".join(r["bases"] for r in rows)
    first = rows[0]["chunk_start"] if rows else 0
    if start < 0 or start >= stop or not rows or first > start or len(text) < stop - first:
        if not own.limit(1).count():
            names = [r[0] for r in reference.select("contig").distinct().orderBy("contig").limit(100).collect()]
            raise ValueError(f"unknown contig {contig!r}; there are {', '.join(names)}")
        raise ValueError(f"range {start}-{stop} is not inside {contig}")
    return text[start - first : stop - first]
