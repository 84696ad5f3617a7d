"""VCF sinks: plain text, and blocked gzip with a tabix index for each part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, WriterCommitMessage

from . import bgzf
from .index import Builder
from .staging import StagedWriter


def output_format(path: str) -> str:
    """vcf, vcf.gz or bcf by the file name."""
    for end, kind in ((".bcf", "bcf"), (".gz", "vcf.gz"), (".vcf", "vcf")):
        if path.endswith(end):
            return kind
    raise ValueError(f"no variant format for {path!r}")


class VcfWriter(StagedWriter):
    def __init__(self, options, overwrite):
        super().__init__(options["path"], overwrite, ".vcf.gz")
        self.header, self.names = options["header"], options["contigs"].split(",")

    def write(self, iterator) -> WriterCommitMessage:
        own, done = self.begin()
        build, number = Builder(len(self.names)), {n: k for k, n in enumerate(self.names)}
        with open(own + ".vcf.gz", "wb") as f:
            w = bgzf.Writer(f)
            w.write(self.header.encode())
            w.flush()
            for row in iterator:
                data = row["line"].encode() + b"\n"
                if len(w.held) + len(data) > bgzf.BLOCK:
                    w.flush()
                start = w.tell()
                w.write(data)
                build.push(number[row["contig"]], row["pos"], row["pos"] + row["rlen"], start, w.tell())
                done.rows += 1
            w.close()
        with open(own + ".vcf.gz.tbi", "wb") as f:
            t = bgzf.Writer(f)
            t.write(build.tbi(self.names))
            t.close()
        done.files += [(own + ".vcf.gz.tbi", ".vcf.gz.tbi"), (own + ".vcf.gz", ".vcf.gz")]
        return done


class VcfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vcf_blocks"

    def schema(self):
        return "contig string, pos int, rlen int, line string"

    def writer(self, schema, overwrite):
        return VcfWriter(self.options, overwrite)


def write_vcf(lines: DataFrame, header: list[str], path: str, contigs: list[str], partitions: int | None = None) -> None:
    """lines: (contig, pos, line[, rlen]).  A ``.vcf`` path becomes a folder of text parts in order, the header first; ``.gz`` one of blocked, indexed parts."""
    kind, spark = output_format(path), lines.sparkSession
    if kind == "bcf":
        raise ValueError("BCF takes typed rows, not lines: see write_bcf")
    order = F.array_position(F.array(*map(F.lit, contigs)), F.col("contig"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.withColumn("rlen", F.col("rlen") if "rlen" in lines.columns else F.lit(1)).repartitionByRange(n, order, "pos").sortWithinPartitions(order, "pos")
    if kind == "vcf":
        spark.createDataFrame([(h,) for h in header], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
        rows.select(F.col("line").alias("value")).write.mode("overwrite").text(f"{path}/records")
        return
    spark.dataSource.register(VcfSource)
    rows.select("contig", "pos", "rlen", "line").write.format("vcf_blocks").mode("overwrite").option("header", "\n".join(header) + "\n").option("contigs", ",".join(contigs)).save(path)
