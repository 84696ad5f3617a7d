"""Regions, tiles and interval joins."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LAST = 2**31 - 1


@dataclass(frozen=True)
class Region:
    """A region text: contig, and 1-based inclusive bounds where given."""

    contig: str
    start: int | None = None
    end: int | None = None

    @classmethod
    def parse(cls, text: str) -> Region:
        """``name``, ``name:start`` or ``name:start-end``; names may hold ``-`` but no ``:``."""
        m = re.fullmatch(r"([^:]+)(?::(\d+)(?:-(\d+))?)?", text.strip())
        if not m or not text.isascii() or not m[1].strip():
            raise ValueError(f"not a region: {text!r}")
        start, end = (int(x) if x else None for x in m.groups()[1:])
        if any(x is not None and not 1 <= x <= _LAST for x in (start, end)) or (end is not None and start > end):
            raise ValueError(f"bounds out of order or range: {text!r}")
        return cls(m[1], start, end)


def region_columns(text: Column) -> Column:
    """struct(contig, start, end) of region texts, 1-based inclusive; null where the text is no region."""
    t, pattern = F.trim(text), r"^([^:]+)(?::(\d+)(?:-(\d+))?)?$"
    number = lambda k: F.nullif(F.regexp_extract(t, pattern, k), F.lit("")).try_cast("int")
    start, end = number(2), number(3)
    sound = t.rlike(pattern) & F.coalesce(start >= 1, F.lit(True)) & F.coalesce(start <= end, F.lit(True))
    return F.when(sound, F.struct(F.regexp_extract(t, pattern, 1).alias("contig"), start.alias("start"), end.alias("end")))


def resolve(contigs: DataFrame, target) -> DataFrame:
    """(tid, contig, start, end) of a target, 0-based inclusive: a Region or its text, a tid, (contig, start, end), or None for all contigs with bases."""
    table = contigs.select("tid", F.col("name").alias("contig"), "length")
    if target is None:
        return table.where("length > 0").select("tid", "contig", F.lit(0).alias("start"), (F.col("length") - 1).cast("int").alias("end"))
    if isinstance(target, int):
        found, start, end = table.where(F.col("tid") == target), 0, None
    elif isinstance(target, tuple):
        name, start, end = target
        found = table.where(F.col("contig") == name)
    else:
        region = target if isinstance(target, Region) else Region.parse(target)
        found, start, end = table.where(F.col("contig") == region.contig), (region.start or 1) - 1, None if region.end is None else region.end - 1
    rows = found.limit(2).collect()
    if not rows:
        raise ValueError(f"unknown contig: {target!r}")
    last = rows[0]["length"] - 1
    if last < 0:
        raise ValueError(f"empty contig: {target!r}")
    if start > (last if end is None else end) or (end is not None and end > last):
        raise ValueError(f"range outside of the contig: {target!r}")
    return found.select("tid", "contig", F.lit(start).alias("start"), F.lit(last if end is None else end).cast("int").alias("end"))


def tiles(ranges: DataFrame, max_len: int = 10_000, overlap: int = 0) -> DataFrame:
    """Tiles of (contig, start, end) ranges: cores part the range in steps of max_len; a tile is its core and the overlap on both sides, inside the range."""
    if not 0 <= overlap < max_len:
        raise ValueError("the overlap must be less than the tile length")
    cores = ranges.withColumn("core_start", F.explode(F.sequence(F.col("start").cast("long"), F.col("end").cast("long"), F.lit(max_len).cast("long"))))
    cores = cores.withColumn("core_end", F.least(F.col("core_start") + max_len - 1, F.col("end").cast("long")))
    out = cores.withColumn("tile_start", F.greatest(F.col("core_start") - overlap, F.col("start").cast("long"))).withColumn("tile_end", F.least(F.col("core_end") + overlap, F.col("end").cast("long")))
    return out.select("contig", *(F.col(c).cast("int").alias(c) for c in ("core_start", "core_end", "tile_start", "tile_end")))


def overlapping(reads: DataFrame, contig: str, start: int, end: int) -> DataFrame:
    """Reads on the contig whose closed interval meets [start, end]; both bounds reach the scan as pushed filters."""
    return reads.where((F.col("contig") == contig) & (F.col("pos") <= end) & (F.col("end_pos") >= start))


def interval_join(reads: DataFrame, ranges: DataFrame, width: int, start: str = "tile_start", end: str = "tile_end") -> DataFrame:
    """Each pair of a read and a range that overlap, once.

    Both sides are exploded into buckets of ``width`` positions and meet by an equi-join on (contig, bucket); a pair counts in the
    first bucket that both have, so no duplicates arise and nothing has to be made distinct.
    """
    a = reads.withColumn("__b", F.explode(F.sequence(F.floor(F.col("pos") / width), F.floor(F.col("end_pos") / width))))
    b = ranges.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    both = a.join(b, ["contig", "__b"]).where((F.col("pos") <= F.col(end)) & (F.col("end_pos") >= F.col(start)))
    return both.where(F.col("__b") == F.floor(F.greatest("pos", start) / width)).drop("__b")


def merge_intervals(chunks: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Unions of overlapping or touching intervals of each key (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = chunks.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    grouped = marked.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "__g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__g")
