"""Shared parts of the corpus operators: word tables over Arrow batches, shared-folder tables, size-checked joins."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MASK16 = 0xFFFF
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows up to which a one-column id table is broadcast (about 16 MB as a hashed relation).
BROADCAST_IDS = 500_000
#: Bytes of an Arrow batch; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def _splitmix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    with np.errstate(over="ignore"):
        return _splitmix(x.astype(np.uint64, copy=False) + np.uint64(0x9E3779B97F4A7C15))


_POS = mix64(np.arange(1 << 16, dtype=np.uint64)) | np.uint64(1)
_BYTE = mix64(np.arange(1000, 1256, dtype=np.uint64))

SPACE_LUT = np.zeros(256, bool)
SPACE_LUT[[0x20, *range(0x09, 0x0E)]] = True
#: Everything below 0x80 except digits and lower-case letters separates licence words.
ALNUM_SEP_LUT = np.zeros(256, bool)
ALNUM_SEP_LUT[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: A-Z to a-z, other bytes unchanged.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


class Words:
    """Words of a list of texts: 64-bit hashes, byte bounds in ``buf``, and per text the first word and the number of words."""

    __slots__ = ("buf", "ends", "first", "hash", "n", "raw", "starts", "text_at")

    def __init__(self, texts: list[bytes], seps: np.ndarray = SPACE_LUT, lower: bool = True):
        buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(sizes, out=self.text_at[1:])
        self.raw = buf
        if lower:
            buf = ASCII_LOWER[buf]
        gap = seps[buf]
        word = ~gap
        edge = word[1:] & gap[:-1]
        self.starts = np.flatnonzero(np.concatenate(([word[0]], edge)))
        self.ends = np.flatnonzero(np.concatenate((gap[1:] & word[:-1], [False]))) + 1
        self.buf = buf
        self.hash = _hash_spans(buf, self.starts, self.ends)
        bounds = np.searchsorted(self.starts, self.text_at)
        self.first, self.n = bounds[:-1], np.diff(bounds)


def _hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Multilinear hash of the byte spans [start, end) of ``buf``; ``step`` bytes are expanded at once."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    lens = ends - starts
    with np.errstate(over="ignore"):
        while i < n:
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, "right")))
            at, size = starts[i:j], lens[i:j]
            total = int(size.sum())
            head = np.cumsum(size) - size
            if total > 4 * step:  # one giant word: fold it piece by piece
                acc = np.uint64(0)
                for p in range(0, total, step):
                    piece = buf[at[0] + p : at[0] + min(total, p + step)]
                    k = np.arange(p, p + len(piece), dtype=np.uint64)
                    acc += (_BYTE[piece] * (_POS[k & np.uint64(_MASK16)] + mix64(k >> np.uint64(16)) * np.uint64(2))).sum(dtype=np.uint64)
                out[i] = acc
            else:
                k = np.arange(total) - np.repeat(head, size)
                pos = _POS[k & _MASK16]
                if size.max(initial=0) > _MASK16:
                    pos = pos + mix64((k >> 16).astype(np.uint64)) * np.uint64(2) * (k > _MASK16).astype(np.uint64)
                out[i:j] = np.add.reduceat(_BYTE[buf[k + np.repeat(at, size)]] * pos, head)
            i = j
        return mix64(out + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes that ``Words`` gives these words."""
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    return _hash_spans(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends) if raw else np.empty(0, np.uint64)


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words, in order; runs that cross texts are the caller's to skip."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        acc = np.zeros(m, np.uint64)
        for j in range(k):
            acc += hashes[j : j + m] * _POS[j + 17]
            acc ^= acc >> np.uint64(29)
        return mix64(acc)


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(texts: list[bytes], limit: int = 1 << 20):
    """Index ranges of texts of about ``limit`` bytes together; a longer text stands alone."""
    i, n = 0, len(texts)
    while i < n:
        j, size = i, 0
        while j < n and (j == i or size + len(texts[j]) <= limit):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster names in spark.checkpoint.dir; in a session of one machine without that setting (tests), in an own one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        held = spark.sparkContext.getCheckpointDir()
        if held is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="helixframe-"))
            held = spark.sparkContext.getCheckpointDir()
        root = held
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table that ``stored`` wrote once nothing reads it any more."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def within(df: DataFrame, ids: DataFrame, key: str, how: str, most: int = BROADCAST_IDS) -> DataFrame:
    """left_semi or left_anti of df with the one-column table ids; ids is broadcast only if it has ``most`` rows or fewer, else shuffled."""
    small = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if small else ids.hint("shuffle_merge"), key, how)


class _Released:
    """f, with freed memory given back to the system when a task ends: workers live long, and their heaps would keep the largest task's size."""

    def __init__(self, f):
        self.f = f

    def __call__(self, batches):
        yield from self.f(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass


def arrow_map(df: DataFrame, f, schema) -> DataFrame:
    """df.mapInArrow(f, schema) with batches of about BATCH_BYTES in this session from now on, so that long texts do not fill a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(_Released(f), schema)


def crc_mod5(column) -> F.Column:
    """crc32 of an id as text, modulo 5."""
    return F.crc32(column.cast("string").cast("binary")) % 5
