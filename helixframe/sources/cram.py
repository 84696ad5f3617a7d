"""CRAM 3.0 files to reads: container by container in parallel, bases rebuilt from a FASTA file with its index or from the slice's own reference.

The driver walks the container headers; a task decodes whole containers.  Blocks may be raw, gzip, bzip2, lzma or rANS 4x8; the further
codecs of version 3.1 raise an error that names them.  An encoder for simple containers stands beside the decoder, for tests and round trips.
"""

from __future__ import annotations

import bz2
import gzip
import hashlib
import io
import lzma
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bam import SCHEMA, _aux, _strand
from .sam import check_sort_order

#: Block methods, content types, and the start position of the container that ends a file.
RAW, GZIP, BZIP2, LZMA, RANS = range(5)
LATER = {5: "rANS Nx16", 6: "arithmetic coder", 7: "fqzcomp", 8: "name tokeniser"}
FILE_HEADER, COMPRESSION_HEADER, SLICE_HEADER, EXTERNAL, CORE = 0, 1, 2, 4, 5
END_START = 0x454F46
DETACHED, DOWNSTREAM, NO_BASES, QUALITIES = 2, 4, 8, 1

# --- numbers


def itf8(data: bytes, at: int) -> tuple[int, int]:
    """A 32-bit number of one to five bytes, and where it ends."""
    first = data[at]
    more = 0 if first < 0x80 else 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
    if more == 4:
        value = (first & 15) << 28 | data[at + 1] << 20 | data[at + 2] << 12 | data[at + 3] << 4 | data[at + 4] & 15
    else:
        value = int.from_bytes(bytes([first & (0xFF >> more + 1)]) + data[at + 1 : at + 1 + more], "big")
    return value - (1 << 32) if value >> 31 else value, at + 1 + more


def ltf8(data: bytes, at: int) -> tuple[int, int]:
    """A 64-bit number of one to nine bytes: as many more as the first byte has leading ones."""
    first, more = data[at], 0
    while more < 8 and first & (0x80 >> more):
        more += 1
    value = int.from_bytes(bytes([first & (0x7F >> more)]) + data[at + 1 : at + 1 + more], "big")
    return value - (1 << 64) if value >> 63 else value, at + 1 + more


def put_itf8(value: int) -> bytes:
    v = value & 0xFFFFFFFF
    for more, bits in enumerate((7, 14, 21, 28)):
        if v >> bits == 0:
            raw = bytearray(v.to_bytes(more + 1, "big"))
            raw[0] |= 0xFF00 >> more & 0xFF
            return bytes(raw)
    return bytes([0xF0 | v >> 28, v >> 20 & 255, v >> 12 & 255, v >> 4 & 255, v & 15])


def put_ltf8(value: int) -> bytes:
    v = value & ((1 << 64) - 1)
    more = next(m for m in range(9) if m == 8 or v >> 7 * (m + 1) == 0)
    raw = bytearray(v.to_bytes(max(more + 1, 9 if more == 8 else 0), "big"))
    raw[0] |= 0xFF00 >> more & 0xFF
    return bytes(raw)


def _array(data: bytes, at: int) -> tuple[list[int], int]:
    n, at = itf8(data, at)
    out = []
    for _ in range(n):
        v, at = itf8(data, at)
        out.append(v)
    return out, at


# --- rANS 4x8


def _frequencies(data: bytes, at: int) -> tuple[dict[int, int], int]:
    """Frequencies by symbol; neighbouring symbols are given as a run."""
    found: dict[int, int] = {}
    symbol, run = data[at], 0
    at += 1
    while True:
        f = data[at]
        at += 1
        if f >= 0x80:
            f, at = (f & 0x7F) << 8 | data[at], at + 1
        found[symbol] = f
        if run:
            run, symbol = run - 1, symbol + 1
            continue
        after = data[at]
        at += 1
        if after == symbol + 1:
            run, at = data[at], at + 1
        symbol = after
        if not symbol:
            return found, at


class _Table:
    """For each of 4096 slots its symbol, that symbol's frequency, and the slot's offset in it."""

    def __init__(self, frequencies: dict[int, int]):
        self.slots = []
        for symbol, f in frequencies.items():
            self.slots += [(symbol, f, k) for k in range(f)]
        self.slots += [(0, 1, 0)] * (4096 - len(self.slots))


def rans_decode(data: bytes) -> bytes:
    order, _, size = struct.unpack_from("<BII", data)
    at, out = 9, bytearray(size)
    if not size:
        return b""
    if order == 0:
        own, at = _frequencies(data, at)
        tables = {0: _Table(own)}
    else:
        tables, context, run = {}, data[at], 0
        at += 1
        while True:
            own, at = _frequencies(data, at)
            tables[context] = _Table(own)
            if run:
                run, context = run - 1, context + 1
                continue
            after = data[at]
            at += 1
            if after == context + 1:
                run, at = data[at], at + 1
            context = after
            if not context:
                break
    states = list(struct.unpack_from("<4I", data, at))
    at += 16

    def step(j: int, context: int) -> int:
        nonlocal at
        x = states[j]
        symbol, f, k = tables[context].slots[x & 4095]
        x = f * (x >> 12) + k
        while x < 1 << 23 and at < len(data):
            x, at = x << 8 | data[at], at + 1
        states[j] = x
        return symbol

    if order == 0:
        for i in range(size):
            out[i] = step(i & 3, 0)
        return bytes(out)
    quarter, last = size // 4, [0] * 4
    for i in range(quarter):
        for j in range(4):
            last[j] = out[i + j * quarter] = step(j, last[j])
    for i in range(4 * quarter, size):
        last[3] = out[i] = step(3, last[3])
    return bytes(out)


def _scaled(counts: dict[int, int], total: int = 4095) -> dict[int, int]:
    """Counts brought to a sum of ``total``, each at least 1."""
    n = sum(counts.values())
    out = {s: max(1, c * total // n) for s, c in counts.items()}
    while (left := total - sum(out.values())) != 0:
        most = max(out, key=out.get)
        out[most] += left if left > 0 else max(left, 1 - out[most])
    return out


def _put_frequencies(found: dict[int, int]) -> bytes:
    out, symbols, run = bytearray(), sorted(found), 0
    for i, s in enumerate(symbols):
        if run:
            run -= 1
        else:
            out.append(s)
            if i and symbols[i - 1] == s - 1:
                run = next((k for k in range(i, len(symbols)) if symbols[k] - s != k - i), len(symbols)) - i - 1
                out.append(run)
        f = found[s]
        out += bytes([f]) if f < 0x80 else bytes([0x80 | f >> 8, f & 255])
    return bytes(out) + b"\0"


def rans_encode(data: bytes, order: int = 0) -> bytes:
    n, quarter = len(data), len(data) // 4
    if not n:
        return struct.pack("<BII", order, 0, 0)
    pairs: dict[int, dict[int, int]] = {}
    plan = []  # (state, context, symbol) in the order in which they are decoded
    if order == 0:
        plan = [(i & 3, 0, c) for i, c in enumerate(data)]
    else:
        last = [0] * 4
        for i in range(quarter):
            for j in range(4):
                plan.append((j, last[j], data[i + j * quarter]))
                last[j] = data[i + j * quarter]
        for i in range(4 * quarter, n):
            plan.append((3, last[3], data[i]))
            last[3] = data[i]
    for _, context, symbol in plan:
        own = pairs.setdefault(context, {})
        own[symbol] = own.get(symbol, 0) + 1
    tables = {c: _scaled(own) for c, own in pairs.items()}
    starts = {c: dict(zip(sorted(t), [sum(t[x] for x in sorted(t)[:k]) for k in range(len(t))], strict=True)) for c, t in tables.items()}
    head = bytearray()
    if order == 0:
        head += _put_frequencies(tables[0])
    else:
        contexts, run = sorted(tables), 0
        for i, c in enumerate(contexts):
            if run:
                run -= 1
            else:
                head.append(c)
                if i and contexts[i - 1] == c - 1:
                    run = next((k for k in range(i, len(contexts)) if contexts[k] - c != k - i), len(contexts)) - i - 1
                    head.append(run)
            head += _put_frequencies(tables[c])
        head.append(0)
    states, tail = [1 << 23] * 4, bytearray()
    for j, context, symbol in reversed(plan):
        f, x = tables[context][symbol], states[j]
        while x >= (f << 19):
            tail.append(x & 255)
            x >>= 8
        states[j] = (x // f << 12) + x % f + starts[context][symbol]
    body = bytes(head) + struct.pack("<4I", *states) + bytes(reversed(tail))
    return struct.pack("<BII", order, len(body), n) + body


# --- blocks and containers


class Block(NamedTuple):
    kind: int
    content: int
    data: bytes


def read_block(data: bytes, at: int) -> tuple[Block, int]:
    start, method, kind = at, data[at], data[at + 1]
    content, at = itf8(data, at + 2)
    packed, at = itf8(data, at)
    size, at = itf8(data, at)
    body = data[at : at + packed]
    at += packed
    if zlib.crc32(data[start:at]) != struct.unpack_from("<I", data, at)[0]:
        raise ValueError("a block's checksum is wrong")
    if method in LATER:
        raise ValueError(f"blocks of the {LATER[method]} are not decoded")
    body = {RAW: bytes, GZIP: gzip.decompress, BZIP2: bz2.decompress, LZMA: lzma.decompress, RANS: rans_decode}[method](body)
    if len(body) != size:
        raise ValueError("a block's size is wrong")
    return Block(kind, content, body), at + 4


def put_block(kind: int, content: int, data: bytes, method: int = RAW) -> bytes:
    packed = {RAW: bytes, GZIP: gzip.compress, BZIP2: bz2.compress, LZMA: lzma.compress, RANS: rans_encode}[method](data)
    raw = bytes([method, kind]) + put_itf8(content) + put_itf8(len(packed)) + put_itf8(len(data)) + packed
    return raw + struct.pack("<I", zlib.crc32(raw))


class Container(NamedTuple):
    """offset: of its first block; ref: contig number, -1 without one, -2 several; start from 1."""

    offset: int
    size: int
    ref: int
    start: int
    span: int
    records: int


def containers(f) -> Iterator[Container]:
    """The containers of a file object at its first container, the one that ends the file left out."""
    while len(head := f.read(64)) >= 4:
        base = f.tell() - len(head)
        head += f.read(1 << 16) if len(head) == 64 else b""
        size, at = struct.unpack_from("<i", head)[0], 4
        ref, at = itf8(head, at)
        start, at = itf8(head, at)
        span, at = itf8(head, at)
        records, at = itf8(head, at)
        _, at = ltf8(head, at)
        _, at = ltf8(head, at)
        blocks, at = itf8(head, at)
        _, at = _array(head, at)
        if zlib.crc32(head[:at]) != struct.unpack_from("<I", head, at)[0]:
            raise ValueError("a container's checksum is wrong")
        if not (ref == -1 and start == END_START and not records):
            yield Container(base + at + 4, size, ref, start, span, records)
        f.seek(base + at + 4 + size)


def put_container(ref: int, start: int, span: int, records: int, counter: int, bases: int, blocks: list[bytes], landmarks: list[int]) -> bytes:
    body = b"".join(blocks)
    head = struct.pack("<i", len(body)) + b"".join(map(put_itf8, (ref, start, span, records))) + put_ltf8(counter) + put_ltf8(bases)
    head += put_itf8(len(blocks)) + put_itf8(len(landmarks)) + b"".join(map(put_itf8, landmarks))
    return head + struct.pack("<I", zlib.crc32(head)) + body


def read_header(f) -> str:
    """The SAM header text; f stands at the first data container afterwards."""
    head = f.read(26)
    if head[:4] != b"CRAM":
        raise ValueError("not a CRAM file")
    if head[4] != 3:
        raise ValueError(f"CRAM version {head[4]}.{head[5]} is not decoded")
    first = next(containers(f), None)
    if first is None:
        raise ValueError("a CRAM file without a container")
    f.seek(first.offset)
    block, _ = read_block(f.read(first.size), 0)
    f.seek(first.offset + first.size)
    return block.data[4 : 4 + struct.unpack_from("<i", block.data)[0]].decode()


# --- encodings of data series


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
            self.at += 1
        return value


class _Stream:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self) -> int:
        value, self.at = itf8(self.data, self.at)
        return value

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]


class _Slice(NamedTuple):
    core: _Bits
    streams: dict[int, _Stream]


def _huffman(alphabet: list[int], lengths: list[int]) -> Callable[[_Slice], int]:
    """Canonical codes: by length, then by symbol."""
    codes, code, last = {}, 0, 0
    for size, symbol in sorted(zip(lengths, alphabet, strict=True)):
        code <<= size - last
        codes[size, code] = symbol
        code, last = code + 1, size
    if set(lengths) == {0}:
        return lambda s: alphabet[0]

    def read(s: _Slice) -> int:
        size = value = 0
        while (size, value) not in codes or not size:
            value, size = value << 1 | s.core.take(1), size + 1
            if size > 31:
                raise ValueError("no such code")
        return codes[size, value]

    return read


def encoding(data: bytes, at: int, kind: str) -> tuple[Callable[[_Slice], int | bytes], int]:
    """The reader of an encoding of numbers ("int"), bytes ("byte") or byte arrays ("bytes"), and where its description ends."""
    codec, at = itf8(data, at)
    size, at = itf8(data, at)
    end = at + size
    if codec == 1:
        content, _ = itf8(data, at)
        return (lambda s: s.streams[content].number()) if kind == "int" else (lambda s: s.streams[content].byte()), end
    if codec == 3:
        alphabet, at = _array(data, at)
        lengths, at = _array(data, at)
        return _huffman(alphabet, lengths), end
    if codec == 4:
        length, at = encoding(data, at, "int")
        inner, inner_at = itf8(data, at)
        if inner == 1:
            content, _ = itf8(data, itf8(data, inner_at)[1])
            return lambda s: s.streams[content].take(length(s)), end
        value, _ = encoding(data, at, "byte")
        return lambda s: bytes(value(s) for _ in range(length(s))), end
    if codec == 5:
        stop = data[at]
        content, _ = itf8(data, at + 1)

        def until(s: _Slice) -> bytes:
            stream = s.streams[content]
            cut = stream.data.index(stop, stream.at)
            out, stream.at = stream.data[stream.at : cut], cut + 1
            return out

        return until, end
    if codec in (6, 7, 9):
        offset, at = itf8(data, at)
        k = itf8(data, at)[0] if codec != 9 else 0

        def beta(s: _Slice) -> int:
            return s.core.take(k) - offset

        def ones(s: _Slice, bit: int) -> int:
            n = 0
            while s.core.take(1) == bit:
                n += 1
            return n

        def subexponential(s: _Slice) -> int:
            n = ones(s, 1)
            return (s.core.take(k) if n == 0 else (1 << n + k - 1) | s.core.take(n + k - 1)) - offset

        def gamma(s: _Slice) -> int:
            n = ones(s, 0)
            return ((1 << n) | s.core.take(n)) - offset

        return {6: beta, 7: subexponential, 9: gamma}[codec], end
    if codec == 0:
        return lambda s: 0, end
    raise ValueError(f"encoding {codec} is not decoded")


_KINDS = {"RN": "bytes", "IN": "bytes", "SC": "bytes", "BB": "bytes", "QQ": "bytes", "FC": "byte", "BA": "byte", "QS": "byte", "BS": "byte"}


class Compression:
    """A container's compression header."""

    def __init__(self, data: bytes):
        self.names, self.delta, self.reference, self.substitution, self.tags = True, True, True, bytes(5), [[]]
        _, at = itf8(data, 0)
        n, at = itf8(data, at)
        for _ in range(n):
            key, at = data[at : at + 2].decode(), at + 2
            if key == "SM":
                self.substitution, at = data[at : at + 5], at + 5
            elif key == "TD":
                size, at = itf8(data, at)
                lists, at = data[at : at + size], at + size
                self.tags = [[t[k : k + 3] for k in range(0, len(t), 3)] for t in lists[:-1].split(b"\0")]
            else:
                name = {"RN": "names", "AP": "delta", "RR": "reference"}.get(key)
                if name:
                    setattr(self, name, bool(data[at]))
                at += 1
        self.series, self.tag_values = {}, {}
        _, at = itf8(data, at)
        n, at = itf8(data, at)
        for _ in range(n):
            key, at = data[at : at + 2].decode(), at + 2
            self.series[key], at = encoding(data, at, _KINDS.get(key, "int"))
        _, at = itf8(data, at)
        n, at = itf8(data, at)
        for _ in range(n):
            key, at = itf8(data, at)
            self.tag_values[key.to_bytes(3, "big")], at = encoding(data, at, "bytes")

    def base(self, ref: str, code: int) -> str:
        """The read's base for a substitution code at a reference base."""
        ref = ref if ref in "ACGT" else "N"
        bits = self.substitution["ACGTN".index(ref)]
        return next(b for k, b in enumerate(c for c in "ACGTN" if c != ref) if bits >> 6 - 2 * k & 3 == code)


def _restored(c: Compression, s: _Slice, pos: int, size: int, ref: Callable[[int, int], str], known: bool) -> tuple[list, list[str], dict[int, int], dict[int, bytes]]:
    """(CIGAR ops, bases, single qualities, runs of qualities by place) of a mapped read's features; pos from 0."""
    ops, bases, scores, runs, at, here = [], [], {}, {}, 0, pos

    def op(letter: str, n: int):
        if n and ops and ops[-1][0] == letter:
            ops[-1][1] += n
        elif n:
            ops.append([letter, n])

    def match(upto: int):
        nonlocal at, here
        n = upto - at
        if n > 0:
            bases.extend(ref(here, n) if known else "N" * n)
            op("M", n)
            at, here = at + n, here + n

    last = 0
    read = lambda key: c.series[key](s)
    for _ in range(read("FN")):
        code = chr(read("FC"))
        last += read("FP")
        place = last - 1
        match(place)
        if code == "X":
            bases.append(c.base(ref(here, 1), read("BS")))
        elif code == "B":
            bases.append(chr(read("BA")))
            scores[place] = read("QS")
        if code in "XB":
            op("M", 1)
            at, here = at + 1, here + 1
        elif code in "ISi":
            text = chr(read("BA")) if code == "i" else read("IN" if code == "I" else "SC").decode()
            bases.extend(text)
            op("S" if code == "S" else "I", len(text))
            at += len(text)
        elif code in "DN":
            n = read("DL" if code == "D" else "RS")
            op(code, n)
            here += n
        elif code in "PH":
            op(code, read("PD" if code == "P" else "HC"))
        elif code == "b":
            text = read("BB").decode()
            bases.extend(text)
            op("M", len(text))
            at, here = at + len(text), here + len(text)
        elif code == "q":
            runs[place] = read("QQ")
        elif code == "Q":
            scores[place] = read("QS")
        else:
            raise ValueError(f"no such feature: {code!r}")
    match(size)
    return ops, bases, scores, runs


def slice_rows(c: Compression, header: bytes, blocks: list[Block], groups: list[str], contigs: list[tuple[str, int]], fetch, first_id: int) -> list[dict]:
    """The reads of a slice.  fetch(contig, start, stop): bases of the reference."""
    ref_id, at = itf8(header, 0)
    start, at = itf8(header, at)
    span, at = itf8(header, at)
    n, at = itf8(header, at)
    counter, at = ltf8(header, at)
    _, at = itf8(header, at)
    _, at = _array(header, at)
    embedded, at = itf8(header, at)
    digest = header[at : at + 16]
    s = _Slice(_Bits(next((b.data for b in blocks if b.kind == CORE), b"")), {b.content: _Stream(b.data) for b in blocks if b.kind == EXTERNAL})
    whole: dict[int, tuple[int, str]] = {}
    if embedded >= 0:
        whole[ref_id] = start - 1, s.streams[embedded].data.decode().upper()
    elif c.reference and ref_id >= 0 and span > 0:
        whole[ref_id] = start - 1, fetch(contigs[ref_id][0], start - 1, start - 1 + span).upper()
        if any(digest) and hashlib.md5(whole[ref_id][1].encode(), usedforsecurity=False).digest() != digest:
            raise ValueError(f"the reference of {contigs[ref_id][0]}:{start} is not the one that the file was made with")

    def bases_of(tid: int, here: int, many: int) -> str:
        if tid in whole and whole[tid][0] <= here and here + many <= whole[tid][0] + len(whole[tid][1]):
            return whole[tid][1][here - whole[tid][0] : here - whole[tid][0] + many]
        if not c.reference or embedded >= 0:
            return "N" * many
        text = fetch(contigs[tid][0], here, min(here + many, contigs[tid][1])).upper()
        return text + "N" * (many - len(text))

    read = lambda key: c.series[key](s)
    rows, before = [], start
    for k in range(n):
        flags, own = read("BF"), read("CF")
        tid = read("RI") if ref_id == -2 else ref_id
        size, place = read("RL"), read("AP")
        before = pos = before + place if c.delta else place
        group = read("RG")
        name = read("RN").decode() if c.names else None
        row = {"flags": flags, "tid": tid, "pos": pos - 1, "next_tid": -1, "next_pos": -1, "template_len": 0, "down": None, "detached": bool(own & DETACHED)}
        if own & DETACHED:
            mate = read("MF")
            row["flags"] |= (0x20 if mate & 1 else 0) | (8 if mate & 2 else 0)
            if not c.names:
                name = read("RN").decode()
            row["next_tid"], row["next_pos"], row["template_len"] = read("NS"), read("NP") - 1, read("TS")
        elif own & DOWNSTREAM:
            row["down"] = k + read("NF") + 1
        row["qname"] = name
        aux = b"".join(t + c.tag_values[t](s) for t in c.tags[read("TL")])
        row["aux"] = {key: dict(zip(("type", "i", "f", "s", "a"), v, strict=True)) for key, v in _aux(aux).items()}
        if 0 <= group < len(groups) and "RG" not in row["aux"]:
            row["aux"]["RG"] = {"type": "Z", "i": None, "f": None, "s": groups[group], "a": None}
        scores: dict[int, int] = {}
        runs: dict[int, bytes] = {}
        if flags & 4:
            ops, mapq = [], 0
            bases = [] if own & NO_BASES else [chr(read("BA")) for _ in range(size)]
        else:
            ops, bases, scores, runs = _restored(c, s, pos - 1, size, lambda here, many, tid=tid: bases_of(tid, here, many), c.reference or embedded >= 0)
            mapq = read("MQ")
            bases = [] if own & NO_BASES else bases
        qual = [255] * len(bases)
        if own & QUALITIES:
            qual = [read("QS") for _ in range(size)][: len(bases) or size]
            qual = qual if bases else []
        for p, run in runs.items():
            qual[p : p + len(run)] = run
        for p, q in scores.items():
            qual[p] = q
        seq = "".join(x if x in "ACGT" else "N" for x in "".join(bases).upper())
        reach = sum(m for o, m in ops if o in "MDN=X")
        row |= {
            "read_id": first_id + counter + k, "contig": contigs[tid][0] if tid >= 0 else None, "end_pos": pos - 1 + max(reach, 1) - 1, "mapq": mapq, "cigar": [{"op": o, "len": m} for o, m in ops], "seq": seq,
            "qual": list(qual), "matching_bases": sum(m for o, m in ops if o == "M"), "indel_bases": sum(m for o, m in ops if o in "ID"), "seq_len": len(seq),
        }
        rows.append(row)
    _resolve_mates(rows, first_id + counter)
    for row in rows:
        row["strand"] = _strand(row["flags"])
        del row["down"], row["detached"]
    return rows


def _resolve_mates(rows: list[dict], counter: int) -> None:
    """Mates, template lengths and names of fragments whose next segment stands later in the slice."""
    seen: set[int] = set()
    for k, row in enumerate(rows):
        if k in seen:
            continue
        chain, at = [k], k
        while rows[at]["down"] is not None and rows[at]["down"] < len(rows):
            at = rows[at]["down"]
            chain.append(at)
        seen.update(chain)
        name = next((rows[i]["qname"] for i in chain if rows[i]["qname"]), None) or f"read{counter + k}"
        for i in chain:
            rows[i]["qname"] = rows[i]["qname"] or name
        if len(chain) < 2:
            continue
        one = len({rows[i]["tid"] for i in chain}) == 1 and not any(rows[i]["flags"] & 4 for i in chain)
        left, right = min(rows[i]["pos"] for i in chain), max(rows[i]["end_pos"] for i in chain)
        first = min(chain, key=lambda i: (rows[i]["pos"], not rows[i]["flags"] & 0x40))
        for i, j in zip(chain, [*chain[1:], chain[0]], strict=True):
            mate = rows[j]
            rows[i]["next_tid"], rows[i]["next_pos"] = mate["tid"], mate["pos"]
            rows[i]["flags"] |= (0x20 if mate["flags"] & 0x10 else 0) | (8 if mate["flags"] & 4 else 0)
            rows[i]["template_len"] = (right - left + 1) * (1 if i == first else -1) if one else 0


def container_rows(data: bytes, groups: list[str], contigs: list[tuple[str, int]], fetch, first_id: int = 0) -> Iterator[dict]:
    block, at = read_block(data, 0)
    if block.kind != COMPRESSION_HEADER:
        raise ValueError("a container without a compression header")
    c = Compression(block.data)
    while at < len(data):
        head, at = read_block(data, at)
        if head.kind != SLICE_HEADER:
            raise ValueError("a slice without its header")
        k = 0
        for step in (itf8, itf8, itf8, itf8, ltf8):
            _, k = step(head.data, k)
        n, blocks = itf8(head.data, k)[0], []
        for _ in range(n):
            own, at = read_block(data, at)
            blocks.append(own)
        yield from slice_rows(c, head.data, blocks, groups, contigs, fetch, first_id)


def _contigs(header: str) -> tuple[list[tuple[str, int]], list[str]]:
    fields = [dict(f.split(":", 1) for f in line.split("\t")[1:] if ":" in f) | {"": line[:3]} for line in header.splitlines()]
    return [(f["SN"], int(f["LN"])) for f in fields if f[""] == "@SQ"], [f["ID"] for f in fields if f[""] == "@RG"]


def _fetcher(fasta: str | None):
    """fetch(contig, start, stop) from a FASTA file with a .fai beside it, opened by whoever calls it."""
    if fasta is None:
        def none(contig, start, stop):
            raise ValueError("the file needs a reference")

        return none
    with open(fasta + ".fai") as f:
        index = {r[0]: tuple(map(int, r[1:5])) for r in (line.split("\t") for line in f.read().splitlines()) if len(r) >= 5}
    file = open(fasta, "rb")  # noqa: SIM115

    def fetch(contig: str, start: int, stop: int) -> str:
        if contig not in index:
            raise ValueError(f"the reference has no contig {contig!r}")
        size, offset, bases, width = index[contig]
        stop = min(stop, size)
        if stop <= start:
            return ""
        file.seek(offset + start // bases * width + start % bases)
        return file.read((stop - 1) // bases * width + (stop - 1) % bases - (start // bases * width + start % bases) + 1).translate(None, b"\r\n").decode()

    return fetch


def read_cram(spark: SparkSession, path: str, reference: str | None = None, contig: str | None = None, start: int = 0, end: int | None = None, keep_unmapped: bool = False, any_order: bool = False) -> DataFrame:
    """reads of a CRAM file, all or those of a region (0-based, inclusive), which reads only the containers that may hold them.

    reference: a FASTA file with its .fai, which the workers open; not needed where slices have their own or store all bases.
    """
    with open(path, "rb") as f:
        header = read_header(f)
        found = list(containers(f))
    if not any_order:
        check_sort_order(header)
    names, groups = _contigs(header)
    last = 2**31 - 1 if end is None else end
    if contig is not None:
        tid = next((k for k, (n, _) in enumerate(names) if n == contig), None)
        if tid is None:
            raise ValueError(f"unknown contig {contig!r}; there are {', '.join(n for n, _ in names[:100])}")
        found = [c for c in found if c.ref == -2 or c.ref == tid and c.start - 1 <= last and c.start - 1 + c.span > start]
    columns = T.DataType.fromDDL(SCHEMA).names

    def rows(batches):
        import pandas as pd

        fetch = _fetcher(reference) if reference else _fetcher(None)
        with open(path, "rb") as f:
            for batch in batches:
                for at, size in zip(batch["at"], batch["size"], strict=True):
                    f.seek(at)
                    yield pd.DataFrame([r for r in container_rows(f.read(size), groups, names, fetch) if keep_unmapped or not r["flags"] & 4], columns=columns)

    parts = spark.createDataFrame([(c.offset, c.size) for c in found], "at long, size long")
    out = parts.repartition(max(1, min(len(found), 4 * spark.sparkContext.defaultParallelism)), "at").mapInPandas(rows, SCHEMA)
    return out if contig is None else out.where((F.col("contig") == contig) & (F.col("pos") <= last) & (F.col("end_pos") >= start))


# --- the encoder


def encode_slice(reads: list[dict], tid: int, reference: str, counter: int, groups: list[str], method: int = GZIP, embed: bool = False) -> bytes:
    """A container of one slice with mapped reads of one contig in order (flags, pos, mapq, qname, cigar, seq, qual, rg): every series in a block of its own.

    reference: the contig's bases.  Mate fields are stored with each read.
    """
    keys = ["BF", "CF", "RL", "AP", "RG", "RN", "MF", "NS", "NP", "TS", "TL", "FN", "FC", "FP", "BS", "IN", "SC", "DL", "RS", "HC", "PD", "MQ", "QS", "BA"]
    number = {k: i + 1 for i, k in enumerate(keys)}
    data = {k: bytearray() for k in keys}
    put = lambda key, v: data[key].extend(put_itf8(v))
    start, stop, bases = reads[0]["pos"], max(r["end_pos"] for r in reads) + 1, 0
    before = start + 1
    for r in reads:
        for key, v in (("BF", r["flags"] & ~0x28), ("CF", DETACHED | QUALITIES), ("RL", len(r["seq"])), ("AP", r["pos"] + 1 - before), ("RG", groups.index(r["rg"]) if r["rg"] else -1)):
            put(key, v)
        before = r["pos"] + 1
        data["RN"] += r["qname"].encode() + b"\0"
        for key, v in (("MF", (1 if r["flags"] & 0x20 else 0) | (2 if r["flags"] & 8 else 0)), ("NS", r["next_tid"]), ("NP", r["next_pos"] + 1), ("TS", r["template_len"]), ("TL", 0)):
            put(key, v)
        features, at, here = [], 0, r["pos"]
        for o, n in r["cigar"]:
            if o in "M=X":
                for k in range(n):
                    want, own = reference[here + k], r["seq"][at + k]
                    if want != own:
                        features.append((at + k, "X", "ACGTN".replace(want if want in "ACGT" else "N", "").index(own)))
                at, here = at + n, here + n
            elif o in "IS":
                features.append((at, o, r["seq"][at : at + n]))
                at += n
            else:
                features.append((at, o, n))
                here += n * (o in "DN")
        put("FN", len(features))
        last = 0
        for place, code, value in features:
            data["FC"] += code.encode()
            put("FP", place + 1 - last)
            last = place + 1
            if code == "X":
                data["BS"].append(value)
            elif code in "IS":
                data["IN" if code == "I" else "SC"] += value.encode() + b"\0"
            else:
                put({"D": "DL", "N": "RS", "H": "HC", "P": "PD"}[code], value)
        put("MQ", r["mapq"])
        data["QS"] += bytes(r["qual"])
        bases += len(r["seq"])
    external = lambda i: put_itf8(1) + put_itf8(len(put_itf8(i))) + put_itf8(i)
    stopped = lambda i: put_itf8(5) + put_itf8(1 + len(put_itf8(i))) + b"\0" + put_itf8(i)
    kept = b"RN\1AP\1RR\1SM" + bytes([0b00011011] * 5) + b"TD" + put_itf8(1) + b"\0"
    series = b"".join(k.encode() + (stopped if _KINDS.get(k) == "bytes" else external)(number[k]) for k in keys)
    sized = lambda n, body: put_itf8(len(put_itf8(n)) + len(body)) + put_itf8(n) + body
    compression = put_block(COMPRESSION_HEADER, 0, sized(5, kept) + sized(len(keys), series) + sized(0, b""))
    own = reference[start:stop]
    blocks = [put_block(CORE, 0, b"")] + [put_block(EXTERNAL, number[k], bytes(data[k]), method) for k in keys] + ([put_block(EXTERNAL, 100, own.encode(), method)] if embed else [])
    ids = [*number.values(), *([100] if embed else [])]
    head = b"".join(map(put_itf8, (tid, start + 1, stop - start, len(reads)))) + put_ltf8(counter) + put_itf8(len(blocks)) + put_itf8(len(ids)) + b"".join(map(put_itf8, ids))
    head += put_itf8(100 if embed else -1) + hashlib.md5(own.encode(), usedforsecurity=False).digest()
    header = put_block(SLICE_HEADER, 0, head)
    return put_container(tid, start + 1, stop - start, len(reads), counter, bases, [compression, header, *blocks], [len(compression)])


def file_start(header: str) -> bytes:
    raw = header.encode()
    return b"CRAM\3\0" + bytes(20) + put_container(0, 0, 0, 0, 0, 0, [put_block(FILE_HEADER, 0, struct.pack("<i", len(raw)) + raw)], [0])


def file_end() -> bytes:
    return put_container(-1, END_START, 0, 0, 0, 0, [put_block(COMPRESSION_HEADER, 0, b"\1\0\1\0\1\0")], [])
