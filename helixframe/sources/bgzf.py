"""Blocked gzip: blocks of at most 64 KiB that can be read from any virtual offset (block offset << 16 | place in the block)."""

from __future__ import annotations

import struct
import zlib
from typing import BinaryIO

#: Fixed value: the empty block that ends a file.
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK = 0xFF00


def read_block(f: BinaryIO) -> bytes | None:
    """Contents of the block at the file's place, None at the end.  Checksum and size are verified."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or head[:4] != b"\x1f\x8b\x08\x04":
        raise ValueError("not a BGZF block")
    extra = f.read(struct.unpack("<H", head[10:])[0])
    size, at = None, 0
    while at + 4 <= len(extra):
        kind, n = extra[at : at + 2], struct.unpack_from("<H", extra, at + 2)[0]
        if kind == b"BC" and n == 2:
            size = struct.unpack_from("<H", extra, at + 4)[0] + 1
        at += 4 + n
    if size is None:
        raise ValueError("a BGZF block without its size")
    body = f.read(size - 12 - len(extra))
    if len(body) != size - 12 - len(extra):
        raise ValueError("truncated BGZF block")
    data = zlib.decompress(body[:-8], -15)
    crc, n = struct.unpack("<II", body[-8:])
    if n != len(data) or crc != zlib.crc32(data):
        raise ValueError("BGZF block fails its checksum")
    return data


class Reader:
    """Bytes from a virtual offset on."""

    def __init__(self, f: BinaryIO, offset: int = 0):
        self.f = f
        self.seek(offset)

    def seek(self, offset: int) -> None:
        self.f.seek(offset >> 16)
        self.block_at = offset >> 16
        self.data, self.at = read_block(self.f) or b"", offset & 0xFFFF

    def tell(self) -> int:
        if self.at >= len(self.data):
            return self.f.tell() << 16
        return self.block_at << 16 | self.at

    def read(self, n: int) -> bytes:
        """n bytes, fewer at the end."""
        parts = []
        while n > 0:
            if self.at >= len(self.data):
                self.block_at = self.f.tell()
                block = read_block(self.f)
                if block is None:
                    break
                self.data, self.at = block, 0
                continue
            part = self.data[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)

    def skip_records(self) -> None:
        """Past the records (a 32-bit size, then as many bytes) that end in this block, without copying them."""
        data, at, n = self.data, self.at, len(self.data)
        while at + 4 <= n and (end := at + 4 + int.from_bytes(data[at : at + 4], "little")) <= n:
            at = end
        self.at = at


def encode_block(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


class Writer:
    """Writes whole records: one that does not fit the block starts the next, one larger than a block spans several."""

    def __init__(self, f: BinaryIO, level: int = 6):
        self.f, self.level, self.held, self.done = f, level, bytearray(), 0

    def tell(self) -> int:
        return self.done << 16 | len(self.held)

    def write(self, record: bytes) -> None:
        if self.held and len(self.held) + len(record) > BLOCK:
            self.flush()
        self.held += record
        while len(self.held) > BLOCK:
            self._emit(BLOCK)

    def _emit(self, n: int) -> None:
        block = encode_block(bytes(self.held[:n]), self.level)
        self.f.write(block)
        self.done += len(block)
        del self.held[:n]

    def flush(self) -> None:
        while self.held:
            self._emit(min(len(self.held), BLOCK))

    def close(self) -> None:
        self.flush()
        self.f.write(EOF_BLOCK)


def translate(gzi: list[tuple[int, int]], offset: int) -> int:
    """Virtual offset of an uncompressed offset by the (compressed, uncompressed) block starts of a .gzi index."""
    at = (0, 0)
    for pair in gzi:
        if pair[1] > offset:
            break
        at = pair
    return at[0] << 16 | (offset - at[1])


def read_gzi(data: bytes) -> list[tuple[int, int]]:
    n = struct.unpack_from("<Q", data)[0]
    if len(data) != 8 + 16 * n:
        raise ValueError("size of the .gzi index")
    return [struct.unpack_from("<QQ", data, 8 + 16 * k) for k in range(n)]
