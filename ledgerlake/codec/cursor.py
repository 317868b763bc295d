"""A cursor over little-endian binary data."""

from __future__ import annotations

import struct


class DecodeError(ValueError):
    """The data does not have the form asked for."""


class Cursor:
    __slots__ = ("data", "at", "end")

    def __init__(self, data: bytes):
        self.data, self.at, self.end = bytes(data), 0, len(data)

    def take(self, size: int) -> bytes:
        stop = self.at + size
        if size < 0 or stop > self.end:
            raise DecodeError(f"end of data: {size} bytes wanted at {self.at} of {self.end}")
        found = self.data[self.at : stop]
        self.at = stop
        return found

    def done(self) -> bool:
        return self.at >= self.end

    def unsigned(self, size: int) -> int:
        at = self.at
        if at + size > self.end:
            raise DecodeError(f"end of data: {size} bytes wanted at {at} of {self.end}")
        self.at = at + size
        return int.from_bytes(self.data[at : at + size], "little")

    def signed(self, size: int) -> int:
        return int.from_bytes(self.take(size), "little", signed=True)

    def real(self, size: int) -> float:
        return struct.unpack("<f" if size == 4 else "<d", self.take(size))[0]

    def flag(self) -> bool:
        return self.unsigned(1) != 0

    def varuint32(self) -> int:
        """Seven bits a byte, low ones first; at most five bytes and 32 bits."""
        if self.at < self.end and (byte := self.data[self.at]) < 0x80:
            self.at += 1
            return byte
        value = 0
        for shift in range(0, 35, 7):
            byte = self.unsigned(1)
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                if value >> 32:
                    break
                return value
        raise DecodeError("a varuint32 beyond 32 bits")

    def varint32(self) -> int:
        """Zig-zag: even numbers are positive, odd ones negative."""
        value = self.varuint32()
        return value >> 1 ^ -(value & 1)

    def block(self) -> bytes:
        """Bytes after their length."""
        return self.take(self.varuint32())

    def text(self) -> str:
        return self.block().decode("utf-8", errors="replace")


def varuint32(value: int) -> bytes:
    if 0 <= value < 0x80:
        return value.to_bytes()
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)
