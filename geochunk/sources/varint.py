"""Variable-length whole numbers: 7 bits a byte, low bits first; signed ones keep their sign in the lowest bit."""

from __future__ import annotations

import numpy as np


class Cursor:
    """A place in a byte string."""

    __slots__ = ("at", "data", "end")

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def __bool__(self) -> bool:
        return self.at < self.end

    def byte(self) -> int:
        if self.at >= self.end:
            raise EOFError("the data end inside a number")
        self.at += 1
        return self.data[self.at - 1]

    def unsigned(self) -> int:
        value = shift = 0
        while True:
            b = self.byte()
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    def signed(self) -> int:
        v = self.unsigned()
        return (v >> 1) ^ -(v & 1)

    def part(self, size: int) -> Cursor:
        if self.at + size > self.end:
            raise EOFError("the data end inside a part")
        c = Cursor(self.data, self.at, self.at + size)
        self.at += size
        return c

    def text(self) -> bytes:
        """Bytes up to a zero byte, which is skipped."""
        stop = self.data.index(b"\0", self.at, self.end)
        out = self.data[self.at : stop]
        self.at = stop + 1
        return out

    def rest(self) -> bytes:
        return self.data[self.at : self.end]


def unsigned(v: int) -> bytes:
    out = bytearray()
    while v >= 0x80:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    out.append(v)
    return bytes(out)


def signed(v: int) -> bytes:
    return unsigned(-2 * v - 1 if v < 0 else 2 * v)


def unsigned_array(data: bytes, start: int, end: int) -> np.ndarray:
    """All numbers of a stretch of bytes, as uint64."""
    b = np.frombuffer(data, np.uint8, end - start, start)
    stops = np.flatnonzero(b < 0x80)
    if not len(b):
        return np.zeros(0, np.uint64)
    if not len(stops) or stops[-1] != len(b) - 1:
        raise EOFError("the data end inside a number")
    starts = np.concatenate([[0], stops[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, stops - starts + 1)
    return np.bitwise_or.reduceat((b & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64), starts)
