"""Bit strings, most significant bit first: a reader, a writer, and packed columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class BitReader:
    """Reads fields from bytes. A read beyond the end raises EOFError and leaves the place as it is."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        """The next n bits (0 to 63) as a number."""
        if not 0 <= n <= 63:
            raise ValueError("a field has 0 to 63 bits")
        if n > self.remaining():
            raise EOFError("fewer bits are left")
        first, stop = self.at // 8, -(-(self.at + n) // 8)
        value = int.from_bytes(self.data[first:stop], "big") >> (stop * 8 - self.at - n)
        self.at += n
        return value & ((1 << n) - 1)

    def seek(self, bit: int) -> None:
        self.at = bit

    def align(self) -> None:
        """On to the next whole byte."""
        self.at = -(-self.at // 8) * 8

    def remaining(self) -> int:
        return max(0, 8 * len(self.data) - self.at)

    def bytes_read(self) -> int:
        return -(-self.at // 8)

    def at_end(self) -> bool:
        return self.remaining() == 0


class BitWriter:
    """Collects fields; finish() pads the last byte with zero bits."""

    def __init__(self) -> None:
        self.value, self.at = 0, 0

    def write(self, value: int, n: int = 1) -> None:
        """The low n bits (0 to 63) of value."""
        if not 0 <= n <= 63:
            raise ValueError("a field has 0 to 63 bits")
        self.value, self.at = self.value << n | value & ((1 << n) - 1), self.at + n

    def align(self) -> None:
        self.write(0, -self.at % 8)

    def finish(self) -> bytes:
        self.align()
        return self.value.to_bytes(self.at // 8, "big")


def pack_fields(values: np.ndarray, width: int) -> bytes:
    """Numbers of one width, one after another."""
    shifts = np.arange(width - 1, -1, -1)
    return np.packbits(((np.asarray(values, np.int64)[:, None] >> shifts) & 1).astype(np.uint8).ravel()).tobytes()


def unpack_fields(data: bytes, width: int, count: int) -> np.ndarray:
    """The inverse of pack_fields()."""
    if not width:
        return np.zeros(count, np.int64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8))[: width * count].reshape(count, width).astype(np.int64)
    return bits @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))


def packed(fields: list[tuple[Column, int]]) -> Column:
    """Binary column of the fields (column, bits) of a row, padded with zero bits."""
    low = [F.lpad(F.bin(c.cast("long").bitwiseAND((1 << n) - 1)), n, "0") for c, n in fields]
    total = sum(n for _, n in fields)
    bits = F.rpad(F.concat(*low), -(-total // 8) * 8, "0")
    return F.unhex(F.concat(*(F.lpad(F.conv(F.substring(bits, 1 + 4 * i, 4), 2, 16), 1, "0") for i in range(-(-total // 8) * 2))))


def field(data: Column, at: int, n: int) -> Column:
    """n bits of a binary column from bit at, as BIGINT; null if there are fewer."""
    first, stop = at // 8, -(-(at + n) // 8)
    number = F.conv(F.hex(F.substring(data, first + 1, stop - first)), 16, 10).cast("long")
    return F.when(F.octet_length(data) * 8 >= at + n, F.shiftright(number, stop * 8 - at - n).bitwiseAND((1 << n) - 1))
