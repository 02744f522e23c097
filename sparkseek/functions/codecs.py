"""Compact forms of bytes, number lists and gram sets, and small numeric helpers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType


def packbits(data: bytes) -> bytes:
    """Run lengths of bytes: n < 128 is followed by n + 1 bytes as they are, n > 128 by one byte that stands 257 - n times."""
    out, at, plain = bytearray(), 0, bytearray()

    def flush() -> None:
        for i in range(0, len(plain), 128):
            piece = plain[i : i + 128]
            out.append(len(piece) - 1)
            out.extend(piece)
        plain.clear()

    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 2:
            flush()
            out += bytes((257 - run, data[at]))
        else:
            plain += data[at : at + run]
        at += run
    flush()
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2
    return bytes(out)


def delta_varint(numbers: Sequence[int]) -> bytes:
    """Ascending numbers as the differences between them, seven bits a byte, the lowest first."""
    out, last = bytearray(), 0
    for x in sorted(numbers):
        d, last = x - last, x
        if d < 0:
            raise ValueError("numbers must not be negative")
        while d > 127:
            out.append(d & 127 | 128)
            d >>= 7
        out.append(d)
    return bytes(out)


def undelta_varint(data: bytes) -> list[int]:
    out, last, value, shift = [], 0, 0, 0
    for b in data:
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            last += value
            out.append(last)
            value = shift = 0
    return out


def bloom(items: Sequence[str], bits: int = 1 << 14, hashes: int = 4) -> bytes:
    """A Bloom filter of the items."""
    field = np.zeros(bits, bool)
    for x in items:
        field[_places(x, bits, hashes)] = True
    return np.packbits(field).tobytes()


def bloom_has(field: bytes, items: Sequence[str], hashes: int = 4) -> bool:
    """Whether all items may be in the filter; never False if they are."""
    bits = np.unpackbits(np.frombuffer(field, np.uint8))
    return all(bits[_places(x, len(bits), hashes)].all() for x in items)


def _places(item: str, bits: int, hashes: int) -> np.ndarray:
    h = xxhash.xxh3_128_intdigest(item.encode("utf-8", "surrogatepass"))
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return np.array([(a + i * b) % (1 << 64) % bits for i in range(hashes)])


def _mapped(f, kind):
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else f(v))

    return run


def packed(data: Column) -> Column:
    """packbits() of a binary column; NULL stays NULL, as in all functions here."""
    return _mapped(lambda v: packbits(bytes(v)), BinaryType())(data)


def unpacked(data: Column) -> Column:
    return _mapped(lambda v: unpackbits(bytes(v)), BinaryType())(data)


def deltas(numbers: Column) -> Column:
    """delta_varint() of an array of numbers that are not negative."""
    return _mapped(lambda v: delta_varint([int(x) for x in v]), BinaryType())(numbers)


def undeltas(data: Column) -> Column:
    return _mapped(lambda v: undelta_varint(bytes(v)), ArrayType(LongType()))(data)


def bloom_of(items: Column, bits: int = 1 << 14, hashes: int = 4) -> Column:
    """Bloom filter of an array of strings."""
    return _mapped(lambda v: bloom(list(v), bits, hashes), BinaryType())(items)


def may_hold(field: Column, items: Column, hashes: int = 4) -> Column:
    """Whether a filter may hold all strings of an array; NULL if either is NULL."""

    @F.pandas_udf(BooleanType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else bloom_has(bytes(x), list(y), hashes) for x, y in zip(a, b)], dtype=object)

    return run(field, items)


def smoothed(values: Column, alpha: float = 0.2) -> Column:
    """Exponential moving average of an array, which begins at its first value; NULL for an empty one."""
    start = F.lit(None).cast("double")
    return F.aggregate(values, start, lambda a, x: F.when(a.isNull(), x.cast("double")).otherwise(a * (1 - alpha) + x * alpha))


def missing_characters(text: Column, pattern: str) -> Column:
    """How many characters of the pattern the text lacks, repeats counted: no window of the text comes closer to the pattern by edits."""
    total = F.lit(0)
    for c in sorted(set(pattern)):
        held = F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))
        total = total + F.greatest(F.lit(0), F.lit(pattern.count(c)) - held)
    return total
