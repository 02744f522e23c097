"""Hashes that must equal given values; grouping inside the library uses Spark's own."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the two hashes.
FNV_OFFSET, FNV_PRIME = 1469598103934665603, 1099511628211
CRC_POLYNOMIAL = 0x82F63B78


def fnv64_of(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(CRC_POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


def crc32c_of(data: bytes) -> int:
    """CRC-32C register that starts at 0 and is not inverted at the end."""
    table, r = _crc_table().tolist(), 0
    for b in data:
        r = table[(r ^ b) & 0xFF] ^ (r >> 8)
    return r


def _by_bytes(values: pd.Series, step, start: int, kind) -> np.ndarray:
    """Runs a byte-wise hash over all strings of a batch side by side, longest last, so each step is one array operation."""
    raw = [b"" if v is None else v.encode("utf-8") for v in values]
    order = np.argsort([len(r) for r in raw], kind="stable")
    state = np.full(len(raw), start, kind)
    lengths = np.array([len(raw[i]) for i in order])
    joined = np.frombuffer(b"".join(raw[i] for i in order), np.uint8)
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(raw) else np.empty(0, int)
    for k in range(lengths.max(initial=0)):
        first = np.searchsorted(lengths, k, side="right")
        state[first:] = step(state[first:], joined[at[first:] + k])
    out = np.empty_like(state)
    out[order] = state
    return out


@F.pandas_udf(StringType())
def _fnv64(values: pd.Series) -> pd.Series:
    prime = np.uint64(FNV_PRIME)
    with np.errstate(over="ignore"):
        h = _by_bytes(values, lambda s, b: (s ^ b.astype(np.uint64)) * prime, FNV_OFFSET, np.uint64)
    return pd.Series([f"{x:016x}" for x in h.tolist()]).where(values.notna().to_numpy(), None)


@F.pandas_udf(StringType())
def _crc32c(values: pd.Series) -> pd.Series:
    table = _crc_table()
    h = _by_bytes(values, lambda s, b: table[(s ^ b) & np.uint32(0xFF)] ^ (s >> np.uint32(8)), 0, np.uint32)
    return pd.Series([f"{x:08x}" for x in h.tolist()]).where(values.notna().to_numpy(), None)


def hash64(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes with the offset above, in hex; NULL stays NULL."""
    return _fnv64(text)


def crc32c(text: Column) -> Column:
    """CRC-32C register of the UTF-8 bytes, in hex; NULL stays NULL."""
    return _crc32c(text)


def fingerprint(columns: Sequence[str]) -> Column:
    """128 bits that stand for the values of the columns; NULLs and empty strings differ."""
    marked = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return F.struct(F.xxhash64(*marked).alias("hi"), F.xxhash64(F.lit("low"), *reversed(marked)).alias("lo"))
