"""murmur2 key hash (D1) — the hash Kafka clients use to place keyed records.

Spark's built-in ``hash()`` is murmur3 and gives different partitions, so
this is the one non-native expression. It runs as an Arrow pandas UDF whose
body is vectorized with numpy: keys of equal byte length are hashed together
as a ``(n, length)`` uint8 matrix, 4-byte blocks at a time, with uint32
wrap-around arithmetic. No per-row Python on the hot path.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# murmur2 constants as used by Kafka's default partitioner.
SEED = 0x9747B28C
M = 0x5BD1E995
R = 24


def murmur2_scalar(data: bytes) -> int:
    """Reference scalar implementation (signed 32-bit result); used in tests."""
    mask = 0xFFFFFFFF
    length = len(data)
    h = (SEED ^ length) & mask
    for i in range(length // 4):
        k = data[4 * i] | data[4 * i + 1] << 8 | data[4 * i + 2] << 16 | data[4 * i + 3] << 24
        k = (k * M) & mask
        k ^= k >> R
        k = (k * M) & mask
        h = (h * M) & mask
        h ^= k
    tail = length & ~3
    rem = length % 4
    if rem == 3:
        h ^= data[tail + 2] << 16
    if rem >= 2:
        h ^= data[tail + 1] << 8
    if rem >= 1:
        h ^= data[tail]
        h = (h * M) & mask
    h ^= h >> 13
    h = (h * M) & mask
    h ^= h >> 15
    return h - (1 << 32) if h & 0x80000000 else h


def murmur2_array(keys: list[bytes]) -> np.ndarray:
    """Vectorized murmur2 over a batch of byte strings (signed int32 results)."""
    n = len(keys)
    out = np.zeros(n, dtype=np.int32)
    if n == 0:
        return out
    lengths = np.fromiter((len(k) for k in keys), dtype=np.int64, count=n)
    m = np.uint32(M)
    with np.errstate(over="ignore"):
        for length in np.unique(lengths):
            idx = np.flatnonzero(lengths == length)
            L = int(length)
            h = np.full(idx.size, (SEED ^ L) & 0xFFFFFFFF, dtype=np.uint32)
            if L:
                buf = np.frombuffer(b"".join(keys[i] for i in idx), dtype=np.uint8).reshape(idx.size, L)
                b32 = buf.astype(np.uint32)
                for blk in range(L // 4):
                    c = 4 * blk
                    k = b32[:, c] | (b32[:, c + 1] << 8) | (b32[:, c + 2] << 16) | (b32[:, c + 3] << 24)
                    k = k * m
                    k ^= k >> np.uint32(R)
                    k = k * m
                    h = h * m
                    h ^= k
                tail, rem = L & ~3, L % 4
                if rem == 3:
                    h ^= b32[:, tail + 2] << 16
                if rem >= 2:
                    h ^= b32[:, tail + 1] << 8
                if rem >= 1:
                    h ^= b32[:, tail]
                    h = h * m
            h ^= h >> np.uint32(13)
            h = h * m
            h ^= h >> np.uint32(15)
            out[idx] = h.view(np.int32)
    return out


@F.pandas_udf(T.IntegerType())
def _murmur2_utf8(s: pd.Series) -> pd.Series:
    keys = [b"" if v is None else v.encode("utf-8") for v in s.tolist()]
    return pd.Series(murmur2_array(keys), dtype="int32")


def murmur2(text: Column | str) -> Column:
    """murmur2 of the UTF-8 bytes of ``text`` (NULL hashes as empty bytes)."""
    return _murmur2_utf8(F.col(text) if isinstance(text, str) else text)


def to_positive(h: Column) -> Column:
    """``h & 0x7fffffff``."""
    return h.cast("long").bitwiseAND(F.lit(0x7FFFFFFF))


def murmur2_sql_ctes(src: str, text: str, out: str, prefix: str) -> dict[str, str]:
    """DuckDB twin for the oracle: CTEs that add ``out`` = signed murmur2 of
    the text expression ``text`` to every row of ``src`` (ASCII text: one
    byte per character). 64-bit arithmetic masked to 32 bits; blocks folded
    with ``list_reduce``."""
    m, mask = M, 0xFFFFFFFF

    def b(j: str) -> str:
        return f"CAST(unicode(substr(_t, CAST({j} AS BIGINT) + 1, 1)) AS BIGINT)"

    blocks = (f"list_transform(range(_L // 4), lambda i: ({b('4*i')} | ({b('4*i+1')} << 8) | "
              f"({b('4*i+2')} << 16) | ({b('4*i+3')} << 24)))")
    k1 = f"list_transform({blocks}, lambda k: (k * {m}) & {mask})"
    k2 = f"list_transform({k1}, lambda k: xor(k, k >> {R}))"
    k3 = f"list_transform({k2}, lambda k: (k * {m}) & {mask})"
    p = prefix
    tail = (f"(CASE WHEN _L % 4 = 3 THEN {b('_L - 1')} << 16 ELSE 0 END) | "
            f"(CASE WHEN _L % 4 >= 2 THEN {b('_L - _L % 4 + 1')} << 8 ELSE 0 END) | {b('_L - _L % 4')}")
    return {
        f"{p}0": f"SELECT *, coalesce({text}, '') AS _t, length(coalesce({text}, '')) AS _L FROM {src}",
        f"{p}1": f"SELECT *, list_reduce({k3}, lambda h, k: xor((h * {m}) & {mask}, k), xor({SEED}, _L) & {mask}) AS _h1 "
                 f"FROM {p}0",
        f"{p}2": f"SELECT *, CASE WHEN _L % 4 = 0 THEN _h1 ELSE (xor(_h1, {tail}) * {m}) & {mask} END AS _h2 FROM {p}1",
        f"{p}3": f"SELECT *, xor(_h2, _h2 >> 13) AS _h3 FROM {p}2",
        f"{p}4": f"SELECT *, (_h3 * {m}) & {mask} AS _h4 FROM {p}3",
        f"{p}5": (f"SELECT * EXCLUDE (_t, _L, _h1, _h2, _h3, _h4, _h5), CAST(CASE WHEN _h5 >= 2147483648 "
                  f"THEN _h5 - 4294967296 ELSE _h5 END AS INTEGER) AS {out} "
                  f"FROM (SELECT *, xor(_h4, _h4 >> 15) AS _h5 FROM {p}4)"),
    }
