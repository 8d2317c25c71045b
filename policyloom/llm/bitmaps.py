"""Bitmaps of fixed size over hashed keys: a scan's rows are passed on only if their key may be wanted.

A bitmap has buckets * 32768 bits whatever the input; wrong positives cost work and never results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collect_bitmap(frame: DataFrame, key: str, buckets: int) -> np.ndarray:
    """One bit for each value of a long column (a hash) modulo the size; at most buckets * 4 KB reach the driver."""
    size = buckets * 32768
    bit = F.pmod(F.col(key), F.lit(size)) + 1
    rows = frame.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    bits = np.zeros(size // 8, np.uint8)
    for r in rows:
        bits[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)
    return bits


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each long whether its bit is set."""
    at = keys.astype(np.int64, copy=False) % np.int64(len(bits) * 8)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
