"""Hashes on unsigned 64-bit numbers, in Arrow batches: ANSI arithmetic of the JVM would raise where they wrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Multipliers of the 64-bit mixing function.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def edge_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A mixed 64-bit number of an unordered pair of 32-bit nodes."""
    u = np.uint64
    x = (np.minimum(a, b).astype(u) << u(32)) | np.maximum(a, b).astype(u)
    x = (x ^ (x >> u(30))) * MIX[0]
    x = (x ^ (x >> u(27))) * MIX[1]
    return x ^ (x >> u(31))


def perturbed(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights with one in sixteen raised by a geometric number that the pair alone decides; edges are never invented."""
    u = np.uint64
    h = edge_hash(a, b)
    low = ((h >> u(8)) | u(1)) & u(0xFFFFFFFF)
    zeros = 31 - np.floor(np.log2(low.astype(np.float64))).astype(np.int64)
    return weight + np.where((h & u(255)) < u(16), zeros, 0)


@F.pandas_udf(T.LongType())
def perturb(a: pd.Series, b: pd.Series, weight: pd.Series) -> pd.Series:
    return pd.Series(perturbed(a.to_numpy(np.int64), b.to_numpy(np.int64), weight.to_numpy(np.int64)))


def xxh64(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data, seed=0)


def blank_hash(data: bytes) -> int:
    """XXH64 that is 0 for no bytes."""
    return xxh64(data) ^ xxh64(b"")


@F.pandas_udf(T.DecimalType(20, 0))
def xxh64_of(data: pd.Series) -> pd.Series:
    """XXH64 (seed 0) of binary values, as an unsigned number."""
    from decimal import Decimal

    return pd.Series([None if x is None else Decimal(xxh64(bytes(x))) for x in data])


def shuffle_checksum(x, y=None):
    """A checksum that does not depend on order: the sum of the hashes of each row's bytes, modulo 2^64.

    With y given apart, the sum of both hashes as in the older form, which cannot tell swapped labels.
    """
    total = F.sum(xxh64_of(x).cast("decimal(38,0)"))
    if y is not None:
        total = total + F.sum(xxh64_of(y).cast("decimal(38,0)"))
    return F.pmod(total, F.lit(str(1 << 64)).cast("decimal(38,0)")).cast("decimal(20,0)")
