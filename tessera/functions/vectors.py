"""Vector expressions on arrays, accumulated in doubles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit vectors; vectors of no length become zeros."""
    scaled = lambda size: F.transform(v, lambda x: F.when(size > 1e-9, x.cast("double") / size).otherwise(F.lit(0.0)))
    return F.element_at(F.transform(F.array(norm(v)), scaled), 1)  # binds the norm, which would be taken anew for each element


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-9))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()
CHARS = 1 << 18  # characters embedded at once


def _embedded(plain: list[str], dims: int, n: int) -> np.ndarray:
    joined = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    data = np.frombuffer("".join(plain).encode("utf-8", "surrogatepass"), np.uint8)
    widths = 1 + (joined > 0x7F) + (joined > 0x7FF) + (joined > 0xFFFF)
    at = np.concatenate([[0], np.cumsum(widths)])  # where each character's bytes begin
    sizes = np.array([len(x) for x in plain])
    grams = np.where(sizes >= n, sizes - n + 1, 1)
    row = np.repeat(np.arange(len(plain)), grams)
    first = np.repeat(np.cumsum(sizes) - sizes, grams) + np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
    begin, end = at[first], at[np.minimum(first + n, np.repeat(np.cumsum(sizes), grams))]
    crc = np.full(len(row), 0xFFFFFFFF, np.uint32)
    for k in range(int((end - begin).max(initial=0))):
        own = np.flatnonzero(begin + k < end)
        if len(own) == len(row):  # as the first bytes of all grams of n characters are
            crc = CRC[(crc ^ data[begin + k]) & 0xFF] ^ (crc >> np.uint32(8))
        else:
            some = crc[own]
            crc[own] = CRC[(some ^ data[begin[own] + k]) & 0xFF] ^ (some >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    signs = np.where(crc >> np.uint32(20) & 1, 1.0, -1.0)
    sums = np.bincount(row * dims + crc % dims, signs, len(plain) * dims).reshape(-1, dims)
    norms = np.sqrt((sums * sums).sum(1, keepdims=True))
    return sums / np.where(norms > 1e-9, norms, 1.0)


def embedded_all(texts: list[str | None], dims: int = 64, n: int = 3) -> np.ndarray:
    """Signed counts of hashed character n-grams, of unit length, a row for each text."""
    plain = [(text or "").lower() for text in texts]
    out, start, held = [np.zeros((0, dims))], 0, 0
    for i, text in enumerate(plain):
        held += len(text)
        if held >= CHARS or i + 1 == len(plain):
            out.append(_embedded(plain[start : i + 1], dims, n))
            start, held = i + 1, 0
    return np.concatenate(out)


def embedded(text: str | None, dims: int = 64, n: int = 3) -> list[float]:
    return embedded_all([text], dims, n)[0].tolist()


def hashing_embedding(x: Column, dims: int = 64, n: int = 3) -> Column:
    """A deterministic stand-in for an embedding model, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedded_all(texts.tolist(), dims, n)), index=texts.index, dtype="object")

    return run(x)
