"""Vectors: cosine, truncation, and their short encodings."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 256


def cosine(vec: Column, query: list[float]) -> Column:
    """Cosine with a fixed query, in double precision, over the query's dimensions. 0 if either norm is 0 or the vector is shorter; null for null."""
    q = np.asarray(query, dtype=np.float64)
    norm = float(np.sqrt(q @ q))

    @F.pandas_udf("double")
    def of(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), np.nan)
        whole = [i for i, v in enumerate(vectors) if v is not None]
        long = [i for i in whole if len(vectors.iloc[i]) >= len(q)]
        out[whole] = 0.0
        if long and norm:
            m = np.stack([np.asarray(vectors.iloc[i][: len(q)], dtype=np.float64) for i in long])
            norms = np.sqrt(np.einsum("ij,ij->i", m, m))
            out[long] = np.divide(m @ q, norms * norm, out=np.zeros(len(long)), where=norms > 0)
        return pd.Series(out).where(~pd.Series(out).isna(), None)

    return of(vec)


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def matryoshka(vec: Column, dim: int = DIM) -> Column:
    """The first dimensions, normalized; a zero vector stays."""
    head = F.transform(F.slice(vec, 1, dim), lambda x: x.cast("double"))
    n = norm(head)
    return F.when(n > 0, F.transform(head, lambda x: x / n)).otherwise(head)


def int8(vec: Column) -> Column:
    """Each number as floor(127 x + 1/2), within -127 and 127."""
    return F.transform(vec, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x.cast("double") * 127 + 0.5))).cast("tinyint"))


def sign_bits(vec: Column) -> Column:
    """Signs as text of 0 and 1, 1 for numbers that aren't negative."""
    return F.array_join(F.transform(vec, lambda x: F.when(x >= 0, "1").otherwise("0")), "")


def pack_int8(values: list[float]) -> str:
    q = np.clip(np.floor(np.clip(np.asarray(values, float), -1, 1) * 127 + 0.5), -127, 127).astype(np.int8)
    return base64.b64encode(q.tobytes()).decode()


def unpack_int8(packed: str | None) -> list[float] | None:
    try:
        return (np.frombuffer(base64.b64decode(packed or "?", validate=True), np.int8) / 127).tolist()
    except ValueError:
        return None


def pack_bits(values: list[float]) -> str:
    return base64.b64encode(np.packbits(np.asarray(values, float) >= 0).tobytes()).decode()


def unpack_bits(packed: str | None, dim: int | None = None) -> list[float] | None:
    try:
        bits = np.unpackbits(np.frombuffer(base64.b64decode(packed or "?", validate=True), np.uint8))
    except ValueError:
        return None
    return (bits[: dim or len(bits)].astype(float) * 2 - 1).tolist()


def is_json(vec: Column) -> Column:
    """Whether a vector is stored as JSON text."""
    return F.coalesce(F.startswith(vec, F.lit("[")), F.lit(False))


def base64_of(digits: Column) -> Column:
    """Base64 of bytes in hexadecimal, in one line."""
    return F.replace(F.base64(F.unhex(digits)), F.lit("\r\n"), F.lit(""))


def packed_int8(vec: Column) -> Column:
    """pack_int8() of a column: base64 of int8, from numbers cut at -1 and 1."""
    byte = lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(255))), 2, "0")
    return base64_of(F.array_join(F.transform(int8(vec), byte), ""))


def unpacked_int8(packed: Column) -> Column:
    """unpack_int8() of a column; null for what isn't base64."""
    digits = F.hex(F.try_to_binary(packed, F.lit("BASE64")))
    byte = lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    signed = lambda x: F.when(x > 127, x - 256).otherwise(x) / 127
    return F.when(F.length(digits) > 0, F.transform(F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1), lambda i: signed(byte(i))))


def packed_bits(vec: Column) -> Column:
    """pack_bits() of a column: base64 of the signs, the first bit on top, filled up with zeros."""
    bits = sign_bits(vec)
    byte = lambda i: F.lpad(F.conv(F.rpad(F.substring(bits, 8 * i + 1, F.lit(8)), 8, "0"), 2, 16), 2, "0")
    return F.when(F.size(vec) == 0, "").otherwise(base64_of(F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(F.size(vec) / 8).cast("int") - 1), byte), "")))


def unpacked_bits(packed: Column, dim: int | None = None) -> Column:
    """unpack_bits() of a column: 1 and -1; null for what isn't base64."""
    digits = F.hex(F.try_to_binary(packed, F.lit("BASE64")))
    n = F.least(F.length(digits) * 4, F.lit(dim)) if dim else F.length(digits) * 4
    nibble = F.array_join(F.transform(F.split(digits, ""), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0")), "")
    return F.when(F.length(digits) > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.when(F.substring(nibble, i, F.lit(1)) == "1", 1.0).otherwise(-1.0)))


def decode(column: Column) -> Column:
    """A vector stored either as JSON text or as base64 of int8."""
    return F.when(is_json(column), F.from_json(column, "array<double>")).otherwise(unpacked_int8(column))
