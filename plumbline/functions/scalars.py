"""Column functions that Spark lacks: vector measures, Hamming distance, HMAC, canonical JSON, rounding."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y))


def cosine(a: Column, b: Column) -> Column:
    """Where a norm is zero: 1 if the vectors are alike, else 0."""
    alike = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= 1e-8 + 1e-5 * F.abs(y)), lambda x: x)
    return F.when((norm(a) == 0) | (norm(b) == 0), alike.cast("double")).otherwise(dot(a, b) / (norm(a) * norm(b)))


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two hashes of up to 16 hex digits, by halves of 32 bits."""

    def half(h, k):
        return F.conv(F.substring(F.lpad(h, 16, "0"), 1 + 8 * k, 8), 16, 10).cast("long")

    return sum((F.bit_count(half(a, k).bitwiseXOR(half(b, k))) for k in range(2)), F.lit(0))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a string column as hex, from two plain digests."""
    import hashlib

    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    pad = lambda x: F.lit(bytearray(b ^ x for b in key.ljust(64, b"\0")))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def sha256_of_base64(text: Column) -> Column:
    """Hash of the bytes that a base64 text stands for; null where it is none."""
    return F.sha2(F.try_to_binary(text, F.lit("base64")), 256)


def canonical_json(value) -> str:
    """Sorted keys, no spaces, ASCII, floats by their shortest representation."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def py_round(x: Column, digits: int) -> Column:
    """Half-even rounding of the binary value, as detectors round severities before fusion. An Arrow UDF on a few rows."""
    import pandas as pd

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None or v != v else round(float(v), digits))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(x)


def scaled_round(x: Column, digits: int) -> Column:
    """Rounding of the scaled binary value, half away from zero, as the SQL beside the queries does it. F.round goes by the shortest decimal
    instead; the two differ on products that lie next to a half."""
    return F.round(x * 10.0**digits, 0) / 10.0**digits
