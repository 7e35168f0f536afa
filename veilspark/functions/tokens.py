"""Token expressions: keyed HMAC-SHA256 tokens and seeded mock tokens, both pure column work."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN_PREFIX = "tok_"
MOCK_PREFIX = "TOKEN_"
_BLOCK = 64


def padded_key(secret: bytes) -> tuple[bytes, bytes]:
    """The inner and outer key blocks of RFC 2104."""
    if len(secret) > _BLOCK:
        secret = hashlib.sha256(secret).digest()
    block = secret.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


class TokenKey:
    """The key as a one-row DataFrame `(ipad binary, opad binary)`.

    Expressions read it through scalar subqueries, so the key is never a literal in a plan, and the
    padded blocks are stored ready-made, so no XOR is needed per cell.
    """

    def __init__(self, frame: DataFrame) -> None:
        self.inner: Column = frame.select("ipad").scalar()
        self.outer: Column = frame.select("opad").scalar()

    @classmethod
    def from_secret(cls, spark: SparkSession, secret: bytes) -> TokenKey:
        if not secret:
            raise ValueError("an empty key gives guessable tokens")
        ipad, opad = padded_key(secret)
        row = (bytearray(ipad), bytearray(opad))
        return cls(spark.createDataFrame([row], "ipad binary, opad binary"))


def hmac_token(key: TokenKey, message: Column) -> Column:
    """`tok_` and the hex HMAC-SHA256 of `message`; NULL for NULL."""
    inner = F.unhex(F.sha2(F.concat(key.inner, message.cast("binary")), 256))
    return F.concat(F.lit(TOKEN_PREFIX), F.sha2(F.concat(key.outer, inner), 256))


def value_token(key: TokenKey, column: str | Column, value: Column) -> Column:
    """The token of a value. The column name is part of the message, so equal values in two columns
    get unrelated tokens."""
    if isinstance(column, str):
        return hmac_token(key, F.concat(F.lit(f"{column}|"), value))
    return hmac_token(key, F.concat(column, F.lit("|"), value))


def mock_token(value: Column, key: Column, seed: int = 0) -> Column:
    """A stand-in token for demos. Seeded by row key, so a retried task gives the same token."""
    salted = F.concat(value, F.lit("|"), key.cast("string"), F.lit(f"|{seed}"))
    return F.concat(F.lit(MOCK_PREFIX), F.substring(F.md5(salted), 1, 16))
