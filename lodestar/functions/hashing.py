"""Stable pseudonyms and fingerprints from SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.text import stripped

BLOCK = 64


def hmac_pads(salt: bytes) -> tuple[str, str]:
    """The inner and outer HMAC pads of a key, as hex."""
    import hashlib

    key = (hashlib.sha256(salt).digest() if len(salt) > BLOCK else salt).ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_sha256(message: Column, salt: bytes) -> Column:
    """HMAC-SHA256 as hex, composed of ``sha2``. The salt is a parameter: never write one into code."""
    inner, outer = hmac_pads(salt)
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def pseudonym(kind: str, value: Column, salt: bytes, digits: int = 6) -> Column:
    """``[KIND:xxxxxx]`` of the stripped lower-case value: one value has one token everywhere."""
    return F.concat(F.lit(f"[{kind}:"), F.substring(hmac_sha256(F.lower(stripped(value)), salt), 1, digits), F.lit("]"))


def paired_hash(a: Column, b: Column) -> Column:
    return F.sha2(F.concat(a.cast("binary"), F.unhex(F.lit("00")), b.cast("binary")), 256)
