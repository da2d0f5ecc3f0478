"""The keyed draws of surrogates: HMAC-SHA256 of "key|block", 4 bytes each, big-endian, in plain Python and as Catalyst expressions."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.operators.patterns import verhoeff_ok  # noqa: F401  (part of this module's surface)


def word(seed: str, key: str, k: int) -> int:
    """The k-th 32-bit draw of a key's stream."""
    block = hmac.new(seed.encode(), f"{key}|{k // 8}".encode(), hashlib.sha256).digest()
    return int.from_bytes(block[4 * (k % 8) : 4 * (k % 8) + 4], "big")


def pads(seed: str) -> tuple[str, str]:
    """Hexadecimal inner and outer pad of a seed."""
    key = seed.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_hex(seed: str, message: Column) -> Column:
    inner, outer = pads(seed)
    digest = F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(message, "utf-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(digest)), 256)


def draw(seed: str, key: Column, k: int) -> Column:
    block = hmac_hex(seed, F.concat(key, F.lit(f"|{k // 8}")))
    return F.conv(F.substring(block, 1 + 8 * (k % 8), 8), 16, 10).cast("bigint")


def digits(seed: str, key: Column, n: int) -> Column:
    """n decimal digits: the first n draws, each modulo 10."""
    return F.concat(*((draw(seed, key, k) % 10).cast("string") for k in range(n)))
