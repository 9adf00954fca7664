"""Keyed hashing with built-in SQL functions only.

Keys stay on the driver; the padded keys enter the plan as literals, so redact
plans (``spark.sql.redaction.string.regex``) before logging them.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def key_pads(key: bytes) -> tuple[str, str]:
    """Inner and outer padded key of HMAC-SHA256, as hex text."""
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    block = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()


def hmac_hex(value: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a binary column as upper-case hex."""
    inner, outer = (F.unhex(F.lit(p)) for p in key_pads(key))
    digest = F.unhex(F.sha2(F.concat(inner, value), 256))
    return F.upper(F.sha2(F.concat(outer, digest), 256))


def hmac_text(value: Column, key: bytes) -> Column:
    return hmac_hex(F.encode(value, "UTF-8"), key)


def derive_key(master: bytes, key_id: str | None) -> bytes:
    """Key of a named rule; without a name the master key itself."""
    return hmac.new(master, key_id.encode(), hashlib.sha256).digest() if key_id else master


def tenant_key(master: bytes, tenant: str, key_id: str) -> bytes:
    """Per-tenant key (HKDF-SHA256, one block), so pseudonyms do not join across tenants."""
    prk = hmac.new(f"tenant:{tenant}".encode(), master, hashlib.sha256).digest()
    okm = hmac.new(prk, f"mask:{key_id}".encode() + b"\x01", hashlib.sha256).digest()
    return okm.hex().upper().encode()
