"""Voter identity as column expressions: signed cookies, address hashes, client addresses."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pads(secret: bytes) -> tuple[Column, Column]:
    """Inner and outer block of HMAC-SHA256, as literals; long secrets are hashed first."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    return F.lit(bytes(b ^ 0x36 for b in key)), F.lit(bytes(b ^ 0x5C for b in key))


def hash_ip(ip: Column) -> Column:
    return F.sha2(ip, 256)


def hmac_hex(secret: bytes, message: Column) -> Column:
    """HMAC-SHA256 in lower-case hex, of built-in functions only."""
    inner, outer = _pads(secret)
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def signature(secret: bytes, poll: Column, raw: Column) -> Column:
    return hmac_hex(secret, F.concat(F.encode(poll, "UTF-8"), F.lit(b"\0"), F.encode(raw, "UTF-8")))


def sign(secret: bytes, poll: Column, raw: Column) -> Column:
    """Cookie ``raw.mac``."""
    return F.concat_ws(".", raw, signature(secret, poll, raw))


def issue(secret: bytes, poll: Column) -> Column:
    """A fresh cookie; not deterministic, so write it out before using it twice."""
    raw = F.uuid()
    return sign(secret, poll, raw)


def verify(secret: bytes, poll: Column, cookie: Column) -> Column:
    """Raw id of a cookie whose signature holds for ``poll``, else null.

    The last dot splits; both sides must be there, the right one 64 hex digits of either case.
    """
    mac = F.substring_index(cookie, ".", -1)
    raw = F.substring(cookie, F.lit(1), F.length(cookie) - F.length(mac) - 1)
    fits = (F.instr(cookie, ".") > 0) & (raw != "") & mac.rlike("^[0-9a-fA-F]{64}$")
    return F.when(fits & (F.lower(mac) == signature(secret, poll, raw)), raw)


def client_ip(forwarded: Column, real_ip: Column, remote: Column) -> Column:
    """First of X-Forwarded-For, else X-Real-IP, else the host of ``host:port``, else that text itself."""
    bracketed = F.regexp_extract(remote, r"^\[([^\[\]]*)\]:[^:]*$", 1)
    plain = F.regexp_extract(remote, r"^([^:\[\]]*):[^:\[\]]*$", 1)
    host = F.when(remote.rlike(r"^\[[^\[\]]*\]:[^:]*$"), bracketed).when(remote.rlike(r"^[^:\[\]]*:[^:\[\]]*$"), plain).otherwise(remote)
    return F.when(forwarded != "", F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))).when(real_ip != "", F.trim(real_ip)).otherwise(host)


def fingerprint(secret: bytes, poll: Column, cookie: Column, ip: Column) -> Column:
    """Raw id of a valid cookie, else the hash of the address (the user agent plays no part)."""
    return F.coalesce(verify(secret, poll, cookie), hash_ip(ip))


def has_cookie(cookie: Column) -> Column:
    """Any cookie, valid or not, keeps a new one from being issued."""
    return F.coalesce(cookie != "", F.lit(False))
