"""Stable identities and hashes, all with built-in functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """UUID of version 5 in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def point_id(channel_id: Column, thread_id: Column) -> Column:
    return uuid5(F.concat(channel_id, F.lit("/"), thread_id))


def content_hash(raw_text: Column) -> Column:
    return F.sha2(raw_text, 256)


def private_doc_id(profile: Column, team: Column, channel: Column, thread: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", profile, team, channel, thread), 256), 1, 40)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC of a string under a key that the driver holds."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256))), 256)


def term_key(key: bytes, kind: Column, value: Column) -> Column:
    """Keyed form of a reference, so that an index can be searched without holding terms."""
    return hmac_sha256(key, F.concat(F.lit("term."), kind, F.lit(":"), F.lower(F.trim(value))))


def channel_key(key: bytes, channel: Column) -> Column:
    return hmac_sha256(key, F.concat(F.lit("channel:"), F.lower(F.trim(channel))))


def seal(payload: Column, key: bytes, row_id: Column) -> Column:
    """AES-GCM with a fresh nonce in front and the row's id as associated data."""
    return F.aes_encrypt(payload, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), row_id)


def unseal(sealed: Column, key: bytes, row_id: Column) -> Column:
    """Null where the key or the id is wrong or the bytes were changed."""
    return F.try_aes_decrypt(sealed, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), row_id).cast("string")
