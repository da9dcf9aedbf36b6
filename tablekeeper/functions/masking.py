"""Deterministic masking as Spark columns."""

import hashlib

from pyspark.sql import functions as F

# The names a masked person may get, picked by position.
FIRST_NAMES = [
    "Alex", "Sam", "Jordan", "Taylor", "Morgan", "Casey", "Riley", "Jamie",
    "Avery", "Quinn", "Robin", "Drew", "Skyler", "Reese", "Cameron", "Devon",
]
LAST_NAMES = [
    "Carter", "Reed", "Shaw", "Lane", "Hayes", "Blair", "Frost", "Wells",
    "Nolan", "Pierce", "Vance", "Cross", "Hale", "Knox", "Page", "Sloan",
]
REDACTED = "***"


def salt_key(salt):
    """Masking key of a salt (text or bytes)."""
    return hashlib.sha256(salt.encode() if isinstance(salt, str) else salt).digest()


def hmac_pads(key):
    """Inner and outer HMAC blocks of a key."""
    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def digest(value, key):
    """HMAC-SHA256 of the text of ``value`` in hex, NULL for NULL."""
    inner, outer = hmac_pads(key)
    first = F.sha2(F.concat(F.lit(inner), F.encode(value.cast("string"), "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def _number(hex_text, start, length):
    return F.conv(F.substring(hex_text, start, length), 16, 10)


def _pick(words, hex_text, start):
    # get() and not element_at(), which gives the last word for a NULL place in Spark 4.1
    place = _number(hex_text, start, 4).cast("int") % len(words)
    return F.get(F.array(*[F.lit(w) for w in words]), place)


def as_hash(value, key, constant=None):
    return F.substring(digest(value, key), 1, 32)


def as_email(value, key, constant=None):
    return F.concat(F.lit("user"), _number(digest(value, key), 1, 8), F.lit("@example.com"))


def as_name(value, key, constant=None):
    h = digest(value, key)
    return F.concat(_pick(FIRST_NAMES, h, 1), F.lit(" "), _pick(LAST_NAMES, h, 5))


def as_phone(value, key, constant=None):
    # lpad also cuts longer numbers to ten digits
    return F.concat(F.lit("+1"), F.lpad(_number(digest(value, key), 1, 12), 10, "0"))


def as_redacted(value, key, constant=None):
    return F.when(value.isNotNull(), F.lit(REDACTED if constant is None else constant))


def as_constant(value, key, constant=None):
    return F.when(value.isNotNull(), F.lit(constant).cast("string"))


def as_null(value, key, constant=None):
    # a branch never taken keeps the column's type
    return F.when(F.lit(False), value)


STRATEGIES = {
    "redact": as_redacted,
    "null": as_null,
    "constant": as_constant,
    "email": as_email,
    "name": as_name,
    "phone": as_phone,
    "hash": as_hash,
}
