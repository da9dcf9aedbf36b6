"""Encrypted columns: magic, version, 16-byte salt, 12-byte nonce, ciphertext with tag.

The key is stretched once per data set, not per row; every row gets its own nonce. With bucket keys (another version
byte, and 8 bytes of bucket between salt and nonce) the stretched key is a master key: each bucket of at most
``BUCKET_ROWS`` rows has a key of its own, the HMAC-SHA-256 of its number, made by column functions. So no key
meets more random nonces than that, however many rows a data set has. Both layouts open alike.
"""

import hashlib
import os

import pandas as pd
from pyspark.sql import functions as F

MAGIC = b"TKPR"
VERSION = 1
#: Layout with bucket keys; 2 is not in use.
BUCKET_VERSION = 3
BUCKET_SIZE = 8
#: Far below the 2^32 random nonces that one key of this mode may see.
BUCKET_ROWS = 1 << 24
SALT_SIZE = 16
NONCE_SIZE = 12
TAG_SIZE = 16
HEADER_SIZE = len(MAGIC) + 1 + SALT_SIZE + NONCE_SIZE
# Cost of the key stretching.
SCRYPT = {"n": 2**17, "r": 8, "p": 1, "dklen": 32, "maxmem": 256 << 20}
SALTS_AT_ONCE = 256


def derive_key(passphrase, salt):
    return hashlib.scrypt(passphrase.encode("utf-8"), salt=salt, **SCRYPT)


def encrypt(df, column, passphrase, magic=MAGIC):
    """The table with one binary column encrypted under a fresh salt."""
    salt = os.urandom(SALT_SIZE)
    key = derive_key(passphrase, salt)
    sealed = F.aes_encrypt(F.col(column), F.lit(key), F.lit("GCM"))
    header = magic + bytes([VERSION]) + salt
    return df.withColumn(column, F.concat(F.lit(header), sealed))


def _pads(key):
    """The two padded keys of HMAC-SHA-256."""
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def bucket_key(inner, outer, bucket):
    """HMAC-SHA-256 of ``bucket`` under the key of these pads, as a column."""
    return F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, bucket), 256))), 256))


def encrypt_in_buckets(df, column, passphrase, magic=MAGIC):
    """The same with bucket keys. A bucket is a stretch of ``BUCKET_ROWS`` rows of one partition."""
    salt = os.urandom(SALT_SIZE)
    inner, outer = _pads(derive_key(passphrase, salt))
    number = F.shiftright(F.col("_row"), BUCKET_ROWS.bit_length() - 1)
    bucket = F.unhex(F.lpad(F.hex(number), 2 * BUCKET_SIZE, "0"))
    key = bucket_key(F.lit(inner), F.lit(outer), bucket)
    header = magic + bytes([BUCKET_VERSION]) + salt
    sealed = F.concat(F.lit(header), bucket, F.aes_encrypt(F.col(column), key, F.lit("GCM")))
    return df.withColumn("_row", F.monotonically_increasing_id()).withColumn(column, sealed).drop("_row")


def is_encrypted(data, magic=MAGIC):
    long_enough = F.octet_length(data) >= HEADER_SIZE
    return F.coalesce(long_enough & (F.substring(data, 1, len(magic)) == F.lit(magic)), F.lit(False))


def _salt(data):
    return F.substring(data, len(MAGIC) + 2, SALT_SIZE)


def _version(data):
    return F.substring(data, len(MAGIC) + 1, 1)


def _refusal(data, magic):
    of = lambda version: _version(data) == F.lit(bytes([version]))
    return (
        F.when(F.octet_length(data) < HEADER_SIZE + TAG_SIZE, "too small or corrupt")
        .when(F.substring(data, 1, len(magic)) != F.lit(magic), "bad magic")
        .when(~of(VERSION) & ~of(BUCKET_VERSION), "unsupported version")
        .when(of(BUCKET_VERSION) & (F.octet_length(data) < HEADER_SIZE + BUCKET_SIZE + TAG_SIZE), "too small or corrupt")
    )


def _stretch(passphrase):
    def keys(batches):
        for batch in batches:
            found = [derive_key(passphrase, bytes(s)) for s in batch["_salt"]]
            inner, outer = zip(*map(_pads, found)) if found else ([], [])
            yield pd.DataFrame({"_salt": batch["_salt"], "_key": found, "_inner": inner, "_outer": outer})

    return keys


def _with_keys(df, salt, passphrase):
    """Add ``_key`` and its pads. Data sets rarely mix salts; with very many the keys are made on the cluster."""
    salted = df.withColumn("_salt", salt)
    salts = salted.filter(F.col("_salt").isNotNull()).select("_salt").distinct()
    some = [bytes(r[0]) for r in salts.limit(SALTS_AT_ONCE + 1).collect()]
    if len(some) > SALTS_AT_ONCE:
        keys = salts.mapInPandas(_stretch(passphrase), "_salt binary, _key binary, _inner binary, _outer binary")
        return salted.join(keys, "_salt", "left")
    found = [(value, derive_key(passphrase, value)) for value in some]
    found = [(value, key, *_pads(key)) for value, key in found]

    def pick(n):
        out = F.lit(None).cast("binary")
        for row in found:
            out = F.when(F.col("_salt") == F.lit(row[0]), F.lit(row[n])).otherwise(out)
        return out

    return salted.withColumns({"_key": pick(1), "_inner": pick(2), "_outer": pick(3)})


def decrypt(df, column, passphrase, magic=MAGIC):
    """The table with the column decrypted; ``reason`` says why a value could not be."""
    data = F.col(column)
    refusal = _refusal(data, magic)
    checked = df.withColumn("reason", refusal)
    keyed = _with_keys(
        checked, F.when(F.col("reason").isNull() & data.isNotNull(), _salt(data)), passphrase
    )
    start = HEADER_SIZE - NONCE_SIZE + 1
    by_bucket = _version(data) == F.lit(bytes([BUCKET_VERSION]))
    bucket = F.substring(data, start, BUCKET_SIZE)
    key = F.when(by_bucket, bucket_key(F.col("_inner"), F.col("_outer"), bucket)).otherwise(F.col("_key"))
    body = F.when(by_bucket, F.substring(data, start + BUCKET_SIZE, 2**31 - 1)).otherwise(
        F.substring(data, start, 2**31 - 1))
    opened = F.when(F.col("_key").isNotNull(), F.try_aes_decrypt(body, key, F.lit("GCM")))
    wrong = F.col("_key").isNotNull() & F.col("_plain").isNull()
    return (
        keyed.withColumn("_plain", opened)
        .withColumn("reason", F.when(wrong, "wrong passphrase or corrupt").otherwise(F.col("reason")))
        .withColumn(column, F.col("_plain"))
        .select(*df.columns, "reason")
    )
