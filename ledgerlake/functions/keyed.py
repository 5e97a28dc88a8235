"""Field keys, keyed tokens and authenticated encryption of columns.

A field's key is SHA-256 of the parent key, "field:" and the name. Ciphertext is the 12-byte nonce, the
encrypted bytes and the 16-byte tag.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.errors import KeyRequired


def field_key(parent: bytes, name: str) -> bytes:
    return hashlib.sha256(parent + b"field:" + name.encode()).digest()


def token(c: Column, key: bytes) -> Column:
    """Lower-case hex SHA-256 of the key and the value."""
    return F.sha2(F.concat(F.lit(key), F.encode(c.cast("string"), "utf-8")), 256)


def encrypt(c: Column, key: bytes | None, nonce: Column | None = None) -> Column:
    """AES-GCM; nonce gives 12 bytes where equal results are wanted."""
    if not key:
        raise KeyRequired("a field key is needed to encrypt")
    value = F.encode(c.cast("string"), "utf-8")
    args = [value, F.lit(key), F.lit("GCM"), F.lit("DEFAULT")]
    return F.aes_encrypt(*args, nonce) if nonce is not None else F.aes_encrypt(*args)


def decrypt(c: Column, key: bytes | None) -> Column:
    if not key:
        raise KeyRequired("a field key is needed to decrypt")
    return F.aes_decrypt(c, F.lit(key), F.lit("GCM")).cast("string")


def position_nonce(position: Column) -> Column:
    """The position's eight bytes, lowest first, and four zeros."""
    digits = F.lpad(F.hex(position.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)], F.lit("00000000")))


def reversible(c: Column, key: bytes) -> Column:
    """A token to join by and a ciphertext to reveal by."""
    return F.struct(token(c, key).alias("token"), encrypt(c, key).alias("ciphertext"))


def tenant_pseudonym(c: Column, key: bytes, tenant: str) -> Column:
    """tok_ and 16 hex digits: equal within a tenant, different between tenants."""
    return F.concat(F.lit("tok_"), F.left(token(c, field_key(key, tenant)), F.lit(16)))
