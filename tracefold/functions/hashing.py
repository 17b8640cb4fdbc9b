"""Hash column builders (FN1-FN4).

All but BLAKE2b run as native SQL expressions inside whole-stage codegen.
HMAC-SHA-256 is composed from ``sha2`` over binary concatenations: the key is
padded and XOR-ed with the inner/outer pads on the driver (it is a short
config value), and only the two pad literals reach the plan.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLOCK = 64  # SHA-256 block size in bytes


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sha256_hex(text: Column | str) -> Column:
    """FN1: lower-case hex SHA-256 of the UTF-8 text."""
    return F.sha2(_as_col(text).cast("string"), 256)


def hmac_pads(key: bytes | str) -> tuple[str, str]:
    """Inner and outer pad of an HMAC-SHA-256 key, as hex strings."""
    if isinstance(key, str):
        key = key.encode("utf-8")
    if not key:
        raise ValueError("HMAC key must be non-empty")
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    ipad = bytes(b ^ 0x36 for b in key).hex()
    opad = bytes(b ^ 0x5C for b in key).hex()
    return ipad, opad


def hmac_sha256_hex(msg: Column | str, key: bytes | str) -> Column:
    """FN2: hex HMAC-SHA-256 of the UTF-8 message under a fixed key."""
    ipad, opad = hmac_pads(key)
    return hmac_sha256_hex_pads(msg, F.lit(ipad), F.lit(opad))


def hmac_sha256_hex_pads(msg: Column | str, ipad_hex: Column, opad_hex: Column) -> Column:
    """HMAC-SHA-256 with per-row pads (hex columns), e.g. a key per tenant."""
    body = F.encode(_as_col(msg).cast("string"), "UTF-8")
    inner = F.sha2(F.concat(F.unhex(ipad_hex), body), 256)
    return F.sha2(F.concat(F.unhex(opad_hex), F.unhex(inner)), 256)


def tenant_keys_frame(spark, keys: dict[str, bytes | str], tenant_col: str = "tenant_id"):
    """Small key table ``(tenant_id, ipad_hex, opad_hex)`` for FN3 joins.

    One row per configured tenant; its size is the key config, not the data.
    """
    rows = [(t, *hmac_pads(k)) for t, k in sorted(keys.items())]
    schema = T.StructType([
        T.StructField(tenant_col, T.StringType(), False),
        T.StructField("ipad_hex", T.StringType(), False),
        T.StructField("opad_hex", T.StringType(), False),
    ])
    return spark.createDataFrame(rows, schema)


def rekey_by_tenant(df, hash_col: str, keys: dict[str, bytes | str], out_col: str,
                    tenant_col: str = "tenant_id"):
    """FN3: tenant-keyed HMAC over a stored SHA-256 column.

    Equal hashes stay equal within one tenant and differ across tenants. Rows
    whose tenant has no key get a null. The key table has one row per
    configured tenant; Spark broadcasts it while it is small and shuffles
    both sides beyond that.
    """
    kt = tenant_keys_frame(df.sparkSession, keys, tenant_col)
    joined = df.join(kt, on=tenant_col, how="left")
    return joined.withColumn(
        out_col,
        F.when(F.col("ipad_hex").isNotNull(),
               hmac_sha256_hex_pads(F.col(hash_col), F.col("ipad_hex"), F.col("opad_hex"))),
    ).drop("ipad_hex", "opad_hex")


def hmac_prefix_u64_hex(msg: Column | str, key: bytes | str) -> Column:
    """First 8 bytes of the HMAC as 16 lower-case hex digits.

    Big-endian uint64 order equals lexicographic order of this string, so a
    threshold test needs no unsigned arithmetic.
    """
    return F.substring(hmac_sha256_hex(msg, key), 1, 16)


def rate_threshold_hex(rate: float) -> str:
    """uint64 threshold ``uint64(rate * 2**63) * 2`` as 16 hex digits."""
    if not 0.0 < rate < 1.0:
        raise ValueError("rates outside (0, 1) short-circuit before hashing")
    t = (int(rate * float(1 << 63)) * 2) % (1 << 64)
    return f"{t:016x}"


@F.pandas_udf(T.StringType())
def blake2b_128_hex(text: pd.Series) -> pd.Series:
    """FN4: BLAKE2b with a 16-byte digest, hex. No native Spark equivalent."""
    return text.map(
        lambda s: None if s is None else hashlib.blake2b(s.encode("utf-8"), digest_size=16).hexdigest()
    )
