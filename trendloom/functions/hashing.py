"""Repeatable hash of keys: the first 60 bits of a digest over key and seed, so the same rows are drawn everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 15
MODULUS = 16**DIGITS


def draw(key: str | Column, seed: int = 0) -> Column:
    """Hash of a key in [0, MODULUS); null for null. Seeds give independent hashes."""
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(k.cast("string"), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")


def draw_sql(key: str, seed: int = 0) -> str:
    """The same hash as SQL text for the twin of a query."""
    return f"('0x' || substr(md5(({key})::varchar || ':{seed}'), 1, {DIGITS}))::bigint"
