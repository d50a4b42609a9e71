"""Stable hashes: the same on every engine, machine and run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a key are joined by the unit separator, so ("a", "bc") and ("ab", "c") differ.
SEPARATOR = "\x1f"


def stable_key(*parts: Column | str | int) -> Column:
    """First 16 hex digits of SHA-256 over the parts; they order like the 64-bit number they spell."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *[c.cast("string") for c in cols]), 256), 1, 16)


def stable_unit(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the key's first 52 bits."""
    return F.conv(F.substring(stable_key(*parts), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def bucket_seed(base: int, label: Column) -> Column:
    """(base + first 32 bits of SHA-256) mod 2**32."""
    return F.pmod(F.lit(base) + F.conv(F.substring(F.sha2(label, 256), 1, 8), 16, 10).cast("bigint"), F.lit(1 << 32))


def digest(content: Column) -> Column:
    return F.sha2(content, 256)
