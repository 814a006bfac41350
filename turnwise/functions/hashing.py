"""Hashes, fingerprints and back-off on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def fingerprint(*fields: Column) -> Column:
    """SHA-256 over the fields, each behind its length as eight bytes, highest first."""
    part = lambda f: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(f).cast("bigint")), 16, "0")), f.cast("binary"))
    return F.sha2(F.concat(*map(part, fields)), 256)


def backoff(failures: Column, base: float = 30.0, most: float = 120.0) -> Column:
    """Seconds to wait after so many failures in a row."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), F.least(F.lit(6), failures - 1)))
