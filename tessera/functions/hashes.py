"""Content hashes and derived ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def stable_id(*parts: Column, length: int = 16, null: str = "") -> Column:
    """The first hexadecimal digits of the SHA-256 of the parts joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit(null)) for p in parts]), 256), 1, length)


def email_id(c: Column) -> Column:
    return F.sha2(F.lower(F.trim(F.coalesce(c, F.lit("")))), 256)


def identity(explicit: Column, *parts: Column) -> Column:
    """The record's own id, or digits of a hash of what makes it up."""
    return F.coalesce(F.nullif(F.trim(explicit), F.lit("")), stable_id(*parts))


def fingerprint(*columns: Column) -> Column:
    """A hash that differs whenever any column differs, null included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
