"""Ids and draws that are equal in every run: hashes in place of seeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def record_id(name: Column, doc: Column, task: Column) -> Column:
    return F.concat(name, F.lit("#"), F.substring(F.sha1(F.concat_ws("|", name, doc.cast("string"), task)), 1, 8))


def _head(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def unit(*parts) -> Column:
    """A number from 0 to 1 from a key."""
    return _head(F.concat_ws("|", *parts)) / F.lit(4294967295)


def pick_variant(doc: Column, task: Column, field: Column, n: int) -> Column:
    """Variant 0..n-1 of a document, task and field."""
    return F.pmod(_head(F.concat_ws("|", doc.cast("string"), task, F.coalesce(field, F.lit("")))), F.lit(n))


def draw(seed: int, *cols) -> Column:
    """A key to order by in place of a shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *cols))
