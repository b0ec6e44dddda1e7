"""Hash strings: ``slh1-`` and 64 hexadecimal digits of a SHA-256 digest (fixed format)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "slh1-"


def parse_hash(h: Column) -> Column:
    """The digest as binary; null for anything that isn't a hash string. Digits of either case are taken."""
    return F.when(h.rlike(r"^slh1-[0-9a-fA-F]{64}\z"), F.unhex(F.substring(h, 6, 64)))


def format_hash(digest: Column) -> Column:
    return F.concat(F.lit(PREFIX), F.lower(F.hex(digest)))
