"""Stable hashing: A/B groups and reproducible sampling / splitting.

All hashes are MD5 of a '_'-joined text key, so any engine (and any number of
partitions) gives the same answer.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _md5_key(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("_", *[c.cast("string") for c in cols]))


def ab_group(user: Column, salt: str = "default") -> Column:
    """B1: integer value of md5("{user}_{salt}") even -> treatment, odd -> control.

    The parity of the 128-bit integer is the parity of its last hex digit.
    """
    last = F.conv(F.substring(_md5_key(user, salt), 32, 1), 16, 10).cast("int")
    return F.when(last % 2 == 0, F.lit("treatment")).otherwise(F.lit("control"))


def unit_hash(*parts) -> Column:
    """Uniform value in [0, 1) from the first 32 bits of md5 of the key."""
    head = F.conv(F.substring(_md5_key(*parts), 1, 8), 16, 10).cast("bigint")
    return head.cast("double") / F.lit(4294967296.0)
