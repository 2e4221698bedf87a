"""Group results handed back to rows without one task per hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def salted(df: DataFrame, id_col: str) -> DataFrame:
    """With a salt (0..63) that follows from the row's id."""
    return df.withColumn("__salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))


def salt_set() -> Column:
    """Aggregate: the salts that occur in a group, as bits of one number."""
    return F.bit_or(F.expr("shiftleft(1L, __salt)")).alias("__salts")


def by_salt(groups: DataFrame) -> DataFrame:
    """One row of each group for each salt it has; joins with salted rows on key and __salt."""
    present = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit("__salts", k) == 1)
    return groups.withColumn("__salt", F.explode(present)).drop("__salts")
