"""Joins and columns that the operators share."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32


def salt(column: str | Column, salts: int) -> Column:
    """A number below `salts` that follows from a row's own value, so that a retried task gives the same."""
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, spread: str, salts: int = SALTS) -> DataFrame:
    """Left join of `rows` to `table`, one row per key, with the rows of a hot key dealt over `salts` tasks.

    The rows get a salt from column `spread`; the table is repeated once per salt. The table
    should hold only the keys that occur more than once.
    """
    repeated = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", salt(spread, salts)).join(repeated, [key, "__salt"], "left").drop("__salt")
