"""NULL, rounding and ratio rules that differ from Spark's defaults."""

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    """A column from a name or a column."""
    return F.col(c) if isinstance(c, str) else c


def is_in(c: str | Column, values: Iterable) -> Column:
    """Set membership where a missing value is simply not a member."""
    return F.coalesce(col(c).isin(list(values)), F.lit(False))


def is_true(cond: Column) -> Column:
    """A condition where unknown counts as false."""
    return F.coalesce(cond, F.lit(False))


def sum_or_zero(c: str | Column) -> Column:
    """Sum in which nothing to add gives zero."""
    return F.coalesce(F.sum(col(c)), F.lit(0))


def strict(agg: Column, *inputs: Column) -> Column:
    """NULL as soon as one input value of the group is NULL, else `agg`."""
    missing = [F.count_if(col(i).isNull()) for i in inputs]
    any_missing = missing[0]
    for m in missing[1:]:
        any_missing = any_missing + m
    return F.when(any_missing == 0, agg)


def ratio(num: Column, den: Column) -> Column:
    """num / den as doubles: x/0 is Infinity and 0/0 is NULL."""
    num, den = num.cast("double"), den.cast("double")
    return F.when(den != 0, num / den).when(num > 0, F.lit(float("inf"))).when(num < 0, F.lit(float("-inf")))


def share(num: Column, den: Column) -> Column:
    """num / den, NULL when the denominator is zero or missing."""
    return F.when(den != 0, num.cast("double") / den)


def half_even(c: str | Column, digits: int) -> Column:
    """Round half to even."""
    return F.bround(col(c), digits)


def first_match(c: str | Column, pattern: str) -> Column:
    """Leftmost match of a pattern, NULL when there is none."""
    return F.regexp_substr(col(c), F.lit(pattern))


def signif(c: str | Column, digits: int) -> Column:
    """Round to significant digits, half to even."""
    c = col(c)
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.rint(c * scale) / scale)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on `keys` where NULL matches NULL. For full joins the keys are coalesced."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__right_{k}"))
    joined = left.join(renamed, cond, how)
    if how in ("full", "outer", "full_outer", "right", "right_outer"):
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(f"__right_{k}")) for k in keys})
    return joined.drop(*[f"__right_{k}" for k in keys])


def join_group_facts(df: DataFrame, facts: DataFrame, keys: Sequence[str], spread: str, how: str = "left", salts: int = 16) -> DataFrame:
    """Null-safe join of `facts`, one row per group, to rows whose groups may be few and large.

    The facts are repeated once per salt and the rows take a salt from column `spread`, so a
    group of a third of all rows is dealt over `salts` tasks. (Spark broadcasts the facts
    instead where it knows that they are small.)
    """
    repeated = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = df.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return join_null_safe(rows, repeated, [*keys, "__salt"], how).drop("__salt")
