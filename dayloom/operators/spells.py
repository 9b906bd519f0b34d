"""Changes, spells and marked slots along a diary.

The windows are per diary. A diary has one row per slot, so a partition holds at most the slots
of a day; all operators share the partitioning by diary and add no exchange between them.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The measures whose change starts a new spell (location does not).
SPELL_MEASURES = ("pri", "sec", "enj", "dev", "whoa", "whob", "whoc", "whod")


def changed(c: str | Column, id: str = "diaryid", slot: str = "slot") -> Column:
    """The value differs from the slot before; a missing value is a value; the first slot is a change."""
    c = F.col(c) if isinstance(c, str) else c
    w = Window.partitionBy(id).orderBy(slot)
    return (F.row_number().over(w) == 1) | ~c.eqNullSafe(F.lag(c).over(w))


def change_flags(df: DataFrame, cols: Sequence[str], id: str = "diaryid", slot: str = "slot") -> DataFrame:
    """Replace each column by its change flag."""
    return df.withColumns({c: changed(c, id, slot) for c in cols})


def spells(
    df: DataFrame,
    cols: Sequence[str] = SPELL_MEASURES,
    activity: str = "pri",
    id: str = "diaryid",
    slot: str = "slot",
) -> DataFrame:
    """Runs of slots without any change: (id, period, begin, end, length, activity)."""
    w = Window.partitionBy(id).orderBy(slot)
    # One comparison of the whole tuple with the slot before.
    state = F.struct(*cols)
    start = F.lag(state).over(w)
    any_change = (start.isNull() | ~state.eqNullSafe(start)).cast("int")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = df.select(id, slot, F.col(activity).alias("__a"), any_change.alias("__new")).withColumn(
        "period", F.sum("__new").over(running)
    )
    return (
        numbered.groupBy(id, "period")
        .agg(F.min(slot).alias("begin"), F.max(slot).alias("end"), F.max("__a").alias(activity))
        .withColumn("length", F.col("end") - F.col("begin") + 1)
    )


def spell_stats(spell_table: DataFrame, id: str = "diaryid") -> DataFrame:
    """Spells per diary and the standard deviation of their length."""
    return spell_table.groupBy(id).agg(
        F.count(F.lit(1)).alias("n_spells"), F.stddev_samp("length").alias("sd_length")
    )


def first_last_slot(
    df: DataFrame,
    test: Column,
    first: str = "first_slot",
    last: str = "last_slot",
    id: str = "diaryid",
    slot: str = "slot",
) -> DataFrame:
    """First and last slot of a diary that pass a test; NULL if none does."""
    hit = F.when(test, F.col(slot))
    return df.groupBy(id).agg(F.min(hit).alias(first), F.max(hit).alias(last))


def drop_groups_with_null(df: DataFrame, c: str, id: str = "diaryid") -> DataFrame:
    """Discard all rows of a diary in which one value is unknown."""
    unknown = F.max(F.col(c).isNull()).over(Window.partitionBy(id))
    return df.withColumn("__unknown", unknown).filter(~F.col("__unknown")).drop("__unknown")


def slots_after(
    df: DataFrame, anchors: DataFrame, anchor: str, n: int = 12, id: str = "diaryid", slot: str = "slot"
) -> DataFrame:
    """Slots from a diary's anchor to n slots later, both ends included (an equi-join on the diary)."""
    marked = anchors.filter(F.col(anchor).isNotNull()).select(id, anchor)
    return df.join(marked, id).filter(F.col(slot).between(F.col(anchor), F.col(anchor) + n))


def wake_and_sleep_aggs(status: Column, slot: str = "slot") -> dict[str, Column]:
    """First and last slot not asleep and half-asleep slots, as aggregates of a diary.

    All three are missing if the status of one slot is unknown, so the diary need not be
    filtered in a pass of its own.
    """
    known = F.count_if(status.isNull()) == 0
    awake = F.when(status != "Sleeping", F.col(slot))
    return {
        "wakeup_time": F.when(known, F.min(awake)),
        "sleeping_time": F.when(known, F.max(awake)),
        "half_sleep_time": F.when(known, F.count_if(status == "Half-Sleeping")),
    }
