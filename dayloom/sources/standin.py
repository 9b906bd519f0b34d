"""Diaries made from an event stream and a customer table.

One user is one diary; the 30 days of the stream are cut into 144 slots of five hours. The
latest event of a slot gives the primary activity, which lasts until the next event; another
activity in the same slot is the secondary one. The result has the shape of coded survey data:
integer codes per slot plus a codebook, and raw answers per respondent.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.sources.keys import ACTIVITY_KEY, small_table

SLOTS = 144
SLOT_SECONDS = 18000
START = "2024-01-01 00:00:00"

# Event type -> activity label for k % 3 = 0, 1, 2.
EVENT_ACTIVITIES = {
    "view": ("Watching tv,video,dvd,music", "Reading including e-books", "Going out to eat, drink"),
    "click": ("Paid work including at home", "Paid work including at home", "Work,study break"),
    "purchase": ("Cleaning tidying housework", "Caring for own child", "Shopping,bank etc incl internet"),
    "signup": ("Sleeping", "Sleeping", "Resting"),
    "error": ("Travel by car", "Telephone,text,email,letters", "walking, Jogging"),
}
ACTIVITY_CODES = {label: i for i, (label, _, _) in enumerate(ACTIVITY_KEY, 1)}
LOCATIONS = ["Home", "Elsewhere"]
DEVICES = ["Device", "No device"]
COMPANIONS = [
    "Alone",
    "Partner",
    "Person not from household",
    "Child from other household",
    "Child",
    "Other relative",
]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
WAVES = ["early 2016", "June 2020", "August 2020"]
ECON = [
    "Self-employed",
    "Employed full-time",
    "Employed part-time",
    "Business owner",
    "Student",
    "Casual worker",
    "Homemaker",
    "Retired",
    "Unemployed",
]
HIED = [
    "Higher degree (MA, PhD)",
    "First degree (BA, BSc)",
    "A levels or further study",
    "GCSE grades",
    "Apprenticeship",
    "No qualifications",
]
NOW = ["Yes, full time", "Yes, part time", "I am not working", "On furlough"]
BEFORE = ["Working full time", "Working part time", "I wasn't working"]
CLASSES = {
    "BUILDING": "Higher managerial, administrative and professional occupatio",
    "MACHINERY": "Intermediate occupations",
    "HOUSEHOLD": "Routine and manual occupations",
    "FURNITURE": "Not working, never worked and long-term unemployed",
    "AUTOMOBILE": "STUDENT",
}


def _quoted(v) -> str:
    return "'" + v.replace("'", r"\'") + "'" if isinstance(v, str) else str(v)


def _case(subject: str, branches: dict) -> Column:
    """A CASE of constants as one parsed expression: far fewer calls to the JVM than chained when()."""
    return F.expr(f"case {subject} " + " ".join(f"when {_quoted(k)} then {_quoted(v)}" for k, v in branches.items()) + " end")


def _pick(index: str, values: list) -> Column:
    """values[index], NULL outside the list."""
    return _case(index, dict(enumerate(values)))


_SCHEMAS: dict[str, T.StructType] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its footer is read once per folder for the schema."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def codebook(spark: SparkSession) -> DataFrame:
    """(variable, code, label) of every coded slot measure."""
    rows = [(v, c, label) for v in ("pri", "sec") for label, c in ACTIVITY_CODES.items()]
    rows += [("loc", i, label) for i, label in enumerate(LOCATIONS, 1)]
    rows += [("dev", i, label) for i, label in enumerate(DEVICES, 1)]
    rows += [(f"who{p}", i, label) for p in "abcd" for i, label in enumerate(COMPANIONS, 1)]
    return small_table(spark, rows, variable=pa.string(), code=pa.int32(), label=pa.string())


def _activity_code() -> Column:
    codes = {
        f"{event}{i}": ACTIVITY_CODES[label]
        for event, labels in EVENT_ACTIVITIES.items()
        for i, label in enumerate(labels)
    }
    return _case("concat(event_type, k % 3)", codes)


def slots_long(spark: SparkSession, sf_dir: str, start: str = START, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """(diaryid, slot) of the 144 slots from `start` on, with coded pri, sec, loc, enj, dev, whoa..whod; every slot of every diary.

    Events are first reduced to one row per user and slot with map-side partial aggregates over
    fixed-width values, so one user with a third of all events sends at most 144 rows per map
    task. After that a diary has 144 cells, which meet once, partitioned by diaryid.
    """
    events = read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("diaryid"), "event_id", "ts", "event_type", "value", "props"
    )
    seconds = F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit(start)), F.col("ts").cast("timestamp_ntz"))
    cells = (
        events.withColumn("slot", (1 + F.floor(seconds / float(slot_seconds))).cast("int"))
        .filter(F.col("slot").between(1, SLOTS))
        .withColumn("k", F.regexp_substr("props", F.lit("[0-9]+")).cast("int"))
        .withColumn("code", _activity_code())
        .groupBy("diaryid", "slot")
        .agg(
            F.max_by("code", "event_id").alias("pri0"),
            F.min("code").alias("mn"),
            F.max("code").alias("mx"),
            F.max_by("value", "event_id").alias("v"),
            F.max_by("k", "event_id").alias("k"),
        )
    )
    # A diary is small by construction: at most 144 cells are collected for it.
    diaries = cells.groupBy("diaryid").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", F.struct("pri0", "mn", "mx", "v", "k")))).alias("cells")
    )
    grid = diaries.select(
        "diaryid", "cells", F.explode(F.sequence(F.lit(1), F.lit(SLOTS))).alias("slot")
    ).select("diaryid", "slot", F.try_element_at("cells", F.col("slot")).alias("c"))
    so_far = Window.partitionBy("diaryid").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    pri0, k = F.col("c.pri0"), F.col("c.k")
    v = F.last("c.v", ignorenulls=True).over(so_far)
    return grid.select(
        "diaryid",
        "slot",
        F.last(pri0, ignorenulls=True).over(so_far).alias("pri"),
        F.when(F.col("c.mn") != pri0, F.col("c.mn")).when(F.col("c.mx") != pri0, F.col("c.mx")).alias("sec"),
        F.when(v < 15, 1).when(v < 60, 2).alias("loc"),
        (1 + k % 7).alias("enj"),
        F.when(k % 2 == 0, 1).when(k % 2 == 1, 2).alias("dev"),
        (1 + k % 4).alias("whoa"),
        F.when(k % 3 == 1, 5).alias("whob"),
        F.when(k % 5 == 2, 6).alias("whoc"),
        F.lit(None).cast("int").alias("whod"),
    )


def wide_diaries(spark: SparkSession, sf_dir: str, measures=("pri", "sec", "loc")) -> DataFrame:
    """The same diaries in the wide form of the survey file: pri1..pri144, sec1.. and so on."""
    long = slots_long(spark, sf_dir)
    packed = long.groupBy("diaryid").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", F.struct(*measures)))).alias("m")
    )
    return packed.select(
        "diaryid",
        *[F.col("m")[s][m].alias(f"{m}{s}") for m in measures for s in range(1, SLOTS + 1)],
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw answers of everyone who could keep a diary, before any recode; reads no events."""
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"
    )
    health = [
        f"if(c_custkey % {gap} <> 0, cast(1 + (c_custkey * {step} + c_nationkey) % 5 as int), null) as nq{i}"
        for i, (step, gap) in enumerate([(3, 17), (7, 19), (11, 23), (13, 17)], 1)
    ]
    return customer.withColumn("diaryid", F.col("c_custkey")).select(
        F.expr("diaryid"),
        F.expr("cast(floor(diaryid / 2) as bigint) as mainid"),
        _pick("diaryid % 3", WAVES).alias("survey"),
        F.expr("if(c_custkey % 50 <> 49, bround((abs(c_acctbal) + 100) / 5000.0D, 4), null) as weight"),
        _pick("diaryid % 7", WEEKDAYS).alias("dday"),
        F.expr("cast(1 + diaryid % 28 as int) as ddomonth"),
        F.expr("cast(case diaryid % 3 when 0 then 2 + diaryid % 2 when 1 then 6 else 8 end as int) as dmonth"),
        F.expr("case when diaryid % 3 = 0 then 2016 else 2020 end as dyear"),
        F.expr("if(c_nationkey % 2 = 0, 'Female', 'Male') as sex"),
        F.expr("case when c_nationkey % 6 = 5 then '65+' when c_nationkey % 6 < 3 then '18-39' else '40-64' end as dagegrp"),
        _pick("c_custkey % 10", ECON).alias("econstat"),
        _case("c_mktsegment", CLASSES).alias("dclasuk"),
        _pick("c_custkey % 7", HIED).alias("hied"),
        _pick("c_custkey % 5", NOW).alias("emplnow"),
        _pick("c_nationkey % 4", BEFORE).alias("empbfore"),
        F.expr("if(c_custkey % 13 <> 0, cast(c_nationkey % 3 as int), null) as nunder5"),
        F.expr("if(c_custkey % 4 = 0, 1, 0) as n5to11"),
        F.expr("if(c_custkey % 5 <> 0, 0, null) as n12to16"),
        *[F.expr(h) for h in health],
        F.expr("3 as nq5_1"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(diaryid) of everyone with an event."""
    return read_table(spark, sf_dir, "events").select(F.col("user_id").alias("diaryid")).distinct()


def raw_respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw answers of those who kept a diary, one row per diary."""
    return users(spark, sf_dir).join(answers(spark, sf_dir), "diaryid")


def clusters_of(ids: DataFrame) -> DataFrame:
    """A stand-in for the typology of diaries (label): raw cluster 1..60, a few diaries without one."""
    return ids.filter(F.col("label") % 29 != 0).withColumn("cluster60", (1 + (F.col("label") * 7) % 60).cast("int"))


def raw_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, cluster60) of those who kept a diary."""
    return clusters_of(users(spark, sf_dir).withColumnRenamed("diaryid", "label"))
