"""Lookup tables shipped with the library, and CSV readers for replacements."""

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Activity label as recorded, tidy label, activity group.
ACTIVITY_KEY = [
    ("Sleeping", "Sleeping", "rest_sleep"),
    ("Resting", "Resting", "rest_rest"),
    ("Washing, dressing", "Washing, dressing", "rest_selfcare"),
    ("Eating, drinking,home or work", "Eating or drinking, (home or work)", "rest_eat"),
    ("Preparing food, cooking etc", "Preparing food, cooking etc.", "unpaid_work_house"),
    ("Cleaning tidying housework", "Cleaning, tidying, housework", "unpaid_work_house"),
    ("Clothes washing, mending", "Clothes washing, mending", "unpaid_work_house"),
    ("Maintenance diy, etc", "Maintenance, DIY, etc.", "unpaid_work_house"),
    ("Consuming services", "Consuming services", "leisure_outside"),
    ("church,temple,synagogue,prayer", "Church, Temple, Synagogue, Prayer", "leisure_social"),
    ("walking, Jogging", "Walking, Jogging", "leisure_outside"),
    ("travel: cycle", "Travel by bike", "travel"),
    ("Travel by car", "Travel by car", "travel"),
    ("Travel by bus,tram", "Travel by bus,tram", "travel"),
    ("Travel by train,tube", "Travel by train,tube", "travel"),
    ("Travel other", "Travel, other", "travel"),
    ("Paid work including at home", "Paid work including at home", "work"),
    ("Formal education", "Formal education", "study"),
    ("Recreational courses", "Recreational courses", "leisure_study"),
    ("Voluntary work for organisation", "Voluntary work for organisation", "unpaid_work_org"),
    ("Caring for own child", "Caring for own child", "unpaid_work_childcare"),
    ("Caring for other children", "Caring for other children", "unpaid_work_childcare"),
    ("Help,caring for cores adult", "Help, caring for coresident adult", "unpaid_work_care"),
    ("Help,caring for noncoresidents", "Help, caring for non-coresident", "unpaid_work_care"),
    ("Work,study break", "Work or study break", "rest_break"),
    ("Shopping,bank etc incl internet", "Shopping, bank etc, incl. online", "shopping"),
    ("Watching tv,video,dvd,music", "Watching tv, video, dvd, music", "leisure_media"),
    ("Reading including e-books", "Reading including e-books", "leisure_reading"),
    ("Playing sports, exercise", "Playing sports, exercise", "leisure_exercise"),
    ("Going out to eat, drink", "Going out to eat, drink", "leisure_social"),
    ("Walking,dog walking", "Walking, dog walking", "leisure_outside"),
    ("Playing computer gamesm", "Playing computer games", "leisure_computergame"),
    ("Ttime with friends,family", "Time with friends,family", "leisure_social"),
    ("Telephone,text,email,letters", "Telephone, text, email, letters", "comms"),
    ("Cinema,theatre,sport etc", "Cinema, theatre, sport etc.", "leisure_culture"),
    ("Hobbies", "Hobbies", "leisure_hobbies"),
    ("write-in other", "write-in other", "other"),
    ("138", "138", "other"),
]

# Raw cluster number, description of the routine.
RECLUSTER_KEY = [
    (1, "Workday Morning, short"),
    (2, "Workday Morning"),
    (3, "Workday Morning, more unpaid"),
    (4, "Workday 9 to 5"),
    (5, "Workday 9 to 5, more leisure"),
    (6, "Workday 9 to 5, unpaid evening"),
    (7, "Workday 9 to 5, other evening"),
    (8, "Workday 9 to 5, long"),
    (9, "Workday 9 to 5, no leisure"),
    (10, "Workday 9 to 5, long leisure"),
    (11, "Workday 9 to 5, night leisure"),
    (12, "Workday Afternoon"),
    (13, "Workday Afternoon, short with unpaid"),
    (14, "Workday Afternoon, short"),
    (15, "Workday Afternoon, long"),
    (16, "Unpaid and Leisure, morning unpaid"),
    (17, "Unpaid and Leisure, morning unpaid"),
    (18, "Leisure, interrupted"),
    (19, "Leisure, interrupted"),
    (20, "Leisure, interrupted"),
    (21, "Unpaid and Leisure, unpaid afternoon"),
    (22, "Unpaid and Leisure, unpaid afternoon"),
    (23, "Disrupted Day, short"),
    (24, "Disrupted Day, mixed"),
    (25, "Disrupted Day, mixed"),
    (26, "Disrupted Day, mixed"),
    (27, "Unpaid Workday, long"),
    (28, "Unpaid Workday, lunch"),
    (29, "Unpaid Workday"),
    (30, "Unpaid and Leisure, morning unpaid, late start"),
    (31, "Other and Leisure, other afternoon"),
    (32, "Other and Leisure, other afternoon"),
    (33, "Other and Leisure, other afternoon"),
    (34, "Other and Leisure, other morning"),
    (35, "Other and Leisure, other morning"),
    (36, "Disrupted Day, short leisure evening"),
    (37, "Disrupted Day, short leisure evening"),
    (38, "Rest, interrupted"),
    (39, "Leisure, all day, late start"),
    (40, "Leisure, slightly interrupted, late start"),
    (41, "Leisure, interrupted, late start"),
    (42, "Leisure, interrupted, late start"),
    (43, "Other and Leisure, other morning, late start"),
    (44, "Other and Leisure, other morning, late start"),
    (45, "Unpaid and Leisure, morning unpaid, late start"),
    (46, "Unpaid and Leisure, morning unpaid, late start"),
    (47, "Leisure, all day"),
    (48, "Leisure, all day"),
    (49, "Disrupted Day, long leisure evening"),
    (50, "Disrupted Day, long leisure evening"),
    (51, "Disrupted Day, long leisure evening"),
    (52, "Disrupted Day, long leisure evening"),
    (53, "Disrupted Day, overnight"),
    (54, "Disrupted Day, overnight"),
    (55, "Disrupted Day, overnight"),
    (56, "Disrupted Day, overnight"),
    (57, "Disrupted Day, overnight"),
    (58, "Workday, night shift"),
    (59, "Workday, night shift"),
    (60, "Rest, all day"),
]

ACTIVITY_KEY_SCHEMA = "original_level string, pri_tidied string, activity_group string"
RECLUSTER_KEY_SCHEMA = "original_cluster int, description string"


def small_table(spark: SparkSession, rows: Sequence[tuple], **columns: pa.DataType) -> DataFrame:
    """A constant table whose size Spark knows when it plans, so joins broadcast it from the start."""
    schema = pa.schema(list(columns.items()))
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(columns, r)) for r in rows], schema=schema))


def activity_key(spark: SparkSession) -> DataFrame:
    """The shipped activity key."""
    return small_table(spark, ACTIVITY_KEY, original_level=pa.string(), pri_tidied=pa.string(), activity_group=pa.string())


def recluster_key(spark: SparkSession) -> DataFrame:
    """The shipped routine naming key."""
    return small_table(spark, RECLUSTER_KEY, original_cluster=pa.int32(), description=pa.string())


def load_key(spark: SparkSession, path: str, schema: str = ACTIVITY_KEY_SCHEMA) -> DataFrame:
    """A key of the user's own, read from CSV with a declared schema.

    No broadcast hint: Spark knows the file size and broadcasts when it is small.
    """
    return spark.read.csv(path, schema=schema, header=True)
