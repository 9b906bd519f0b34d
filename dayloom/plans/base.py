"""Base tables every report starts from: decoded long diaries and recoded respondents."""

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.functions import recode as R
from dayloom.functions.semantics import share, sum_or_zero
from dayloom.operators.sequences import recluster
from dayloom.operators.spells import wake_and_sleep_aggs
from dayloom.sources import keys, standin
from dayloom.sources.tables import decode_labels

HEALTH_ITEMS = ("nq1", "nq2", "nq3", "nq4")
CHILD_COUNTS = ("nunder5", "n5to11", "n12to16")
MEDIA = "Watching tv, video, dvd, music"

# Leisure activities that take place outside the home.
OUTSIDE_LEISURE = [
    "Consuming services",
    "Church, Temple, Synagogue, Prayer",
    "Walking, Jogging",
    "Playing sports, exercise",
    "Going out to eat, drink",
    "Walking, dog walking",
]


def activity_levels(codebook: DataFrame, key: DataFrame, variable: str) -> DataFrame:
    """code -> recorded label, tidy label, activity group of one activity variable."""
    labels = codebook.filter(F.col("variable") == variable).select("code", "label")
    return labels.join(key, F.col("label") == F.col("original_level"), "left").select(
        "code", "label", "pri_tidied", "activity_group"
    )


def activity_long(slots: DataFrame, codebook: DataFrame, key: DataFrame, labels: Sequence[str] = ("loc",)) -> DataFrame:
    """Coded slots -> labels, tidy activities, activity groups and the five states.

    Primary and secondary activity sit on the same row, so no join of two long tables is needed;
    every lookup is a small table.
    """
    pri = activity_levels(codebook, key, "pri").select(
        F.col("code").alias("__p"),
        F.col("label").alias("__pri"),
        "pri_tidied",
        "activity_group",
    )
    sec = activity_levels(codebook, key, "sec").select(
        F.col("code").alias("__s"),
        F.col("label").alias("__sec"),
        F.col("pri_tidied").alias("sec_tidied"),
        F.col("activity_group").alias("sec_group"),
    )
    decoded = decode_labels(slots, labels, codebook).drop(*[f"{c}_ord" for c in labels])
    return (
        decoded.join(pri, F.col("pri") == F.col("__p"), "left")
        .join(sec, F.col("sec") == F.col("__s"), "left")
        .withColumns({"pri": F.col("__pri"), "sec": F.col("__sec"), "coded5_activity": R.code5("activity_group")})
        .drop("__p", "__s", "__pri", "__sec")
    )


def telework_agg() -> dict[str, Column]:
    """Home or outside workday of a diary with work slots: more than half of them at home."""
    work = F.col("activity_group") == "work"
    at_home = share(F.count_if(work & (F.col("loc") == "Home")), F.count_if(work))
    return {"telework": F.when(at_home > 0.5, "Home Workday").when(at_home.isNotNull(), "Outside Workday")}


def multitasking_agg() -> dict[str, Column]:
    """Slots with a secondary activity other than the primary one."""
    return {"n_multi": F.count_if(F.col("sec_tidied").isNotNull() & (F.col("pri_tidied") != F.col("sec_tidied")))}


def distinct_labels(test: Column, label: str = "pri_tidied") -> Column:
    """Distinct tidy activities among the slots that pass a test; NULL if there is none.

    A diary has a bounded number of slots, so the set is small whatever codes a survey uses.
    """
    return F.nullif(F.size(F.collect_set(F.when(test, F.col(label)))), F.lit(0))


def leisure_aggs() -> dict[str, Column]:
    """Leisure slots, variety, out-of-home variety and media share of a diary.

    Share and variety are missing for a diary without leisure; leisure time is missing if a slot
    is unknown.
    """
    is_leisure = F.col("activity_group").contains("leisure")
    tidy = F.col("pri_tidied")
    state = F.col("coded5_activity").startswith("leisure")
    n_leisure = F.count_if(is_leisure)
    return {
        "leisure_time": F.when(F.count_if(state.isNull()) == 0, F.sum(state.cast("int"))),
        "voracity": distinct_labels(is_leisure),
        "outside_voracity": F.when(
            n_leisure > 0, F.coalesce(distinct_labels(is_leisure & tidy.isin(OUTSIDE_LEISURE)), F.lit(0))
        ),
        "leisure_media": share(F.count_if(is_leisure & (tidy == MEDIA)), n_leisure),
    }


def sleep_aggs() -> dict[str, Column]:
    """Waking, sleeping and half-asleep slots, and slots of sleep, rest, work and break.

    The first three are missing if the sleep status of one slot is unknown.
    """

    def either(label):
        test = R.any_true(F.col("pri_tidied") == label, F.col("sec_tidied") == label)
        return sum_or_zero(test.cast("int"))

    status = R.sleep_status("pri_tidied", "sec_tidied")
    return {
        "sleep_time": either("Sleeping"),
        "rest_time": either("Resting"),
        "work_time": either("Paid work including at home"),
        "break_time": either("Work or study break"),
        **wake_and_sleep_aggs(status),
    }


def diary_indicators(activity: DataFrame, aggs: dict[str, Column] | None = None) -> DataFrame:
    """All per-diary indicators in one aggregate; a query that uses a few computes only those."""
    aggs = aggs or {**telework_agg(), **multitasking_agg(), **leisure_aggs(), **sleep_aggs()}
    return activity.groupBy("diaryid").agg(*[c.alias(n) for n, c in aggs.items()])


def recoded_respondents(raw: DataFrame, clusters: DataFrame) -> DataFrame:
    """Covariates, health score, routine and working status of every respondent."""
    named = clusters.withColumnRenamed("label", "diaryid")
    return (
        raw.join(named, "diaryid", "left")
        .withColumns(
            {
                "mh": R.row_mean(HEALTH_ITEMS),
                "survey": R.recode("survey", R.SURVEY_NAMES),
                "wrk_before": R.work_before("empbfore"),
                "wrk_now": R.work_now("emplnow"),
                "wrk_change": R.employment_change("empbfore", "emplnow"),
                "dclasuk": R.recode("dclasuk", R.CLASS_NAMES),
                "hied2": R.qualification("hied", 2),
                "hied4": R.qualification("hied", 4),
                "econ_status": R.econ_status("econstat"),
                "workday": R.workday("cluster"),
                "cl_desc": R.cluster_label("cluster", "description"),
            }
        )
        .withColumns(R.child_flags(CHILD_COUNTS))
        .withColumn("in_work", R.in_work("survey", "econ_status", "wrk_now"))
        .drop(*HEALTH_ITEMS, "nq5_1", "emplnow", "empbfore")
    )


def respondent_data(recoded: DataFrame, indicators: DataFrame, how: str = "left") -> DataFrame:
    """The analysed sample with its diary indicators, telework status and day types.

    With how="inner", only those with a diary: `recoded` may then hold others too.
    """
    joined = recoded.filter(R.in_sample("dagegrp", "econstat")).join(indicators, "diaryid", how)
    return joined.withColumns(
        {
            "teleworkday": R.teleworkday("workday", "telework"),
            "day_type": R.day_type("workday", "in_work", "telework"),
        }
    )


class Study:
    """The base tables of one data folder, each a lazy DataFrame.

    For repeated work on large data, write `activity`, `respondents` and `clusters` once with
    `save_table` and pass the re-read tables in; a `key` of one's own replaces the shipped one.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        activity: DataFrame | None = None,
        respondents: DataFrame | None = None,
        clusters: DataFrame | None = None,
        key: DataFrame | None = None,
    ):
        self.spark, self.folder = spark, folder
        given = {"activity": activity, "respondents": respondents, "clusters": clusters, "key": key}
        # A table set here is found before the property that would compute it.
        self.__dict__.update({n: t for n, t in given.items() if t is not None})

    @cached_property
    def codebook(self) -> DataFrame:
        return standin.codebook(self.spark)

    @cached_property
    def key(self) -> DataFrame:
        return keys.activity_key(self.spark)

    @cached_property
    def slots(self) -> DataFrame:
        return standin.slots_long(self.spark, self.folder)

    @cached_property
    def activity(self) -> DataFrame:
        return activity_long(self.slots, self.codebook, self.key)

    @cached_property
    def company(self) -> DataFrame:
        who = ("whoa", "whob", "whoc", "whod")
        coded = self.slots.select("diaryid", "slot", *who)
        return decode_labels(coded, who, self.codebook).drop(*[f"{c}_ord" for c in who])

    @cached_property
    def raw(self) -> DataFrame:
        return standin.raw_respondents(self.spark, self.folder)

    @cached_property
    def clusters(self) -> DataFrame:
        return recluster(standin.raw_clusters(self.spark, self.folder), keys.recluster_key(self.spark))

    @cached_property
    def recoded(self) -> DataFrame:
        return recoded_respondents(self.raw, self.clusters)

    @cached_property
    def answered(self) -> DataFrame:
        """Recoded answers of everyone, with or without a diary: joins with diaries drop the others.

        Made without reading the events, so that a report reads them once, for the diaries.
        """
        answers = standin.answers(self.spark, self.folder)
        clusters = self.__dict__.get("clusters")
        if clusters is None:
            raw = standin.clusters_of(answers.select(F.col("diaryid").alias("label")))
            clusters = recluster(raw, keys.recluster_key(self.spark))
        return recoded_respondents(answers, clusters)

    @cached_property
    def indicators(self) -> DataFrame:
        return diary_indicators(self.activity)

    @cached_property
    def respondents(self) -> DataFrame:
        return respondent_data(self.answered, self.indicators, "inner")

    @cached_property
    def sample(self) -> DataFrame:
        """The sample without diary indicators, for reports that do not use them."""
        return self.recoded.filter(R.in_sample("dagegrp", "econstat"))

    @cached_property
    def diaries(self) -> DataFrame:
        """Slots of the analysed sample with the respondent's columns; other diaries drop out."""
        return self.activity.join(self.answered.filter(R.in_sample("dagegrp", "econstat")), "diaryid")
