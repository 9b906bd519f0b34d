"""The study's derived data sets and published tables, as chains of operators."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.functions import recode as R
from dayloom.functions.semantics import half_even, is_true, join_group_facts, join_null_safe, share
from dayloom.operators import aggregate as A
from dayloom.operators import reshape as S
from dayloom.operators import spells as W
from dayloom.plans.base import MEDIA, OUTSIDE_LEISURE, Study, diary_indicators, leisure_aggs, sleep_aggs  # noqa: F401

SLOTS = 144
SLOTS_PER_HOUR = 6


# ---- data sets -----------------------------------------------------------------------------


def spells_data(s: Study) -> DataFrame:
    """Sample with spells per diary and the spread of their length."""
    stats = W.spell_stats(W.spells(s.slots))
    return A.sample_join(s.respondents, [stats]).withColumn("telework", F.coalesce("telework", F.lit("Not Workday")))


def multi_data(s: Study) -> DataFrame:
    """Sample with multitasking slots per diary; none counts as zero."""
    return s.respondents.withColumn("n_multi", F.coalesce("n_multi", F.lit(0))).withColumn(
        "prop_multi", F.col("n_multi") / F.lit(float(SLOTS))
    )


def leisure_indicators(activity: DataFrame) -> DataFrame:
    """Leisure slots, variety and media share of every diary."""
    return diary_indicators(activity, leisure_aggs())


def leisure_shares(s: Study, levels: Sequence[str]) -> DataFrame:
    """Share of each leisure activity in the leisure of a diary, one column per activity."""
    leisure = s.activity.filter(F.col("activity_group").contains("leisure"))
    shares = A.plain_share(leisure, "diaryid", "pri_tidied", "prop")
    return S.pivot_fill(shares, "diaryid", "pri_tidied", "prop", list(levels), 0.0)


def leisure_data(s: Study) -> DataFrame:
    """Sample with the leisure indicators."""
    return s.respondents


def sleep_indicators(activity: DataFrame) -> DataFrame:
    """Waking, sleeping, rest, work and break slots of every diary."""
    return diary_indicators(activity, sleep_aggs())


def sleep_data(s: Study) -> DataFrame:
    """Sample with the sleep indicators."""
    return s.respondents


def company_data(s: Study) -> DataFrame:
    """Sample with slots in company, one row per (diary, household, measure)."""
    totals = A.company_slots(s.company)
    joined = A.sample_join(s.respondents, [totals])
    measures = [c for c in totals.columns if c.startswith("with_")]
    long = S.unpivot(joined, measures, "measure", "value")
    return S.split_name(long, "measure", ("household", "measure"))


def company_to_model(s: Study) -> DataFrame:
    """Sample with household company measures as columns."""
    totals = A.company_slots(s.company)
    mine = totals.select(
        "diaryid", *[F.col(c).alias(c.split("_X")[1]) for c in totals.columns if c.startswith("with_household_X")]
    )
    return A.sample_join(s.respondents, [mine])


def workday_data(s: Study) -> DataFrame:
    """Workdays of known day type with their routine category."""
    return (
        s.respondents.filter((F.col("workday") == "Workday") & F.col("day_type").isNotNull())
        .withColumn("workday_type", R.routine_group("workday_type"))
        .withColumn("is_teleworkday", F.when(F.col("day_type") == "Home Workday", 1).otherwise(0))
    )


def workday95_data(s: Study) -> DataFrame:
    """Workdays of the three working classes: 9 to 5 or not."""
    standard = is_true(F.col("description").rlike("Workday 9"))
    return (
        s.respondents.filter((F.col("workday") == "Workday") & (F.col("dclasuk") != "Not working or unemployed"))
        .withColumn("w9to5", F.when(standard, "9 to 5 Workday").otherwise("Non-standard Workday"))
        .withColumn("is_not_w9to5", F.when(standard, 0).otherwise(1))
    )


def routine_data(s: Study) -> DataFrame:
    """Sample of known working status with the routine categories of the models."""
    return s.respondents.filter(F.col("in_work").isNotNull()).withColumns(
        {r: R.routine_group(r) for r in ("unpaid_cluster", "interrupted_cluster", "leisure_cluster", "disr", "disr_unpaid")}
    )


def cluster_health_data(s: Study) -> DataFrame:
    """Sample of known health score and current work with the routine group."""
    return A.complete_cases(
        s.respondents.withColumn("cluster_group", R.routine_group("cluster_group")), ["mh", "wrk_now"]
    )


def multi95_data(s: Study) -> DataFrame:
    """Workdays with multitasking: 9 to 5 or other."""
    standard = is_true(F.col("description").rlike("Workday 9 to 5"))
    return (
        multi_data(s)
        .filter(F.col("workday") == "Workday")
        .withColumn("workday95", F.when(standard, "Workday 9 to 5").otherwise("Other Workday"))
    )


def multi_health_data(s: Study) -> DataFrame:
    """Multitasking sample of known health score and current work, with binned multitasking."""
    return A.complete_cases(multi_data(s), ["mh", "wrk_now"]).withColumn(
        "proportion_multitasking",
        R.cut_right("prop_multi", [0, 1 / 3, 2 / 3, 1], ["(0,0.333]", "(0.333,0.667]", "(0.667,1]"], "0"),
    )


def voracity_data(s: Study) -> DataFrame:
    """Diaries with leisure and known working status; variety counted from zero."""
    return (
        A.complete_cases(leisure_data(s), ["voracity", "in_work"])
        .withColumn("voracity0", F.col("voracity") - 1)
        .withColumn("inside_voracity", F.col("voracity") - F.col("outside_voracity"))
    )


def media_data(s: Study) -> DataFrame:
    """Diaries with leisure and known working status."""
    return A.complete_cases(leisure_data(s), ["leisure_media", "in_work"])


def media_health_data(s: Study) -> DataFrame:
    """Diaries with leisure, health score and current work, with binned media share."""
    fifths = [i / 5 for i in range(6)]
    labels = ["(0,0.2]", "(0.2,0.4]", "(0.4,0.6]", "(0.6,0.8]", "(0.8,1]"]
    return A.complete_cases(leisure_data(s), ["leisure_media", "mh", "wrk_now"]).withColumn(
        "prop_leisure_media", R.cut_right("leisure_media", fifths, labels, "0")
    )


def sleep_model_data(s: Study) -> DataFrame:
    """Sleep indicators of diaries of known day type."""
    return sleep_data(s).filter(F.col("day_type").isNotNull())


def multi_entropy_data(s: Study) -> DataFrame:
    """Multitasking sample with the mean entropy of the diary's routine."""
    entropy = A.mean_entropy(s.diaries, "cl_desc", "coded5_activity")
    return join_group_facts(multi_data(s), entropy, ["cl_desc"], "diaryid")


# ---- tables and figures --------------------------------------------------------------------


def wave_dates(s: Study) -> DataFrame:
    return A.count_by(s.raw, ["ddomonth", "dmonth", "dyear", "survey"])


def respondents_by_wave(s: Study) -> DataFrame:
    """Table 2.1: people by number of diaries and wave, their total, and the diaries per wave."""
    waves = ["early 2016", "June 2020", "August 2020"]
    people = S.pivot_fill(A.count_of_counts(s.raw, ["survey"], "mainid", "n_diaries"), "n_diaries", "survey", "n", waves)
    diaries = S.pivot_fill(
        A.count_by(s.raw, "survey").withColumn("n_diaries", F.lit("Total diaries")), "n_diaries", "survey", "n", waves
    )
    return S.union_by_name([A.with_total_row(people, "n_diaries", "Total respondents"), diaries])


def weighting_effect(s: Study, by: str) -> DataFrame:
    """Figures 2.2.1 and 2.2.2: diaries and weighted diaries by wave, category and sample."""
    flagged = s.raw.withColumn("in_sample", R.in_sample_flag("dagegrp", "econstat"))
    cells = A.weighted_count(flagged, ["survey", by, "in_sample"])
    cells = cells.withColumn("n", F.col("n").cast("double"))
    return S.unpivot(cells, ["n", "n_weighted"], "weighted", "value")


def work_change(s: Study) -> DataFrame:
    """Figure 2.3.1: change of work status by sex, age, qualification, class and overall."""
    base = s.recoded.filter(
        R.in_sample("dagegrp", "econstat") & (F.col("wrk_change") != "not in work before lockdown")
    )
    cells = A.by_each(
        base, ["survey"], ["sex", "dagegrp", "hied2", "dclasuk"], [F.sum("weight").alias("n")], extra=["wrk_change"]
    )
    shares = A.share_of_group(cells, ["survey", "dimension", "category"], "n", "proportion")
    kept = shares.filter(
        (F.col("survey") != "2016")
        & F.col("wrk_change").isin("full to part time", "part to full time", "furlough", "not working")
        & ~F.col("category").rlike("Not working")
    )
    return kept.withColumn("wrk_change", R.recode("wrk_change", {"not working": "no longer working"}))


def health_reliability(s: Study) -> DataFrame:
    """Reliability of the health score over people with complete answers."""
    items = ["nq1", "nq2", "nq3", "nq4"]
    people = A.first_per_key(s.raw.select("mainid", "diaryid", *items), "mainid", ["diaryid"])
    return A.cronbach_alpha(A.complete_cases(people, items), items)


def cluster_profile(s: Study) -> DataFrame:
    """Table 4.1: composition, modal age group and entropy of every routine."""
    age = A.weighted_mode(s.sample, "cl_desc", "dagegrp").select("cl_desc", F.col("dagegrp").alias("modal_age_group"))
    entropy = A.mean_entropy(s.diaries, "cl_desc", "coded5_activity").select("cl_desc", "prop_max_h")
    tests = {
        "female": F.col("sex") == "Female",
        "with_children": F.col("has_kids") == "Children",
        "not_working": F.col("in_work") == "Not Working",
        "degree": F.col("hied2") == "Degree",
        "higher_professional": F.col("dclasuk") == "Higher managerial and professional",
        "intermediate": F.col("dclasuk") == "Intermediate",
        "routine": F.col("dclasuk") == "Routine",
    }
    profile = A.conditional_share(s.sample, ["cl_desc", "cluster"], tests)
    joined = join_null_safe(join_null_safe(profile, age, ["cl_desc"], "full"), entropy, ["cl_desc"], "full")
    return joined.withColumns({c: half_even(c, 3) * 100 for c in [*tests, "prop_max_h"]})


def cluster_share_by_wave(s: Study, pattern: str, by: str | None = None, clusters: Sequence[int] = range(1, 38)) -> DataFrame:
    """Figures 4.1.2, 4.2.2, 4.3.2-4, 4.4.2, 4.4.4: share of routines by wave, filtered afterwards."""
    group = ["survey", *([by] if by else [])]
    shares = A.weighted_share(s.sample, group, ["cluster", "description"], name="percent")
    shares = shares.withColumn("percent", F.col("percent") * 100)
    return A.filter_matches(shares, "description", pattern).filter(F.col("cluster").isin(list(clusters)))


def nonstandard_workdays(s: Study, by: str) -> DataFrame:
    """Figure 4.1.4: share of workdays that are not 9 to 5."""
    shares = A.weighted_share(workday95_data(s), ["survey", by], "w9to5", name="prop")
    return shares.filter(F.col("w9to5") == "Non-standard Workday")


def day_types(s: Study) -> DataFrame:
    """Figure 4.1.7: day types by wave."""
    known = s.respondents.filter(F.col("day_type").isNotNull())
    shares = A.weighted_share(known, "survey", "day_type", name="prop")
    return shares.withColumn("label", half_even(F.col("prop") * 100, 1))


def spells_by(s: Study, by: Sequence[str]) -> DataFrame:
    """Figures 5.1.1, 5.1.5, 5.1.9: mean spells per diary."""
    return A.weighted_mean(spells_data(s), by, {"mean_n": F.col("n_spells")})


def spells_by_activity(s: Study) -> DataFrame:
    """Figure 5.1.2: weighted spells by sex, state and wave."""
    levels = s.codebook.filter(F.col("variable") == "pri").join(
        s.key, F.col("label") == F.col("original_level"), "left"
    )
    named = W.spells(s.slots).join(levels.select("code", "activity_group"), F.col("pri") == F.col("code"), "left")
    joined = s.sample.join(named.drop("code"), "diaryid", "left").withColumn("coded5", R.code5("activity_group"))
    return A.weighted_total(joined, ["sex", "coded5", "survey"], ["diaryid"], name="weighted_n_periods")


def multitasking_rates(s: Study) -> DataFrame:
    """Share of slots without a secondary activity and of multitasking time, in one pass."""
    multi = F.col("sec_tidied").isNotNull() & (F.col("pri_tidied") != F.col("sec_tidied"))
    return A.overall_rates(s.activity, {"no_secondary": F.col("sec_tidied").isNull(), "multitasking": multi})


def multitasking_by(s: Study, by: Sequence[str]) -> DataFrame:
    """Figures 5.2.1, 5.2.3: mean share of multitasking among diaries with some."""
    return A.weighted_mean(multi_data(s).filter(F.col("n_multi") > 0), by, {"mean_multi": F.col("prop_multi")})


def multitasking_by_day_type(s: Study) -> DataFrame:
    """Figure 5.2.4: by day type and wave, with all diaries of the wave.

    Only the day-type rows leave out unknown day types; the overall rows keep them.
    """
    some = multi_data(s).filter(F.col("prop_multi") > 0)
    table = A.by_each(some, ["survey"], ["day_type"], [A.mean_of("prop_multi").alias("mean_multi")], "All Diary Days")
    return table.filter((F.col("dimension") != "day_type") | F.col("category").isNotNull())


def entropy_and_multitasking(s: Study) -> DataFrame:
    """Figure 5.2.8: mean entropy and mean multitasking per routine."""
    entropy = A.mean_entropy(s.diaries, "cl_desc", "coded5_activity").select("cl_desc", "mean_h")
    multi = A.weighted_mean(multi_data(s), "cl_desc", {"mean_multi": F.col("n_multi") / F.lit(144.0)})
    joined = join_null_safe(entropy, multi, ["cl_desc"], "full")
    kept = joined.filter(~F.col("cl_desc").rlike("37"))
    return kept.withColumn("number", F.regexp_substr("cl_desc", F.lit("[0-9]{1,2}"))).withColumn(
        "group", F.regexp_substr("cl_desc", F.lit("[A-Z][^,]*"))
    )


def health_density(data: DataFrame, group: str, points: int = 512) -> DataFrame:
    """Figures 5.3.1, 6.3.1: density of the health score by bin, with the weight of the bin."""
    sizes = A.weighted_count(data, group, n="n_rows", n_weighted="n_obs").select(group, "n_obs")
    curve = A.weighted_density(data, group, "mh", 0.0, 4.0, 0.25, points)
    return join_null_safe(curve, sizes, [group], "left")


def leisure_variety(s: Study) -> DataFrame:
    """Figure 6.1.1: variety of leisure in and outside the home."""
    data = voracity_data(s).select(
        "hied2",
        "survey",
        "workday",
        "weight",
        F.col("inside_voracity").alias("inside_leisure"),
        F.col("outside_voracity").alias("outside_leisure"),
    )
    long = S.unpivot(data, ["inside_leisure", "outside_leisure"], "location", "vorac")
    return A.weighted_mean(long, ["hied2", "survey", "workday", "location"], {"mean_voracity": F.col("vorac")})


def leisure_hours(s: Study) -> DataFrame:
    """Figure 6.1.2: mean hours of leisure with a readable label."""
    data = leisure_data(s).withColumn("leisure_hours", F.col("leisure_time") / F.lit(float(SLOTS_PER_HOUR)))
    return A.weighted_mean(data, ["hied2", "survey"], {"mean_leisure_hours": F.col("leisure_hours")}).withColumn(
        "label", R.hours_label("mean_leisure_hours")
    )


def working_share(s: Study) -> DataFrame:
    """Figure 6.1.6: share working by wave and degree; unknown status stays in the base."""
    shares = A.weighted_share(s.sample, ["survey", "hied2"], "in_work", name="prop")
    return shares.filter(F.col("in_work") == "Working")


def zero_leisure(s: Study, levels: Sequence[str]) -> DataFrame:
    """Figure 6.2.1: weight of diaries without each leisure activity.

    Diaries without any leisure have no share but stay in the base.
    """
    joined = A.sample_join(s.sample.select("diaryid", "weight"), [leisure_shares(s, levels)])
    long = S.unpivot(joined, list(levels), "leisure_type", "prop").filter(~F.col("leisure_type").rlike("Church"))
    return A.conditional_share(long, "leisure_type", {"prop_0": F.col("prop") == 0})


def media_share(s: Study) -> DataFrame:
    """Share of media in all leisure slots."""
    leisure = s.activity.filter(F.col("coded5_activity").startswith("leisure"))
    return A.overall_rates(leisure, {"prop_media": F.col("activity_group").contains("media")})


def media_means(s: Study) -> DataFrame:
    """Mean media share by wave, degree and work, unweighted and weighted."""
    return (
        media_data(s)
        .groupBy("survey", "hied2", "in_work")
        .agg(F.avg("leisure_media").alias("mean_media"), A.mean_of("leisure_media").alias("mean_media_weighted"))
    )


def woken_by(s: Study) -> DataFrame:
    """Figures 7.1.1, 7.1.3, 7.1.4: share awake before each of the first 48 slots has ended."""
    curve = A.weighted_ecdf(sleep_model_data(s), ["survey", "day_type", "hied2"], "wakeup_time", (1, 48), "below", name="prop")
    return curve.withColumn("clock", R.slot_to_time("time", edge="end"))


def awake_after(s: Study) -> DataFrame:
    """Figures 7.2.1, 7.2.2: share still awake after each of the last 60 slots."""
    curve = A.weighted_ecdf(sleep_model_data(s), ["survey", "day_type"], "sleeping_time", (1, SLOTS), "above", name="prop")
    return curve.filter(F.col("time") > SLOTS - 60).withColumn("clock", R.slot_to_time("time", edge="end"))


def after_waking(s: Study, n: int = 12) -> DataFrame:
    """Figure 7.1.5: what is done after waking, by wave, wake-up bin, workday and degree."""
    wake = sleep_indicators(s.activity).select("diaryid", "wakeup_time")
    first_hours = W.slots_after(s.activity.select("diaryid", "slot", "coded5_activity"), wake, "wakeup_time", n)
    shares = A.plain_share(first_hours, "diaryid", "coded5_activity", "prop")
    states = ["rest", "unpaid_work", "other", "work", "leisure"]
    wide = S.pivot_fill(shares, "diaryid", "coded5_activity", "prop", states, 0.0)
    hour = F.col("wakeup_time") / F.lit(float(SLOTS_PER_HOUR)) + 4
    data = A.sample_join(s.sample, [wide, wake]).withColumn(
        "wakeup_bin", R.cut_right(hour, [4, 6, 8, 10, 12], ["(4,6]", "(6,8]", "(8,10]", "(10,12]"])
    )
    means = A.weighted_mean(
        A.complete_cases(data, ["in_work", "wakeup_bin"]), ["survey", "wakeup_bin", "workday", "hied2"], states
    )
    return S.unpivot(means, states, "name", "value")


def sleep_hours(s: Study) -> DataFrame:
    """Figure 7.3.1: mean hours asleep by wave, for each day type and for all days."""
    mean = (A.mean_of("sleep_time") / F.lit(float(SLOTS_PER_HOUR))).alias("mean_dep")
    return A.by_each(sleep_model_data(s), ["survey"], ["day_type"], [mean], "All Respondents")


def company_hours(s: Study) -> DataFrame:
    """Figure 8.1.1: hours with household members by class, wave and children."""
    measures = list(R.COMPANY_NAMES)
    hours = {m: F.col(m) / F.lit(float(SLOTS_PER_HOUR)) for m in measures}
    means = A.weighted_mean(company_to_model(s), ["dclasuk", "survey", "has_kids"], hours)
    return S.unpivot(means, measures, "measure", "value").withColumn("measure", R.recode("measure", R.COMPANY_NAMES))
