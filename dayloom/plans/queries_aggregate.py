"""Queries: aggregates, windows and the published descriptive tables."""

from pyspark.sql import functions as F

from dayloom.functions import recode as R
from dayloom.functions.semantics import strict
from dayloom.operators import aggregate as A
from dayloom.operators import spells as W
from dayloom.plans import reports as P
from dayloom.plans import sql_tables as T
from dayloom.plans.queries_shape import LEISURE_LEVELS
from dayloom.plans.registry import query
from dayloom.plans.sql_base import in_list, text


def share_sql(table: str, group: str, level: str, name: str = "share", n: str = "n") -> str:
    """Weighted shares of levels within groups."""
    keys = f"{group}, {level}" if group else level
    over = f"over (partition by {group})" if group else "over ()"
    return f"""
select {keys}, {n}, {n} / nullif(sum({n}) {over}, 0)::double as {name}
from (select {keys}, coalesce(sum(weight), 0) as {n} from {table} group by all) c"""


# ---- aggregates ----------------------------------------------------------------------------


@query(
    "count_of_counts",
    """
select survey, n_diaries, count(*) as n
from (select survey, mainid, count(*) as n_diaries from raw group by all) c group by all""",
)
def count_of_counts(s):
    return A.count_of_counts(s.raw, ["survey"], "mainid", "n_diaries")


@query("wave_dates", "select ddomonth, dmonth, dyear, survey, count(*) as n from raw group by all")
def wave_dates(s):
    return P.wave_dates(s)


@query("weighted_count", "select survey, dday, count(*) as n, coalesce(sum(weight), 0) as n_weighted from raw group by all", "n_weighted")
def weighted_count(s):
    return A.weighted_count(s.raw, ["survey", "dday"])


@query("weighted_share", share_sql("diaries", "cluster, slot", "coded5_activity"), "n share")
def weighted_share(s):
    return A.weighted_share(s.diaries, ["cluster", "slot"], "coded5_activity")


@query(
    "weighted_share_strict",
    """
with c as (select survey, hied2, case when count(*) = count(weight) then sum(weight) end as n from recoded group by all)
select survey, hied2, n, case when count(*) over (partition by survey) = count(n) over (partition by survey)
  then n / sum(n) over (partition by survey) end as share from c""",
    "n share",
)
def weighted_share_strict(s):
    return A.weighted_share(s.recoded, "survey", "hied2", strict=True)


@query("weighted_share_overall", share_sql("recoded", "", "wrk_change"), "n share")
def weighted_share_overall(s):
    return A.weighted_share(s.recoded, [], "wrk_change")


@query(
    "share",
    """
select diaryid, loc, n, n / sum(n) over (partition by diaryid)::double as prop
from (select diaryid, loc, count(*) as n from activity where activity_group = 'work' group by all) c""",
    "prop",
)
def plain_share(s):
    return A.plain_share(s.activity.filter(F.col("activity_group") == "work"), "diaryid", "loc", "prop")


@query(
    "conditional_share",
    """
select survey, coalesce(sum(case when sex = 'Female' then weight end), 0) / nullif(sum(weight), 0) as female,
       coalesce(sum(case when in_work = 'Not Working' then weight end), 0) / nullif(sum(weight), 0) as not_working,
       case when count(*) = count(in_work) then coalesce(sum(case when in_work = 'Not Working' then weight end), 0) / nullif(sum(weight), 0) end as not_working_strict
from recoded group by survey""",
    "female not_working not_working_strict",
)
def conditional_share(s):
    out = F.col("in_work") == "Not Working"
    tests = {"female": F.col("sex") == "Female", "not_working": out, "not_working_strict": out}
    return A.conditional_share(s.recoded, "survey", tests, strict=["not_working_strict"])


@query(
    "weighted_mean",
    f"""
select survey, sex, has_kids, {T.weighted_mean('n_spells')} as n_spells, {T.weighted_mean('sd_length')} as sd_length
from ({T.SPELLS_DATA}) x group by all""",
    "n_spells sd_length",
)
def weighted_mean(s):
    return A.weighted_mean(P.spells_data(s), ["survey", "sex", "has_kids"], ["n_spells", "sd_length"])


@query(
    "weighted_mean_strict",
    f"""
select survey, sex, case when count(*) = count(weight) and count(*) = count(mh) then {T.weighted_mean('mh')} end as mh
from recoded group by all""",
    "mh",
)
def weighted_mean_strict(s):
    return A.weighted_mean(s.recoded, ["survey", "sex"], "mh", strict=True)


@query("slot_totals", f"select * from ({T.SLEEP_IND}) x")
def slot_totals(s):
    return P.sleep_indicators(s.activity)


@query("company_slots", f"select * from ({T.COMPANY_IND}) x")
def company_slots(s):
    return A.company_slots(s.company)


@query("company_slots_long", f"select * from ({T.COMPANY_IND}) x")
def company_slots_long(s):
    """From one row per diary, slot and companion."""
    who = ["whoa", "whob", "whoc", "whod"]
    return A.company_slots_long(s.company.unpivot(["diaryid", "slot"], who, "who", "who_value"))


@query(
    "weighted_total",
    """
select sex, survey, coded5_activity, sum(n * weight) as total
from (select sex, survey, coded5_activity, diaryid, weight, count(*) as n from diaries group by all) c group by all""",
    "total",
)
def weighted_total(s):
    return A.weighted_total(s.diaries, ["sex", "survey", "coded5_activity"], ["diaryid"])


@query(
    "simple_aggs",
    'select diaryid, count(*) as n, avg(length) as mean, min(length) as min, max(length) as max, stddev_samp(length) as sd '
    f"from ({T.SPELLS}) x group by diaryid",
    "mean sd",
)
def simple_aggs(s):
    return A.simple_aggs(W.spells(s.slots), "diaryid", "length")


@query(
    "weight_facts",
    """
select avg(weight) as mean_all, avg(case when dagegrp <> '65+' and econstat <> 'Student' then weight end) as mean_sample,
       count(case when weight > 1 then 1 end) as n_over, count(case when weight > 1 and dagegrp <> '65+' and econstat <> 'Student' then 1 end) as n_over_sample
from raw""",
    "mean_all mean_sample",
)
def weight_facts(s):
    # The stand-in weights lie below the study's bound of 4, so the test data are held to 1.
    return A.weights_over(s.raw, 1, R.in_sample("dagegrp", "econstat"))


_PEOPLE = """
select n_diaries, coalesce(max(case when survey = 'early 2016' then n end), 0) as "early 2016",
       coalesce(max(case when survey = 'June 2020' then n end), 0) as "June 2020",
       coalesce(max(case when survey = 'August 2020' then n end), 0) as "August 2020"
from (select survey, n_diaries, count(*) as n from (select survey, mainid, count(*) as n_diaries from raw group by all) c group by all) d
group by n_diaries"""


@query(
    "total_row",
    f"""
with p as ({_PEOPLE})
select cast(n_diaries as varchar) as n_diaries, "early 2016", "June 2020", "August 2020" from p
union all
select 'Total respondents', cast(sum("early 2016") as bigint), cast(sum("June 2020") as bigint), cast(sum("August 2020") as bigint) from p
union all
select 'Total diaries', count(case when survey = 'early 2016' then 1 end), count(case when survey = 'June 2020' then 1 end),
       count(case when survey = 'August 2020' then 1 end) from raw""",
)
def total_row(s):
    return P.respondents_by_wave(s)


_ALL_DIMS = ("sex", "dagegrp", "hied2", "dclasuk")


@query(
    "by_each",
    " union all ".join(
        f"select survey, '{d}' as dimension, {d} as category, {T.weighted_mean('mh')} as mh, count(*) as n from recoded group by survey, {d}"
        for d in _ALL_DIMS
    )
    + f" union all select survey, 'All', 'All', {T.weighted_mean('mh')}, count(*) from recoded group by survey",
    "mh",
)
def by_each(s):
    return A.by_each(
        s.recoded, ["survey"], list(_ALL_DIMS), [A.mean_of("mh").alias("mh"), F.count(F.lit(1)).alias("n")]
    )


@query(
    "weighted_mode",
    """
select cl_desc, dagegrp, n from (
  select cl_desc, dagegrp, coalesce(sum(weight), 0) as n, rank() over (partition by cl_desc order by round_even(coalesce(sum(weight), 0), 9) desc) as rk
  from respondents group by cl_desc, dagegrp) x where rk = 1""",
    "n",
)
def weighted_mode(s):
    return A.weighted_mode(s.sample, "cl_desc", "dagegrp")


@query(
    "n_distinct_if",
    f"""
select diaryid, count(distinct sec_tidied) + max((sec_tidied is null)::int) as n_secondary,
       count(distinct case when activity_group like '%leisure%' then pri_tidied end) as n_leisure,
       count(distinct case when pri_tidied in {in_list(P.OUTSIDE_LEISURE)} then pri_tidied end) as n_outside
from activity group by diaryid""",
)
def n_distinct_if(s):
    return A.n_distinct(
        s.activity,
        "diaryid",
        {
            "n_secondary": ("sec_tidied", None),
            "n_leisure": ("pri_tidied", F.col("activity_group").contains("leisure")),
            "n_outside": ("pri_tidied", F.col("pri_tidied").isin(P.OUTSIDE_LEISURE)),
        },
    )


@query("corr", f"select corr(leisure_media, voracity) as corr from ({T.LEISURE_IND}) x", "corr")
def corr(s):
    return A.correlation(P.leisure_indicators(s.activity), "leisure_media", "voracity")


_ITEMS = ["nq1", "nq2", "nq3", "nq4"]
_VARS = " + ".join(f"var_samp({i})" for i in _ITEMS)
_COVS = " + ".join(f"covar_samp({a}, {b})" for i, a in enumerate(_ITEMS) for b in _ITEMS[i + 1 :])


@query(
    "cronbach_alpha",
    f"""
with people as (
  select * from (select *, row_number() over (partition by mainid order by diaryid) as rn from raw) x where rn = 1),
c as (select ({_VARS}) / 4 as v, ({_COVS}) / 6 as c from people where {' and '.join(f'{i} is not null' for i in _ITEMS)})
select 4 * c / (v + 3 * c) as alpha from c""",
    "alpha",
)
def cronbach_alpha(s):
    return P.health_reliability(s)


@query("mean_entropy", T.entropy("diaries", "cl_desc"), "mean_h prop_max_h")
def mean_entropy(s):
    return A.mean_entropy(s.diaries, "cl_desc", "coded5_activity")


def ecdf_sql(group: str, x: str, lo: int, hi: int, op: str, where: str = "true") -> str:
    return f"""
with d as ({T.SLEEP_MODEL}),
t as (select cast(unnest(range({lo}, {hi + 1})) as int) as time)
select {group}, time, coalesce(sum(case when {x} {op} time then weight end), 0) / nullif(sum(weight), 0) as prop
from d cross join t where {where} group by all"""


@query("weighted_ecdf", ecdf_sql("survey, day_type", "wakeup_time", 1, 48, "<"), "prop")
def weighted_ecdf(s):
    return A.weighted_ecdf(P.sleep_model_data(s), ["survey", "day_type"], "wakeup_time", (1, 48), name="prop")


@query("weighted_ecdf_above", ecdf_sql("survey", "sleeping_time", 1, 144, ">"), "prop")
def weighted_ecdf_above(s):
    return A.weighted_ecdf(P.sleep_model_data(s), "survey".split(), "sleeping_time", (1, 144), "above", name="prop")


@query(
    "weighted_histogram",
    f"""
select hied2, cast(floor(leisure_media / 0.05 + 0.5) as bigint) as bin, count(*) as n, coalesce(sum(weight), 0) as n_weighted
from ({T.MEDIA_DATA}) x group by all""",
    "n_weighted",
)
def weighted_histogram(s):
    return A.weighted_histogram(P.media_data(s), "hied2", "leisure_media", 0.05)


def density_sql(table: str, group: str, x: str, lo: float, hi: float, bw: float, points: int) -> str:
    """Linear binning on the grid, six bandwidths beyond it on either side, and the kernel between bins and points."""
    step = (hi - lo) / (points - 1)
    pad = int(6 * bw / step) + 1
    return f"""
select {group}, p as point, {lo} + p * {step!r}::double as x_at,
       coalesce(sum(case when bin between {-pad} and {points - 1 + pad} then w * exp(-0.5 * pow((p - bin) * {step / bw!r}::double, 2)) end), 0)
         / (sum(w) * {bw * (2 * 3.141592653589793) ** 0.5!r}::double) as density
from (
  select {group}, below + h as bin, sum(weight * case when h = 0 then 1 - part else part end) as w
  from (select {group}, weight, below, least(greatest(place - below, 0.0), 1.0) as part
    from (select {group}, weight, place, greatest(least(floor(place), {points + pad}), {-pad - 2}) as below
      from (select {group}, weight, ({x} - {lo}) / {step!r}::double as place from ({table}) d where {x} is not null and weight is not null) a) b) c
  cross join (values (0), (1)) v(h) group by all) bins
cross join (select cast(unnest(range(0, {points})) as int) as p) g group by all"""


@query("weighted_density", density_sql(T.SPELLS_DATA, "survey", "n_spells", 0.0, 144.0, 3.0, 128), "x_at density")
def weighted_density(s):
    return A.weighted_density(P.spells_data(s), "survey", "n_spells", 0.0, 144.0, 3.0, 128)


def interval_sql(table: str, group: str, x: str, point: str) -> str:
    rows = " union all ".join(
        f"select {group}, {point} as point, {q} as width, quantile_cont({x}, {(1 - q) / 2}) as lower, quantile_cont({x}, {(1 + q) / 2}) as upper "
        f"from ({table}) x group by {group}"
        for q in (0.5, 0.8, 0.95)
    )
    return rows


@query("interval", interval_sql("select * from events", "event_type", "value", "quantile_cont(value, 0.5)"), "point width lower upper")
def interval(s):
    events = s.spark.read.parquet(f"{s.folder}/events.parquet")
    return A.interval(events, "event_type", "value")


@query(
    "interval_mean",
    interval_sql(T.SPELLS, "diaryid", "length", "avg(length)"),
    "point width lower upper",
)
def interval_mean(s):
    # A diary has at most 144 spells, so the built-in percentile is safe.
    return A.interval(W.spells(s.slots), "diaryid", "length", point="mean")


@query(
    "overall_rates",
    """
select count(case when sec_tidied is null then 1 end) / count(*)::double as no_secondary,
       count(case when sec_tidied is not null and pri_tidied <> sec_tidied then 1 end) / count(*)::double as multitasking from activity""",
    "no_secondary multitasking",
)
def overall_rates(s):
    return P.multitasking_rates(s)


@query(
    "any_multitasking",
    f"select count(case when prop_multi > 0 then 1 end) / count(*)::double as any_multi from ({T.MULTI}) m",
    "any_multi",
)
def any_multitasking(s):
    return A.overall_rates(P.multi_data(s), {"any_multi": F.col("prop_multi") > 0})


@query(
    "null_profile",
    " union all ".join(
        f"select '{c}' as \"column\", count(*) - count({c}) as n_missing from slots"
        for c in ("pri", "sec", "loc", "enj", "dev", "whoa", "whob", "whoc", "whod")
    ),
)
def null_profile(s):
    return A.null_profile(s.slots, ["pri", "sec", "loc", "enj", "dev", "whoa", "whob", "whoc", "whod"])


@query("diaries_with_missing", "select distinct diaryid from company where whoa is null")
def diaries_with_missing(s):
    return s.company.filter(F.col("whoa").isNull()).select("diaryid").distinct()


@query(
    "frequency",
    """
select hied4, count(*) as n, case hied4 when 'Higher degree' then 1 when 'First degree' then 2 when 'A Levels' then 3 else 4 end as hied4_ord
from recoded where hied4 is not null group by hied4""",
)
def frequency(s):
    levels = ["Higher degree", "First degree", "A Levels", "Apprenticeship, GCSE or None"]
    return A.frequency(s.recoded, "hied4", levels)


@query("sorted_output", "select dyear, dmonth, ddomonth, count(*) as n from raw group by all order by 1, 2, 3")
def sorted_output(s):
    keys = ["dyear", "dmonth", "ddomonth"]
    return A.sorted_output(A.count_by(s.raw, keys), keys)


# ---- windows -------------------------------------------------------------------------------

_FLAGS = ("pri", "sec", "enj", "dev", "whoa")


@query(
    "change_flags",
    "select diaryid, slot, "
    + ", ".join(f"row_number() over w = 1 or {c} is distinct from lag({c}) over w as {c}" for c in _FLAGS)
    + " from slots window w as (partition by diaryid order by slot)",
)
def change_flags(s):
    return W.change_flags(s.slots.select("diaryid", "slot", *_FLAGS), _FLAGS)


@query("spells", T.SPELLS)
def spells(s):
    return W.spells(s.slots)


@query("spell_stats", T.SPELL_STATS, "sd_length")
def spell_stats(s):
    return W.spell_stats(W.spells(s.slots))


@query(
    "first_last_slot",
    """
select diaryid, min(case when pri_tidied <> 'Sleeping' then slot end) as first_slot,
       max(case when pri_tidied <> 'Sleeping' then slot end) as last_slot from activity group by diaryid""",
)
def first_last_slot(s):
    return W.first_last_slot(s.activity, F.col("pri_tidied") != "Sleeping")


# ---- published tables ----------------------------------------------------------------------


@query(
    "weighting_effect",
    """
with m as (
  select survey, dday, case when dagegrp <> '65+' and econstat <> 'Student' then 'Yes' else 'No' end as in_sample,
         count(*) * 1.0::double as n, coalesce(sum(weight), 0) as n_weighted from raw group by all)
select survey, dday, in_sample, weighted, value from m unpivot include nulls (value for weighted in (n, n_weighted))""",
    "value",
)
def weighting_effect(s):
    return P.weighting_effect(s, "dday")


@query(
    "weighting_effect_age",
    """
with m as (
  select survey, dagegrp, case when dagegrp <> '65+' and econstat <> 'Student' then 'Yes' else 'No' end as in_sample,
         count(*) * 1.0::double as n, coalesce(sum(weight), 0) as n_weighted from raw group by all)
select survey, dagegrp, in_sample, weighted, value from m unpivot include nulls (value for weighted in (n, n_weighted))""",
    "value",
)
def weighting_effect_age(s):
    return P.weighting_effect(s, "dagegrp")


_CHANGES = " union all ".join(
    f"""select survey, wrk_change, '{d}' as dimension, {d if d != 'All' else "'All'"} as category, n,
  n / nullif(sum(n) over (partition by survey{', ' + d if d != 'All' else ''}), 0) as proportion
from (select survey, wrk_change{', ' + d if d != 'All' else ''}, sum(weight) as n from respondents
      where wrk_change <> 'not in work before lockdown' group by all) c_{d}"""
    for d in ("sex", "dagegrp", "hied2", "dclasuk", "All")
)


@query(
    "work_change",
    f"""
select survey, case when wrk_change = 'not working' then 'no longer working' else wrk_change end as wrk_change,
       dimension, category, n, proportion
from ({_CHANGES}) x
where survey <> '2016' and wrk_change in ('full to part time', 'part to full time', 'furlough', 'not working')
  and not regexp_matches(category, 'Not working')""",
    "n proportion",
)
def work_change(s):
    return P.work_change(s)


@query(
    "cluster_profile",
    f"""
with prof as (
  select cl_desc, cluster,
    coalesce(sum(case when sex = 'Female' then weight end), 0) / nullif(sum(weight), 0) as female,
    coalesce(sum(case when has_kids = 'Children' then weight end), 0) / nullif(sum(weight), 0) as with_children,
    coalesce(sum(case when in_work = 'Not Working' then weight end), 0) / nullif(sum(weight), 0) as not_working,
    coalesce(sum(case when hied2 = 'Degree' then weight end), 0) / nullif(sum(weight), 0) as degree,
    coalesce(sum(case when dclasuk = 'Higher managerial and professional' then weight end), 0) / nullif(sum(weight), 0) as higher_professional,
    coalesce(sum(case when dclasuk = 'Intermediate' then weight end), 0) / nullif(sum(weight), 0) as intermediate,
    coalesce(sum(case when dclasuk = 'Routine' then weight end), 0) / nullif(sum(weight), 0) as routine
  from respondents group by all),
age as (
  select cl_desc, dagegrp from (
    select cl_desc, dagegrp, rank() over (partition by cl_desc order by round_even(coalesce(sum(weight), 0), 9) desc) as rk
    from respondents group by cl_desc, dagegrp) x where rk = 1),
ent as ({T.entropy('diaries', 'cl_desc')})
select p.cl_desc, p.cluster, {', '.join(f"round_even({c}, 3) * 100 as {c}" for c in ('female', 'with_children', 'not_working', 'degree', 'higher_professional', 'intermediate', 'routine'))},
       a.dagegrp as modal_age_group, round_even(e.prop_max_h, 3) * 100 as prop_max_h
from prof p full join age a on a.cl_desc is not distinct from p.cl_desc full join ent e on e.cl_desc is not distinct from p.cl_desc""",
    "female with_children not_working degree higher_professional intermediate routine prop_max_h",
)
def cluster_profile(s):
    return P.cluster_profile(s)


@query(
    "cluster_share_by_sex",
    f"""
select survey, sex, cluster, description, n, percent * 100 as percent
from ({share_sql('respondents', 'survey, sex', 'cluster, description', 'percent')}) x
where regexp_matches(description, '^(Rest|Disrupted)') and cluster between 1 and 37""",
    "n percent",
)
def cluster_share_by_sex(s):
    return P.cluster_share_by_wave(s, "^(Rest|Disrupted)", "sex")


@query(
    "cluster_share_by_class",
    f"""
select survey, dclasuk, cluster, description, n, percent * 100 as percent
from ({share_sql('respondents', 'survey, dclasuk', 'cluster, description', 'percent')}) x
where regexp_matches(description, '^Leisure') and cluster between 1 and 37""",
    "n percent",
)
def cluster_share_by_class(s):
    return P.cluster_share_by_wave(s, "^Leisure", "dclasuk")


@query(
    "nonstandard_workdays",
    f"select * from ({share_sql(f'({T.WORKDAYS95}) w', 'survey, sex', 'w9to5', 'prop')}) x where w9to5 = 'Non-standard Workday'",
    "n prop",
)
def nonstandard_workdays(s):
    return P.nonstandard_workdays(s, "sex")


@query(
    "day_types",
    f"""
select *, round_even(prop * 100, 1) as label
from ({share_sql('(select * from respondents where day_type is not null) r', 'survey', 'day_type', 'prop')}) x""",
    "n prop label",
)
def day_types(s):
    return P.day_types(s)


@query(
    "spells_by_day_type",
    f"select day_type, {T.weighted_mean('n_spells')} as mean_n from ({T.SPELLS_DATA}) x group by all",
    "mean_n",
)
def spells_by_day_type(s):
    return P.spells_by(s, ["day_type"])


@query(
    "spells_by_cluster",
    f"select cluster, description, {T.weighted_mean('n_spells')} as mean_n from ({T.SPELLS_DATA}) x group by all",
    "mean_n",
)
def spells_by_cluster(s):
    return P.spells_by(s, ["cluster", "description"])


@query(
    "spells_by_work",
    f"select survey, in_work, {T.weighted_mean('n_spells')} as mean_n from ({T.SPELLS_DATA}) x group by all",
    "mean_n",
)
def spells_by_work(s):
    return P.spells_by(s, ["survey", "in_work"])


@query("sleep_density", density_sql(T.SLEEP_MODEL, "day_type", "sleep_time", 0.0, 144.0, 3.0, 145), "x_at density")
def sleep_density(s):
    """Figure 7.3: hours slept by day type, as a density over slots."""
    return A.weighted_density(P.sleep_model_data(s), "day_type", "sleep_time", 0.0, 144.0, 3.0, 145)


@query("top_k", f"select diaryid, n_spells from ({T.SPELLS_DATA}) x where n_spells is not null order by n_spells desc, diaryid limit 10")
def top_k(s):
    """The ten diaries with the most spells."""
    data = P.spells_data(s).select("diaryid", "n_spells").filter("n_spells is not null")
    return A.top_k(data, 10, [F.desc("n_spells"), F.asc("diaryid")])


@query(
    "spells_by_activity",
    f"""
select sex, coded5, survey, sum(n * weight) as weighted_n_periods
from (
  select r.sex, case when k.activity_group = 'work' then 'work' when k.activity_group like 'unpaid%' then 'unpaid_work'
         when k.activity_group like 'leisure%' then 'leisure' when k.activity_group like 'rest%' then 'rest'
         when k.activity_group is not null then 'other' end as coded5, r.survey, r.diaryid, r.weight, count(*) as n
  from respondents r left join ({T.SPELLS}) p on p.diaryid = r.diaryid left join akey k on k.code = p.pri
  group by all) c group by all""",
    "weighted_n_periods",
)
def spells_by_activity(s):
    return P.spells_by_activity(s)


@query(
    "multitasking_by",
    f"select sex, has_kids, survey, {T.weighted_mean('prop_multi')} as mean_multi from ({T.MULTI}) m where n_multi > 0 group by all",
    "mean_multi",
)
def multitasking_by(s):
    return P.multitasking_by(s, ["sex", "has_kids", "survey"])


@query(
    "multitasking_by_day_type",
    f"""
with m as (select * from ({T.MULTI}) x where prop_multi > 0)
select survey, 'day_type' as dimension, day_type as category, {T.weighted_mean('prop_multi')} as mean_multi
from m where day_type is not null group by all
union all
select survey, 'All Diary Days', 'All Diary Days', {T.weighted_mean('prop_multi')} from m group by all""",
    "mean_multi",
)
def multitasking_by_day_type(s):
    return P.multitasking_by_day_type(s)


@query(
    "multitasking_9_to_5",
    f"select workday95, survey, {T.weighted_mean('prop_multi')} as mean_multi from ({T.MULTI95}) m where n_multi > 0 group by all",
    "mean_multi",
)
def multitasking_9_to_5(s):
    some = P.multi95_data(s).filter(F.col("n_multi") > 0)
    return A.weighted_mean(some, ["workday95", "survey"], {"mean_multi": F.col("prop_multi")})


@query(
    "entropy_and_multitasking",
    f"""
select e.cl_desc, e.mean_h, m.mean_multi, regexp_extract(e.cl_desc, '[0-9]{{1,2}}') as number,
       regexp_extract(e.cl_desc, '[A-Z][^,]*') as "group"
from ({T.entropy('diaries', 'cl_desc')}) e
full join (select cl_desc, {T.weighted_mean('n_multi / 144.0::double')} as mean_multi from ({T.MULTI}) x group by all) m
  on m.cl_desc is not distinct from e.cl_desc
where not regexp_matches(e.cl_desc, '37')""",
    "mean_h mean_multi",
)
def entropy_and_multitasking(s):
    return P.entropy_and_multitasking(s)


@query(
    "health_by_multitasking",
    f"""
select d.*, z.n_obs from ({density_sql(T.MULTI_HEALTH, 'proportion_multitasking', 'mh', 0.0, 4.0, 0.25, 128)}) d
left join (select proportion_multitasking, coalesce(sum(weight), 0) as n_obs from ({T.MULTI_HEALTH}) m group by all) z
  on z.proportion_multitasking = d.proportion_multitasking""",
    "x_at density n_obs",
)
def health_by_multitasking(s):
    return P.health_density(P.multi_health_data(s), "proportion_multitasking", 128)


@query(
    "health_by_media",
    f"""
select d.*, z.n_obs from ({density_sql(T.MEDIA_HEALTH, 'prop_leisure_media', 'mh', 0.0, 4.0, 0.25, 128)}) d
left join (select prop_leisure_media, coalesce(sum(weight), 0) as n_obs from ({T.MEDIA_HEALTH}) m group by all) z
  on z.prop_leisure_media = d.prop_leisure_media""",
    "x_at density n_obs",
)
def health_by_media(s):
    return P.health_density(P.media_health_data(s), "prop_leisure_media", 128)


@query(
    "leisure_variety",
    " union all ".join(
        f"select hied2, survey, workday, '{n}' as location, {T.weighted_mean(x)} as mean_voracity from ({T.VORACITY}) v group by all"
        for n, x in (("inside_leisure", "inside_voracity"), ("outside_leisure", "outside_voracity"))
    ),
    "mean_voracity",
)
def leisure_variety(s):
    return P.leisure_variety(s)


@query(
    "leisure_hours",
    f"""
select hied2, survey, mean_leisure_hours,
       cast(floor(t) as int) || 'h ' || cast(round((t - floor(t)) * 60) as int) || 'm' as label
from (select *, round_even(mean_leisure_hours, 1) as t
      from (select hied2, survey, {T.weighted_mean('leisure_time / 6.0::double')} as mean_leisure_hours from ({T.LEISURE}) l group by all) x) y""",
    "mean_leisure_hours",
)
def leisure_hours(s):
    return P.leisure_hours(s)


@query(
    "working_share",
    f"select * from ({share_sql('respondents', 'survey, hied2', 'in_work', 'prop')}) x where in_work = 'Working'",
    "n prop",
)
def working_share(s):
    return P.working_share(s)


_ZERO = " union all ".join(
    f"""
select {text(v)} as leisure_type,
       coalesce(sum(case when c.n_leisure > 0 and coalesce(c.n_{i}, 0) = 0 then weight end), 0) / nullif(sum(weight), 0) as prop_0
from respondents r left join (
  select diaryid, count(*) as n_leisure, count(case when pri_tidied = {text(v)} then 1 end) as n_{i}
  from activity where activity_group like '%leisure%' group by diaryid) c on c.diaryid = r.diaryid"""
    for i, v in enumerate(LEISURE_LEVELS)
)


@query("zero_leisure", _ZERO, "prop_0")
def zero_leisure(s):
    return P.zero_leisure(s, LEISURE_LEVELS)


@query(
    "media_share",
    """
select count(case when activity_group like '%media%' then 1 end) / count(*)::double as prop_media
from activity where coded5_activity like 'leisure%'""",
    "prop_media",
)
def media_share(s):
    return P.media_share(s)


@query(
    "media_means",
    f"""
select survey, hied2, in_work, avg(leisure_media) as mean_media, {T.weighted_mean('leisure_media')} as mean_media_weighted
from ({T.MEDIA_DATA}) m group by all""",
    "mean_media mean_media_weighted",
)
def media_means(s):
    return P.media_means(s)


@query(
    "woken_by",
    f"""
select *, timestamp '2020-01-01 04:00:00' + to_minutes(10 * time) as clock
from ({ecdf_sql('survey, day_type, hied2', 'wakeup_time', 1, 48, '<')}) e""",
    "prop",
)
def woken_by(s):
    return P.woken_by(s)


@query(
    "awake_after",
    f"""
select *, timestamp '2020-01-01 04:00:00' + to_minutes(10 * time) as clock
from ({ecdf_sql('survey, day_type', 'sleeping_time', 85, 144, '>')}) e""",
    "prop",
)
def awake_after(s):
    return P.awake_after(s)


_STATES = ("rest", "unpaid_work", "other", "work", "leisure")


@query(
    "after_waking",
    f"""
with w as (select diaryid, wakeup_time from ({T.SLEEP_IND}) x),
c as (
  select a.diaryid, {', '.join(f"count(case when coded5_activity = '{v}' then 1 end) / count(*)::double as {v}" for v in _STATES)}
  from activity a join w on w.diaryid = a.diaryid where a.slot between wakeup_time and wakeup_time + 12 group by a.diaryid),
d as (
  select r.*, {', '.join(_STATES)},
    case when h > 4 and h <= 6 then '(4,6]' when h > 6 and h <= 8 then '(6,8]' when h > 8 and h <= 10 then '(8,10]' when h > 10 and h <= 12 then '(10,12]' end as wakeup_bin
  from respondents r left join c on c.diaryid = r.diaryid
  left join (select diaryid, wakeup_time / 6.0::double + 4 as h from w) v on v.diaryid = r.diaryid),
m as (
  select survey, wakeup_bin, workday, hied2, {', '.join(f"{T.weighted_mean(v)} as {v}" for v in _STATES)}
  from d where in_work is not null and wakeup_bin is not null group by all)
select survey, wakeup_bin, workday, hied2, name, value from m unpivot include nulls (value for name in ({', '.join(_STATES)}))""",
    "value",
)
def after_waking(s):
    return P.after_waking(s)


@query(
    "sleep_hours",
    f"""
with d as ({T.SLEEP_MODEL})
select survey, 'day_type' as dimension, day_type as category, {T.weighted_mean('sleep_time')} / 6 as mean_dep from d group by all
union all select survey, 'All Respondents', 'All Respondents', {T.weighted_mean('sleep_time')} / 6 from d group by all""",
    "mean_dep",
)
def sleep_hours(s):
    return P.sleep_hours(s)


_COMPANY = " union all ".join(
    f"select dclasuk, survey, has_kids, {text(label)} as measure, {T.weighted_mean(f'{c} / 6.0::double')} as value from ({T.COMPANY_MODEL}) c group by all"
    for c, label in R.COMPANY_NAMES.items()
)


@query("company_hours", _COMPANY, "value")
def company_hours(s):
    return P.company_hours(s)


def measure_sql(table: str, group: str, x: str, probs: tuple[float, ...]) -> str:
    """Quantiles of weight: the smallest value up to which a share of the group's weight lies."""
    return f"""
select {group}, prob, min(v) as value from (
  select {group}, v, sum(sum(w)) over (partition by {group} order by v) as upto, sum(sum(w)) over (partition by {group}) as total
  from (select {group}, cast({x} as double) as v, cast(weight as decimal(20, 9)) as w from ({table}) d where {x} is not null and weight > 0) a
  group by {group}, v) b
cross join (values {', '.join(f"({p}::double, {p}::decimal(10, 9))" for p in probs)}) q(prob, exact)
where upto >= exact * total group by {group}, prob"""


@query("weighted_quantiles", measure_sql(T.SLEEP_MODEL, "day_type", "sleep_time", (0.05, 0.25, 0.5, 0.75, 0.95)), "value")
def weighted_quantiles(s):
    return A.weighted_quantiles(P.sleep_model_data(s), "day_type", "sleep_time", [0.05, 0.25, 0.5, 0.75, 0.95])


def adaptive_sql(table: str, group: str, x: str, lo: float, hi: float, points: int, adjust: float) -> str:
    """The bandwidths, the bins on the grid, and the kernel between bins and points."""
    step = (hi - lo) / (points - 1)
    return f"""
with known as (select {group}, cast({x} as double) as v, weight from ({table}) d where {x} is not null and weight > 0),
q as ({measure_sql(table, group, x, (0.25, 0.75))}),
iqr as (select {group}, max(case when prob = 0.75 then value end) - max(case when prob = 0.25 then value end) as iqr from q group by {group}),
m as (select {group}, count(*) as n, sqrt(greatest(round(sum(weight * v * v) / sum(weight) - pow(sum(weight * v) / sum(weight), 2), 9), 0)) as sd from known group by {group}),
bw as (
  select m.{group}, 0.9::double * case when least(sd, iqr / 1.34::double) > 0 then least(sd, iqr / 1.34::double) when sd > 0 then sd else 1 end * pow(n, -0.2::double) * {adjust}::double as bandwidth
  from m join iqr on iqr.{group} is not distinct from m.{group}),
bins as (
  select {group}, below + h as bin, sum(weight * case when h = 0 then 1 - part else part end) as w
  from (select {group}, weight, below, least(greatest(place - below, 0.0), 1.0) as part
    from (select {group}, weight, place, greatest(least(floor(place), {2 * points}), {-points - 2}) as below
      from (select {group}, weight, (v - {lo}) / {step!r}::double as place from known) a) b) c
  cross join (values (0), (1)) k(h) group by all)
select bins.{group}, p as point, {lo} + p * {step!r}::double as x_at, bandwidth,
  coalesce(sum(case when bin between {-points} and {2 * points - 1} then w * exp(-0.5 * pow((p - bin) * {step!r}::double / bandwidth, 2)) end), 0)
    / (sum(w) * bandwidth * {(2 * 3.141592653589793) ** 0.5!r}::double) as density
from bins join bw on bw.{group} is not distinct from bins.{group} cross join (select cast(unnest(range(0, {points})) as int) as p) g
group by bins.{group}, p, bandwidth"""


@query("adaptive_density", adaptive_sql(T.SLEEP_MODEL, "day_type", "sleep_time", 0.0, 144.0, 145, 1.2), "x_at bandwidth density")
def adaptive_density(s):
    """Hours slept by day type, a density whose bandwidth follows the group's data."""
    return A.adaptive_density(P.sleep_model_data(s), "day_type", "sleep_time", 0.0, 144.0, 145, 1.2)
