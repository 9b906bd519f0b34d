"""Queries: sources, reshaping, recodes, filters and joins."""

from pyspark.sql import functions as F

from dayloom.functions import recode as R
from dayloom.operators import aggregate as A
from dayloom.operators import reshape as S
from dayloom.operators import spells as W
from dayloom.operators.effects import CONTRASTS
from dayloom.plans import reports as P
from dayloom.plans import sql_tables as T
from dayloom.plans.registry import query
from dayloom.plans.sql_base import first_word, in_list, pick, rule_case, state_case, text
from dayloom.sources import keys, standin, tables

CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
LEISURE_LEVELS = [
    "Watching tv, video, dvd, music",
    "Reading including e-books",
    "Going out to eat, drink",
    "Walking, Jogging",
]


# ---- sources -------------------------------------------------------------------------------


@query(
    "load_wide",
    "select c_custkey, c_nationkey, c_acctbal, c_mktsegment from customer",
    "c_acctbal",
)
def load_wide(s):
    df = tables.load_wide(s.spark, f"{s.folder}/customer.parquet", CUSTOMER_SCHEMA)
    return df.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(
    "diary_id",
    "select event_id, user_id, row_number() over (order by user_id, ts, event_id) as diaryid from events",
)
def diary_id(s):
    events = s.spark.read.parquet(f"{s.folder}/events.parquet").select("event_id", "user_id", "ts")
    return tables.with_diary_id(events, ["user_id", "ts", "event_id"]).drop("ts")


@query(
    "decode_labels",
    f"""
select s.diaryid, s.slot, a.original_level as pri, s.pri as pri_ord,
       {pick('s.loc - 1', standin.LOCATIONS)} as loc, s.loc as loc_ord,
       {pick('s.whoa - 1', standin.COMPANIONS)} as whoa, s.whoa as whoa_ord
from slots s left join akey a on a.code = s.pri""",
)
def decode_labels(s):
    cols = ["pri", "loc", "whoa"]
    return tables.decode_labels(s.slots.select("diaryid", "slot", *cols), cols, s.codebook)


@query("activity_long", "select diaryid, slot, pri, pri_tidied, activity_group, coded5_activity, sec, sec_tidied, sec_group, loc from activity")
def activity_long(s):
    return s.activity.select(
        "diaryid", "slot", "pri", "pri_tidied", "activity_group", "coded5_activity", "sec", "sec_tidied", "sec_group", "loc"
    )


_RESPONDENT = (
    "diaryid, mainid, survey, weight, dday, sex, dagegrp, econstat, dclasuk, hied2, hied4, econ_status, n_kids, "
    "has_kids, nunder5, n5to11, n12to16, mh, wrk_before, wrk_now, wrk_change, in_work, cluster60, cluster, "
    "description, cl_desc, workday, telework, teleworkday, day_type"
)


@query("respondent_data", f"select {_RESPONDENT} from respondents", "weight mh")
def respondent_data(s):
    return s.respondents.select(*_RESPONDENT.split(", "))


# ---- reshape -------------------------------------------------------------------------------


@query("unpivot_slots", "select diaryid, slot, pri from slots")
def unpivot_slots(s):
    return S.unpivot_slots(standin.wide_diaries(s.spark, s.folder, ("pri",)), "pri", "pri")


@query("unpivot_measures", "select diaryid, slot, pri, sec, loc from slots")
def unpivot_measures(s):
    wide = standin.wide_diaries(s.spark, s.folder, ("pri", "sec", "loc"))
    return S.unpivot_measures(wide, ["pri", "sec", "loc"])


@query(
    "who_long",
    "select diaryid, slot, who_index, who_value from company unpivot include nulls (who_value for who_index in (whoa, whob, whoc, whod))",
)
def who_long(s):
    return S.unpivot(s.company, ["whoa", "whob", "whoc", "whod"], "who_index", "who_value")


_LEISURE_SQL = f"""
select diaryid, pri_tidied, n / sum(n) over (partition by diaryid)::double as prop
from (select diaryid, pri_tidied, count(*) as n from activity where activity_group like '%leisure%' group by all) c"""
_LEISURE_WIDE = "select diaryid, " + ", ".join(
    f"coalesce(max(case when pri_tidied = {text(v)} then prop end), 0) as \"{v}\"" for v in LEISURE_LEVELS
) + f" from ({_LEISURE_SQL}) x group by diaryid"
_SHORT = dict(zip(LEISURE_LEVELS, ("media", "reading", "going_out", "walking")))


@query(
    "pivot_fill",
    "select diaryid, " + ", ".join(f'"{v}" as {n}' for v, n in _SHORT.items()) + f" from ({_LEISURE_WIDE}) y",
    "media reading going_out walking",
)
def pivot_fill(s):
    leisure = s.activity.filter(F.col("activity_group").contains("leisure"))
    shares = A.plain_share(leisure, "diaryid", "pri_tidied", "prop")
    return S.pivot_fill(shares, "diaryid", "pri_tidied", "prop", _SHORT, 0.0)


_WAVES = {"2016": "w2016", "June 2020": "june", "August 2020": "august"}


@query(
    "pivot_wide",
    "select dclasuk, sex, " + ", ".join(f"max(case when survey = {text(k)} then n end) as {v}" for k, v in _WAVES.items())
    + " from (select dclasuk, sex, survey, count(*) as n from recoded group by all) c group by all",
)
def pivot_wide(s):
    return S.pivot_wide(A.count_by(s.recoded, ["dclasuk", "sex", "survey"]), ["dclasuk", "sex"], "survey", "n", _WAVES)


@query(
    "unpivot_measures_summary",
    """
with m as (select survey, sex, count(*) * 1.0::double as n, coalesce(sum(weight), 0) as n_weighted from raw group by all)
select survey, sex, weighted, value from m unpivot include nulls (value for weighted in (n, n_weighted))""",
    "value",
)
def unpivot_measures_summary(s):
    cells = A.weighted_count(s.raw, ["survey", "sex"]).withColumn("n", F.col("n").cast("double"))
    return S.unpivot(cells, ["n", "n_weighted"], "weighted", "value")


@query(
    "complete_grid",
    """
with cells0 as (select cluster, slot, coded5_activity, count(*) as n from diaries group by all)
select c.cluster, s.slot, v.coded5_activity, coalesce(x.n, 0) as n
from (select distinct cluster from cells0) c
cross join (select distinct slot from cells0) s
cross join (select distinct coded5_activity from cells0) v
left join cells0 x on x.cluster is not distinct from c.cluster and x.slot = s.slot
  and x.coded5_activity is not distinct from v.coded5_activity""",
)
def complete_grid(s):
    cells = A.count_by(s.diaries, ["cluster", "slot", "coded5_activity"])
    return S.complete_grid(cells, ["cluster", "slot", "coded5_activity"], {"n": 0})


@query(
    "drop_null_columns",
    """
with answered as (
  select id as diaryid, name, value from (select diaryid as id, columns(*)::varchar from raw) r
  unpivot include nulls (value for name in (columns(* exclude id))))
select diaryid, name, value from answered where name in (select name from answered group by name having count(*) = count(value))""",
)
def drop_null_columns(s):
    """Every row of the columns that are complete, one value a row: which columns they are depends on the data."""
    kept = S.drop_null_columns(s.raw)
    cells = [F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in kept.columns]
    return kept.select("diaryid", F.inline(F.array(*cells)))


@query(
    "explode_grid",
    "select r.diaryid, cast(g.t as int) as t from raw r cross join (select unnest(range(1, 49)) as t) g",
)
def explode_grid(s):
    return S.explode_grid(s.raw.select("diaryid"), "t", 1, 48)


@query(
    "union_by_name",
    """
select 'weekday' as source, dday as name, null as dagegrp, count(*) as n from raw group by dday
union all select 'age' as source, null, dagegrp, count(*) from raw group by dagegrp""",
)
def union_by_name(s):
    days = A.count_by(s.raw, "dday").withColumnRenamed("dday", "name")
    return S.union_by_name({"weekday": days, "age": A.count_by(s.raw, "dagegrp")}, "source")


# ---- recodes -------------------------------------------------------------------------------


@query(
    "slot_to_time",
    """
select diaryid, slot, timestamp '2020-01-01 04:00:00' + to_minutes(10 * (slot - 1)) as slot_start,
       timestamp '2020-01-01 04:00:00' + to_minutes(10 * slot) as slot_end from slots""",
)
def slot_to_time(s):
    return s.slots.select(
        "diaryid", "slot", R.slot_to_time("slot").alias("slot_start"), R.slot_to_time("slot", edge="end").alias("slot_end")
    )


@query("code5", f"select diaryid, slot, {state_case('activity_group')} as coded5 from activity")
def code5(s):
    return s.activity.select("diaryid", "slot", R.code5("activity_group").alias("coded5"))


@query(
    "econ_status",
    f"""
select diaryid, case when w in ('owner', 'Self-employed', 'Employed') then 'In Employment' when w = 'Unemployed' then 'Unemployed'
         when w in ('Student', 'Homemaker', 'Retired') then 'Inactive' end as as_written,
       case when w in ('owner', 'Self-employed', 'Employed') then 'In Employment' when w in ('Unemployed', 'Casual') then 'Unemployed'
         when w in ('Student', 'Homemaker', 'Retired') then 'Inactive' end as with_casual
from (select diaryid, {first_word('econstat', R.ECON_PATTERN)} as w from raw) x""",
)
def econ_status(s):
    return s.raw.select(
        "diaryid", R.econ_status("econstat").alias("as_written"), R.econ_status("econstat", True).alias("with_casual")
    )


@query("employment_change", "select diaryid, wrk_before, wrk_now, wrk_change from recoded")
def employment_change(s):
    return s.raw.select(
        "diaryid",
        R.work_before("empbfore").alias("wrk_before"),
        R.work_now("emplnow").alias("wrk_now"),
        R.employment_change("empbfore", "emplnow").alias("wrk_change"),
    )


@query("recode", "select diaryid, survey, dclasuk from recoded")
def recode(s):
    return s.raw.select(
        "diaryid", R.recode("survey", R.SURVEY_NAMES).alias("survey"), R.recode("dclasuk", R.CLASS_NAMES).alias("dclasuk")
    )


@query("qualification", "select diaryid, hied2, hied4 from recoded")
def qualification(s):
    return s.raw.select("diaryid", R.qualification("hied", 2).alias("hied2"), R.qualification("hied").alias("hied4"))


@query(
    "in_work",
    """
select diaryid, in_work, case when survey = '2016' then in_work when wrk_now is null then null else in_work end as in_work_strict
from recoded""",
)
def in_work(s):
    return s.recoded.select(
        "diaryid", "in_work", R.in_work("survey", "econ_status", "wrk_now", strict=True).alias("in_work_strict")
    )


@query("day_type", "select diaryid, workday, telework, teleworkday, day_type from respondents")
def day_type(s):
    return s.respondents.select("diaryid", "workday", "telework", "teleworkday", "day_type")


@query("child_flags", "select diaryid, n_kids, has_kids, nunder5, n5to11, n12to16 from recoded")
def child_flags(s):
    cols = ["nunder5", "n5to11", "n12to16"]
    return s.raw.withColumns(R.child_flags(cols)).select("diaryid", "n_kids", "has_kids", *cols)


@query("row_mean", "select diaryid, mh from recoded", "mh")
def row_mean(s):
    return s.raw.select("diaryid", R.row_mean(["nq1", "nq2", "nq3", "nq4"]).alias("mh"))


@query("workday_flag", "select diaryid, cluster, workday, cl_desc from recoded")
def workday_flag(s):
    named = s.raw.select("diaryid").join(s.clusters.withColumnRenamed("label", "diaryid"), "diaryid", "left")
    return named.select(
        "diaryid", "cluster", R.workday("cluster").alias("workday"), R.cluster_label("cluster", "description").alias("cl_desc")
    )


_RULES = list(R.ROUTINE_RULES)


@query("routine_group", "select diaryid, " + ", ".join(f"{rule_case(r)} as {r}" for r in _RULES) + " from recoded")
def routine_group(s):
    return s.recoded.select("diaryid", *[R.routine_group(r).alias(r) for r in _RULES])


@query(
    "cut_right",
    f"select diaryid, proportion_multitasking from ({T.MULTI_HEALTH}) x",
)
def cut_right(s):
    return P.multi_health_data(s).select("diaryid", "proportion_multitasking")


@query(
    "hours_label",
    """
select diaryid, cast(floor(t) as int) || 'h ' || cast(round((t - floor(t)) * 60) as int) || 'm' as label
from (select diaryid, round_even(leisure_slots / 6.0::double, 1) as t
      from (select diaryid, count(case when coded5_activity = 'leisure' then 1 end) as leisure_slots from activity group by diaryid) c) x""",
)
def hours_label(s):
    slots = A.slot_totals(s.activity, {"n": F.col("coded5_activity") == "leisure"})
    return slots.select("diaryid", R.hours_label(F.col("n") / 6.0).alias("label"))


_MEAN_RANK = f"""
select cl_desc, order_value,
  case when cl_desc is not null then dense_rank() over (partition by cl_desc is null order by order_value nulls last) end as cl_desc_ord
from (select cl_desc, round_even(avg(mh), 9) as order_value from respondents group by cl_desc) x"""


@query("level_order", _MEAN_RANK, "order_value")
def level_order(s):
    return S.reorder_levels(s.sample, "cl_desc", F.bround(F.avg("mh"), 9))


@query(
    "fixed_levels",
    """
select diaryid, dagegrp, case dagegrp when '18-39' then 1 when '40-64' then 2 when '65+' then 3 end as dagegrp_ord,
       survey, case survey when '2016' then 1 when 'June 2020' then 2 when 'August 2020' then 3 end as survey_ord from respondents""",
)
def fixed_levels(s):
    df = S.with_level_order(s.sample.select("diaryid", "dagegrp", "survey"), "dagegrp", ["18-39", "40-64", "65+"], True)
    return S.with_level_order(df, "survey", R.SURVEYS)


@query(
    "text_labels",
    """
select diaryid, regexp_replace(survey, 'early ', '') as survey, upper(substr(sex, 1, 1)) || lower(substr(sex, 2)) || ' / ' || dagegrp as label,
       regexp_matches(econstat, '^Employed') as employed from raw""",
)
def text_labels(s):
    return s.raw.select(
        "diaryid",
        F.regexp_replace("survey", "early ", "").alias("survey"),
        F.concat(F.initcap("sex"), F.lit(" / "), F.col("dagegrp")).alias("label"),
        F.col("econstat").rlike("^Employed").alias("employed"),
    )


@query("sleep_status", f"select diaryid, slot, {T.STATUS} as sleep_status from activity")
def sleep_status(s):
    return s.activity.select("diaryid", "slot", R.sleep_status("pri_tidied", "sec_tidied").alias("sleep_status"))


# ---- filters -------------------------------------------------------------------------------


@query(
    "in_sample",
    """
select diaryid, case when dagegrp <> '65+' and econstat <> 'Student' then 'Yes' else 'No' end as in_sample from raw""",
)
def in_sample(s):
    return s.raw.select("diaryid", R.in_sample_flag("dagegrp", "econstat").alias("in_sample"))


_CLUSTER_SHARE = """
select survey, cluster, description, n, n / sum(n) over (partition by survey) * 100 as percent
from (select survey, cluster, description, coalesce(sum(weight), 0) as n from respondents group by all) c"""


@query(
    "filter_matches",
    f"select * from ({_CLUSTER_SHARE}) x where regexp_matches(description, '^Workday') and cluster between 1 and 37",
    "n percent",
)
def filter_matches(s):
    return P.cluster_share_by_wave(s, "^Workday")


@query("complete_cases", "select diaryid, mh, wrk_now from recoded where mh is not null and wrk_now is not null", "mh")
def complete_cases(s):
    return A.complete_cases(s.recoded.select("diaryid", "mh", "wrk_now"), ["mh", "wrk_now"])


@query(
    "drop_groups_with_null",
    """
select diaryid, slot, pri_tidied from activity a
where not exists (select 1 from activity b where b.diaryid = a.diaryid and b.pri_tidied is null)""",
)
def drop_groups_with_null(s):
    return W.drop_groups_with_null(s.activity.select("diaryid", "slot", "pri_tidied"), "pri_tidied")


@query(
    "first_per_key",
    """
select mainid, diaryid, survey, weight from (
  select *, row_number() over (partition by mainid order by diaryid) as rn from raw) x where rn = 1""",
    "weight",
)
def first_per_key(s):
    return A.first_per_key(s.raw.select("mainid", "diaryid", "survey", "weight"), "mainid", ["diaryid"])


@query("distinct_rows", "select distinct cluster, description from recoded")
def distinct_rows(s):
    return s.recoded.select("cluster", "description").dropDuplicates()


@query(
    "slots_after",
    f"""
select a.diaryid, a.slot, w.wakeup_time, a.coded5_activity
from activity a join ({T.SLEEP_IND}) w on w.diaryid = a.diaryid
where a.slot between w.wakeup_time and w.wakeup_time + 12""",
)
def slots_after(s):
    wake = P.sleep_indicators(s.activity).select("diaryid", "wakeup_time")
    return W.slots_after(s.activity.select("diaryid", "slot", "coded5_activity"), wake, "wakeup_time")


# ---- joins ---------------------------------------------------------------------------------


@query(
    "lookup_join",
    "select s.diaryid, s.slot, k.pri_tidied, k.activity_group from slots s left join akey k on k.code = s.pri",
)
def lookup_join(s):
    labelled = tables.decode_labels(s.slots.select("diaryid", "slot", "pri"), ["pri"], s.codebook)
    return A.lookup_join(labelled, keys.activity_key(s.spark), "pri", "original_level").select(
        "diaryid", "slot", "pri_tidied", "activity_group"
    )


@query(
    "full_join",
    f"""
with age as (
  select cl_desc, dagegrp from (
    select cl_desc, dagegrp, rank() over (partition by cl_desc order by round_even(sum(weight), 9) desc) as rk
    from respondents group by cl_desc, dagegrp) x where rk = 1),
entropy as ({T.entropy('diaries', 'cl_desc')})
select coalesce(a.cl_desc, e.cl_desc) as cl_desc, a.dagegrp, e.mean_h
from age a full join entropy e on e.cl_desc is not distinct from a.cl_desc""",
    "mean_h",
)
def full_join(s):
    from dayloom.functions.semantics import join_null_safe

    age = A.weighted_mode(s.sample, "cl_desc", "dagegrp").select("cl_desc", "dagegrp")
    entropy = A.mean_entropy(s.diaries, "cl_desc", "coded5_activity").select("cl_desc", "mean_h")
    return join_null_safe(age, entropy, ["cl_desc"], "full")


@query(
    "sample_join",
    f"""
select r.diaryid, l.leisure_time, l.voracity, sp.n_spells
from respondents r left join ({T.LEISURE_IND}) l on l.diaryid = r.diaryid left join ({T.SPELL_STATS}) sp on sp.diaryid = r.diaryid""",
)
def sample_join(s):
    leisure = P.leisure_indicators(s.activity).select("diaryid", "leisure_time", "voracity")
    stats = W.spell_stats(W.spells(s.slots)).select("diaryid", "n_spells")
    return A.sample_join(s.sample.select("diaryid"), [leisure, stats])


@query(
    "company_long",
    f"""
with c as ({T.COMPANY_IND})
select diaryid, case when measure like 'with_household%' then 'with_household' else 'with_not_household' end as household,
       split_part(measure, '_X', 2) as measure, value
from c unpivot include nulls (value for measure in (columns(* exclude (diaryid))))""",
)
def company_long(s):
    totals = A.company_slots(s.company)
    long = S.unpivot(totals, [c for c in totals.columns if c.startswith("with_")], "measure", "value")
    return S.split_name(long, "measure", ("household", "measure"))


@query(
    "column_helpers",
    """
select diaryid, nq1 as "% health_1", nq2 as "% health_2", nq3 as "% health_3", nq4 as "% health_4",
       n5to11 as children_5to11_raw, n12to16 as children_12to16_raw, sex as answer_sex, dagegrp as answer_dagegrp
from raw""",
)
def column_helpers(s):
    """Columns chosen by range, pattern and kind, and renamed by pattern, prefix and suffix."""
    health = S.columns_matching(s.raw, r"^nq[0-9]$", "numeric")
    children = S.columns_matching(s.raw, r"^n[0-9]+to", but=["nunder5"])
    picked = s.raw.select("diaryid", *S.columns_between(s.raw.select(*health), "nq1", "nq4"), *children, *S.columns_matching(s.raw, "^(sex|dagegrp)$", "string"))
    named = S.rename_with(picked, ("^nq", "health_"), health)
    named = S.add_affix(named, prefix="% ", cols=S.columns_matching(named, "^health_", "numeric"))
    named = S.rename_with(named, (r"^n(\d+to)", r"children_\1"))
    named = S.add_affix(named, suffix="_raw", cols=S.columns_matching(named, "^children_"))
    return S.add_affix(named, prefix="answer_", cols=["sex", "dagegrp"])
