"""The derived data sets in SQL, for checks: each is a statement over the base tables."""

from dayloom.functions import recode as R
from dayloom.plans.reports import MEDIA, OUTSIDE_LEISURE
from dayloom.plans.sql_base import in_list, rule_case, text

_SPELL_COLS = ("pri", "sec", "enj", "dev", "whoa", "whob", "whoc", "whod")
_CHANGED = " or ".join(f"{c} is distinct from lag({c}) over w" for c in _SPELL_COLS)

SPELLS = f"""
select diaryid, period, min(slot) as "begin", max(slot) as "end", max(pri) as pri, max(slot) - min(slot) + 1 as length
from (
  select diaryid, slot, pri, cast(sum(flag) over (partition by diaryid order by slot) as bigint) as period
  from (
    select diaryid, slot, pri,
           case when row_number() over w = 1 or {_CHANGED} then 1 else 0 end as flag
    from slots window w as (partition by diaryid order by slot)) f) p
group by diaryid, period"""

SPELL_STATS = f"""
select diaryid, count(*) as n_spells, stddev_samp(length) as sd_length from ({SPELLS}) sp group by diaryid"""

SPELLS_DATA = f"""
select r.* replace (coalesce(telework, 'Not Workday') as telework), n_spells, sd_length
from respondents r left join ({SPELL_STATS}) x on x.diaryid = r.diaryid"""

MULTI = """
select r.*, coalesce(x.n_multi, 0) as n_multi, coalesce(x.n_multi, 0) / 144.0::double as prop_multi
from respondents r left join (
  select diaryid, count(*) as n_multi from activity
  where sec_tidied is not null and pri_tidied <> sec_tidied group by diaryid) x on x.diaryid = r.diaryid"""

LEISURE_IND = f"""
select diaryid,
       case when bool_or(coded5_activity is null) then null
            else cast(sum(case when coded5_activity like 'leisure%' then 1 else 0 end) as bigint) end as leisure_time,
       nullif(count(distinct case when activity_group like '%leisure%' then pri_tidied end), 0) as voracity,
       case when bool_or(activity_group like '%leisure%') then
         count(distinct case when activity_group like '%leisure%' and pri_tidied in {in_list(OUTSIDE_LEISURE)} then pri_tidied end)
       end as outside_voracity,
       count(case when activity_group like '%leisure%' and pri_tidied = {text(MEDIA)} then 1 end)
         / nullif(cast(count(case when activity_group like '%leisure%' then 1 end) as double), 0) as leisure_media
from activity group by diaryid"""

LEISURE = f"""
select r.*, leisure_time, voracity, outside_voracity, leisure_media
from respondents r left join ({LEISURE_IND}) x on x.diaryid = r.diaryid"""

VORACITY = f"""
select *, voracity - 1 as voracity0, voracity - outside_voracity as inside_voracity
from ({LEISURE}) l where voracity is not null and in_work is not null"""

MEDIA_DATA = f"select * from ({LEISURE}) l where leisure_media is not null and in_work is not null"

MEDIA_HEALTH = f"""
select *, case when leisure_media > 0 and leisure_media <= 0.2 then '(0,0.2]' when leisure_media > 0.2 and leisure_media <= 0.4 then '(0.2,0.4]'
  when leisure_media > 0.4 and leisure_media <= 3 / 5.0 then '(0.4,0.6]' when leisure_media > 3 / 5.0 and leisure_media <= 0.8 then '(0.6,0.8]'
  when leisure_media > 0.8 and leisure_media <= 1 then '(0.8,1]' else '0' end as prop_leisure_media
from ({LEISURE}) l where leisure_media is not null and mh is not null and wrk_now is not null"""

STATUS = """case
  when (pri_tidied = 'Sleeping' or pri_tidied is null) and sec_tidied = 'Sleeping' then 'Sleeping'
  when pri_tidied = 'Sleeping' and sec_tidied is null then 'Sleeping'
  when pri_tidied = 'Sleeping' and sec_tidied is not null and sec_tidied <> 'Sleeping' then 'Half-Sleeping'
  when pri_tidied <> 'Sleeping' and pri_tidied is not null and sec_tidied = 'Sleeping' then 'Half-Sleeping'
  when pri_tidied <> 'Sleeping' or sec_tidied <> 'Sleeping' then 'Not Sleeping' end"""


def _either(label: str) -> str:
    return f"cast(coalesce(sum(case when pri_tidied = {text(label)} or sec_tidied = {text(label)} then 1 end), 0) as bigint)"


SLEEP_IND = f"""
select t.*, w.wakeup_time, w.sleeping_time, w.half_sleep_time
from (
  select diaryid, {_either('Sleeping')} as sleep_time, {_either('Resting')} as rest_time,
         {_either('Paid work including at home')} as work_time, {_either('Work or study break')} as break_time
  from activity group by diaryid) t
left join (
  select diaryid, min(case when sleep_status <> 'Sleeping' then slot end) as wakeup_time,
         max(case when sleep_status <> 'Sleeping' then slot end) as sleeping_time,
         count(case when sleep_status = 'Half-Sleeping' then 1 end) as half_sleep_time
  from (select diaryid, slot, {STATUS} as sleep_status from activity) s
  group by diaryid having count(*) = count(sleep_status)) w on w.diaryid = t.diaryid"""

SLEEP = f"""
select r.*, sleep_time, rest_time, work_time, break_time, wakeup_time, sleeping_time, half_sleep_time
from respondents r left join ({SLEEP_IND}) x on x.diaryid = r.diaryid"""

SLEEP_MODEL = f"select * from ({SLEEP}) sl where day_type is not null"

_IN = " + ".join(
    f"coalesce(cast(not regexp_matches(who{p}, '(not from)|(other household)|Alone') as int), 0)" for p in "abcd"
)
_OUT = " + ".join(
    f"coalesce(cast(regexp_matches(who{p}, '(not from)|(other household)') as int), 0)" for p in "abcd"
)
_MEASURES = ", ".join(
    f"count(case when {c} >= {n} then 1 end) as {c}_Xat_least_{word}"
    for c in ("with_household", "with_not_household")
    for word, n in (("one", 1), ("two", 2), ("three", 3))
)
COMPANY_IND = f"""
select diaryid, {_MEASURES}, cast(sum(with_household) as bigint) as with_household_Xperson_hours,
       cast(sum(with_not_household) as bigint) as with_not_household_Xperson_hours
from (select diaryid, {_IN} as with_household, {_OUT} as with_not_household from company) c group by diaryid"""

COMPANY_MODEL = f"""
select r.*, with_household_Xat_least_one as at_least_one, with_household_Xat_least_two as at_least_two,
       with_household_Xat_least_three as at_least_three, with_household_Xperson_hours as person_hours
from respondents r left join ({COMPANY_IND}) x on x.diaryid = r.diaryid"""

WORKDAYS = f"""
select *, {rule_case('workday_type')} as workday_type, case when day_type = 'Home Workday' then 1 else 0 end as is_teleworkday
from respondents where workday = 'Workday' and day_type is not null"""

WORKDAYS95 = """
select *, case when description like '%Workday 9%' then '9 to 5 Workday' else 'Non-standard Workday' end as w9to5,
       case when description like '%Workday 9%' then 0 else 1 end as is_not_w9to5
from respondents where workday = 'Workday' and dclasuk <> 'Not working or unemployed'"""

ROUTINES = "select *, " + ", ".join(
    f"{rule_case(r)} as {r}" for r in ("unpaid_cluster", "interrupted_cluster", "leisure_cluster", "disr", "disr_unpaid")
) + " from respondents where in_work is not null"

CLUSTER_HEALTH = f"""
select *, {rule_case('cluster_group')} as cluster_group from respondents where mh is not null and wrk_now is not null"""

MULTI95 = f"""
select *, case when description like '%Workday 9 to 5%' then 'Workday 9 to 5' else 'Other Workday' end as workday95
from ({MULTI}) m where workday = 'Workday'"""

MULTI_HEALTH = f"""
select *, case when prop_multi > 0 and prop_multi <= 1 / 3.0::double then '(0,0.333]'
  when prop_multi > 1 / 3.0::double and prop_multi <= 2 / 3.0::double then '(0.333,0.667]'
  when prop_multi > 2 / 3.0::double and prop_multi <= 1 then '(0.667,1]' else '0' end as proportion_multitasking
from ({MULTI}) m where mh is not null and wrk_now is not null"""


def entropy(table: str, group: str) -> str:
    """Mean entropy per group and its share of the maximum."""
    return f"""
select {group}, avg(h) as mean_h, avg(h) / max(k) as prop_max_h
from (
  select {group}, slot, -sum(p * ln(p)) as h
  from (
    select {group}, slot, coded5_activity, n / sum(n) over (partition by {group}, slot)::double as p
    from (select {group}, slot, coded5_activity, count(*) as n from {table} group by all) c) s
  group by {group}, slot) e,
  (select ln(count(distinct coded5_activity) + max((coded5_activity is null)::int)) as k from {table}) m
group by {group}"""


MULTI_ENTROPY = f"""
select m.*, e.mean_h from ({MULTI}) m left join ({entropy('diaries', 'cl_desc')}) e
  on e.cl_desc is not distinct from m.cl_desc"""


def weighted_mean(x: str, w: str = "weight") -> str:
    return f"sum(case when {x} is not null then {w} * ({x}) end) / nullif(sum(case when {x} is not null then {w} end), 0)"
