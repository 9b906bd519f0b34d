"""The base tables in SQL, for checking the Spark results with another engine."""

from dayloom.functions import recode as R
from dayloom.sources import keys, standin


def text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join(
        "(" + ", ".join(text(c) if isinstance(c, str) else "null" if c is None else str(c) for c in r) + ")" for r in rows
    )


def pick(index: str, items) -> str:
    return f"case {index} " + " ".join(f"when {i} then {text(v)}" for i, v in enumerate(items)) + " end"


def in_list(items) -> str:
    return "(" + ", ".join(text(i) if isinstance(i, str) else str(i) for i in items) + ")"


def code_case() -> str:
    cases = [
        f"when event_type = {text(e)} and k % 3 = {i} then {standin.ACTIVITY_CODES[label]}"
        for e, labels in standin.EVENT_ACTIVITIES.items()
        for i, label in enumerate(labels)
    ]
    return "case " + " ".join(cases) + " end"


def rule_case(rule: str) -> str:
    """A routine category as SQL. DuckDB has no lookahead, so the one negated test is spelled out."""
    rules, fallback = R.ROUTINE_RULES[rule]
    cases = []
    for name, test in rules:
        if isinstance(test, list):
            cond = f"cluster in {in_list(test)}"
        elif name == "9to5WithLeisure":
            cond = "cl_desc like '%9 to 5%' and cl_desc not like '%no leisure%'"
        else:
            cond = f"regexp_matches(cl_desc, {text(test)})"
        cases.append(f"when {cond} then {text(name)}")
    return "case " + " ".join(cases) + f" else {text(fallback)} end"


def state_case(group: str) -> str:
    return (
        f"case when {group} = 'work' then 'work' when {group} like 'unpaid%' then 'unpaid_work' "
        f"when {group} like 'leisure%' then 'leisure' when {group} like 'rest%' then 'rest' "
        f"when {group} is not null then 'other' end"
    )


def first_word(col: str, pattern: str) -> str:
    return f"nullif(regexp_extract({col}, {text(pattern)}), '')"


ACTIVITY_ROWS = values((i, *row) for i, row in enumerate(keys.ACTIVITY_KEY, 1))
CLASS_CASE = "case c_mktsegment " + " ".join(f"when {text(k)} then {text(v)}" for k, v in standin.CLASSES.items()) + " end"
CLASS_NAME_CASE = "case dclasuk " + " ".join(f"when {text(k)} then {text(v)}" for k, v in R.CLASS_NAMES.items()) + " else dclasuk end"
HEALTH = ", ".join(
    f"case when c_custkey % {gap} <> 0 then cast(1 + (c_custkey * {step} + c_nationkey) % 5 as int) end as nq{i}"
    for i, (step, gap) in enumerate([(3, 17), (7, 19), (11, 23), (13, 17)], 1)
)
WHO_LABELS = ", ".join(
    f"{pick(f'who{p} - 1', standin.COMPANIONS)} as who{p}" for p in "abcd"
)

BASE = f"""
ev as (
  select user_id as diaryid, event_id, event_type, value,
         1 + cast(floor(date_diff('second', timestamp '{standin.START}', ts) / {float(standin.SLOT_SECONDS)}) as int) as slot,
         cast(regexp_extract(props, '[0-9]+') as int) as k
  from events),
coded as (
  select *, {code_case()} as code from ev where slot between 1 and {standin.SLOTS}),
cells as (
  select diaryid, slot, arg_max(code, event_id) as pri0, min(code) as mn, max(code) as mx,
         arg_max(value, event_id) as v, arg_max(k, event_id) as k
  from coded group by diaryid, slot),
grid as (
  select d.diaryid, g.slot
  from (select distinct diaryid from coded) d
  cross join (select cast(unnest(range(1, {standin.SLOTS + 1})) as int) as slot) g),
filled as (
  select g.diaryid, g.slot, c.pri0, c.mn, c.mx, c.k,
         last_value(c.pri0 ignore nulls) over w as pri,
         last_value(c.v ignore nulls) over w as v
  from grid g left join cells c on c.diaryid = g.diaryid and c.slot = g.slot
  window w as (partition by g.diaryid order by g.slot rows between unbounded preceding and current row)),
slots as (
  select diaryid, slot, pri,
         case when mn <> pri0 then mn when mx <> pri0 then mx end as sec,
         case when v < 15 then 1 when v < 60 then 2 end as loc,
         1 + k % 7 as enj,
         case k % 2 when 0 then 1 when 1 then 2 end as dev,
         1 + k % 4 as whoa,
         case when k % 3 = 1 then 5 end as whob,
         case when k % 5 = 2 then 6 end as whoc,
         cast(null as int) as whod
  from filled),
akey(code, original_level, pri_tidied, activity_group) as (values {ACTIVITY_ROWS}),
activity as (
  select s.diaryid, s.slot, p.original_level as pri, q.original_level as sec,
         {pick('s.loc - 1', standin.LOCATIONS)} as loc,
         s.enj, s.dev, s.whoa, s.whob, s.whoc, s.whod,
         p.pri_tidied, p.activity_group, q.pri_tidied as sec_tidied, q.activity_group as sec_group,
         {state_case('p.activity_group')} as coded5_activity
  from slots s left join akey p on p.code = s.pri left join akey q on q.code = s.sec),
company as (select diaryid, slot, {WHO_LABELS} from slots),
raw as (
  select u.diaryid, cast(floor(u.diaryid / 2.0) as bigint) as mainid,
         {pick('u.diaryid % 3', standin.WAVES)} as survey,
         case when c_custkey % 50 <> 49 then round_even((abs(c_acctbal) + 100) / 5000.0, 4) end as weight,
         {pick('u.diaryid % 7', standin.WEEKDAYS)} as dday,
         cast(1 + u.diaryid % 28 as int) as ddomonth,
         cast(case when u.diaryid % 3 = 0 then 2 + u.diaryid % 2 when u.diaryid % 3 = 1 then 6 else 8 end as int) as dmonth,
         cast(case when u.diaryid % 3 = 0 then 2016 else 2020 end as int) as dyear,
         case when c_nationkey % 2 = 0 then 'Female' else 'Male' end as sex,
         case when c_nationkey % 6 = 5 then '65+' when c_nationkey % 6 < 3 then '18-39' else '40-64' end as dagegrp,
         {pick('c_custkey % 10', standin.ECON)} as econstat,
         {CLASS_CASE} as dclasuk,
         {pick('c_custkey % 7', standin.HIED)} as hied,
         {pick('c_custkey % 5', standin.NOW)} as emplnow,
         {pick('c_nationkey % 4', standin.BEFORE)} as empbfore,
         case when c_custkey % 13 <> 0 then cast(c_nationkey % 3 as int) end as nunder5,
         case when c_custkey % 4 = 0 then 1 else 0 end as n5to11,
         case when c_custkey % 5 <> 0 then 0 end as n12to16,
         {HEALTH}, 3 as nq5_1
  from (select distinct user_id as diaryid from events) u join customer c on c.c_custkey = u.diaryid),
rkey(original_cluster, description) as (values {values(keys.RECLUSTER_KEY)}),
routines as (
  select k.original_cluster, k.description, m.cluster
  from rkey k join (
    select description, cast(dense_rank() over (order by quantile_cont(original_cluster, 0.5)) as int) as cluster
    from rkey group by description) m on m.description = k.description),
rawclusters as (
  select user_id as label, cast(1 + (user_id * 7) % 60 as int) as cluster60
  from (select distinct user_id from events) where user_id % 29 <> 0),
clusters as (
  select r.label, r.cluster60, t.description, t.cluster
  from rawclusters r left join routines t on t.original_cluster = r.cluster60),
statuses as (
  select r.*, c.cluster60, c.cluster, c.description,
         {first_word('empbfore', R.BEFORE_PATTERN)} as before0,
         {first_word('emplnow', R.NOW_PATTERN)} as wrk_now,
         {first_word('econstat', R.ECON_PATTERN)} as econ0,
         {first_word('hied', R.QUALIFICATION_PATTERN)} as hied0,
         coalesce(nunder5, 0) + coalesce(n5to11, 0) + coalesce(n12to16, 0) as n_kids,
         (coalesce(nq1 - 1, 0) + coalesce(nq2 - 1, 0) + coalesce(nq3 - 1, 0) + coalesce(nq4 - 1, 0))
           / nullif(cast((nq1 is not null)::int + (nq2 is not null)::int + (nq3 is not null)::int + (nq4 is not null)::int as double), 0) as mh
  from raw r left join clusters c on c.label = r.diaryid),
worked as (
  select *, case when before0 = 'wasn''t working' then 'not working' else before0 end as wrk_before from statuses),
recoded0 as (
  select diaryid, mainid, case when survey = 'early 2016' then '2016' else survey end as survey, weight, dday,
         ddomonth, dmonth, dyear, sex, dagegrp, econstat, {CLASS_NAME_CASE} as dclasuk, hied,
         case when nunder5 > 0 then 'Yes' when nunder5 is not null then 'No' end as nunder5,
         case when n5to11 > 0 then 'Yes' when n5to11 is not null then 'No' end as n5to11,
         case when n12to16 > 0 then 'Yes' when n12to16 is not null then 'No' end as n12to16,
         cluster60, description, cluster, mh, wrk_before, wrk_now,
         case when wrk_before = 'full time' and wrk_now = 'part time' then 'full to part time'
              when wrk_before = 'part time' and wrk_now = 'full time' then 'part to full time'
              when wrk_before in ('full time', 'part time') then wrk_now
              when wrk_before = 'not working' then 'not in work before lockdown'
              when wrk_before is null or wrk_now is null then null else 'Other' end as wrk_change,
         case when hied0 in ('Higher degree', 'First degree') then 'Degree' when hied0 is not null then 'No Degree' end as hied2,
         case when hied0 = 'f' then 'A Levels'
              when hied0 in ('Apprenticeship', 'GCSE', 'No qualifications') then 'Apprenticeship, GCSE or None'
              else hied0 end as hied4,
         case when econ0 in ('owner', 'Self-employed', 'Employed') then 'In Employment'
              when econ0 = 'Unemployed' then 'Unemployed'
              when econ0 in ('Student', 'Homemaker', 'Retired') then 'Inactive' end as econ_status,
         case when cluster in {in_list(R.WORKDAY_CLUSTERS)} then 'Workday' else 'Not Workday' end as workday,
         cluster || ': ' || description as cl_desc,
         n_kids, case when n_kids > 0 then 'Children' else 'No Children' end as has_kids
  from worked),
recoded as (
  select *, case when survey = '2016' and econ_status = 'In Employment' then 'Working'
                 when survey = '2016' and econ_status <> 'In Employment' then 'Not Working'
                 when survey <> '2016' and wrk_now in ('full time', 'part time') then 'Working'
                 when survey <> '2016' then 'Not Working' end as in_work
  from recoded0),
telework as (
  select diaryid, case when count(case when loc = 'Home' then 1 end) * 1.0 / count(*) > 0.5
                       then 'Home Workday' else 'Outside Workday' end as telework
  from activity where activity_group = 'work' group by diaryid),
respondents as (
  select r.*, t.telework,
         case when workday = 'Not Workday' then 'Not Workday' when workday = 'Workday' then telework end as teleworkday,
         case when workday = 'Not Workday' and in_work = 'Working' then 'Not Workday, Working'
              when workday = 'Not Workday' and in_work = 'Not Working' then 'Not Workday, Not Working'
              when workday = 'Workday' then telework end as day_type
  from recoded r left join telework t on t.diaryid = r.diaryid
  where dagegrp <> '65+' and econstat <> 'Student'),
diaries as (
  select a.slot, a.pri_tidied, a.activity_group, a.coded5_activity, a.sec_tidied, r.*
  from activity a join respondents r on r.diaryid = a.diaryid)
""".strip()


def with_base(body: str) -> str:
    """A statement over the base tables; a body may add tables by starting with 'with'."""
    stripped = body.strip()
    if stripped.startswith("with "):
        return f"with {BASE},\n{stripped[5:]}"
    return f"with {BASE}\n{stripped}"
