"""Recodes of survey answers and slots into analysis categories."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.functions.semantics import col, first_match, half_even, is_in, is_true, signif

# Answer patterns and category names used by the recodes below.
ECON_PATTERN = "Self-employed|Employed|owner|Student|Casual|Homemaker|Retired|Unemployed"
BEFORE_PATTERN = "full time|part time|wasn't working"
NOW_PATTERN = "full time|part time|not working|furlough"
QUALIFICATION_PATTERN = "Higher degree|First degree|f|GCSE|Apprenticeship|No qualifications"
NOT_HOUSEHOLD_PATTERN = "(not from)|(other household)"
ALONE_LABEL = "Alone"
CLASS_NAMES = {
    "Higher managerial, administrative and professional occupatio": "Higher managerial and professional",
    "Intermediate occupations": "Intermediate",
    "Routine and manual occupations": "Routine",
    "Not working, never worked and long-term unemployed": "Not working or unemployed",
    "STUDENT": "Student",
}
SURVEY_NAMES = {"early 2016": "2016"}
COMPANY_NAMES = {
    "at_least_one": "At least one",
    "at_least_two": "At least two",
    "at_least_three": "At least three",
    "person_hours": "Person-Hours",
}
WORKDAY_CLUSTERS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 36]
STATES = ["work", "unpaid_work", "other", "leisure", "rest"]
SURVEYS = ["2016", "June 2020", "August 2020"]
DAY_TYPES = ["Not Workday, Not Working", "Not Workday, Working", "Outside Workday", "Home Workday"]

# Routine categories as (category, cluster numbers or description pattern).
ROUTINE_RULES = {
    "workday_type": (
        [
            ("SecondShift", [6]),
            ("Morning", [1, 2, 3]),
            ("NoLeisure", [8, 9, 15]),
            ("Afternoon", [12, 13, 14]),
            ("9to5", "9 to 5"),
        ],
        "OtherWorkday",
    ),
    "unpaid_cluster": (
        [("c32", [32]), ("UnpaidAndLeisure", [16, 18]), ("UnpaidWorkday", [21, 22, 23])],
        "other",
    ),
    "interrupted_cluster": (
        [
            ("LeisureInterrupted", [17, 30]),
            ("LeisureSlightlyInterrupted", [29]),
            ("LeisureAllDay", [28, 33]),
        ],
        "other",
    ),
    "leisure_cluster": ([(str(c), [c]) for c in (17, 28, 29, 30, 32, 33)], "other"),
    "disr": ([(str(c), [c]) for c in (19, 20, 26, 27, 34, 35, 37)], "other"),
    "disr_unpaid": ([("c35and37", [35, 37]), ("OtherDisrupted", [19, 20, 26, 27, 34])], "other"),
    "cluster_group": (
        [
            ("9to5WithLeisure", "^(?!.*no leisure).*9 to 5"),
            ("OtherWorkday", "Workday"),
            ("DisruptedorRest", "Disrupted|Rest"),
            ("LateStart", "late start"),
            ("UnpaidAndLeisure", "Unpaid and Leisure"),
            ("UnpaidWorkday", "Unpaid Workday"),
        ],
        "OtherNotWorkday",
    ),
}


def slot_to_time(
    slot: str | Column,
    base: str = "2020-01-01",
    start_hour: int = 4,
    minutes: int = 10,
    edge: str = "start",
) -> Column:
    """Clock time of a slot on a dummy date: its start, or its end."""
    steps = col(slot) - 1 if edge == "start" else col(slot)
    day = F.to_timestamp_ntz(F.lit(f"{base} 00:00:00"))
    return day + F.make_dt_interval(
        hours=F.lit(start_hour), mins=(steps * minutes).cast("int")
    )


def code5(group: str | Column) -> Column:
    """Activity group to one of the five states; a missing group stays missing."""
    g = col(group)
    return (
        F.when(g == "work", "work")
        .when(g.startswith("unpaid"), "unpaid_work")
        .when(g.startswith("leisure"), "leisure")
        .when(g.startswith("rest"), "rest")
        .when(g.isNotNull(), "other")
    )


def lookup(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """Value of a constant map, NULL for anything else.

    The input is mentioned once, so recodes of recodes stay small when Catalyst inlines them
    into filters, which chains of CASE branches do not.
    """
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), col(c))


def either_of(cond: Column, yes: str, no: str) -> Column:
    """`yes` or `no`, NULL if the condition is unknown."""
    return F.get(F.array(F.lit(no), F.lit(yes)), cond.cast("int"))


def _word(text: str | Column, pattern: str) -> Column:
    """First match, '' if there is none; for use with `lookup`."""
    return F.regexp_extract(col(text), pattern, 0)


def econ_status(text: str | Column, casual_as_unemployed: bool = False) -> Column:
    """Economic status in three levels. Casual work has no level unless asked for."""
    levels = {
        "Self-employed": "In Employment",
        "Employed": "In Employment",
        "owner": "In Employment",
        "Student": "Inactive",
        "Homemaker": "Inactive",
        "Retired": "Inactive",
        "Unemployed": "Unemployed",
    }
    if casual_as_unemployed:
        levels["Casual"] = "Unemployed"
    return lookup(_word(text, ECON_PATTERN), levels)


def work_before(text: str | Column) -> Column:
    """Work status before lockdown."""
    names = {"full time": "full time", "part time": "part time", "wasn't working": "not working"}
    return lookup(_word(text, BEFORE_PATTERN), names)


def work_now(text: str | Column) -> Column:
    """Work status at the time of the survey."""
    return lookup(_word(text, NOW_PATTERN), {v: v for v in NOW_PATTERN.split("|")})


def employment_change(before: str | Column, now: str | Column) -> Column:
    """Change of work status over lockdown, from the raw answers."""
    b, n = work_before(before), work_now(now)
    moves = {"full time > part time": "full to part time", "part time > full time": "part to full time"}
    return F.coalesce(
        lookup(F.concat(b, F.lit(" > "), n), moves),
        F.when(b == "not working", "not in work before lockdown").when(b.isNotNull(), n),
    )


def recode(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """Rename some levels and keep the others."""
    return F.coalesce(lookup(c, mapping), col(c)) if mapping else col(c)


def qualification(text: str | Column, levels: int = 4) -> Column:
    """Highest qualification in four levels, or degree / no degree."""
    four = {
        "Higher degree": "Higher degree",
        "First degree": "First degree",
        "f": "A Levels",
        "GCSE": "Apprenticeship, GCSE or None",
        "Apprenticeship": "Apprenticeship, GCSE or None",
        "No qualifications": "Apprenticeship, GCSE or None",
    }
    if levels == 2:
        four = {k: "Degree" if v.endswith("degree") else "No Degree" for k, v in four.items()}
    return lookup(_word(text, QUALIFICATION_PATTERN), four)


def in_work(wave: str | Column, econ: str | Column, now: str | Column, strict: bool = False) -> Column:
    """Working or not: by economic status in 2016, by current work status later.

    A missing current status counts as not working, unless `strict`.
    """
    wave, econ, now = col(wave), col(econ), col(now)
    working = now.isin("full time", "part time")
    if not strict:
        working = is_true(working)
    return F.when(wave == "2016", either_of(econ == "In Employment", "Working", "Not Working")).when(
        wave != "2016", either_of(working, "Working", "Not Working")
    )


def workday(cluster: str | Column) -> Column:
    """Workday routines by cluster number; no cluster means not a workday."""
    return F.when(is_in(cluster, WORKDAY_CLUSTERS), "Workday").otherwise("Not Workday")


def cluster_label(cluster: str | Column, description: str | Column) -> Column:
    """'number: description'."""
    return F.concat(col(cluster).cast("string"), F.lit(": "), col(description))


def teleworkday(workday: str | Column, telework: str | Column) -> Column:
    """Not a workday, a home workday or an outside workday."""
    w = col(workday)
    return F.when(w == "Not Workday", "Not Workday").when(w == "Workday", col(telework))


def day_type(workday: str | Column, in_work: str | Column, telework: str | Column) -> Column:
    """Four-way day type; missing if the telework status of a workday is unknown."""
    w, i = col(workday), col(in_work)
    return (
        F.when((w == "Not Workday") & (i == "Working"), "Not Workday, Working")
        .when((w == "Not Workday") & (i == "Not Working"), "Not Workday, Not Working")
        .when(w == "Workday", col(telework))
    )


def count_children(cols: Sequence[str]) -> Column:
    """Row sum that skips missing values."""
    total = F.lit(0)
    for c in cols:
        total = total + F.coalesce(F.col(c), F.lit(0))
    return total


def child_flags(cols: Sequence[str]) -> dict[str, Column]:
    """n_kids, has_kids and a Yes/No column per age band, for withColumns."""
    n = count_children(cols)
    out = {"n_kids": n, "has_kids": F.when(n > 0, "Children").otherwise("No Children")}
    out.update({c: F.when(F.col(c) > 0, "Yes").when(F.col(c).isNotNull(), "No") for c in cols})
    return out


def row_mean(cols: Sequence[str], shift: float = -1) -> Column:
    """Mean of the present values, each shifted; NULL if none is present."""
    total, n = F.lit(0.0), F.lit(0)
    for c in cols:
        total = total + F.coalesce(F.col(c) + shift, F.lit(0)).cast("double")
        n = n + F.col(c).isNotNull().cast("int")
    return F.when(n > 0, total / n)


def routine_group(rule: str, cluster: str | Column = "cluster", text: str | Column = "cl_desc") -> Column:
    """Modelling category of a routine, first matching rule wins."""
    rules, fallback = ROUTINE_RULES[rule]
    out = None
    for name, test in rules:
        cond = is_in(cluster, test) if isinstance(test, list) else is_true(col(text).rlike(test))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(fallback)


def cut_right(
    x: str | Column, edges: Sequence[float], labels: Sequence[str] | None = None, zero_label: str | None = None
) -> Column:
    """Right-closed bins (a, b]; outside the edges the label is missing, or `zero_label`."""
    x = col(x)
    labels = labels or [f"({a:.3g},{b:.3g}]" for a, b in zip(edges, edges[1:])]
    out = None
    for a, b, label in zip(edges, edges[1:], labels):
        cond = (x > a) & (x <= b)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out if zero_label is None else out.otherwise(zero_label)


def hours_label(hours: str | Column) -> Column:
    """7.5 -> '7h 30m', after rounding to a tenth of an hour; missing hours have no label."""
    tenths = half_even(hours, 1)
    whole = F.floor(tenths)
    return F.when(tenths.isNotNull(), F.format_string("%dh %dm", whole, F.rint((tenths - whole) * 60).cast("int")))


def odds_label(odds: str | Column) -> Column:
    """'> 100', '< 0.01', or the odds with two significant digits."""
    o = col(odds)
    return F.when(o > 100, "> 100").when(o < 0.01, "< 0.01").otherwise(
        F.regexp_replace(signif(o, 2).cast("string"), r"\.0$", "")
    )


def level_position(c: str | Column, levels: Sequence[str]) -> Column:
    """1-based place of a value in a list of levels; NULL if it is not one."""
    c = col(c)
    out = None
    for i, level in enumerate(levels, 1):
        out = F.when(c == level, F.lit(i)) if out is None else out.when(c == level, F.lit(i))
    return out


def any_true(a: Column, b: Column) -> Column:
    """OR with unknowns: true if either is true, unknown if neither is true and one is unknown."""
    return a | b


def sleep_status(pri: str | Column, sec: str | Column, asleep: str = "Sleeping") -> Column:
    """Sleeping, Half-Sleeping, Not Sleeping, or missing, from primary and secondary activity."""
    p, s = col(pri) == asleep, col(sec) == asleep
    sleeping = (is_true(p) & is_true(s | s.isNull())) | (p.isNull() & is_true(s))
    half = (is_true(p) & is_true(~s)) | (is_true(~p) & is_true(s))
    return (
        F.when(sleeping, "Sleeping")
        .when(half, "Half-Sleeping")
        .when(is_true(~p) | is_true(~s), "Not Sleeping")
    )


def in_sample(age: str | Column, econ: str | Column) -> Column:
    """The analysed population: under 65 and not a student; unknown stays unknown."""
    return (col(age) != "65+") & (col(econ) != "Student")


def in_sample_flag(age: str | Column, econ: str | Column) -> Column:
    """Yes / No, where unknown counts as No."""
    return F.when(is_true(in_sample(age, econ)), "Yes").otherwise("No")
