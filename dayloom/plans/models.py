"""The study's 35 models as specifications: data, outcome, grouping, family and covariates.

A model's group effects are replicate draws (`draws_of`); its population coefficients come from
a fitted weighted model (`fit_of`); its gaps and odds are tables of contrasts (`odds_of`). Every
specification can also be written as SQL, for checks.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.functions.recode import ROUTINE_RULES, recode
from dayloom.operators import effects as E
from dayloom.operators.aggregate import complete_cases
from dayloom.operators.reshape import union_by_name
from dayloom.plans import reports as P
from dayloom.plans import sql_tables as T
from dayloom.plans.base import Study
from dayloom.plans.sql_base import text
from dayloom.runtime import cut_lineage

N_DRAWS = 100


@dataclass
class Model:
    """One model. Outcomes are {name: expression}, in an SQL both engines read the same."""

    data: Callable[[Study], DataFrame]
    sql: str
    groups: list[str]
    outcomes: dict[str, str]
    family: str
    y: str
    terms: list[str]
    spread: dict[str, str] = field(default_factory=dict)
    slopes: dict[str, tuple[str, str]] = field(default_factory=dict)
    weighted: bool = True


def _levels(rule: str) -> dict[str, str]:
    """One indicator per routine category; the fallback category is the pivot."""
    rules, _ = ROUTINE_RULES[rule]
    return {name: f"cast({rule} = {text(name)} as int)" for name, _ in rules}


def _zero_and_mean(y: str, zero: str = "zi") -> dict[str, str]:
    return {"mu": f"case when {y} > 0 then {y} end", zero: f"cast({y} = 0 as int)"}


ROUTINE = (P.routine_data, T.ROUTINES)
SPELLS = (P.spells_data, T.SPELLS_DATA)
MULTI = (P.multi_data, T.MULTI)
VORACITY = (P.voracity_data, T.VORACITY)
MEDIA = (P.media_data, T.MEDIA_DATA)
SLEEP = (P.sleep_model_data, T.SLEEP_MODEL)
COMPANY = (P.company_to_model, T.COMPANY_MODEL)
PEOPLE = ["dclasuk", "dagegrp"]

MODELS: dict[str, Model] = {
    "4_1_1": Model(P.workday_data, T.WORKDAYS, ["survey"], _levels("workday_type"), "categorical", "workday_type", ["dagegrp", "dclasuk", "sex"]),
    "4_1_2": Model(P.workday95_data, T.WORKDAYS95, ["dclasuk", "survey"], {"mu": "is_not_w9to5"}, "bernoulli", "is_not_w9to5", ["dagegrp", "sex"]),
    "4_1_3": Model(P.workday_data, T.WORKDAYS, ["cluster", "survey"], {"mu": "is_teleworkday"}, "bernoulli", "is_teleworkday", ["survey"], weighted=False),
    "4_2_1": Model(*ROUTINE, ["sex", "survey"], _levels("unpaid_cluster"), "categorical", "unpaid_cluster", [*PEOPLE, "has_kids"]),
    "4_2_2": Model(*ROUTINE, ["sex", "survey", "in_work"], _levels("unpaid_cluster"), "categorical", "unpaid_cluster", [*PEOPLE, "has_kids", "workday"]),
    "4_3_1": Model(*ROUTINE, ["sex", "survey"], _levels("interrupted_cluster"), "categorical", "interrupted_cluster", PEOPLE),
    "4_3_2": Model(*ROUTINE, ["sex", "survey", "in_work"], _levels("interrupted_cluster"), "categorical", "interrupted_cluster", [*PEOPLE, "workday"]),
    "4_4_1": Model(*ROUTINE, ["survey"], _levels("disr"), "categorical", "disr", [*PEOPLE, "sex"]),
    "4_4_2": Model(*ROUTINE, ["survey", "sex"], _levels("disr_unpaid"), "categorical", "disr_unpaid", PEOPLE),
    "4_6_1": Model(P.cluster_health_data, T.CLUSTER_HEALTH, ["cluster_group"], _zero_and_mean("mh", "hu"), "hurdle_gamma", "mh", ["wrk_now", "sex", "has_kids"]),
    "5_1_1": Model(*SPELLS, ["sex", "has_kids", "survey"], {"mu": "n_spells"}, "negbinomial", "n_spells", ["dagegrp", "dclasuk", "day_type"]),
    "5_1_2": Model(*SPELLS, ["survey"], {"mu": "n_spells"}, "negbinomial", "n_spells", ["dagegrp", "sex", "dclasuk", "has_kids"], {"shape": "n_spells"}),
    "5_1_3": Model(*SPELLS, ["survey", "in_work"], {"mu": "n_spells"}, "negbinomial", "n_spells", ["dagegrp", "sex", "dclasuk", "has_kids", "workday"], {"shape": "n_spells"}),
    "5_1_4": Model(*SPELLS, ["cluster"], {"mu": "n_spells"}, "negbinomial", "n_spells", ["workday"]),
    "5_2_1": Model(*MULTI, ["has_kids", "survey"], _zero_and_mean("n_multi"), "zero_negbinomial", "n_multi", ["dagegrp", "sex", "dclasuk"]),
    "5_2_2": Model(*MULTI, ["day_type"], _zero_and_mean("n_multi"), "zero_negbinomial", "n_multi", ["sex", "has_kids", "dagegrp", "dclasuk"]),
    "5_2_3": Model(P.multi95_data, T.MULTI95, ["workday95"], _zero_and_mean("n_multi"), "zero_negbinomial", "n_multi", ["sex", "has_kids", "dagegrp", "dclasuk"]),
    "5_2_4": Model(P.multi_entropy_data, T.MULTI_ENTROPY, [], {}, "zero_negbinomial", "n_multi", ["sex", "has_kids", "dclasuk", "dagegrp", "mean_h"], slopes={"mu": ("mean_h", "case when n_multi > 0 then ln(n_multi) end"), "zi": ("mean_h", "cast(n_multi = 0 as int)")}),
    "5_3_1": Model(P.multi_health_data, T.MULTI_HEALTH, [], {}, "hurdle_gamma", "mh", ["sex", "has_kids", "dagegrp", "dclasuk", "wrk_now", "prop_multi"], slopes={"prop_multi": ("prop_multi", "case when mh > 0 then ln(mh) end")}),
    "6_1_1": Model(*VORACITY, ["hied2"], {"mu": "voracity0"}, "poisson", "voracity0", ["hied2"]),
    "6_1_2": Model(*VORACITY, [], {}, "poisson", "voracity0", ["leisure_time"], slopes={"leisure_time": ("leisure_time", "voracity0")}),
    "6_1_3": Model(*VORACITY, ["hied2"], {}, "poisson", "voracity0", ["leisure_time", "hied2"], slopes={"leisure_time": ("leisure_time", "voracity0")}),
    "6_1_4": Model(*VORACITY, ["hied2", "survey"], {"mu": "voracity0"}, "poisson", "voracity0", ["sex", *PEOPLE, "workday", "leisure_time"]),
    "6_1_5": Model(*VORACITY, ["hied2", "survey", "in_work"], {"mu": "voracity0"}, "poisson", "voracity0", ["sex", *PEOPLE, "leisure_time"]),
    "6_2_1": Model(*MEDIA, ["hied2", "survey"], {"mu": "leisure_media"}, "gaussian", "leisure_media", ["sex", "dagegrp", "workday"]),
    "6_2_2": Model(*MEDIA, ["hied2", "survey", "in_work"], {"mu": "leisure_media"}, "gaussian", "leisure_media", ["sex", "dagegrp"]),
    "6_2_3": Model(*MEDIA, ["cluster"], {"mu": "leisure_media"}, "gaussian", "leisure_media", ["dagegrp", "sex", "dclasuk"], weighted=False),
    "6_3_1": Model(P.media_health_data, T.MEDIA_HEALTH, [], {}, "hurdle_gamma", "mh", ["wrk_now", "sex", *PEOPLE, "leisure_media"], slopes={"leisure_media": ("leisure_media", "case when mh > 0 then ln(mh) end")}),
    "7_1_1": Model(*SLEEP, ["survey", "day_type", "hied2"], {"mu": "wakeup_time"}, "student", "wakeup_time", ["sex", "dagegrp"]),
    "7_2_1": Model(*SLEEP, ["survey", "day_type"], {"mu": "sleeping_time"}, "student", "sleeping_time", ["dagegrp", "sex", "dclasuk", "has_kids"], {"sigma": "sleeping_time"}),
    "7_3_1": Model(*SLEEP, ["survey"], {"mu": "sleep_time"}, "student", "sleep_time", ["dagegrp", "dclasuk", "sex"], {"sigma": "sleep_time"}),
    "7_3_2": Model(*SLEEP, ["day_type", "survey"], {"mu": "sleep_time"}, "student", "sleep_time", ["dagegrp", "sex", "dclasuk"], {"sigma": "sleep_time"}),
    "8_1_1": Model(*COMPANY, ["survey", "dclasuk", "has_kids"], {"mu": "at_least_two"}, "gaussian", "at_least_two", ["dagegrp", "sex"]),
    "8_1_2": Model(*COMPANY, ["survey", "dclasuk", "has_kids", "in_work"], {"mu": "at_least_two"}, "gaussian", "at_least_two", ["dagegrp", "sex"]),
    "8_1_3": Model(*COMPANY, ["sex", "has_kids", "survey", "dclasuk"], {"mu": "at_least_two"}, "gaussian", "at_least_two", ["dagegrp"]),
}

# The quoted odds that a gap is larger in one wave than in another, as
# (model, dimension of the gap, keys, inverse, pairs of waves or None for all three).
GAP_CHANGES = {
    "gap_change_5_1_1": ("5_1_1", "sex", ["has_kids"], True, None),
    "gap_change_6_1_5": ("6_1_5", "hied2", ["diff"], False, {"odds_june": ("2016", "June 2020")}),
    "gap_change_6_2_1": ("6_2_1", "hied2", ["diff"], False, None),
    "gap_change_7_1_1": ("7_1_1", "hied2", ["diff", "day_type"], False, None),
    "gap_change_7_3_2": ("7_3_2", "day_type", ["diff", "resp"], False, None),
    "gap_change_8_1_2": ("8_1_2", "dclasuk", ["diff", "has_kids", "in_work"], False, None),
}
WAVE_PAIRS = {
    "odds_june_2016": ("June 2020", "2016"),
    "odds_august_june": ("August 2020", "June 2020"),
    "odds_august_2016": ("August 2020", "2016"),
}


def data_of(s: Study, model: str) -> DataFrame:
    """A model's data: complete in the grouping columns, with the short class names."""
    m = MODELS[model]
    data = complete_cases(m.data(s), m.groups) if m.groups else m.data(s)
    return data.withColumn("dclasuk", recode("dclasuk", E.DRAW_CLASS_NAMES))


def draws_of(s: Study, model: str, n_draws: int = N_DRAWS) -> DataFrame:
    """(draw, groups, resp, value): replicate effects of a model."""
    m = MODELS[model]
    data, w = data_of(s, model), "weight" if m.weighted else None
    if m.slopes:
        pairs = {n: (F.expr(x), F.expr(y)) for n, (x, y) in m.slopes.items()}
        return E.replicate_slopes(data, m.groups, pairs, n_draws, w)
    return E.replicate_draws(
        data,
        m.groups,
        {n: F.expr(x) for n, x in m.outcomes.items()},
        n_draws,
        w,
        spread={n: F.expr(x) for n, x in m.spread.items()},
    )


def _key(cols: Sequence[str]) -> Column:
    return F.concat_ws(" / ", *[F.col(c).cast("string") for c in cols])


def odds_of(s: Study, model: str, n_draws: int = N_DRAWS) -> DataFrame:
    """Every gap of a model with its odds of direction: (dim, diff, cell, odds, label).

    Grouping dimensions without named contrasts (and slopes) are reported level by level.
    """
    m = MODELS[model]
    draws = draws_of(s, model, n_draws)
    dims = [g for g in m.groups if g in E.CONTRASTS] if not m.slopes else []
    if len(dims) > 1:
        # The draws are few rows made from all the data: keep them, and pass over the data once.
        draws = cut_lineage(draws)
    parts = []
    for dim in dims:
        rest = [*[g for g in m.groups if g != dim], "resp"]
        gaps = E.contrasts(draws, dim).select("diff", _key(rest).alias("cell"), "value")
        parts.append(E.direction_odds(gaps, "diff", "cell").withColumn("dim", F.lit(dim)))
    if not dims:
        cells = draws.select(F.lit("level").alias("diff"), _key([*m.groups, "resp"]).alias("cell"), "value")
        parts.append(E.direction_odds(cells, "diff", "cell").withColumn("dim", F.lit("level")))
    return union_by_name(parts).select("dim", "diff", "cell", "odds", "label")


def intervals_of(s: Study, model: str, n_draws: int = N_DRAWS) -> DataFrame:
    """Median and central intervals of every group effect of a model."""
    from dayloom.operators.aggregate import interval

    m = MODELS[model]
    return interval(draws_of(s, model, n_draws), [*m.groups, "resp"])


def gap_change_of(s: Study, name: str, n_draws: int = N_DRAWS) -> DataFrame:
    model, dim, keys, inverse, pairs = GAP_CHANGES[name]
    return E.gap_change_odds(draws_of(s, model, n_draws), dim, *keys, pairs=pairs, inverse=inverse)


def fit_of(s: Study, model: str) -> DataFrame:
    """Population coefficients of a model by its family: (part, resp, term, coefficient)."""
    m = MODELS[model]
    w = "weight" if m.weighted else None
    data = data_of(s, model)
    if m.family == "hurdle_gamma":
        return E.two_part_fit(data, m.y, m.terms, "gamma", w)
    if m.family == "zero_negbinomial":
        return E.two_part_fit(data, m.y, m.terms, "tweedie", w)
    # Stand-ins: a Huber loss for Student errors, variance mean^1.5 for overdispersed counts.
    family = {"student": "robust", "negbinomial": "tweedie"}.get(m.family, m.family)
    fit = E.weighted_glm(data, m.y, m.terms, family, w)
    return fit.select(F.lit("mu").alias("part"), "*")


# ---- the same in SQL -----------------------------------------------------------------------

_CLASS_CASE = "case dclasuk " + " ".join(f"when {text(k)} then {text(v)}" for k, v in E.DRAW_CLASS_NAMES.items()) + " else dclasuk end"


def uniform_sql(unit: str, draw: str) -> str:
    return f"((cast('0x' || substr(md5(cast({unit} as varchar) || ':' || cast({draw} as varchar)), 1, 8) as bigint) + 0.5) / 4294967296.0::double)"


def draws_sql(table: str, groups: Sequence[str], outcomes: dict[str, str], n: int, weight: str = "weight", unit: str = "mainid", spread: dict[str, str] | None = None) -> str:
    """CTEs ending in `draws` (draw, groups, resp, value)."""
    spread = spread or {}
    every = {**outcomes, **spread}
    keys = "".join(f", {g}" for g in groups)
    ys = "".join(f", cast({x} as double) as y_{i}" for i, x in enumerate(every.values()))
    sums = ", ".join(
        f"sum(e * y_{i}) as s_{i}, sum(case when y_{i} is not null then e end) as t_{i}, sum(e * y_{i} * y_{i}) as q_{i}"
        for i in range(len(every))
    )

    def estimate(i, name, agg):
        s, t, q = (f"{agg}({x}_{i})" if agg else f"{x}_{i}" for x in "stq")
        mean = f"({s} / nullif({t}, 0))"
        return f"sqrt(greatest(round({q} / nullif({t}, 0) - {mean} * {mean}, 9), 0))" if name in spread else mean

    overall = ", ".join(f"{estimate(i, n_, 'sum')} as m_{i}" for i, n_ in enumerate(every))
    rows = " union all ".join(
        f"select c.draw{keys}, {text(n_)} as resp, round({estimate(i, n_, '')} - m_{i}, 9) as value from dcells c join doverall o on o.draw = c.draw"
        for i, n_ in enumerate(every)
    )
    return f"""
with dbase as (select * from ({table}) b0),
drows as (
  select g.draw{keys}, {weight} * -ln({uniform_sql(unit, 'g.draw')}) as e{ys}
  from dbase cross join (select cast(unnest(range(1, {n + 1})) as int) as draw) g where {weight} is not null),
dcells as (select draw{keys}, {sums} from drows group by draw{keys}),
doverall as (select draw, {overall} from dcells group by draw),
draws as ({rows})"""


def slopes_sql(table: str, groups: Sequence[str], slopes: dict[str, tuple[str, str]], n: int, weight: str = "weight", unit: str = "mainid") -> str:
    keys = "".join(f", {g}" for g in groups)
    parts = []
    for name, (x, y) in slopes.items():
        parts.append(
            f"""select draw{keys}, {text(name)} as resp,
       round((sum(e * x * y) / sum(e) - sum(e * x) / sum(e) * (sum(e * y) / sum(e)))
         / nullif(round(sum(e * x * x) / sum(e) - sum(e * x) / sum(e) * (sum(e * x) / sum(e)), 9), 0), 9) as value
from (select g.draw{keys}, {weight} * -ln({uniform_sql(unit, 'g.draw')}) as e, cast({x} as double) as x, cast({y} as double) as y
      from dbase cross join (select cast(unnest(range(1, {n + 1})) as int) as draw) g
      where {weight} is not null and ({x}) is not null and ({y}) is not null) r group by draw{keys}"""
        )
    return f"with dbase as (select * from ({table}) b0),\ndraws as ({' union all '.join(parts)})"


def model_draws_sql(model: str, n: int = N_DRAWS) -> str:
    m = MODELS[model]
    where = " and ".join(f"{g} is not null" for g in m.groups) or "true"
    table = f"select * replace ({_CLASS_CASE} as dclasuk) from ({m.sql}) t0 where {where}"
    weight = "weight" if m.weighted else "1.0"
    if m.slopes:
        return slopes_sql(table, m.groups, m.slopes, n, weight)
    return draws_sql(table, m.groups, m.outcomes, n, weight, spread=m.spread)


def contrast_sql(dim: str, rest: Sequence[str], draws: str = "draws", pairs=None) -> str:
    """(draw, rest, diff, value) from a draws table."""
    keys = ", ".join(["draw", *rest])
    rows = []
    for a, b in pairs or E.CONTRASTS[dim]:
        rows.append(
            f"select {keys}, {text(f'{a} - {b}')} as diff, max(case when {dim} = {text(a)} then value end) - max(case when {dim} = {text(b)} then value end) as value from {draws} group by {keys}"
        )
    return " union all ".join(rows)


LABEL_SQL = r"""case when odds > 100 then '> 100' when odds < 0.01 then '< 0.01'
  else regexp_replace(cast(round_even(odds * pow(10.0, 1 - floor(log10(odds))), 0) / pow(10.0, 1 - floor(log10(odds))) as varchar), '\.0$', '') end"""


def odds_expr(above: str, below: str) -> str:
    return f"case when {below} > 0 then {above} / cast({below} as double) when {above} > 0 then 'inf'::double end"


def direction_sql(table: str, keys: Sequence[str]) -> str:
    cols = ", ".join(keys)
    above, below = "count(case when value > 0 then 1 end)", "count(case when value < 0 then 1 end)"
    return f"""
select {cols}, odds, {LABEL_SQL} as label
from (select {cols}, {odds_expr(above, below)} as odds from ({table}) v group by {cols}) o"""


def odds_sql(model: str, n: int = N_DRAWS) -> str:
    m = MODELS[model]
    dims = [g for g in m.groups if g in E.CONTRASTS] if not m.slopes else []
    parts = []
    for dim in dims:
        rest = [*[g for g in m.groups if g != dim], "resp"]
        cell = "concat_ws(' / ', " + ", ".join(f"cast({c} as varchar)" for c in rest) + ")"
        gaps = f"select diff, {cell} as cell, value from ({contrast_sql(dim, rest)}) g"
        parts.append(f"select {text(dim)} as dim, * from ({direction_sql(gaps, ['diff', 'cell'])}) d")
    if not dims:
        cell = "concat_ws(' / ', " + ", ".join(f"cast({c} as varchar)" for c in [*m.groups, "resp"]) + ")"
        cells = f"select 'level' as diff, {cell} as cell, value from draws"
        parts.append(f"select 'level' as dim, * from ({direction_sql(cells, ['diff', 'cell'])}) d")
    return model_draws_sql(model, n) + "\n" + " union all ".join(parts)


def gap_change_sql(name: str, n: int = N_DRAWS) -> str:
    model, dim, keys, inverse, pairs = GAP_CHANGES[name]
    m = MODELS[model]
    rest = [*[g for g in m.groups if g != dim], "resp"]
    others = ["draw", *[c for c in rest if c != "survey"], "diff"]
    pairs = pairs or WAVE_PAIRS
    waves = list(dict.fromkeys(w for pair in pairs.values() for w in pair))
    wide = ", ".join(f"max(case when survey = {text(w)} then value end) as w{i}" for i, w in enumerate(waves))
    cols = []
    for out, (a, b) in pairs.items():
        i, j = waves.index(a), waves.index(b)
        more, less = f"count(case when w{i} > w{j} then 1 end)", f"count(case when w{i} < w{j} then 1 end)"
        cols.append(f"{odds_expr(less, more) if inverse else odds_expr(more, less)} as {out}")
    ks = ", ".join(keys)
    return model_draws_sql(model, n) + f"""
select {ks}, {', '.join(cols)} from (
  select {', '.join(others)}, {wide} from ({contrast_sql(dim, rest)}) g group by {', '.join(others)}) x group by {ks}"""


def one_factor_fit(data: DataFrame, y: str, factor: str, family: str, w: str = "weight") -> DataFrame:
    """(level, fitted) of a model with one factor: the linear predictor of each level."""
    part = data.select(y, factor, w)
    fit = {r["term"]: r["coefficient"] for r in E.weighted_glm(part, y, [factor], family, w).collect()}
    steps = F.create_map(*[F.lit(x) for t, c in fit.items() for x in (t, c)])
    level = part.filter(F.col(y).isNotNull() & (F.col(w) > 0)).select(F.col(factor).alias("level")).dropna().distinct()
    step = F.coalesce(F.try_element_at(steps, F.concat(F.lit(f"{factor}_"), F.col("level"))), F.lit(0.0))
    return level.select("level", (F.lit(fit["(Intercept)"]) + step).alias("fitted"))


#: Models whose covariates are all categories, with the link their effects are adjusted on.
ADJUSTED = {"5_1_1": "poisson", "6_2_1": "gaussian", "8_1_1": "gaussian"}


def adjusted_of(s: Study, model: str, n_draws: int = N_DRAWS) -> DataFrame:
    """(term, level, estimate, est_error, effect_size): effects of a model's groups, adjusted for its covariates.

    `effect_size` is exp of the estimate under a log link, a multiplicative effect.
    """
    m, family = MODELS[model], ADJUSTED[model]
    draws = E.adjusted_draws(data_of(s, model), [*m.groups, *m.terms], m.y, family, n_draws, "weight" if m.weighted else None)
    table = draws.groupBy("term", "level").agg(F.avg("value").alias("estimate"), F.stddev_samp("value").alias("est_error"))
    return table.withColumn("effect_size", F.exp("estimate") if family == "poisson" else F.lit(None).cast("double"))
