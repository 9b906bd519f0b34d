"""Queries: draws, contrasts, odds, pooled effects, fitted models and predictive checks."""

from pyspark.sql import functions as F

from dayloom.functions import recode as R
from dayloom.operators import aggregate as A
from dayloom.operators import effects as E
from dayloom.operators import mixed as X
from dayloom.operators import mixtures as Z
from dayloom.operators import predictive as V
from dayloom.plans import models as M
from dayloom.plans import reports as P
from dayloom.plans import sql_tables as T
from dayloom.plans.registry import query
from dayloom.plans.sql_base import text

DRAWS_SQL = M.draws_sql(T.SPELLS_DATA, ["sex", "survey"], {"mu": "n_spells"}, M.N_DRAWS)
INTERVALS = ((0.5, "0.5"), (0.8, "0.8"), (0.95, "0.95"))


def spell_draws(s):
    """Replicates of mean spells by sex and wave."""
    return E.replicate_draws(P.spells_data(s), ["sex", "survey"], "n_spells", M.N_DRAWS)


@query("replicate_draws", DRAWS_SQL + " select draw, sex, survey, value from draws", "value")
def replicate_draws(s):
    return spell_draws(s)


@query(
    "shrunken_effects",
    f"""
with c as (
  select day_type, survey, count(*) as n, sum(weight) as w, sum(weight * weight) as w2, sum(weight * n_spells) as wy,
         sum(weight * n_spells * n_spells) as wyy
  from ({T.SPELLS_DATA}) x where weight is not null and n_spells is not null group by all),
m as (select *, wy / w as mean, case when n > 1 then greatest(wyy / w - (wy / w) * (wy / w), 0) end as s2 from c where w > 0),
o as (select sum(wy) / sum(w) as mu, sum(w * s2) / nullif(sum(case when s2 is not null then w end), 0) as pooled from m),
v as (select m.*, mu, coalesce(s2, pooled) * w2 / (w * w) as v from m, o),
t as (select greatest(var_samp(mean) - avg(v), 0) as tau2 from v)
select day_type, survey, n, mean, coalesce(tau2 / nullif(tau2 + v, 0), 0) * (mean - mu) as effect from v, t""",
    "mean effect",
)
def shrunken_effects(s):
    return E.shrunken_effects(P.spells_data(s), ["day_type", "survey"], "n_spells")


@query("contrasts", DRAWS_SQL + f" select draw, sex, resp, diff, value from ({M.contrast_sql('survey', ['sex', 'resp'])}) g", "value")
def contrasts(s):
    draws = spell_draws(s).withColumn("resp", F.lit("mu"))
    return E.contrasts(draws, "survey")


@query(
    "direction_odds",
    DRAWS_SQL + M.direction_sql(M.contrast_sql("survey", ["sex"]), ["diff", "sex"]),
    "odds",
)
def direction_odds(s):
    return E.direction_odds(E.contrasts(spell_draws(s), "survey"), "diff", "sex")


@query(
    "gap_change_odds",
    DRAWS_SQL
    + f""" select {', '.join(
        M.odds_expr(f"count(case when w{i} > w{j} then 1 end)", f"count(case when w{i} < w{j} then 1 end)") + f' as {n}'
        for n, i, j in (('odds_june_2016', 1, 0), ('odds_august_june', 2, 1), ('odds_august_2016', 2, 0)))}, diff
from (select draw, diff, max(case when survey = '2016' then value end) as w0, max(case when survey = 'June 2020' then value end) as w1,
        max(case when survey = 'August 2020' then value end) as w2
      from ({M.contrast_sql('sex', ['survey'])}) g group by draw, diff) x group by diff""",
    "odds_june_2016 odds_august_june odds_august_2016",
)
def gap_change_odds(s):
    return E.gap_change_odds(spell_draws(s), lambda d: E.contrasts(d, "sex"), "diff")


_NAMED = {"sex": ["Female", "Male"], "survey": R.SURVEYS}


@query("parse_draw_names", DRAWS_SQL + " select draw, sex, survey, 'mu' as coef, value from draws", "value")
def parse_draw_names(s):
    wide = E.draw_columns(spell_draws(s), _NAMED, "Intercept")
    return E.parse_draw_names(wide)


@query(
    "gather_terms",
    DRAWS_SQL
    + " select draw, 'r_sex:survey[' || sex || '_' || replace(survey, ' ', '.') || ',Intercept]' as term, value from draws where survey = 'June 2020'",
    "value",
)
def gather_terms(s):
    wide = E.draw_columns(spell_draws(s), _NAMED, "Intercept")
    return E.gather_terms(wide, "June")


@query("effect_size", M.model_draws_sql("5_3_1") + " select resp, exp(avg(value)) as effect from draws group by resp", "effect")
def effect_size(s):
    return E.effect_size(M.draws_of(s, "5_3_1"), "resp")


def _effects_sql(model: str) -> str:
    m = M.MODELS[model]
    label = "concat_ws('_', " + ", ".join([*m.groups, "resp"]) + ")"
    return (
        M.model_draws_sql(model)
        + f"""
select {text(model)} as model, {label} as effect, round_even(avg(value), 3) as estimate, round_even(stddev_samp(value), 3) as est_error,
       round_even(quantile_cont(value, 0.025), 3) as q2_5, round_even(quantile_cont(value, 0.975), 3) as q97_5
from draws group by all
union all select '5_3_1', 'No Group Level Effects', null, null, null, null"""
    )


@query("effects_table", _effects_sql("7_3_2"), "estimate est_error q2_5 q97_5")
def effects_table(s):
    groups = [*M.MODELS["7_3_2"].groups, "resp"]
    models = {"7_3_2": (M.draws_of(s, "7_3_2"), groups), "5_3_1": (None, [])}
    return E.effects_table(models)


def _interval_sql(model: str) -> str:
    keys = ", ".join([*M.MODELS[model].groups, "resp"])
    rows = " union all ".join(
        f"select {keys}, quantile_cont(value, 0.5) as point, {q} as width, quantile_cont(value, {(1 - q) / 2}) as lower, quantile_cont(value, {(1 + q) / 2}) as upper from draws group by {keys}"
        for q, _ in INTERVALS
    )
    return M.model_draws_sql(model) + "\n" + rows


for _id in ("5_1_4", "7_3_2"):
    query(f"draw_intervals_{_id}", _interval_sql(_id), "point width lower upper")(
        lambda s, i=_id: M.intervals_of(s, i)
    )


_PRED_SQL = (
    M.draws_sql(T.CLUSTER_HEALTH, ["cluster_group"], {"mu": "mh"}, 30, unit="diaryid")
    + f"""
select h.diaryid, h.cluster_group, d.draw, h.mh,
       centre + d.value + sd * sqrt(-2 * ln({M.uniform_sql('h.diaryid', "'r' || d.draw")})) * cos(2 * 3.141592653589793::double * {M.uniform_sql('h.diaryid', "'a' || d.draw")}) as predicted
from ({T.CLUSTER_HEALTH}) h
join draws d on d.cluster_group = h.cluster_group
join (select cluster_group, coalesce(stddev_samp(mh), 0) as sd from ({T.CLUSTER_HEALTH}) x where weight is not null group by cluster_group) z on z.cluster_group = h.cluster_group
cross join (select sum(weight * mh) / sum(weight) as centre from ({T.CLUSTER_HEALTH}) x where weight is not null) m
where h.weight is not null"""
)


@query("predictive_check", _PRED_SQL, "mh predicted")
def predictive_check(s):
    data = P.cluster_health_data(s).select("diaryid", "cluster_group", "mh", "weight")
    return E.predictive_check(data, ["cluster_group"], "mh").drop("weight")


@query(
    "odds_working_routine",
    M.model_draws_sql("8_1_2")
    + f"""
select survey, has_kids, {M.odds_expr("count(case when a > b then 1 end)", "count(case when a < b then 1 end)")} as odds
from (select draw, survey, has_kids, max(case when in_work = 'Working' then value end) as a, max(case when in_work = 'Not Working' then value end) as b
      from draws where dclasuk = 'Routine' group by all) x group by survey, has_kids""",
    "odds",
)
def odds_working_routine(s):
    draws = M.draws_of(s, "8_1_2").filter(F.col("dclasuk") == "Routine").drop("dclasuk", "resp")
    return E.gap_change_odds(
        draws, lambda d: d, "survey", "has_kids", dim="in_work", pairs={"odds": ("Working", "Not Working")}
    )


for _id in M.MODELS:
    query(f"model_{_id}", M.odds_sql(_id), "odds")(lambda s, i=_id: M.odds_of(s, i))

for _name, _spec in M.GAP_CHANGES.items():
    query(_name, M.gap_change_sql(_name), " ".join(_spec[4] or M.WAVE_PAIRS))(lambda s, n=_name: M.gap_change_of(s, n))

# Models of several covariates have no SQL counterpart; tests compare them with other solvers.
for _name, _id in {
    "weighted_glm": "8_1_1",
    "weighted_glm_bernoulli": "4_1_2",
    "weighted_glm_poisson": "6_1_4",
    "weighted_glm_categorical": "4_4_2",
    "weighted_glm_tweedie": "5_1_1",
    "weighted_glm_robust": "7_3_1",
    "two_part_fit": "4_6_1",
}.items():
    query(_name)(lambda s, i=_id: M.fit_of(s, i))


# A model with one factor fits the weighted mean of each level: the closed form the fits are held to.
# {name: (family, outcome, what the link does to the mean)}
ONE_FACTOR = {
    "gaussian": ("gaussian", "n_spells", "{m}"),
    "poisson": ("poisson", "n_spells", "ln({m})"),
    "gamma": ("gamma", "n_spells", "ln({m})"),
    "tweedie": ("tweedie", "n_spells", "ln({m})"),
    "bernoulli": ("bernoulli", "n_spells / 144.0D", "ln({m} / (1 - {m}))"),
}


def _one_factor_sql(y: str, link: str) -> str:
    mean = f"(sum(weight * {y.replace('D', '::double')}) / sum(weight))"
    return f"""
select survey as level, round_even({link.format(m=mean)}, 3) as fitted from ({T.SPELLS_DATA}) x
where n_spells is not null and weight > 0 and survey is not null group by survey"""


for _name, (_family, _y, _link) in ONE_FACTOR.items():

    @query(f"one_factor_{_name}", _one_factor_sql(_y, _link), "fitted")
    def one_factor(s, family=_family, y=_y):
        data = P.spells_data(s).filter(F.col("n_spells").isNotNull()).withColumn("outcome", F.expr(y).cast("double"))
        return M.one_factor_fit(data, "outcome", "survey", family).withColumn("fitted", F.bround("fitted", 3))


@query(
    "predictive_density",
    f"""
with rep as ({_PRED_SQL}),
stacked as (select cluster_group, 'predicted' as kind, predicted as x from rep
  union all select cluster_group, 'data', mh from rep where draw = 1)
select cluster_group || ' / ' || kind as kind, bin, count(*) as n from (
  select cluster_group, kind, cast(floor(round_even(x, 6) / 0.25 + 0.5) as bigint) as bin from stacked) b group by all""",
)
def predictive_density(s):
    """Figure 4.6: replicates beside the data, as a binned density per routine group."""
    data = P.cluster_health_data(s).select("diaryid", "cluster_group", "mh", "weight")
    drawn = E.predictive_check(data, ["cluster_group"], "mh")
    both = drawn.select("cluster_group", F.explode(F.array(
        F.struct(F.lit("predicted").alias("kind"), F.col("predicted").alias("x")),
        F.when(F.col("draw") == 1, F.struct(F.lit("data").alias("kind"), F.col("mh").alias("x"))),
    )).alias("v")).filter("v is not null").select(F.concat_ws(" / ", "cluster_group", "v.kind").alias("kind"), F.bround("v.x", 6).alias("x"))
    return A.weighted_histogram(both.withColumn("weight", F.lit(1.0)), "kind", "x", 0.25).select("kind", "bin", "n")


for _id in M.ADJUSTED:
    query(f"adjusted_{_id}")(lambda s, i=_id: M.adjusted_of(s, i))

# Least squares with two covariates of two levels, from sums per draw by the normal equations.
_TWO_SQL = f"""
with e as (
  select d.draw, cast(sex = 'Male' as int) as x1, cast(has_kids = 'No Children' as int) as x2, at_least_two as y,
         weight * -ln({M.uniform_sql('mainid', 'd.draw')}) as w
  from ({T.COMPANY_MODEL}) r cross join (select unnest(range(1, {M.N_DRAWS + 1})) as draw) d
  where weight is not null and sex is not null and has_kids is not null and at_least_two is not null),
s as (
  select draw, sum(w) as a, sum(w * x1) as b, sum(w * x2) as c, sum(w * x1 * x2) as d,
         sum(w * y) as t, sum(w * x1 * y) as t1, sum(w * x2 * y) as t2 from e group by draw),
k as (select *, a * (b * c - d * d) - b * (b * c - d * c) + c * (b * d - b * c) as det from s)
select draw, round_even((a * (t1 * c - d * t2) - t * (b * c - d * c) + c * (b * t2 - t1 * c)) / det, 6) as sex_effect,
       round_even((a * (b * t2 - t1 * d) - b * (b * t2 - t1 * c) + t * (b * d - b * c)) / det, 6) as kids_effect
from k"""


@query("adjusted_two_covariates", _TWO_SQL, "sex_effect kids_effect")
def adjusted_two_covariates(s):
    """Company by sex and children, each adjusted for the other, per draw."""
    draws = E.adjusted_draws(P.company_to_model(s), ["sex", "has_kids"], "at_least_two", "gaussian", M.N_DRAWS)
    one = lambda term: F.max(F.when(F.col("term") == term, F.col("value")))
    return draws.groupBy("draw").agg(one("sex").alias("sex_effect"), one("has_kids").alias("kids_effect"))


# ---- models with more than a mean, and with numbers beside categories ---------------------------

# Of several covariates: tests hold them to likelihoods written out on their own.
@query("zero_inflated_5_2_1")
def zero_inflated(s):
    """Multitasking slots: negative binomial counts with extra zeros, both parts by the same covariates."""
    terms = ["dagegrp", "sex", "dclasuk", "has_kids", "survey"]
    return Z.count_fit(M.data_of(s, "5_2_1"), "n_multi", terms, (), terms)


@query("negbinomial_shape_5_1_2")
def negbinomial_shape(s):
    """Spells: negative binomial, its shape by wave."""
    return Z.count_fit(M.data_of(s, "5_1_2"), "n_spells", ["survey", "dagegrp", "sex", "dclasuk", "has_kids"], ["survey"])


@query("student_7_2_1")
def student(s):
    """Falling asleep: Student-t, mean and scale by wave and day type."""
    return Z.student_fit(M.data_of(s, "7_2_1"), "sleeping_time", ["survey", "day_type", "dagegrp", "sex", "dclasuk", "has_kids"], ["survey", "day_type"])


@query("pooled_8_1_1")
def pooled(s):
    """Time with others: groups of wave, class and children are pooled beside age and sex."""
    data = M.data_of(s, "8_1_1").withColumn("group", F.concat_ws(" / ", "survey", "dclasuk", "has_kids"))
    return X.pooled_effects(data, "at_least_two", ["dagegrp", "sex"], pooled=["group"])


# Fitted by likelihood, a negative binomial with one factor in its mean and its shape has the weighted means.
@query(
    "one_factor_negbinomial",
    f"""
select survey as level, round_even(ln(sum(weight * n_spells) / sum(weight)), 4) as fitted from ({T.SPELLS_DATA}) x
where n_spells is not null and weight > 0 and survey is not null group by survey""",
    "fitted",
)
def one_factor_negbinomial(s):
    fit = Z.count_fit(P.spells_data(s), "n_spells", ["survey"], ["survey"])
    mean = fit.filter("part = 'mu'")
    start = mean.filter("level is null").select(F.col("coefficient").alias("start"))
    levels = P.spells_data(s).filter("n_spells is not null and weight > 0").select(F.col("survey").alias("level")).dropna().distinct()
    steps = levels.join(mean.filter("level is not null").select("level", "coefficient"), "level", "left")
    return steps.select("level", F.bround(start.scalar() + F.coalesce("coefficient", F.lit(0.0)), 4).alias("fitted"))


_SLOPE_SQL = f"""
with e as (
  select d.draw, cast(sex = 'Male' as int) as x1, leisure_time as x2, voracity0 as y, weight * -ln({M.uniform_sql('mainid', 'd.draw')}) as w
  from ({T.VORACITY}) r cross join (select unnest(range(1, {M.N_DRAWS + 1})) as draw) d
  where weight > 0 and sex is not null and leisure_time is not null and voracity0 is not null),
s as (
  select draw, sum(w) as a, sum(w * x1) as b, sum(w * x2) as c, sum(w * x1 * x1) as d11, sum(w * x1 * x2) as d12, sum(w * x2 * x2) as d22,
         sum(w * y) as t, sum(w * x1 * y) as t1, sum(w * x2 * y) as t2 from e group by draw),
k as (select *, d11 - b * b / a as v11, d12 - b * c / a as v12, d22 - c * c / a as v22, t1 - b * t / a as u1, t2 - c * t / a as u2 from s)
select draw, round_even((u1 * v22 - u2 * v12) / (v11 * v22 - v12 * v12), 6) as sex_effect,
       round_even((v11 * u2 - v12 * u1) / (v11 * v22 - v12 * v12), 6) as leisure_slope
from k"""


@query("adjusted_slopes", _SLOPE_SQL, "sex_effect leisure_slope")
def adjusted_slopes(s):
    """Variety of leisure by sex and by time, each adjusted for the other, per draw."""
    draws = X.adjusted_slopes(P.voracity_data(s), "voracity0", ["sex"], ["leisure_time"], M.N_DRAWS)
    one = lambda term: F.max(F.when(F.col("term") == term, F.col("value")))
    return draws.groupBy("draw").agg(one("sex").alias("sex_effect"), one("leisure_time").alias("leisure_slope"))


def _digest_sql(unit: str, tag: str, i: int) -> str:
    return f"((cast('0x' || substr(md5(cast({unit} as varchar) || ':' || {tag}), {1 + 8 * i}, 8) as bigint) + 0.5) / 4294967296.0::double)"


_TRY = "'g' || draw || '.' || i"
_HURDLE_SQL = f"""
with h as (select diaryid, cluster_group, mh, weight from ({T.CLUSTER_HEALTH}) x),
sums as (
  select cluster_group, sum(weight) as t, sum(case when mh > 0 then weight end) as w, sum(case when mh > 0 then weight * mh end) as wy,
         sum(case when mh > 0 then weight * mh * mh end) as wyy
  from h where weight > 0 and mh >= 0 group by cluster_group),
facts as (select cluster_group, 1 - coalesce(w, 0) / t as hu, wy / w as mu, round(wyy / w - (wy / w) * (wy / w), 9) as v from sums),
model as (select cluster_group, hu, mu, case when v > 0 then mu * mu / v end as shape from facts),
drawn as (
  select h.*, hu, mu, shape, case when shape < 1 then shape + 1 else shape end - 1.0::double / 3 as d, d.draw
  from h left join model m on m.cluster_group is not distinct from h.cluster_group cross join (select unnest(range(1, 31)) as draw) d),
tried as (
  select *, sqrt(-2 * ln({_digest_sql('diaryid', _TRY, 0)})) * cos(2 * 3.141592653589793::double * {_digest_sql('diaryid', _TRY, 1)}) as x,
         ln({_digest_sql('diaryid', _TRY, 2)}) as lu
  from drawn cross join (select unnest(range(1, {V.TRIES + 1})) as i) i),
cubed as (select *, 1 + x / sqrt(9 * d) as t from tried),
kept as (
  select diaryid, draw, arg_min(d * t * t * t, i) as g from cubed
  where t > 0 and lu < 0.5 * x * x + d - d * t * t * t + d * ln(t * t * t) group by diaryid, draw)
select diaryid, cluster_group, mh, cast(draw as int) as draw,
  case when {M.uniform_sql('diaryid', "'z' || draw")} < hu then 0.0
       when shape is null then mu
       else coalesce(g, d) * case when shape < 1 then pow({M.uniform_sql('diaryid', "'b' || draw")}, 1 / shape) else 1 end * mu / shape end as predicted
from drawn left join kept using (diaryid, draw)"""


@query("hurdle_draws", _HURDLE_SQL, "mh predicted")
def hurdle_draws(s):
    """Replicates of the health score from the hurdle gamma model of its routine group."""
    data = P.cluster_health_data(s).select("diaryid", "cluster_group", "mh", "weight")
    return V.hurdle_draws(data, ["cluster_group"], "mh").drop("weight")
