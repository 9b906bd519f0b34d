"""Group effects with uncertainty: replicate draws, pooling, contrasts, odds and fitted models.

A draws table is long: (draw, group columns, value), where value is the group's deviation from
the overall mean in that replicate.
"""

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.functions.recode import SURVEYS, odds_label
from dayloom.functions.semantics import first_match, half_even, join_group_facts, join_null_safe, ratio, share
from dayloom.operators.aggregate import interval
from dayloom.operators.reshape import drop_null_columns
from dayloom.runtime import cut_lineage

# Level differences reported for each dimension, as (left, right).
CONTRASTS = {
    "sex": [("Female", "Male")],
    "dclasuk": [
        ("Higher", "Intermediate"),
        ("Higher", "Routine"),
        ("Intermediate", "Routine"),
        ("Routine", "Not Working"),
    ],
    "survey": [("June 2020", "2016"), ("August 2020", "June 2020"), ("August 2020", "2016")],
    "day_type": [
        ("Outside Workday", "Not Workday, Working"),
        ("Outside Workday", "Home Workday"),
        ("Home Workday", "Not Workday, Working"),
        ("Not Workday, Working", "Not Workday, Not Working"),
    ],
    "has_kids": [("Children", "No Children")],
    "hied2": [("Degree", "No Degree")],
    "in_work": [("Working", "Not Working")],
    "workday95": [("Workday 9 to 5", "Other Workday")],
    "cluster_group": [
        ("UnpaidAndLeisure", "OtherNotWorkday"),
        ("LateStart", "OtherNotWorkday"),
        ("DisruptedorRest", "OtherNotWorkday"),
        ("9to5WithLeisure", "OtherWorkday"),
    ],
}

# Patterns that read a group level from a draw's column name.
DRAW_NAME_PATTERNS = {
    "survey": "2016|June.2020|August.2020",
    "sex": "Male|Female",
    "dclasuk": "Higher|Intermediate|Routine|unemployed",
    "hied2": "(No.)?Degree",
    "in_work": "(Not.)?Working",
    "has_kids": "(No.)?Children",
    "day_type": r"(Not.Workday\,.Working)|(Not.Workday\,.Not.Working)|Home.Workday|Outside.Workday",
    "workday95": "Other.Workday|Workday.9.to.5",
}
COEF_PATTERN = "hu|zi|zoi|coi|sigma|shape|nu"
CLUSTER_PATTERN = "[0-9]{1,2}(?=[^0-9])"

# Class levels are shortened in draws.
DRAW_CLASS_NAMES = {
    "Higher managerial and professional": "Higher",
    "Intermediate": "Intermediate",
    "Routine": "Routine",
    "Not working or unemployed": "Not Working",
}


# Draws are rounded to this many digits, so that equal groups differ by zero and not by the
# noise of float sums, whose sign would count in the odds.
NOISE_DIGITS = 9


def uniform(unit: str | Column, draw: str | Column) -> Column:
    """A reproducible number in (0, 1) per unit and draw."""
    unit = F.col(unit) if isinstance(unit, str) else unit
    draw = F.col(draw) if isinstance(draw, str) else draw
    text = F.concat_ws(":", unit.cast("string"), draw.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") + 0.5) / 4294967296.0


def spread_out(df: DataFrame) -> DataFrame:
    """Narrow rows dealt out evenly before each is multiplied by the number of draws.

    Without it the work of all draws stays in the few partitions that small rows coalesce into,
    or in those a hot key fills. The multiplied rows are never shuffled.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def replicate_draws(
    df: DataFrame,
    groups: Sequence[str],
    y: str | Mapping[str, Column],
    n_draws: int = 200,
    w: str | None = "weight",
    unit: str = "mainid",
    resp: str = "resp",
    spread: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Reweighted replicates of each group's weighted mean, as deviation from the overall mean.

    Each unit (a person, whose diaries move together) gets an exponential weight per draw. With
    several outcomes {name: column} the result has a column naming the outcome; outcomes in
    `spread` are compared by their weighted standard deviation instead of their mean. Replicates
    are rows made map-side and summed there: what is shuffled is groups x draws sums.
    """
    many = isinstance(y, Mapping) or spread is not None
    outcomes = dict(y) if isinstance(y, Mapping) else {"mu" if many else "value": F.col(y)}
    spread = dict(spread or {})
    outcomes.update(spread)
    weight = F.col(w) if w else F.lit(1.0)
    base = df.select(*groups, unit, weight.alias("__w"), *[c.cast("double").alias(f"__y_{n}") for n, c in outcomes.items()])
    base = spread_out(base.filter(F.col("__w").isNotNull()))
    drawn = base.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws)))).withColumn(
        "__e", F.col("__w") * -F.ln(uniform(unit, "draw"))
    )
    sums = []
    for n in outcomes:
        present = F.col(f"__y_{n}").isNotNull()
        sums.append(F.sum(F.col("__e") * F.col(f"__y_{n}")).alias(f"__s_{n}"))
        sums.append(F.sum(F.when(present, F.col("__e"))).alias(f"__t_{n}"))
        if n in spread:
            sums.append(F.sum(F.col("__e") * F.col(f"__y_{n}") * F.col(f"__y_{n}")).alias(f"__q_{n}"))
    cells = drawn.groupBy("draw", *groups).agg(*sums)

    def estimate(n, at):
        mean = share(at(f"__s_{n}"), at(f"__t_{n}"))
        if n not in spread:
            return mean
        # Rounded before the root, which would blow the noise of a zero variance up.
        variance = F.round(share(at(f"__q_{n}"), at(f"__t_{n}")) - mean * mean, NOISE_DIGITS)
        return F.sqrt(F.greatest(variance, F.lit(0.0)))

    # The groups of one draw meet here, already summed: a row per group, not per unit.
    of_draw = Window.partitionBy("draw")
    values = {
        n: F.round(estimate(n, F.col) - estimate(n, lambda c: F.sum(c).over(of_draw)), NOISE_DIGITS) for n in outcomes
    }
    if not many:
        return cells.select("draw", *groups, values["value"].alias("value"))
    cells = cells.withColumns({f"__d_{n}": v for n, v in values.items()})
    rows = F.array(*[F.struct(F.lit(n).alias(resp), F.col(f"__d_{n}").alias("value")) for n in outcomes])
    return cells.select("draw", *groups, F.explode(rows).alias("__r")).select(
        "draw", *groups, f"__r.{resp}", "__r.value"
    )


def replicate_slopes(
    df: DataFrame,
    groups: Sequence[str],
    outcomes: Mapping[str, tuple[Column, Column]],
    n_draws: int = 200,
    w: str | None = "weight",
    unit: str = "mainid",
    resp: str = "resp",
) -> DataFrame:
    """Reweighted replicates of weighted regression slopes: {name: (x, y)} -> (draw, groups, resp, value)."""
    weight = F.col(w) if w else F.lit(1.0)
    pairs = []
    for n, (x, y) in outcomes.items():
        both = x.isNotNull() & y.isNotNull()
        pairs += [F.when(both, x).cast("double").alias(f"__x_{n}"), F.when(both, y).cast("double").alias(f"__y_{n}")]
    base = spread_out(df.select(*groups, unit, weight.alias("__w"), *pairs).filter(F.col("__w").isNotNull()))
    drawn = base.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws)))).withColumn(
        "__e", F.col("__w") * -F.ln(uniform(unit, "draw"))
    )
    sums = []
    for n in outcomes:
        e, x, y = F.col("__e"), F.col(f"__x_{n}"), F.col(f"__y_{n}")
        sums += [
            F.sum(F.when(x.isNotNull(), e)).alias(f"__0_{n}"),
            F.sum(e * x).alias(f"__1_{n}"),
            F.sum(e * y).alias(f"__2_{n}"),
            F.sum(e * x * x).alias(f"__3_{n}"),
            F.sum(e * x * y).alias(f"__4_{n}"),
        ]
    cells = drawn.groupBy("draw", *groups).agg(*sums)
    rows = []
    for n in outcomes:
        t, sx, sy, sxx, sxy = (F.col(f"__{i}_{n}") for i in range(5))
        spread_x = F.round(share(sxx, t) - share(sx, t) * share(sx, t), NOISE_DIGITS)
        slope = F.round(share(share(sxy, t) - share(sx, t) * share(sy, t), spread_x), NOISE_DIGITS)
        rows.append(F.struct(F.lit(n).alias(resp), slope.alias("value")))
    return cells.select("draw", *groups, F.explode(F.array(*rows)).alias("__r")).select(
        "draw", *groups, f"__r.{resp}", "__r.value"
    )


def adjusted_draws(
    df: DataFrame,
    covariates: Sequence[str],
    y: str,
    family: str = "gaussian",
    n_draws: int = 200,
    w: str | None = "weight",
    unit: str = "mainid",
) -> DataFrame:
    """Reweighted replicates of adjusted effects: (draw, term, level, value).

    A model with a main effect of every categorical covariate is fitted for each draw; a level's
    value is its difference to the covariate's first level on the scale of the link (identity
    for gaussian, log for poisson, logit for bernoulli), the intercept has no level. For these
    families the weight and the weighted outcome of a covariate cell tell all about it, so the
    rows of a person are summed, then persons per cell and draw, map-side; a draw's cells, whose
    number does not grow with the data, meet in one small solve. Incomplete rows are left out.
    """
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    outcome = F.col(y).cast("double")
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in covariates], unit, weight.alias("__w"), outcome.alias("__y")).dropna()
    people = rows.groupBy(unit, *covariates).agg(F.sum("__w").alias("__w"), F.sum(F.col("__w") * F.col("__y")).alias("__wy"))
    drawn = spread_out(people).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
    drawn = drawn.withColumn("__e", -F.ln(uniform(unit, "draw")))
    cells = drawn.groupBy("draw", *covariates).agg(
        F.sum(F.col("__e") * F.col("__w")).alias("__w"), F.sum(F.col("__e") * F.col("__wy")).alias("__wy")
    )

    def solve(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell[cell["__w"] > 0]
        names, columns = [("(Intercept)", None)], [np.ones(len(cell))]
        for c in covariates:
            for level in sorted(cell[c].unique())[1:]:
                names.append((c, level))
                columns.append((cell[c] == level).to_numpy(float))
        coefficients = _main_effects(np.column_stack(columns), cell["__w"].to_numpy(), cell["__wy"].to_numpy(), family)
        return pd.DataFrame(
            {"draw": cell["draw"].iloc[0], "term": [t for t, _ in names], "level": [v for _, v in names], "value": coefficients}
        )

    return cells.groupBy("draw").applyInPandas(solve, "draw int, term string, level string, value double")


def _main_effects(x: np.ndarray, w: np.ndarray, wy: np.ndarray, family: str, rounds: int = 100) -> np.ndarray:
    """Weighted maximum likelihood from the cells' weights and weighted outcomes, by iterated least squares."""
    mean = wy / w
    if family == "gaussian":
        root = np.sqrt(w)
        return np.linalg.lstsq(x * root[:, None], mean * root, rcond=None)[0]
    overall = wy.sum() / w.sum()
    b = np.zeros(x.shape[1])
    b[0] = np.log(overall) if family == "poisson" else np.log(overall / (1 - overall))
    for _ in range(rounds):
        eta = np.clip(x @ b, -30, 30)
        mu = np.exp(eta) if family == "poisson" else 1 / (1 + np.exp(-eta))
        curve = mu if family == "poisson" else mu * (1 - mu)
        root = np.sqrt(w * curve)
        new = np.linalg.lstsq(x * root[:, None], (eta + (mean - mu) / curve) * root, rcond=None)[0]
        if np.abs(new - b).max() < 1e-10:
            return new
        b = new
    return b


def shrunken_effects(
    df: DataFrame, groups: Sequence[str], y: str, w: str = "weight"
) -> DataFrame:
    """Partially pooled group effects: (groups, n, mean, effect).

    effect = tau2 / (tau2 + v) * (mean - overall mean), with v = s2 / n_eff,
    n_eff = (sum w)^2 / sum w^2 and tau2 = max(0, var(means) - mean(v)). A group of one takes the
    pooled variance.
    """
    used = df.filter(F.col(w).isNotNull() & F.col(y).isNotNull())
    wt, yy = F.col(w), F.col(y).cast("double")
    cells = used.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(wt).alias("__w"),
        F.sum(wt * wt).alias("__w2"),
        F.sum(wt * yy).alias("__wy"),
        F.sum(wt * yy * yy).alias("__wyy"),
    ).filter(F.col("__w") > 0)
    cells = cells.withColumn("mean", F.col("__wy") / F.col("__w")).withColumn(
        "__s2", F.when(F.col("n") > 1, F.greatest(F.col("__wyy") / F.col("__w") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    )
    # A row per group, kept: the overall values below must not pass over the data again.
    cells = cut_lineage(cells)
    known = F.col("__s2").isNotNull()
    overall = cells.agg(
        (F.sum("__wy") / F.sum("__w")).alias("m"),
        share(F.sum(F.col("__w") * F.col("__s2")), F.sum(F.when(known, F.col("__w")))).alias("pooled"),
    )
    # One row each: scalar subqueries, no join.
    with_v = cells.withColumn(
        "__v",
        F.coalesce("__s2", overall.select("pooled").scalar()) * F.col("__w2") / (F.col("__w") * F.col("__w")),
    )
    tau2 = with_v.agg(F.greatest(F.var_samp("mean") - F.avg("__v"), F.lit(0.0)).alias("t"))
    t = F.coalesce(tau2.scalar(), F.lit(0.0))
    effect = F.coalesce(share(t, t + F.col("__v")), F.lit(0.0)) * (F.col("mean") - overall.select("m").scalar())
    return with_v.select(*groups, "n", "mean", effect.alias("effect"))


def contrasts(
    draws: DataFrame,
    dim: str,
    pairs: Sequence[tuple[str, str]] | None = None,
    value: str = "value",
    diff: str = "diff",
) -> DataFrame:
    """Differences between named levels of one dimension within a draw: (rest, diff, value)."""
    pairs = list(pairs or CONTRASTS[dim])
    levels = list(dict.fromkeys(level for pair in pairs for level in pair))
    rest = [c for c in draws.columns if c not in (dim, value)]
    wide = draws.groupBy(*rest).agg(
        *[F.max(F.when(F.col(dim) == level, F.col(value))).alias(f"__l{i}") for i, level in enumerate(levels)]
    )
    at = {level: F.col(f"__l{i}") for i, level in enumerate(levels)}
    rows = [F.struct(F.lit(f"{a} - {b}").alias(diff), (at[a] - at[b]).alias(value)) for a, b in pairs]
    return wide.select(*rest, F.explode(F.array(*rows)).alias("__r")).select(*rest, f"__r.{diff}", f"__r.{value}")


def direction_odds(draws: DataFrame, *keys: str, value: str = "value", inverse: bool = False) -> DataFrame:
    """Draws above zero over draws below zero per key, with a label: (keys, odds, label)."""
    above, below = F.count_if(F.col(value) > 0), F.count_if(F.col(value) < 0)
    odds = ratio(below, above) if inverse else ratio(above, below)
    return draws.groupBy(*keys).agg(odds.alias("odds")).withColumn("label", odds_label("odds"))


def gap_change_odds(
    draws: DataFrame,
    difference: str | Callable[[DataFrame], DataFrame],
    *keys: str,
    dim: str = "survey",
    pairs: Mapping[str, tuple[str, str]] | None = None,
    value: str = "value",
    inverse: bool = False,
) -> DataFrame:
    """Is a gap larger in one wave than in another: odds per pair of waves, one column each.

    `difference` names a dimension for `contrasts`, or maps a draws table to a table of gaps.
    """
    pairs = dict(
        pairs
        or {
            "odds_june_2016": ("June 2020", "2016"),
            "odds_august_june": ("August 2020", "June 2020"),
            "odds_august_2016": ("August 2020", "2016"),
        }
    )
    gaps = difference(draws) if callable(difference) else contrasts(draws, difference, value=value)
    levels = list(dict.fromkeys(level for pair in pairs.values() for level in pair))
    rest = [c for c in gaps.columns if c not in (dim, value)]
    wide = gaps.groupBy(*rest).agg(
        *[F.max(F.when(F.col(dim) == level, F.col(value))).alias(f"__l{i}") for i, level in enumerate(levels)]
    )
    at = {level: F.col(f"__l{i}") for i, level in enumerate(levels)}
    aggs = []
    for name, (a, b) in pairs.items():
        more, less = F.count_if(at[a] > at[b]), F.count_if(at[a] < at[b])
        aggs.append((ratio(less, more) if inverse else ratio(more, less)).alias(name))
    return wide.groupBy(*keys).agg(*aggs)


def parse_draw_names(
    wide: DataFrame, resp_levels: Sequence[str] = (), cluster: bool = False, draw: str = "draw"
) -> DataFrame:
    """Columns named like r_sex:survey[Female_June.2020,Intercept] -> long draws with their levels.

    Names are few, so the levels are read once per name and not once per row. Level columns in
    which any name has no match are dropped.
    """
    named = [c for c in wide.columns if c.startswith("r_")]
    names = wide.sparkSession.createDataFrame([(c,) for c in named], "name string")
    levels = {}
    if cluster:
        levels["cluster"] = first_match("name", CLUSTER_PATTERN)
    if resp_levels:
        levels["resp"] = first_match("name", "|".join(resp_levels))
    levels["coef"] = F.coalesce(first_match("name", COEF_PATTERN), F.lit("mu"))
    levels.update({n: first_match("name", p) for n, p in DRAW_NAME_PATTERNS.items()})
    tidy = {n: F.regexp_replace(c, r"\.", " ") for n, c in levels.items()}
    tidy["dclasuk"] = F.when(tidy["dclasuk"] == "unemployed", "Not Working").otherwise(tidy["dclasuk"])
    key = drop_null_columns(names.withColumns(tidy), list(tidy))
    return _columns_to_rows(wide, named, draw, "name").join(key, "name").drop("name")


def _columns_to_rows(wide: DataFrame, cols: Sequence[str], draw: str, name: str) -> DataFrame:
    """Unpivot columns whose names hold dots and brackets; a group that a replicate doesn't have is no row."""
    cells = [F.struct(F.lit(c).alias(name), F.col(f"`{c}`").alias("value")) for c in cols]
    rows = wide.select(draw, F.explode(F.array(*cells)).alias("__r")).select(draw, f"__r.{name}", "__r.value")
    return rows.filter(F.col("value").isNotNull())


def draw_columns(draws: DataFrame, levels: Mapping[str, Sequence[str]], term: str, draw: str = "draw") -> DataFrame:
    """The wide form of a draws table, named as `parse_draw_names` reads it."""
    from itertools import product

    cells = []
    for combo in product(*levels.values()):
        match = F.lit(True)
        for dim, level in zip(levels, combo):
            match = match & (F.col(dim) == level)
        label = "_".join(level.replace(" ", ".") for level in combo)
        name = f"r_{':'.join(levels)}[{label},{term}]"
        cells.append(F.max(F.when(match, F.col("value"))).alias(name))
    return draws.groupBy(draw).agg(*cells)


def gather_terms(wide: DataFrame, pattern: str, draw: str = "draw", name: str = "term") -> DataFrame:
    """Pick coefficient columns by a regular expression and put them in rows."""
    import re

    chosen = [c for c in wide.columns if c != draw and re.search(pattern, c)]
    return _columns_to_rows(wide, chosen, draw, name)


def effect_size(draws: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """exp of the mean coefficient: a multiplicative effect under a log link."""
    return draws.groupBy(*keys).agg(F.exp(F.avg(value)).alias("effect"))


def effects_table(
    models: Mapping[str, tuple[DataFrame | None, Sequence[str]]], digits: int = 3
) -> DataFrame:
    """Group effects of several models, stacked: (model, effect, estimate, est_error, q2_5, q97_5).

    {model: (draws, group columns)}; a model without group effects gives one marker row.
    """
    out = None
    for model, (draws, groups) in models.items():
        if draws is None:
            continue
        label = F.concat_ws("_", *groups).alias("effect")
        labelled = draws.select(label, "value")
        moments = [F.avg("value").alias("m"), F.stddev_samp("value").alias("s")]
        stats = interval(labelled, "effect", widths=[0.95]).join(labelled.groupBy("effect").agg(*moments), "effect")
        table = stats.select(
            F.lit(model).alias("model"),
            "effect",
            half_even("m", digits).alias("estimate"),
            half_even("s", digits).alias("est_error"),
            half_even("lower", digits).alias("q2_5"),
            half_even("upper", digits).alias("q97_5"),
        )
        out = table if out is None else out.unionByName(table)
    missing = [m for m, (draws, _) in models.items() if draws is None]
    if missing and out is not None:
        marker = out.sparkSession.createDataFrame([(m, "No Group Level Effects") for m in missing], "model string, effect string")
        out = out.unionByName(marker, allowMissingColumns=True)
    return out


def predictive_check(
    df: DataFrame, groups: Sequence[str], y: str, n_draws: int = 30, w: str = "weight", unit: str = "diaryid"
) -> DataFrame:
    """Replicated outcomes beside the data, long: the rows of `df` with (draw, predicted).

    A replicate is the group mean of that draw plus noise with the group's spread; the noise is
    a reproducible normal number per row and draw.
    """
    means = replicate_draws(df, groups, y, n_draws, w, unit)
    used = df.filter(F.col(w).isNotNull() & F.col(y).isNotNull())
    # A row per group holds all its draws; it meets the narrow rows before they are multiplied.
    effects = means.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("draw", "value"))).alias("__effects"))
    spread = used.groupBy(*groups).agg(F.coalesce(F.stddev_samp(y), F.lit(0.0)).alias("__sd"))
    centre = used.agg(share(F.sum(F.col(w) * F.col(y)), F.sum(w))).scalar()
    facts = join_null_safe(spread, effects, groups, "left")
    rows = join_group_facts(used, facts, groups, unit).withColumn("__centre", centre)
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
    radius = F.sqrt(-2 * F.ln(uniform(unit, F.concat(F.lit("r"), F.col("draw")))))
    angle = 2 * 3.141592653589793 * uniform(unit, F.concat(F.lit("a"), F.col("draw")))
    effect = F.try_element_at("__effects", F.col("draw"))
    return drawn.withColumn("predicted", F.col("__centre") + effect + F.col("__sd") * radius * F.cos(angle)).drop(
        "__sd", "__effects", "__centre"
    )


# ---- fitted models -------------------------------------------------------------------------

FAMILIES = {
    "gaussian": ("gaussian", "identity"),
    "binomial": ("binomial", "logit"),
    "bernoulli": ("binomial", "logit"),
    "poisson": ("poisson", "log"),
    "gamma": ("gamma", "log"),
}


def _model_frame(df: DataFrame, y: str, terms: Sequence[str], w: str | None):
    """Complete cases with an encoded feature vector, and the names of its entries."""
    from pyspark.ml.feature import RFormula

    needed = [y, *terms, *([w] if w else [])]
    rows = df.select(*needed).dropna()
    if w:
        rows = rows.filter(F.col(w) > 0)
    # Category levels come from RFormula; string levels are few. Their order follows the rows.
    fitted = RFormula(formula=f"{y} ~ {' + '.join(terms)}", featuresCol="__x", labelCol="__y").fit(rows)
    # Weights of equal rows are summed before the fit, which changes no weighted estimate; the few
    # distinct rows are kept, so the many passes of a fit don't read the data again.
    weight = F.sum(w) if w else F.count(F.lit(1)).cast("double")
    cells = cut_lineage(rows.groupBy(y, *terms).agg(weight.alias("__weight")))
    frame = fitted.transform(cells)
    attrs = frame.schema["__x"].metadata["ml_attr"]["attrs"]
    names = [a["name"] for a in sorted((a for kind in attrs.values() for a in kind), key=lambda a: a["idx"])]
    return frame, names


def weighted_glm(
    df: DataFrame, y: str, terms: Sequence[str], family: str = "gaussian", w: str | None = "weight", max_iter: int = 200
) -> DataFrame:
    """Population coefficients of a weighted model: (resp, term, coefficient, converged). Runs jobs.

    gaussian, bernoulli, poisson and gamma are generalised linear models; 'categorical' is a
    multinomial logistic regression against its first level; 'robust' is a Huber regression;
    'tweedie' is a log-link model with variance growing as mean to the power 1.5. A fit that has
    not settled after `max_iter` rounds (data that separate two levels never do) is marked.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression

    spark = df.sparkSession
    if family == "categorical":
        from pyspark.ml.feature import StringIndexer

        indexed = StringIndexer(inputCol=y, outputCol="level_no", stringOrderType="alphabetAsc").fit(df.dropna(subset=[y]))
        frame, names = _model_frame(indexed.transform(df.dropna(subset=[y])), "level_no", terms, w)
        model = LogisticRegression(
            featuresCol="__x", labelCol="__y", family="multinomial", maxIter=max_iter, weightCol="__weight"
        ).fit(frame)
        converged = model.summary.totalIterations < max_iter
        coef, icpt = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
        rows = []
        for i, level in enumerate(indexed.labels[1:], 1):
            rows.append((level, "(Intercept)", float(icpt[i] - icpt[0]), converged))
            rows += [(level, t, float(c - c0), converged) for t, c, c0 in zip(names, coef[i], coef[0])]
        return spark.createDataFrame(rows, "resp string, term string, coefficient double, converged boolean")
    frame, names = _model_frame(df, y, terms, w)
    weight = {"weightCol": "__weight"}
    if family == "robust":
        model = LinearRegression(featuresCol="__x", labelCol="__y", loss="huber", maxIter=max_iter, **weight).fit(frame)
    elif family == "tweedie":
        model = GeneralizedLinearRegression(
            featuresCol="__x", labelCol="__y", family="tweedie", variancePower=1.5, linkPower=0.0, maxIter=max_iter, **weight
        ).fit(frame)
    else:
        dist, link = FAMILIES[family]
        model = GeneralizedLinearRegression(
            featuresCol="__x", labelCol="__y", family=dist, link=link, maxIter=max_iter, **weight
        ).fit(frame)
    rounds = model.summary.totalIterations if family == "robust" else model.summary.numIterations
    converged = rounds < max_iter
    rows = [(y, "(Intercept)", float(model.intercept), converged)]
    rows += [(y, t, float(c), converged) for t, c in zip(names, model.coefficients.toArray())]
    return spark.createDataFrame(rows, "resp string, term string, coefficient double, converged boolean")


def two_part_fit(
    df: DataFrame, y: str, terms: Sequence[str], family: str = "gamma", w: str | None = "weight"
) -> DataFrame:
    """A zero part (is y zero: binomial) and a positive part: (part, resp, term, coefficient, converged)."""
    zero = weighted_glm(df.withColumn("zero_part", (F.col(y) == 0).cast("int")), "zero_part", terms, "binomial", w)
    positive = weighted_glm(df.filter(F.col(y) > 0), y, terms, family, w)
    return zero.withColumn("resp", F.lit(y)).select(F.lit("zero").alias("part"), "*").unionByName(
        positive.select(F.lit("positive").alias("part"), "*")
    )
