"""Count and Student models against likelihoods written out here."""

import math

import numpy as np
import pytest

from dayloom.operators import mixtures as M

RNG = np.random.default_rng(7)


def count_likelihood(rows, p):
    """Log-likelihood of a zero-inflated negative binomial; p maps (part, term, level) to a coefficient."""

    def line(part, r):
        return sum(c * (1 if t == "(Intercept)" else r[t] if level is None else r[t] == level) for (own, t, level), c in p.items() if own == part)

    total = 0.0
    for r in rows:
        mu, y = math.exp(line("mu", r)), r["y"]
        if any(k[0] == "shape" for k in p):
            s = math.exp(line("shape", r))
            f = math.lgamma(y + s) - math.lgamma(s) - math.lgamma(y + 1) + s * math.log(s / (s + mu)) + y * math.log(mu / (s + mu))
        else:
            f = y * math.log(mu) - mu - math.lgamma(y + 1)
        z = 1 / (1 + math.exp(-line("zi", r))) if any(k[0] == "zi" for k in p) else 0.0
        total += r["weight"] * (math.log(z + (1 - z) * math.exp(f)) if y == 0 else math.log(1 - z) + f)
    return total


def student_likelihood(rows, p):
    def line(part, r):
        return sum(c * (1 if t == "(Intercept)" else r[t] if level is None else r[t] == level) for (own, t, level), c in p.items() if own == part)

    total = 0.0
    for r in rows:
        nu, sigma = p["nu", "(Intercept)", None], math.exp(line("sigma", r))
        gap = (r["y"] - line("mu", r)) / sigma
        total += r["weight"] * (math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - math.log(sigma) - (nu + 1) / 2 * math.log1p(gap * gap / nu))
    return total


def is_a_maximum(likelihood, rows, p, slope=1e-2, step=1e-4):
    """No coefficient can be moved a little, alone or with others, to a higher likelihood."""
    here = likelihood(rows, p)
    for k in p:
        up, down = (likelihood(rows, p | {k: p[k] + x}) for x in (step, -step))
        assert abs(up - down) / (2 * step) < slope * max(1, abs(here) ** 0.5), k
        assert up + down - 2 * here < 1e-7
    rng = np.random.default_rng(0)
    for size in (0.05, 0.3):
        for _ in range(15):
            assert likelihood(rows, {k: c + size * x for (k, c), x in zip(p.items(), rng.normal(size=len(p)), strict=True)}) <= here + 1e-6
    return here


def coefficients(df):
    rows = df.collect()
    assert all(r["converged"] for r in rows)
    return {(r["part"], r["term"], r["level"]): r["coefficient"] for r in rows}


def people(n):
    return [{"sex": "Male" if RNG.random() < 0.5 else "Female", "survey": str(RNG.choice(["2016", "June", "August"])), "kids": int(RNG.integers(0, 3)), "weight": float(RNG.choice([0.5, 1.0, 2.0]))} for _ in range(n)]


def counts(n, zeros):
    rows = people(n)
    for r in rows:
        mu = math.exp(0.8 + 0.5 * (r["sex"] == "Male") - 0.4 * (r["survey"] == "June") + 0.2 * r["kids"])
        shape = math.exp(0.3 + 0.9 * (r["survey"] == "2016"))
        r["y"] = 0 if RNG.random() < zeros * (1.5 if r["sex"] == "Male" else 0.7) else int(RNG.negative_binomial(shape, shape / (shape + mu)))
    return rows


FULL = "sex string, survey string, kids int, weight double, y int"


def table(spark, rows, kind="int"):
    return spark.createDataFrame([tuple(r[c] for c in ("sex", "survey", "kids", "weight", "y")) for r in rows], FULL.replace("y int", f"y {kind}")).repartition(4)


def test_special_functions():
    x = np.array([0.01, 0.3, 1, 2.5, 7, 40, 1e4])
    assert np.allclose(M.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11)
    h = 1e-5
    assert np.allclose(M.digamma(x[1:]), [(math.lgamma(v + h * v) - math.lgamma(v - h * v)) / (2 * h * v) for v in x[1:]], rtol=1e-5, atol=1e-6)
    assert np.allclose(M.trigamma(x), (M.digamma(x * (1 + 1e-6)) - M.digamma(x * (1 - 1e-6))) / (2e-6 * x), rtol=1e-4)


@pytest.mark.parametrize("shape, zero", [(None, None), ((), None), (("survey",), None), ((), ()), (("survey",), ("sex",)), (None, ("sex",))])
def test_count_models_are_maxima(spark, shape, zero):
    rows = counts(500, 0.3 if zero is not None else 0.0)
    fitted = M.count_fit(table(spark, rows), "y", ["sex", "survey", "kids"], shape, zero)
    p = coefficients(fitted)
    assert {k[0] for k in p} == {"mu"} | ({"shape"} if shape is not None else set()) | ({"zi"} if zero is not None else set())
    here = is_a_maximum(count_likelihood, rows, p)
    assert fitted.first()["likelihood"] == pytest.approx(here, abs=1e-4)


def test_zero_inflation_is_found_again(spark):
    rows = counts(6000, 0.4)
    p = coefficients(M.count_fit(table(spark, rows), "y", ["sex", "survey", "kids"], ["survey"], ["sex"]))
    assert p["mu", "sex", "Male"] == pytest.approx(0.5, abs=0.15) and p["mu", "kids", None] == pytest.approx(0.2, abs=0.1)
    extra = {s: 1 / (1 + math.exp(-p["zi", "(Intercept)", None] - (s == "Male") * p["zi", "sex", "Male"])) for s in ("Male", "Female")}
    assert extra["Male"] == pytest.approx(0.6, abs=0.08) and extra["Female"] == pytest.approx(0.28, abs=0.08)


def test_one_factor_negative_binomial_fits_the_means(spark):
    rows = [r | {"y": 3} for r in people(30)] + counts(200, 0.0)
    p = coefficients(M.count_fit(table(spark, rows), "y", ["survey"], ["survey"]))
    for level in ("2016", "June", "August"):
        own = [r for r in rows if r["survey"] == level]
        mean = sum(r["weight"] * r["y"] for r in own) / sum(r["weight"] for r in own)
        fitted = p["mu", "(Intercept)", None] + p.get(("mu", "survey", level), 0.0)
        assert math.exp(fitted) == pytest.approx(mean, rel=1e-5)


def test_counts_without_spread_and_missing_rows(spark):
    rows = [r | {"y": 2} for r in people(40)]
    p = coefficients(M.count_fit(table(spark, rows), "y", ["sex"]))
    assert math.exp(p["mu", "(Intercept)", None]) == pytest.approx(2, rel=1e-3) and p["shape", "(Intercept)", None] > 5
    odd = table(spark, rows).unionByName(spark.createDataFrame([(None, "June", 1, 1.0, 9), ("Male", "June", 1, None, 9), ("Male", "June", 1, 0.0, 9), ("Male", "June", 1, 1.0, None)], FULL))
    assert coefficients(M.count_fit(odd, "y", ["sex"])) == pytest.approx(p, rel=1e-6)
    assert M.count_fit(odd.limit(0), "y", ["sex"]).count() == 0


def test_e_step_sums_agree_with_sql(spark):
    """The expected extra zeros of every covariate cell, from the fitted coefficients."""
    import duckdb
    import pandas as pd

    rows = counts(400, 0.4)
    p = coefficients(M.count_fit(table(spark, rows), "y", ["sex"], None, ["sex"]))
    data, model = pd.DataFrame(rows), pd.DataFrame([{"part": k[0], "level": k[2], "c": c} for k, c in p.items()])
    con = duckdb.connect()
    con.register("data", data)
    con.register("model", model)
    sql = """
    with line as (select s.sex, m.part, sum(m.c) as eta from (select distinct sex from data) s join model m on m.level is null or m.level = s.sex group by all),
    e as (select d.*, 1 / (1 + exp(-z.eta)) as z, exp(-exp(u.eta)) as f0 from data d join line z on z.sex = d.sex and z.part = 'zi' join line u on u.sex = d.sex and u.part = 'mu')
    select sex, sum(case when y = 0 then weight * z / (z + (1 - z) * f0) else 0 end) as extra, sum(weight * z) as share from e group by sex"""
    for _, extra, share in con.execute(sql).fetchall():
        # At the maximum the latent zeros of a cell are as many as its zero part expects.
        assert extra == pytest.approx(share, rel=1e-4)


def test_student_model_is_a_maximum(spark):
    rows = people(400)
    for r in rows:
        r["y"] = float(5 + 2 * (r["sex"] == "Male") + math.exp(0.4 * (r["survey"] == "June")) * RNG.standard_t(3.0))
    p = coefficients(M.student_fit(table(spark, rows, "double"), "y", ["sex", "kids"], ["survey"], digits=1e-7))
    is_a_maximum(student_likelihood, rows, p)
    assert 1.5 < p["nu", "(Intercept)", None] < 8 and p["mu", "sex", "Male"] == pytest.approx(2, abs=0.6)


def test_student_model_without_covariates_and_rows(spark):
    rows = [r | {"y": float(RNG.normal()) if i % 10 else 50.0} for i, r in enumerate(people(120))]
    df = table(spark, rows, "double")
    p = coefficients(M.student_fit(df, "y", []))
    is_a_maximum(student_likelihood, rows, p)
    assert abs(p["mu", "(Intercept)", None]) < 0.6
    assert M.student_fit(df.limit(0), "y", ["sex"]).count() == 0
