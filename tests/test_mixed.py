"""Linear models on cross-products, predictive draws and weighted bandwidths against plain NumPy."""

import hashlib
import math

import numpy as np
import pytest

from dayloom.operators import aggregate as A
from dayloom.operators import mixed as X
from dayloom.operators import predictive as V
from dayloom.operators import reshape as S

RNG = np.random.default_rng(3)


def people(n):
    rows = []
    for i in range(n):
        sex, wave, place = str(RNG.choice(["f", "m"])), str(RNG.choice(["a", "b", "c"])), f"p{RNG.integers(0, 9)}"
        age = float(RNG.integers(18, 65))
        y = 1.5 + (sex == "m") + 0.05 * age + {"a": 0, "b": 0.6, "c": -0.4}[wave] + 0.8 * math.sin(7 * int(place[1:])) + float(RNG.normal())
        rows.append((int(i // 2), sex, wave, place, age, y, float(RNG.choice([0.5, 1.0, 2.0]))))
    return rows


KIND = "mainid bigint, sex string, wave string, place string, age double, y double, weight double"


def exponential(unit, draw):
    u = (int(hashlib.md5(f"{unit}:{draw}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0
    return -math.log(u)


def columns_of(rows):
    return np.array([[1, r[1] == "m", r[2] == "b", r[2] == "c", r[4]] for r in rows], float)


def test_adjusted_slopes_equal_least_squares_of_every_draw(spark):
    rows = people(300)
    odd = [(1, None, "a", "p1", 30.0, 1.0, 1.0), (1, "m", "a", "p1", None, 1.0, 1.0), (1, "m", "a", "p1", 30.0, 1.0, 0.0), (1, "m", "a", "p1", 30.0, None, 1.0)]
    df = spark.createDataFrame(rows + odd, KIND).repartition(5)
    got = {(r["draw"], r["term"], r["level"]): r["value"] for r in X.adjusted_slopes(df, "y", ["sex", "wave"], ["age"], 4).collect()}
    x, y, w = columns_of(rows), np.array([r[5] for r in rows]), np.array([r[6] for r in rows])
    for draw in range(1, 5):
        root = np.sqrt(w * [exponential(r[0], draw) for r in rows])
        want = np.linalg.lstsq(x * root[:, None], y * root, rcond=None)[0]
        names = [("(Intercept)", None), ("sex", "m"), ("wave", "b"), ("wave", "c"), ("age", None)]
        assert np.allclose([got[draw, *n] for n in names], want, atol=1e-7)
    assert len(got) == 20 and X.adjusted_slopes(df.limit(0), "y", ["sex"], ["age"], 3).count() == 0


def test_a_slope_that_others_determine_has_no_value(spark):
    df = spark.createDataFrame([(*r[:4], r[4], r[5], r[6], 2 * r[4] + 1) for r in people(60)], KIND + ", twice double")
    got = {r["term"]: r["value"] for r in X.adjusted_slopes(df, "y", ["sex"], ["age", "twice"], 1).collect()}
    assert got["age"] is None and got["twice"] is None and got["sex"] is not None


def restricted_likelihood(rows, noise, spread, random):
    """Log restricted likelihood from the full covariance of the rows."""
    x, y, w = columns_of(rows), np.array([r[5] for r in rows]), np.array([r[6] for r in rows])
    v = np.diag(noise**2 / w)
    for name, sd in spread.items():
        at = np.array([r[random[name]] for r in rows])
        v += sd**2 * (at[:, None] == at[None, :])
    inverse = np.linalg.inv(v)
    xvx = x.T @ inverse @ x
    beta = np.linalg.solve(xvx, x.T @ inverse @ y)
    r = y - x @ beta
    return -0.5 * (np.linalg.slogdet(v)[1] + np.linalg.slogdet(xvx)[1] + r @ inverse @ r), beta, inverse @ r


def test_pooled_effects_maximise_the_restricted_likelihood(spark):
    rows = people(240)
    df = spark.createDataFrame(rows, KIND).repartition(4)
    out = X.pooled_effects(df, "y", ["sex", "wave"], ["age"], ["place"]).collect()
    assert all(r["converged"] for r in out)
    value = {(r["part"], r["term"], r["level"]): r["value"] for r in out}
    noise, sd = value["sd", "(Noise)", None], value["sd", "place", None]
    top, beta, pull = restricted_likelihood(rows, noise, {"place": sd}, {"place": 3})
    for a, b in ((1.02, 1), (0.98, 1), (1, 1.05), (1, 0.95), (1.05, 0.9)):
        assert restricted_likelihood(rows, a * noise, {"place": b * sd}, {"place": 3})[0] < top
    assert np.allclose([value["fixed", t, v] for t, v in [("(Intercept)", None), ("sex", "m"), ("wave", "b"), ("wave", "c"), ("age", None)]], beta, atol=1e-5)
    at = np.array([r[3] for r in rows])
    for place in set(at):
        assert value["pooled", "place", place] == pytest.approx(sd**2 * pull[at == place].sum(), abs=1e-5)


def test_two_groupings_are_pooled_at_once_and_noise_alone_is_pooled_away(spark):
    rows = people(200)
    df = spark.createDataFrame(rows, KIND)
    out = X.pooled_effects(df, "y", ["sex"], ["age"], ["wave", "place"]).collect()
    assert {(r["part"], r["term"]) for r in out} >= {("pooled", "wave"), ("pooled", "place"), ("sd", "wave"), ("sd", "place"), ("sd", "(Noise)")}
    flat = spark.createDataFrame([(*r[:5], float(RNG.normal()), 1.0) for r in rows], KIND)
    out = {(r["part"], r["term"], r["level"]): r["value"] for r in X.pooled_effects(flat, "y", pooled=["place"]).collect()}
    assert out["sd", "place", None] < 0.35 and out["sd", "(Noise)", None] == pytest.approx(1, abs=0.2)
    assert X.pooled_effects(df.limit(0), "y", ["sex"], pooled=["place"]).count() == 0
    with pytest.raises(ValueError, match="pooled"):
        X.pooled_effects(df, "y", ["sex"])


@pytest.mark.parametrize("shape", [0.3, 1.0, 4.0, 60.0])
def test_gamma_draws_have_the_distribution(spark, shape):
    from pyspark.sql import functions as F

    x = np.sort([r[0] for r in spark.range(8000).select(V.gamma_draw(F.lit(shape), "id", F.lit(1))).collect()])
    assert (x > 0).all() and x.mean() == pytest.approx(shape, rel=0.06) and x.var() == pytest.approx(shape, rel=0.12)
    want = np.sort(np.random.default_rng(1).gamma(shape, size=200_000))
    at = np.quantile(want, np.linspace(0.02, 0.98, 25))
    assert np.abs(np.searchsorted(x, at) / len(x) - np.linspace(0.02, 0.98, 25)).max() < 0.025


def test_hurdle_draws_follow_their_group(spark):
    rows = [(i, "g" if i % 2 else "h", 0.0 if i % 5 == 0 and i % 2 else float(RNG.gamma(3.0, 2.0 if i % 2 else 0.5)), 1.0) for i in range(400)]
    rows += [(900 + i, "same", 2.0, 1.0) for i in range(5)] + [(990, "none", None, 1.0), (991, None, 1.0, 1.0), (992, None, 3.0, None)]
    df = spark.createDataFrame(rows, "diaryid bigint, g string, y double, weight double")
    drawn = V.hurdle_draws(df, ["g"], "y", 40)
    again = V.hurdle_draws(df.repartition(7), ["g"], "y", 40)
    same = lambda rows: sorted((r["diaryid"], r["draw"], None if r["predicted"] is None else round(r["predicted"], 9)) for r in rows)
    assert same(drawn.collect()) == same(again.collect())
    by = {}
    for r in drawn.collect():
        by.setdefault(r["g"], []).append(r["predicted"])
    own = lambda g: np.array([r[2] for r in rows if r[1] == g])
    for g in ("g", "h"):
        assert np.mean(by[g]) == pytest.approx(own(g).mean(), rel=0.08) and np.mean(np.array(by[g]) == 0) == pytest.approx((own(g) == 0).mean(), abs=0.03)
        assert np.std(by[g]) == pytest.approx(own(g).std(), rel=0.15)
    assert set(by["same"]) == {2.0} and set(by["none"]) == {None} and len(by[None]) == 80


def test_hurdle_draws_hash_a_try_once_and_are_dealt_out(spark, capsys):
    df = spark.createDataFrame([(i, "g", float(1 + i % 3), 1.0) for i in range(40)], "diaryid bigint, g string, y double, weight double").coalesce(1)
    drawn = V.hurdle_draws(df, ["g"], "y", 5)
    capsys.readouterr()
    drawn.explain()
    assert 3 <= capsys.readouterr().out.count("md5(") <= 4
    assert drawn.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_weighted_quantiles_of_groups(spark):
    rows = [(str(RNG.choice(["a", "b"])), float(np.round(RNG.normal(), 2)), float(RNG.choice([0.1, 0.25, 3.0]))) for _ in range(500)]
    rows += [("one", 5.0, 1.0), ("zero", 1.0, 0.0), ("zero", None, 1.0), (None, 1.0, 1.0), (None, 2.0, 3.0)]
    probs = [0.05, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["prob"]): r["value"] for r in A.weighted_quantiles(spark.createDataFrame(rows, "g string, x double, weight double"), "g", "x", probs).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((x, round(w * 1000)) for name, x, w in rows if name == g and x is not None and w)
        for p in probs if own else []:
            need, upto = p * sum(w for _, w in own), 0
            for x, w in own:
                upto += w
                if upto >= need - 1e-9:
                    want[g, p] = x
                    break
    assert got == want


def test_bandwidths_follow_the_data(spark):
    rows = [("a", float(x), 1.0) for x in RNG.normal(0, 2, 400)] + [("b", float(x), 1.0) for x in RNG.normal(0, 20, 400)] + [("c", 3.0, 1.0)] * 4 + [("d", float(i == 0), 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, x double, weight double")
    got = {r["g"]: r["bandwidth"] for r in A.bandwidths(df, "g", "x", 1.2).collect()}
    for g in ("a", "b"):
        x = np.sort([r[1] for r in rows if r[0] == g])
        narrow = min(x.std(), (x[299] - x[99]) / 1.34)
        assert got[g] == pytest.approx(1.2 * 0.9 * narrow * 400**-0.2, rel=1e-6)
    assert got["c"] == pytest.approx(1.2 * 0.9 * 4**-0.2) and got["d"] == pytest.approx(1.2 * 0.9 * np.std([1.0] + [0.0] * 49) * 50**-0.2)
    density = A.adaptive_density(df.filter("g in ('a', 'b')"), "g", "x", -100.0, 100.0, 801, 1.2).collect()
    for g in ("a", "b"):
        x, h = np.array([r[1] for r in rows if r[0] == g]), got[g]
        for r in density[::97]:
            if r["g"] == g:
                exact = np.exp(-((r["x_at"] - x) ** 2) / (2 * h * h)).mean() / (h * math.sqrt(2 * math.pi))
                assert r["density"] == pytest.approx(exact, abs=0.02 / h)
        assert sum(r["density"] for r in density if r["g"] == g) * 0.25 == pytest.approx(1, abs=0.01)


def test_missing_values_in_labels_and_levels(spark):
    from pyspark.sql import functions as F

    from dayloom.functions.recode import hours_label
    from dayloom.operators.effects import draw_columns, parse_draw_names

    hours = spark.createDataFrame([(7.52,), (None,), (0.0,)], "h double").select(hours_label("h").alias("label")).collect()
    assert [r["label"] for r in hours] == ["7h 30m", None, "0h 0m"]
    df = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", None), (None, 0.0)], "level string, x double")
    up = {r["level"]: r["level_ord"] for r in S.reorder_levels(df, "level", F.avg("x")).collect()}
    down = {r["level"]: r["level_ord"] for r in S.reorder_levels(df, "level", F.avg("x"), reverse=True).collect()}
    assert up == {"b": 1, "a": 2, "c": 3, None: None} and down == {"a": 1, "b": 2, "c": 3, None: None}
    draws = spark.createDataFrame([(1, "Female", "2016", 0.5), (2, "Male", "2016", 0.25)], "draw int, sex string, survey string, value double")
    long = parse_draw_names(draw_columns(draws, {"sex": ["Female", "Male"], "survey": ["2016", "June 2020"]}, "Intercept"))
    assert {(r["draw"], r["sex"], r["survey"], r["value"]) for r in long.collect()} == {(1, "Female", "2016", 0.5), (2, "Male", "2016", 0.25)}


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, "x", 2.5, 3)], "a int, b string, c double, a_2 bigint")
    assert S.columns_between(df, "b", "a_2") == ["b", "c", "a_2"] and S.columns_between(df, "c", "a") == ["c", "b", "a"]
    assert S.columns_matching(df, "^a") == ["a", "a_2"] and S.columns_matching(df, kind="numeric", but=["c"]) == ["a", "a_2"] and S.columns_matching(df, kind="string") == ["b"]
    assert S.rename_with(df, {"b": "d"}).columns == ["a", "d", "c", "a_2"] and S.rename_with(df, (r"^a(.*)$", r"z\1")).columns == ["z", "b", "c", "z_2"]
    assert S.add_affix(df, "% ", "!", ["c"]).columns == ["a", "b", "% c!", "a_2"]
    with pytest.raises(ValueError, match="same name"):
        S.rename_with(df, {"b": "a"})
