"""Properties, second implementations and plan checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayloom.operators import aggregate as A
from dayloom.operators import effects as E
from dayloom.operators import sequences as Q
from dayloom.operators import spells as W
from dayloom.plans.base import Study


def random_sequences(spark, n, slots, k=5, seed=1, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, k, (n, slots))
    x = np.concatenate([x, np.repeat(x[:1], copies, 0)]) if copies else x
    data = [(i + 1, [int(c) for c in row]) for i, row in enumerate(x)]
    return x, spark.createDataFrame(data, "diaryid bigint, states array<tinyint>")


def random_costs(slots, k=5, seed=2):
    c = np.random.default_rng(seed).random((slots, k, k))
    c = c + c.transpose(0, 2, 1)
    c[:, range(k), range(k)] = 0
    return c


def brute(x, costs):
    t = np.arange(x.shape[1])
    return np.array([[costs[t, a, b].sum() for b in x] for a in x])


@pytest.mark.parametrize("block", [512, 7])
def test_distances_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(Q, "REFERENCE_BLOCK", block)
    x, seqs = random_sequences(spark, 30, 12)
    costs = random_costs(12)
    want = brute(x, costs)
    got = Q.distances_to(seqs, seqs, costs).collect()
    assert len(got) == 30 * 30
    for a, b, d in got:
        assert d == pytest.approx(want[a - 1, b - 1])
    nearest = Q.assign_to_medoids(seqs, seqs.filter("diaryid <= 20"), costs).collect()
    for r in nearest:
        assert r["dist"] == pytest.approx(want[r["diaryid"] - 1, :20].min())
        assert r["medoid"] == 1 + np.argmin(np.round(want[r["diaryid"] - 1, :20], 9))


def test_k_medoids_settle_where_nothing_can_improve(spark):
    x, seqs = random_sequences(spark, 60, 10, copies=6)
    costs = random_costs(10)
    made = Q.k_medoids(seqs, Q.seed_medoids(seqs, 5), costs)
    assert made.settled and made.rounds >= 1
    want = np.round(brute(x, costs), 9)
    medoids = sorted(r["diaryid"] for r in made.medoids.collect())
    got = {r["diaryid"]: (r["medoid"], r["dist"]) for r in made.assigned.collect()}
    assert len(medoids) == 5 and len(got) == 66
    for i, (m, d) in got.items():
        assert d == pytest.approx(min(want[i - 1, j - 1] for j in medoids))
        assert want[i - 1, m - 1] == pytest.approx(d)
    for m in medoids:
        members = [i - 1 for i, (of, _) in got.items() if of == m]
        totals = {i: round(want[i, members].sum(), 6) for i in members}
        assert totals[m - 1] == min(totals.values())
    raw = {r["label"]: r["cluster60"] for r in Q.routine_typology(made).collect()}
    assert set(raw.values()) == set(range(1, 6))
    assert len({raw[1], *[raw[i] for i in range(61, 67)]}) == 1


def test_fewer_days_than_medoids(spark):
    _, seqs = random_sequences(spark, 3, 8, copies=4)
    made = Q.k_medoids(seqs, Q.seed_medoids(seqs, 10), random_costs(8))
    assert made.settled and made.medoids.count() == 3
    assert {r["dist"] for r in made.assigned.collect()} == {0.0}


def test_group_medoid_matches_brute_force(spark):
    x, seqs = random_sequences(spark, 20, 9)
    costs = random_costs(9)
    grouped = seqs.withColumn("g", F.col("diaryid") % 3)
    want = brute(x, costs)
    for r in Q.group_medoids(grouped, "g", costs).collect():
        members = [i for i in range(20) if (i + 1) % 3 == r["g"]]
        assert r["total"] == pytest.approx(min(want[i, members].sum() for i in members))


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    # One group holds most rows and one value a third of them.
    data = [("hot", float(v)) for v in rng.normal(size=6000)] + [("hot", 0.5)] * 3000 + [("cold", 1.0), ("cold", 4.0), ("one", 2.0)]
    df = spark.createDataFrame(data, "g string, x double")
    probs = [0.025, 0.25, 0.5, 0.9, 0.975]
    got = {(r["g"], r["prob"]): r["value"] for r in A.exact_quantiles(df, "g", "x", probs).collect()}
    for g in ("hot", "cold", "one"):
        values = [v for k, v in data if k == g]
        for p in probs:
            assert got[(g, p)] == pytest.approx(np.quantile(values, p))


def test_quantiles_of_a_hot_narrow_group(spark):
    rng = np.random.default_rng(8)
    hot = rng.normal(0, 1e-6, 20_000)
    data = [("hot", float(v)) for v in hot] + [("wide", float(v)) for v in rng.uniform(-1e9, 1e9, 200)]
    df = spark.createDataFrame(data, "g string, x double")
    got = {(r["g"], r["prob"]): r["value"] for r in A.exact_quantiles(df, "g", "x", [0.1, 0.5, 0.99]).collect()}
    for g in ("hot", "wide"):
        values = [v for k, v in data if k == g]
        for p in (0.1, 0.5, 0.99):
            assert got[(g, p)] == pytest.approx(np.quantile(values, p))


def test_variety_counts_labels_whatever_the_codes(spark):
    from dayloom.plans.base import leisure_aggs

    rows = [(1, "Reading", 10), (1, "Watching tv", 138), (1, "Watching tv", 139), (2, "Sleeping", 5)]
    df = spark.createDataFrame(rows, "diaryid int, pri_tidied string, code int").withColumns(
        {"activity_group": F.when(F.col("pri_tidied") == "Sleeping", "sleep").otherwise("leisure other"), "coded5_activity": F.lit("leisure")}
    )
    aggs = leisure_aggs()
    got = {r["diaryid"]: (r["v"], r["o"]) for r in df.groupBy("diaryid").agg(aggs["voracity"].alias("v"), aggs["outside_voracity"].alias("o")).collect()}
    assert got == {1: (2, 0), 2: (None, None)}


def test_company_of_more_than_four(spark):
    rows = [(1, 1, "Partner")] * 5 + [(1, 2, "Alone"), (1, 3, None), (2, 1, None)]
    got = {r["diaryid"]: r for r in A.company_slots_long(spark.createDataFrame(rows, "diaryid int, slot int, who_value string")).collect()}
    assert got[1]["with_household_Xperson_hours"] == 5 and got[1]["with_household_Xat_least_three"] == 1
    assert got[2]["with_household_Xperson_hours"] == 0


def test_entropy_limits(spark):
    one = [(1, s, "a") for s in range(4) for _ in range(2)]
    even = [(2, s, c) for s in range(4) for c in "ab"]
    df = spark.createDataFrame(one + even, "g int, slot int, st string")
    got = {r["g"]: r["prop_max_h"] for r in A.mean_entropy(df, "g", "st").collect()}
    assert got[1] == pytest.approx(0) and got[2] == pytest.approx(1)


def test_cronbach_matches_numpy(spark):
    x = np.random.default_rng(3).normal(size=(60, 3)) + np.arange(60)[:, None] / 20
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    cov = np.cov(x.T)
    v, c = np.diag(cov).mean(), cov[np.triu_indices(3, 1)].mean()
    assert A.cronbach_alpha(df, ["a", "b", "c"]).first()[0] == pytest.approx(3 * c / (v + 2 * c))


def test_density_integrates_to_one(spark):
    df = spark.range(50).select(F.lit("g").alias("g"), (F.col("id") % 7).cast("double").alias("x"), F.lit(2.0).alias("weight"))
    d = A.weighted_density(df, "g", "x", -6.0, 12.0, 0.7, 400)
    assert d.agg(F.sum("density")).first()[0] * 18 / 399 == pytest.approx(1, abs=1e-3)


def test_weighted_glm_matches_least_squares(spark):
    rng = np.random.default_rng(7)
    x, w = rng.normal(size=80), rng.random(80) + 0.1
    y = 2 + 3 * x + rng.normal(size=80)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, w)], "x double, y double, weight double")
    got = {r["term"]: r["coefficient"] for r in E.weighted_glm(df, "y", ["x"]).collect()}
    design = np.stack([np.ones(80), x], 1)
    want = np.linalg.solve(design.T * w @ design, design.T * w @ y)
    assert (got["(Intercept)"], got["x"]) == (pytest.approx(want[0]), pytest.approx(want[1]))


def test_draws_centre_on_the_group_difference(spark):
    df = spark.range(400).select(
        F.col("id").alias("mainid"), F.when(F.col("id") % 2 == 0, "Female").otherwise("Male").alias("sex"), F.lit(1.0).alias("weight"),
        F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("y"),
    )
    draws = E.replicate_draws(df, ["sex"], "y", 50)
    gap = E.contrasts(draws, "sex").agg(F.min("value"), F.max("value")).first()
    assert gap[0] == pytest.approx(2) and gap[1] == pytest.approx(2)
    assert E.direction_odds(E.contrasts(draws, "sex"), "diff").first()["label"] == "> 100"


def test_first_per_key_keeps_the_whole_row(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 2, None), (2, 9, "z")], "k int, o int, v string")
    assert sorted(map(tuple, A.first_per_key(df, "k", ["o"]).collect())) == [(1, 2, None), (2, 9, "z")]


def test_diaries_are_complete_and_spells_cover_them(spark, sf_dir):
    s = Study(spark, sf_dir)
    per = s.slots.groupBy("diaryid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("d"))
    assert {(r["n"], r["d"]) for r in per.collect()} == {(144, 144)}
    total = W.spells(s.slots).groupBy("diaryid").agg(F.sum("length").alias("n"))
    assert {r["n"] for r in total.collect()} == {144}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spells_add_no_exchange_to_the_slots(spark, sf_dir):
    s = Study(spark, sf_dir)
    assert plan_of(W.spell_stats(W.spells(s.slots))).count("Exchange hash") == plan_of(s.slots).count("Exchange hash")


def test_lookups_are_broadcast_and_columns_pruned(spark, sf_dir):
    plan = plan_of(Study(spark, sf_dir).activity)
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    narrow = plan_of(Study(spark, sf_dir).recoded.select("diaryid", "sex"))
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int>" in narrow
    # Unused indicators vanish together with their scan of the slots.
    assert "Window" not in plan_of(Study(spark, sf_dir).respondents.select("diaryid", "sex"))


def test_saved_tables_and_own_keys_stand_in_for_computed_ones(spark, sf_dir, tmp_path):
    from dayloom.operators.sequences import tempogram
    from dayloom.sources import keys
    from dayloom.sources.tables import load_clusters, load_table, save_table

    first = Study(spark, sf_dir)
    save_table(first.activity, f"{tmp_path}/activity")
    save_table(first.respondents, f"{tmp_path}/respondents")
    save_table(first.clusters, f"{tmp_path}/clusters")
    saved = Study(
        spark,
        sf_dir,
        activity=load_table(spark, f"{tmp_path}/activity"),
        respondents=load_table(spark, f"{tmp_path}/respondents"),
        clusters=load_clusters(spark, f"{tmp_path}/clusters"),
    )
    assert sorted(map(str, tempogram(saved.diaries).collect())) == sorted(map(str, tempogram(first.diaries).collect()))
    assert saved.respondents.count() == first.respondents.count()
    # A key of one's own, as CSV, that knows a single activity.
    first.key.filter("pri_tidied = 'Sleeping'").limit(1).coalesce(1).write.option("header", True).csv(f"{tmp_path}/key")
    own = Study(spark, sf_dir, key=keys.load_key(spark, f"{tmp_path}/key"))
    assert {r[0] for r in own.activity.select("pri_tidied").distinct().collect()} <= {"Sleeping", None}


def test_reports_read_the_events_once(spark, sf_dir):
    from dayloom.plans.catalog import QUERIES, runner

    for name in ("respondent_data", "tempogram", "weighted_share", "activity_long"):
        plan = runner(QUERIES[name])(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("events.parquet") == 1, name


def test_predictive_check_multiplies_rows_after_the_last_exchange(spark, sf_dir):
    data = Study(spark, sf_dir).respondents.filter("mh is not null").select("diaryid", "sex", "mh", "weight")
    plan = E.predictive_check(data, ["sex"], "mh", 3)._jdf.queryExecution().executedPlan().toString()
    draws = next(line for line in plan.splitlines() if "Generate explode" in line and "draw#" in line)
    assert plan.splitlines().index(draws) <= min(i for i, line in enumerate(plan.splitlines()) if "Exchange" in line or "Join" in line)


def test_completed_grid_keeps_missing_values(spark):
    from dayloom.operators.reshape import complete_grid

    df = spark.createDataFrame([(1, "a", 5), (2, None, 6)], "g int, c string, n int")
    got = sorted(map(tuple, complete_grid(df, ["g", "c"], {"n": 0}).collect()), key=str)
    assert got == sorted([(1, "a", 5), (1, None, 0), (2, "a", 0), (2, None, 6)], key=str)


def test_adjusted_draws_match_separate_fits(spark):
    rng = np.random.default_rng(17)
    rows = [(i // 2, str(a), str(b), float(rng.poisson(np.exp(0.5 + 0.4 * a - 0.3 * b))), float(rng.uniform(0.5, 2))) for i in range(400) for a, b in [rng.integers(0, 3, 2)]]
    df = spark.createDataFrame(rows, "mainid int, a string, b string, y double, weight double")
    x = np.array([[1, r[1] == "1", r[1] == "2", r[2] == "1", r[2] == "2"] for r in rows], float)
    y, w = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    units = spark.range(200).select(*[E.uniform("id", F.lit(d)).alias(f"u{d}") for d in (1, 2)]).collect()
    for family in ("gaussian", "poisson"):
        got = {}
        for r in E.adjusted_draws(df, ["a", "b"], "y", family, 2).collect():
            got.setdefault(r["draw"], {})[(r["term"], r["level"])] = r["value"]
        for d in (1, 2):
            e = w * np.array([-np.log(units[r[0]][d - 1]) for r in rows])
            beta = np.linalg.solve(x.T @ (e[:, None] * x), x.T @ (e * y)) if family == "gaussian" else np.zeros(5)
            for _ in range(50 if family == "poisson" else 0):
                mu = np.exp(x @ beta)
                beta = beta + np.linalg.solve(x.T @ ((e * mu)[:, None] * x), x.T @ (e * (y - mu)))
            want = dict(zip([("(Intercept)", None), ("a", "1"), ("a", "2"), ("b", "1"), ("b", "2")], beta, strict=True))
            assert got[d].keys() == want.keys()
            assert all(got[d][k] == pytest.approx(want[k], abs=1e-6) for k in want)
