"""Hand-computed micro tables for the NULL, rounding and ordering rules."""

import math

import pytest
from pyspark.sql import functions as F

from dayloom.functions import recode as R
from dayloom.functions import semantics as N
from dayloom.operators import aggregate as A
from dayloom.operators import effects as E
from dayloom.operators import reshape as S
from dayloom.operators import spells as W
from dayloom.sources import tables


def rows(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=repr)


@pytest.fixture(scope="module")
def slots(spark):
    data = [(1, t, "a", None) for t in range(1, 7)]
    data += [(2, t, "ab"[t % 2], None) for t in range(1, 7)]
    data += [(3, 1, None, None), (3, 2, "a", "x"), (3, 3, "a", None), (3, 4, None, None), (3, 5, "b", None), (3, 6, "b", None)]
    return spark.createDataFrame(data, "diaryid bigint, slot int, pri string, sec string")


@pytest.fixture(scope="module")
def weights(spark):
    return spark.createDataFrame(
        [("g", "x", 1.0, 2.0), ("g", "y", 3.0, None), ("g", "x", None, 5.0), ("h", None, 2.0, 1.0)],
        "grp string, lvl string, weight double, v double",
    )


def test_missing_status_is_not_working(spark):
    df = spark.createDataFrame(
        [(w, "In Employment", n) for w in ("2016", "June 2020") for n in (None, "full time", "furlough")],
        "wave string, econ string, now string",
    )
    got = {(r[0], r[1]): (r[2], r[3]) for r in df.select("wave", "now", R.in_work("wave", "econ", "now"), R.in_work("wave", "econ", "now", True)).collect()}
    assert got[("June 2020", None)] == ("Not Working", None)
    assert got[("June 2020", "full time")] == ("Working", "Working")
    assert got[("June 2020", "furlough")] == ("Not Working", "Not Working")
    assert all(got[("2016", n)][0] == "Working" for n in (None, "full time", "furlough"))


def test_missing_cluster_is_not_a_workday(spark):
    df = spark.createDataFrame([(None,), (36,), (15,), (16,)], "c int")
    assert [r[0] for r in df.select(R.workday("c")).collect()] == ["Not Workday", "Workday", "Workday", "Not Workday"]


def test_sleep_status_every_pair(spark):
    vals = ["Sleeping", "Other", None]
    df = spark.createDataFrame([(p, s) for p in vals for s in vals], "p string, s string")
    got = {(r[0], r[1]): r[2] for r in df.select("p", "s", R.sleep_status("p", "s")).collect()}
    assert got == {
        ("Sleeping", "Sleeping"): "Sleeping",
        ("Sleeping", "Other"): "Half-Sleeping",
        ("Sleeping", None): "Sleeping",
        ("Other", "Sleeping"): "Half-Sleeping",
        ("Other", "Other"): "Not Sleeping",
        ("Other", None): "Not Sleeping",
        (None, "Sleeping"): "Sleeping",
        (None, "Other"): "Not Sleeping",
        (None, None): None,
    }


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(0.0,), (1 / 3,), (0.5,), (1.0,), (1.1,)], "x double")
    labels = ["low", "mid", "high"]
    got = [r[0] for r in df.select(R.cut_right("x", [0, 1 / 3, 2 / 3, 1], labels, "0")).collect()]
    assert got == ["0", "low", "mid", "high", "0"]
    assert [r[0] for r in df.select(R.cut_right("x", [0, 1 / 3, 2 / 3, 1], labels)).collect()][0] is None


def test_employment_change_rules(spark):
    df = spark.createDataFrame(
        [("full time", "part time"), ("part time", "full time"), ("full time", "furlough"), ("I wasn't working", "full time"), (None, "full time"), ("full time", None)],
        "b string, n string",
    )
    got = [r[0] for r in df.select(R.employment_change("b", "n")).collect()]
    assert got == ["full to part time", "part to full time", "furlough", "not in work before lockdown", None, None]


def test_casual_work_needs_the_flag(spark):
    df = spark.createDataFrame([("Casual worker",), ("Unemployed",)], "t string")
    assert [tuple(r) for r in df.select(R.econ_status("t"), R.econ_status("t", True)).collect()] == [(None, "Unemployed"), ("Unemployed", "Unemployed")]


def test_row_mean_and_hours_label(spark):
    df = spark.createDataFrame([(1, 3, 7.5), (None, 3, 0.04), (None, None, 2.95)], "a int, b int, h double")
    got = [tuple(r) for r in df.select(R.row_mean(["a", "b"]), R.hours_label("h")).collect()]
    assert got[0] == (1.0, "7h 30m")
    assert got[1] == (2.0, "0h 0m")
    assert got[2][0] is None


def test_slot_to_time_edges(spark):
    r = spark.createDataFrame([(1,)], "slot int").select(R.slot_to_time("slot"), R.slot_to_time("slot", edge="end")).first()
    assert (str(r[0]), str(r[1])) == ("2020-01-01 04:00:00", "2020-01-01 04:10:00")


def test_changes_and_spells(slots):
    flags = rows(W.change_flags(slots.filter("diaryid = 3"), ["pri"]), "slot", "pri")
    assert flags == [(1, True), (2, True), (3, False), (4, True), (5, True), (6, False)]
    spells = W.spells(slots, ["pri", "sec"])
    assert rows(W.spell_stats(spells), "diaryid", "n_spells") == [(1, 1), (2, 6), (3, 5)]
    assert rows(spells.groupBy("diaryid").agg(F.sum("length")), "sum(length)") == [(6,)] * 3
    sd = {r["diaryid"]: r["sd_length"] for r in W.spell_stats(spells).collect()}
    assert sd[1] is None and sd[2] == 0.0


def test_first_last_and_unknown_diaries(slots):
    got = rows(W.first_last_slot(slots, F.col("pri") != "a"), "diaryid", "first_slot", "last_slot")
    assert got == [(1, None, None), (2, 1, 5), (3, 5, 6)]
    assert rows(W.drop_groups_with_null(slots, "pri").select("diaryid").distinct(), "diaryid") == [(1,), (2,)]


def test_slots_after_includes_both_ends(spark, slots):
    anchors = spark.createDataFrame([(1, 2), (2, None)], "diaryid bigint, wake int")
    assert rows(W.slots_after(slots, anchors, "wake", 2), "slot") == [(2,), (3,), (4,)]


def test_weighted_share_keeps_missing_levels(weights):
    got = rows(A.weighted_share(weights, "grp", "lvl"), "grp", "lvl", "share")
    assert got == [("g", "x", 0.25), ("g", "y", 0.75), ("h", None, 1.0)]
    strict = {(r["grp"], r["lvl"]): r["share"] for r in A.weighted_share(weights, "grp", "lvl", strict=True).collect()}
    assert strict[("g", "y")] is None and strict[("h", None)] == 1.0


def test_weighted_mean_lenient_and_strict(weights):
    assert rows(A.weighted_mean(weights, "grp", "v"), "grp", "v") == [("g", 2.0), ("h", 1.0)]
    assert rows(A.weighted_mean(weights, "grp", "v", strict=True), "grp", "v") == [("g", None), ("h", 1.0)]


def test_sum_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(1, None)], "diaryid bigint, b boolean")
    assert A.slot_totals(df, {"n": F.col("b")}).first()["n"] == 0
    assert A.slot_totals(df, {"n": F.col("b")}, strict=["n"]).first()["n"] is None


def test_mode_keeps_ties(spark):
    df = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 1.0), ("g", "c", 0.5)], "g string, l string, weight double")
    assert rows(A.weighted_mode(df, "g", "l"), "l") == [("a",), ("b",)]


def test_distinct_counts_missing_as_a_value(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "a")], "g int, x string")
    assert rows(A.n_distinct(df, "g", {"n": ("x", None)}), "g", "n") == [(1, 2), (2, 1)]


def test_odds_with_zero_and_infinite(spark):
    data = [("both", 1.0), ("both", -1.0), ("both", 0.0), ("both", 2.0), ("pos", 1.0), ("zero", 0.0), ("neg", -1.0)]
    got = {r["k"]: (r["odds"], r["label"]) for r in E.direction_odds(spark.createDataFrame(data, "k string, value double"), "k").collect()}
    assert got == {"both": (2.0, "2"), "pos": (math.inf, "> 100"), "zero": (None, None), "neg": (0.0, "< 0.01")}


def test_contrasts_and_negation(spark):
    draws = spark.createDataFrame([(1, "Female", 3.0), (1, "Male", 1.0), (2, "Female", 1.0), (2, "Male", 2.0)], "draw int, sex string, value double")
    assert rows(E.contrasts(draws, "sex"), "draw", "diff", "value") == [(1, "Female - Male", 2.0), (2, "Female - Male", -1.0)]
    back = E.contrasts(draws, "sex", [("Male", "Female")])
    assert rows(back, "draw", "value") == [(1, -2.0), (2, 1.0)]


def test_ecdf_both_sides(spark):
    df = spark.createDataFrame([("g", 2, 1.0), ("g", 5, 1.0), ("g", None, 2.0)], "g string, x int, weight double")
    below = [r[0] for r in A.weighted_ecdf(df, "g", "x", (1, 6)).orderBy("time").select("share").collect()]
    assert below == [0.0, 0.0, 0.25, 0.25, 0.25, 0.5]
    above = [r[0] for r in A.weighted_ecdf(df, "g", "x", (1, 6), "above").orderBy("time").select("share").collect()]
    assert above == [0.5, 0.25, 0.25, 0.25, 0.0, 0.0]
    late = [r[0] for r in A.weighted_ecdf(df, "g", "x", (4, 5)).orderBy("time").select("share").collect()]
    assert late == [0.25, 0.25]


def test_grid_fills_missing_cells_and_null_levels(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, 7)], "c int, s string, n int")
    got = rows(S.complete_grid(df, ["c", "s"], {"n": 0}), "c", "s", "n")
    assert got == [(1, "a", 5), (1, None, 0), (2, "a", 0), (2, None, 7)]


def test_unpivot_skips_look_alikes_and_keeps_nulls(spark):
    df = spark.createDataFrame([(1, 7, None, 9)], "diaryid bigint, pri1 int, pri2 int, pricrech int")
    assert rows(S.unpivot_slots(df, "pri", "v"), "slot", "v") == [(1, 7), (2, None)]
    assert rows(S.pivot_fill(S.unpivot_slots(df, "pri", "v"), "diaryid", "slot", "v", {1: "s1", 2: "s2"}), "s1", "s2") == [(7, 0)]


def test_diary_ids_follow_the_key(spark):
    n = 5000
    df = spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), F.lit(1).alias("hot"))
    got = tables.with_diary_id(df, ["hot", "k"])
    assert got.filter("diaryid != k + 1").count() == 0 and got.count() == n


def test_decode_labels_order_and_unknown_codes(spark):
    book = spark.createDataFrame([("x", 1, "one"), ("x", 2, "two"), ("y", 1, "other")], "variable string, code int, label string")
    df = spark.createDataFrame([(1,), (9,), (None,)], "x int")
    assert rows(tables.decode_labels(df, ["x"], book), "x", "x_ord") == [("one", 1), (None, None), (None, None)]


def test_null_safe_join_matches_null(spark):
    a = spark.createDataFrame([(None, 1), ("k", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 3)], "k string, b int")
    assert rows(N.join_null_safe(a, b, ["k"]), "k", "a", "b") == [("k", 2, None), (None, 1, 3)]


def test_total_row_and_by_each(spark):
    df = spark.createDataFrame([("1", 2), ("2", 3)], "k string, n int")
    assert ("Total", 5) in rows(A.with_total_row(df, "k", "Total"), "k", "n")
    data = spark.createDataFrame([("w", "a", None), ("w", "b", "z")], "wave string, p string, q string")
    got = rows(A.by_each(data, ["wave"], ["p", "q"], [F.count(F.lit(1)).alias("n")]), "dimension", "category", "n")
    assert got == [("All", "All", 2), ("p", "a", 1), ("p", "b", 1), ("q", "z", 1), ("q", None, 1)]


def test_columns_without_nulls_stay(spark):
    df = spark.createDataFrame([(1, None, 2), (1, 3, 2)], "a int, b int, c int")
    assert S.drop_null_columns(df).columns == ["a", "c"]


def test_query_of_complete_columns_has_every_row(spark):
    from types import SimpleNamespace

    from dayloom.plans.catalog import QUERIES

    raw = spark.createDataFrame([(1, None, "x"), (2, 3, "x"), (2, 3, "x")], "diaryid bigint, a int, b string")
    got = rows(QUERIES["drop_null_columns"].run(SimpleNamespace(raw=raw)), "diaryid", "name", "value")
    assert got == [(1, "b", "x"), (1, "diaryid", "1"), (2, "b", "x"), (2, "b", "x"), (2, "diaryid", "2"), (2, "diaryid", "2")]


def test_parse_draw_names_levels(spark):
    wide = spark.createDataFrame([(1, 0.5, 0.7)], ["draw", "r_dclasuk:survey__zi[unemployed_June.2020,Intercept]", "r_dclasuk:survey__zi[Higher.managerial_2016,Intercept]"])
    got = rows(E.parse_draw_names(wide), "dclasuk", "survey", "coef", "value")
    assert got == [("Higher", "2016", "zi", 0.7), ("Not Working", "June 2020", "zi", 0.5)]


def test_company_totals_from_both_forms(spark):
    data = [(1, 1, "Partner", "Child"), (1, 2, "Alone", None), (1, 3, "Person not from household", "Partner"), (1, 4, None, None)]
    wide = spark.createDataFrame(data, "diaryid bigint, slot int, whoa string, whob string")
    got = A.company_slots(wide, ["whoa", "whob"]).first()
    assert (got["with_household_Xat_least_one"], got["with_household_Xat_least_two"], got["with_household_Xperson_hours"]) == (2, 1, 3)
    assert (got["with_not_household_Xat_least_one"], got["with_not_household_Xperson_hours"]) == (1, 1)
    long = S.unpivot(wide, ["whoa", "whob"], "who_index", "who_value")
    assert A.company_slots_long(long).first().asDict() == got.asDict()


def test_saved_tables_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3, "d")], "label bigint, cluster60 int, cluster int, description string")
    tables.save_table(df, str(tmp_path / "t"))
    assert tables.load_clusters(spark, str(tmp_path / "t")).first() == df.first()
    wide = spark.createDataFrame([(1, 5, 6)], "diaryid bigint, pri1 int, pri2 int")
    tables.save_table(wide, str(tmp_path / "w"))
    assert tables.load_wide(spark, str(tmp_path / "w"), tables.wide_schema(2, ["pri"])).first() == wide.first()
