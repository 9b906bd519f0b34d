"""The routine tree, its cuts and heights, and pairs within a radius, against plain Python."""

import numpy as np
import pytest

from dayloom.operators import routines as Rt
from dayloom.operators import sequences as Q

N_SLOTS, K = 24, 4


def random_days(n, seed, spells=6):
    """Days of a few long spells each, as in a real diary."""
    rng = np.random.default_rng(seed)
    days = np.zeros((n, N_SLOTS), int)
    for d in days:
        for start in np.sort(rng.integers(0, N_SLOTS, spells)):
            d[start:] = rng.integers(0, K)
    costs = rng.uniform(1.5, 4, (N_SLOTS, K, K))
    costs = (costs + costs.transpose(0, 2, 1)) / 2
    costs[:, np.arange(K), np.arange(K)] = 0
    return days, costs


def distances(days, costs):
    return costs[np.arange(N_SLOTS), days[:, None, :], days[None, :, :]].sum(axis=2)


def frame(spark, days, groups=None):
    rows = [(i, int(g), [int(x) for x in d]) for i, (d, g) in enumerate(zip(days, range(len(days)) if groups is None else groups, strict=True))]
    return spark.createDataFrame(rows, "diaryid bigint, node bigint, states array<tinyint>").repartition(3)


def linkage_by_hand(days, costs, groups):
    """Average linkage, the two nearest groups joined over and over: [(kept, gone, height)] and the groups after each step."""
    d = distances(days, costs)
    members = {int(g): np.flatnonzero(groups == g) for g in np.unique(groups)}
    order = {g: [g] for g in members}
    steps, states = [], [dict(order)]
    while len(members) > 1:
        names = sorted(members)
        height, a, b = min((round(d[np.ix_(members[a], members[b])].mean(), 9), a, b) for i, a in enumerate(names) for b in names[i + 1 :])
        steps.append((a, b, height))
        members[a] = np.concatenate([members[a], members.pop(b)])
        order[a] = order[a] + order.pop(b)
        states.append({k: list(v) for k, v in order.items()})
    return steps, states


@pytest.mark.parametrize("n, groups, cuts", [(100, None, [40]), (60, 6, range(1, 8))])
def test_tree_equals_sequential_average_linkage(spark, n, groups, cuts):
    days, costs = random_days(n, 3)
    named = np.arange(n) if groups is None else np.random.default_rng(1).integers(0, groups, n)
    steps, states = linkage_by_hand(days, costs, named)
    history = Rt.agglomerate(frame(spark, days, named), "node", costs)
    got = history.orderBy("step").collect()
    assert [(r["kept"], r["gone"]) for r in got] == [s[:2] for s in steps]
    assert np.allclose([r["height"] for r in got], [s[2] for s in steps], atol=1e-8)
    assert got[-1]["n"] == n and got[-1]["groups"] == len(states[0])
    order = [r["node"] for r in Rt.leaf_order(history).orderBy("place").collect()]
    assert order == next(iter(states[-1].values()))
    for k in cuts:
        state = states[max(0, len(states[0]) - k)]
        want = {node: i + 1 for i, block in enumerate(sorted(state.values(), key=lambda b: order.index(b[0]))) for node in block}
        assert {r["node"]: r["cluster"] for r in Rt.cut_tree(history, k).collect()} == want, k
    height = sorted(s[2] for s in steps)[len(steps) // 2]
    assert {r["cluster"] for r in Rt.cut_tree(history, height=height + 1e-6).collect()} == set(range(1, len(states[len(steps) // 2 + 1]) + 1))
    top = sorted((s[2] for s in steps), reverse=True)
    heights = Rt.merge_heights(history).orderBy("rank").collect()
    assert [r["rank"] for r in heights] == list(range(2, min(51, len(steps)) + 1)) and np.allclose([r["height"] for r in heights], top[1:51])


def test_copies_count_in_a_tree(spark):
    days, costs = random_days(12, 8)
    named = np.arange(12) % 4
    twice = Rt.agglomerate(frame(spark, np.concatenate([days, days[:6]]), np.concatenate([named, named[:6]])), "node", costs).orderBy("step").collect()
    weighted = frame(spark, days, named).selectExpr("*", "if(diaryid < 6, 2, 1) as copies")
    assert Rt.agglomerate(weighted, "node", costs, "copies").orderBy("step").collect() == twice


def test_tree_of_one_group_or_none(spark):
    days, costs = random_days(3, 4)
    one = Rt.agglomerate(frame(spark, days, np.zeros(3, int)), "node", costs)
    assert one.count() == 0 and Rt.cut_tree(one, 5).count() == 0
    assert Rt.agglomerate(frame(spark, days).limit(0), "node", costs).count() == 0


def test_tree_of_a_chain_has_a_round_per_join(spark):
    """Gaps that triple: only one pair at a time is mutually nearest, and the planner's guesses must not grow by rounds."""
    n = 16
    days = np.tril(np.ones((n, N_SLOTS), int), -1)
    costs = np.zeros((N_SLOTS, K, K))
    costs[:] = 3.0 ** np.minimum(np.arange(N_SLOTS), 15)[:, None, None] * (1 - np.eye(K))
    history = Rt.agglomerate(frame(spark, days), "node", costs)
    steps, _ = linkage_by_hand(days, costs, np.arange(n))
    got = history.orderBy("step").collect()
    assert [(r["kept"], r["gone"]) for r in got] == [s[:2] for s in steps] == [(0, i) for i in range(1, n)]
    assert np.allclose([r["height"] for r in got], [s[2] for s in steps])
    clusters = {r["node"]: r["cluster"] for r in Rt.cut_tree(history, 5).collect()}
    assert clusters == {i: max(1, i - n + 6) for i in range(n)}
    assert [r["rank"] for r in Rt.merge_heights(history).orderBy("rank").collect()] == list(range(2, n))


@pytest.mark.parametrize("radius", [4.0, 12.0, 30.0])
def test_pairs_within_a_radius_match_all_pairs(spark, radius):
    days, costs = random_days(150, 6, spells=3)
    days[40:60] = days[:20]  # Equal days are one, under the smallest id.
    d = distances(days, costs)
    first = {days[i].tobytes(): i for i in reversed(range(len(days)))}
    want = {(a, b): d[a, b] for a in first.values() for b in first.values() if a < b and d[a, b] <= radius}
    got = {(r["a"], r["b"]): r["dist"] for r in Rt.pairs_within(frame(spark, days), costs, radius).collect()}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in got) and len(got) > 3


@pytest.mark.parametrize("block", [16, 64, 2048])
def test_pairs_within_any_radius_in_blocks(spark, monkeypatch, block):
    """Radii where most pairs share a segment, and one beyond all distances, where no segment must be shared."""
    days, costs = random_days(90, 11, spells=3)
    days[50:60] = days[:10]
    d = distances(days, costs)
    first = {days[i].tobytes(): i for i in reversed(range(len(days)))}
    monkeypatch.setattr(Rt, "PAIR_BLOCK", block)
    monkeypatch.setattr(Rt, "PAIR_LOT", 7)
    for radius in (30.0, float(np.round(np.median(d), 9)), 1000.0):
        want = {(a, b): d[a, b] for a in first.values() for b in first.values() if a < b and round(d[a, b], 9) <= radius}
        got = [(r["a"], r["b"], r["dist"]) for r in Rt.pairs_within(frame(spark, days), costs, radius).collect()]
        assert len(got) == len(want) and {(a, b) for a, b, _ in got} == want.keys()
        assert all(x == pytest.approx(want[a, b]) for a, b, x in got)
    assert Rt.pairs_within(frame(spark, days).limit(0), costs, 30.0).count() == 0


def test_pairs_within_joins_no_rows_where_most_pairs_meet(spark, monkeypatch):
    days, costs = random_days(60, 12, spells=3)
    monkeypatch.setattr(Rt, "_compared_where_shared", None)
    assert Rt.pairs_within(frame(spark, days), costs, 30.0).count() > 3


def test_segments_hold_for_every_pair_within_the_radius():
    days, costs = random_days(120, 9, spells=3)
    d = distances(days, costs)
    for radius in (2.0, 8.0, 20.0):
        parts = Rt.segments_for(costs, radius)
        assert parts[0][0] == 0 and parts[-1][1] == N_SLOTS
        shared = np.zeros_like(d, bool)
        for a, b in parts:
            shared |= (days[:, None, a:b] == days[None, :, a:b]).all(axis=2)
        assert shared[d <= radius].all()
    # Fewer segments, which fewer days share, for a smaller radius: far fewer pairs meet than there are.
    small = Rt.segments_for(costs, 2.0)
    met = sum(np.unique(days[:, a:b], axis=0, return_counts=True)[1].astype(float) ** 2 @ np.ones(len(np.unique(days[:, a:b], axis=0))) for a, b in small)
    assert met < 0.25 * len(days) ** 2
    with pytest.raises(ValueError, match="radius"):
        Rt.segments_for(costs, 1000.0)


def test_sixty_routines_by_hand(spark):
    """k-medoids with 60 seeds over more days than that, against the same rounds in plain Python."""
    days, costs = random_days(160, 21)
    seqs = frame(spark, days).selectExpr("diaryid", "states")
    seeds = Q.seed_medoids(seqs, 60)
    start = sorted(r[0] for r in seeds.select("diaryid").collect())
    typology = Q.k_medoids(seqs, seeds, costs)
    first = {d.tobytes(): i for i, d in reversed(list(enumerate(days)))}
    distinct = sorted(first.values())
    copies = {i: sum((d == days[i]).all() for d in days) for i in distinct}
    d, medoids, seen = np.round(distances(days, costs), 9), start, []
    while medoids not in seen:
        seen.append(medoids)
        of = {i: min((d[i, m], m) for m in medoids)[1] for i in distinct}
        medoids = sorted(min((round(sum(d[i, j] * copies[j] for j in distinct if of[j] == m), 6), i) for i in distinct if of[i] == m)[1] for m in set(of.values()))
    assert len(start) == 60 and sorted(r[0] for r in typology.medoids.select("diaryid").collect()) == medoids
    of = {i: min((d[i, m], m) for m in medoids)[1] for i in range(len(days))}
    assert {r["diaryid"]: r["medoid"] for r in typology.assigned.collect()} == of
    names = {r["label"]: r["cluster60"] for r in Q.routine_typology(typology).collect()}
    assert names == {i: medoids.index(m) + 1 for i, m in of.items()}
