"""A tree over groups of days, its cuts and heights, and pairs of days within a radius.

The distance between two days is a sum over slots, so the mean distance between all days of one
group and all of another follows from the two groups' state counts: average linkage needs no pair
of days. A tree therefore starts from groups, as many as the caller made of any number of days
(those of k-medoids, or single days where there are few).

Groups are joined in rounds: every pair of groups that are each other's nearest is joined at once.
Joining never brings a group nearer to the others than its parts were, so the tree is the one that
joins the two nearest groups over and over.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.functions.recode import STATES
from dayloom.operators.sequences import cluster_profiles, group_costs, onehot, reference_costs
from dayloom.runtime import rest

DIGITS = 9
# Days of a block; the days of two blocks and a lot of distances between them are one task's memory.
PAIR_BLOCK, PAIR_LOT = 2048, 256
# Comparing two joined rows costs about as much as comparing this many pairs inside blocks.
JOINED_COST = 64


def group_distances(assigned: DataFrame, group: str, costs: np.ndarray, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(a, b, total) for all pairs a < b of groups and (node, n): summed distances of their days, and days.

    A group's state counts meet the other groups' cost rows slot by slot and state by state: what
    is joined and summed grows with the groups, not with their days. `weight` counts a day's copies.
    """
    n_slots, k, _ = costs.shape
    profiles = rest(cluster_profiles(assigned, group, weight).withColumnRenamed(group, "node"))
    sizes = rest(profiles.filter("slot = 1").groupBy("node").agg(F.sum("n").cast("long").alias("n")))
    rows = group_costs(profiles, "node", costs)
    # A cost row is an array of all slots and states; group b's counts pick from it.
    counts = profiles.groupBy("node").agg(
        F.collect_list(F.struct(((F.col("slot") - 1) * k + F.col("code")).cast("int").alias("place"), F.col("n").cast("double").alias("n"))).alias("counts")
    )
    left = rows.select(F.col("node").alias("a"), "row")
    right = counts.select(F.col("node").alias("b"), "counts")
    total = F.aggregate("counts", F.lit(0.0), lambda sum_, c: sum_ + c["n"] * F.get("row", c["place"]))
    # One bucket of groups b at a time meets one bucket of groups a, so no task holds all pairs.
    buckets = max(1, int(np.sqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    deal = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets))
    every = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    left = left.withColumn("i", deal("a")).withColumn("j", every)
    right = right.withColumn("j", deal("b")).withColumn("i", every)
    pairs = left.join(right, ["i", "j"]).filter("a < b").select("a", "b", total.alias("total"))
    return rest(pairs), sizes


def _mean(total: str = "total", a: str = "a_n", b: str = "b_n") -> Column:
    # Rounded, so that the order of additions decides nothing.
    return F.round(F.col(total) / (F.col(a).cast("double") * F.col(b)), DIGITS)


def agglomerate(assigned: DataFrame, group: str, costs: np.ndarray, weight: str | None = None) -> DataFrame:
    """The merge history of average linkage over groups: (step, kept, gone, height, groups, n). Runs jobs.

    A row says that the group named `gone` went into the one named `kept`, at a height (the mean
    distance of their days), and how many groups and days the result has. A group's name is the
    smallest of its parts' names, so every starting group but the smallest is `gone` once. Steps
    count the joins from the lowest height on; equal heights go by name. One group gives no rows.
    """
    pairs, sizes = group_distances(assigned, group, costs, weight)
    facts = lambda x: [F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.lit(1).alias(f"{x}_groups")]
    pairs = rest(pairs.join(sizes.select(*facts("a")), "a").join(sizes.select(*facts("b")), "b"))
    history: list[DataFrame] = []
    while not pairs.isEmpty():
        rated = pairs.withColumn("height", _mean())
        ways = F.explode(F.array(F.struct("a", "b", "height"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "height")))
        nearest = rated.select(ways.alias("w")).groupBy("w.a").agg(F.min(F.struct("w.height", "w.b")).alias("m"))
        # Two groups that are each other's nearest name the same pair twice.
        named = nearest.select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b"))
        mutual = named.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")).filter("times = 2").drop("times")
        joined = rest(rated.join(mutual, ["a", "b"]).select(
            F.col("a").alias("kept"), F.col("b").alias("gone"), "height", F.col("a_groups").alias("kept_groups"),
            (F.col("a_groups") + F.col("b_groups")).alias("groups"), (F.col("a_n") + F.col("b_n")).alias("n"),
        ))
        history.append(joined)
        # Sums of distances add up, so the joined group's are those of its parts.
        part = F.explode(F.array("kept", "gone"))
        now = joined.select(part.alias("node"), F.col("kept").alias("now"), F.col("n").alias("now_n"), F.col("groups").alias("now_groups"))
        moved = pairs
        for x in "ab":
            moved = moved.join(now.withColumnRenamed("node", x), x, "left")
            moved = moved.withColumns({x: F.coalesce("now", x), f"{x}_n": F.coalesce("now_n", f"{x}_n"), f"{x}_groups": F.coalesce("now_groups", f"{x}_groups")})
            moved = moved.drop("now", "now_n", "now_groups")
        turned = F.col("a") > F.col("b")
        ordered = [F.when(turned, F.col(y + c)).otherwise(F.col(x + c)).alias(x + c) for x, y in ("ab", "ba") for c in ("", "_n", "_groups")]
        moved = moved.filter("a != b").select(*ordered, "total")
        pairs = rest(moved.groupBy("a", "b", "a_n", "a_groups", "b_n", "b_groups").agg(F.sum("total").alias("total")))
    if not history:
        name = sizes.schema["node"].dataType.simpleString()
        return sizes.sparkSession.createDataFrame([], f"step int, kept {name}, gone {name}, height double, kept_groups int, groups int, n bigint")
    out = history[0]
    for part in history[1:]:
        out = out.union(part)
    # A row per starting group: few, whatever the number of days.
    step = F.row_number().over(Window.orderBy("height", "groups", "gone"))
    return rest(out.select(step.alias("step"), "kept", "gone", "height", "kept_groups", "groups", "n"))


def _followed(links: DataFrame) -> DataFrame:
    """(node, root, offset): where links (node, next, offset) lead in the end and what they add up to, by pointer jumping."""
    here = rest(links)
    while True:
        beyond = here.select(F.col("node").alias("next"), F.col("next").alias("far"), F.col("offset").alias("more"))
        jumped = here.join(beyond, "next", "left").select(
            "node", F.coalesce("far", "next").alias("next"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"), F.col("far").isNotNull().alias("moved")
        )
        jumped = rest(jumped)
        here = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            return here.withColumnRenamed("next", "root")


def leaf_order(history: DataFrame) -> DataFrame:
    """(node, place): the starting groups from left to right, the kept part of every join left of the other.

    A part that goes stands behind the groups that the kept part had by then, so its place is the
    sum of such numbers on the way to the root.
    """
    links = history.select(F.col("gone").alias("node"), F.col("kept").alias("next"), F.col("kept_groups").cast("long").alias("offset"))
    found = _followed(links)
    roots = found.select(F.col("root").alias("node")).distinct().withColumn("place", F.lit(0).cast("long"))
    return found.select("node", F.col("offset").alias("place")).union(roots)


def cut_tree(history: DataFrame, k: int | None = None, height: float | None = None) -> DataFrame:
    """(node, cluster): the starting groups in k clusters, or in those joined up to a height, numbered from the left.

    Heights never fall on the way to the root, so a node's cluster is where its joins below the cut
    lead. Fewer groups than k are a cluster each. A tree without joins has no rows.
    """
    order = rest(leaf_order(history))
    if k is not None:
        n = order.count()
        low = history.filter(F.col("step") <= max(0, n - k))
    else:
        low = history.filter(F.col("height") <= height)
    links = low.select(F.col("gone").alias("node"), F.col("kept").alias("next"), F.lit(0).alias("offset"))
    led = _followed(links).select("node", "root")
    named = order.join(led, "node", "left").select("node", "place", F.coalesce("root", "node").alias("root"))
    # A cluster's groups stand side by side, and its name's place is the leftmost.
    places = named.filter(F.col("node") == F.col("root")).select("root", F.row_number().over(Window.orderBy("place")).alias("cluster"))
    return named.join(places, "root").select("node", "cluster")


def merge_heights(history: DataFrame, first: int = 2, last: int = 51) -> DataFrame:
    """(rank, height): the largest heights of the tree, from rank `first` to `last`."""
    rank = F.row_number().over(Window.orderBy(F.desc("step")))
    return history.select(rank.alias("rank"), "height").filter(F.col("rank").between(first, last))


def segments_for(costs: np.ndarray, radius: float) -> list[tuple[int, int]]:
    """Segments (first slot, slot after the last) of a day such that two days within the radius agree on one.

    Two days that differ in every segment are farther apart than the sum of the segments' least
    costs; the day is cut into the fewest equal parts where that sum exceeds the radius.
    """
    n_slots, k, _ = costs.shape
    least = np.where(np.eye(k, dtype=bool), np.inf, costs).min(axis=(1, 2))
    for m in range(1, n_slots + 1):
        edges = np.linspace(0, n_slots, m + 1).astype(int)
        if sum(least[a:b].min() for a, b in zip(edges, edges[1:], strict=False)) > radius:
            return list(zip(edges.tolist(), edges[1:].tolist(), strict=False))
    raise ValueError("the radius is so large that two days may differ in every slot")


def pairs_within(seqs: DataFrame, costs: np.ndarray, radius: float, id: str = "diaryid", states: Sequence[str] = STATES) -> DataFrame:
    """(a, b, dist) for all pairs a < b of different days whose distance is at most `radius`.

    Equal days count once, under their smallest id. Days that share a segment are compared, in the
    first one they share, if few do. Where the radius is so wide that most pairs share one, all
    pairs are: block by block, in tasks of a bounded size.
    """
    days = rest(seqs.groupBy("states").agg(F.min(id).alias("day")).filter("day is not null"))
    n = days.count()
    try:
        keyed = _segments(days, segments_for(costs, radius))
    except ValueError:
        keyed = None
    if keyed is not None:
        sizes = keyed.groupBy("at", "part").agg(F.count(F.lit(1)).cast("double").alias("n"))
        met = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0] or 0.0
    if keyed is None or met * JOINED_COST > float(n) * (n - 1):
        rated = _compared_in_blocks(days, costs, radius, -(-n // PAIR_BLOCK) or 1)
    else:
        rated = _compared_where_shared(keyed, costs)
    return rated.select("a", "b", F.round("dist", DIGITS).alias("dist")).filter(F.col("dist") <= radius)


def _segments(days: DataFrame, segments: list[tuple[int, int]]) -> DataFrame:
    """(day, states, parts, at, part): a row per day and segment."""
    text = F.array_join(F.transform("states", lambda c: c.cast("string")), "")
    cuts = [F.substring(text, a + 1, b - a) for a, b in segments]
    return days.select("day", "states", F.array(*cuts).alias("parts")).select("*", F.posexplode("parts").alias("at", "part"))


def _slot_sums(x: np.ndarray, y: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """Distances between the rows of two code matrices, row by row."""
    n_slots, k, _ = costs.shape
    return costs.reshape(-1)[np.arange(n_slots) * k * k + x.astype(int) * k + y].sum(axis=1)


def _compared_where_shared(keyed: DataFrame, costs: np.ndarray) -> DataFrame:
    """(a, b, dist) of the days that share a segment, in the first one they share."""
    one = keyed.select(F.col("day").alias("a"), F.col("states").alias("a_states"), F.col("parts").alias("a_parts"), "at", "part")
    two = keyed.select(F.col("day").alias("b"), F.col("states").alias("b_states"), F.col("parts").alias("b_parts"), "at", "part")
    shared = F.array_position(F.zip_with("a_parts", "b_parts", lambda x, y: x == y), True) - 1
    met = one.join(two, ["at", "part"]).filter((F.col("a") < F.col("b")) & (shared == F.col("at")))

    @F.pandas_udf("double")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        return pd.Series(_slot_sums(np.stack(x.to_numpy()), np.stack(y.to_numpy()), costs))

    return met.select("a", "b", distance("a_states", "b_states").alias("dist"))


def _compared_in_blocks(days: DataFrame, costs: np.ndarray, radius: float, blocks: int) -> DataFrame:
    """(a, b, dist) of all pairs about as near as the radius: every pair of blocks of days is a task's work.

    Single precision finds the pairs, with a margin for its rounding; their distances are summed
    slot by slot.
    """
    n_slots, k, _ = costs.shape
    margin = 1e-6 + n_slots * k * float(np.finfo(np.float32).eps) * float(np.abs(costs).max(axis=(1, 2)).sum())

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = (rows[(rows["block"] == rows[x]).to_numpy()] for x in "ij")
        alone = rows["i"].iloc[0] == rows["j"].iloc[0]
        found = []
        if len(left) and len(right):
            x, y = (np.frombuffer(b"".join(part["codes"]), np.uint8).reshape(len(part), n_slots) for part in (left, right))
            table = reference_costs(y.astype(np.int64), costs).astype(np.float32)
            for at in range(0, len(x), PAIR_LOT):
                near = onehot(x[at : at + PAIR_LOT].astype(np.int64), k).astype(np.float32) @ table <= radius + margin
                if alone:
                    near &= np.arange(at, at + len(near))[:, None] < np.arange(len(y))
                p, q = np.nonzero(near)
                for cut in range(0, len(p), PAIR_LOT * PAIR_LOT):
                    u, v = p[cut : cut + PAIR_LOT * PAIR_LOT] + at, q[cut : cut + PAIR_LOT * PAIR_LOT]
                    dist = _slot_sums(x[u], y[v], costs)
                    kept = dist <= radius + 1e-6
                    found.append(pd.DataFrame({"x": left["day"].to_numpy()[u[kept]], "y": right["day"].to_numpy()[v[kept]], "dist": dist[kept]}))
        return pd.concat(found) if found else pd.DataFrame({"x": [], "y": [], "dist": []})

    text = F.array_join(F.transform("states", lambda c: F.lpad(F.hex(c.cast("int")), 2, "0")), "")
    dealt = days.select("day", F.unhex(text).alias("codes"), F.pmod(F.xxhash64("states"), F.lit(blocks)).alias("block"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    met = met.select("day", "codes", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    kind = days.schema["day"].dataType.simpleString()
    rated = met.groupBy("i", "j").applyInPandas(compare, f"x {kind}, y {kind}, dist double")
    return rated.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "dist")
