"""Whole-day sequences: day profiles, dynamic Hamming distances and routine typologies.

A full diary x diary distance matrix grows with the square of the data, so nothing here builds
one over all diaries. Distances are taken from any number of sequences to the reference
sequences asked for, and two identities keep the rest linear: the distance is a sum over slots,
so the total distance from one sequence to all members of a cluster depends only on the
cluster's state counts per slot.
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.functions.recode import STATES, slot_to_time
from dayloom.functions.semantics import join_group_facts, share, sum_or_zero
from dayloom.operators.aggregate import weighted_share
from dayloom.operators.reshape import explode_grid
from dayloom.runtime import cut_lineage

# References go to the tasks in blocks of this many: slots x states x 512 doubles are 3 MB.
REFERENCE_BLOCK = 512


def sequences(
    slots: DataFrame,
    state: str = "coded5_activity",
    w: str | None = "weight",
    id: str = "diaryid",
    slot: str = "slot",
    n_slots: int = 144,
    states: Sequence[str] = STATES,
) -> DataFrame:
    """(id, weight, states): one ordered code vector per diary without unknown slots.

    Codes are 0-based places in `states`, held as tinyint. A diary has `n_slots` cells, so
    collecting them is bounded.
    """
    code = None
    for i, s in enumerate(states):
        code = F.when(F.col(state) == s, F.lit(i)) if code is None else code.when(F.col(state) == s, F.lit(i))
    cell = F.struct(F.col(slot).alias("slot"), code.cast("tinyint").alias("code"))
    aggs = [F.array_sort(F.collect_list(F.when(F.col(state).isNotNull(), cell))).alias("cells")]
    if w:
        aggs.append(F.max(w).alias("weight"))
    return (
        slots.groupBy(id)
        .agg(*aggs)
        .filter(F.size("cells") == n_slots)
        .select(id, *(["weight"] if w else []), F.transform("cells", lambda c: c["code"]).alias("states"))
    )


def tempogram(
    slots: DataFrame,
    group: str | None = "cluster",
    state: str = "coded5_activity",
    slot: str = "slot",
    w: str = "weight",
    states: Sequence[str] = STATES,
    n_slots: int = 144,
    id: str = "diaryid",
    label: str | None = "description",
) -> DataFrame:
    """Day profile: weighted share of each state per slot, zero-completed, with group size and label.

    Unknown states are not plotted but stay in the base of the shares.
    """
    keys = [group] if group else []
    code = F.when(F.col(state).isNotNull(), F.col(state))
    sums = [sum_or_zero(F.when(code == v, F.col(w))).alias(f"__{i}") for i, v in enumerate(states)]
    # One pass over the slots, reduced map-side to groups x slots rows. The label belongs to the
    # group, so it is a key and not a string aggregate, which could not be hashed in place.
    named = [*keys, label] if group and label else keys
    cells = slots.groupBy(*named, slot).agg(
        *sums, sum_or_zero(w).alias("__total"), F.count(F.lit(1)).alias("__n")
    )
    percent = F.struct(*[share(F.col(f"__{i}"), F.col("__total")).alias(f"p{i}") for i in range(len(states))])
    kept = [F.sum("__n").alias("group_size")] if group else []
    # A group has at most one cell per slot; absent slots are filled from the grid.
    per_group = cells.groupBy(*named).agg(
        F.map_from_entries(F.collect_list(F.struct(slot, percent))).alias("__cells"),
        *kept,
    )
    grid = explode_grid(per_group, slot, 1, n_slots).withColumn("__c", F.try_element_at("__cells", F.col(slot)))
    rows = [
        F.struct(F.lit(v).alias(state), F.coalesce(F.col(f"__c.p{i}"), F.lit(0.0)).alias("percent"))
        for i, v in enumerate(states)
    ]
    facts_out = ["group_size", *([label] if label else [])] if group else []
    return grid.select(*keys, slot, F.explode(F.array(*rows)).alias("__r"), *facts_out).select(
        *keys, slot, f"__r.{state}", "__r.percent", slot_to_time(slot).alias("slot_time"), *facts_out
    )


def transition_rates(
    slots: DataFrame,
    state: str = "coded5_activity",
    w: str | None = "weight",
    id: str = "diaryid",
    slot: str = "slot",
) -> DataFrame:
    """Weighted P(state at t | state at t-1) per slot t >= 2: (slot, prev, cur, rate)."""
    order = Window.partitionBy(id).orderBy(slot)
    weight = F.col(w) if w else F.lit(1.0)
    pairs = slots.select(
        slot, F.lag(state).over(order).alias("prev"), F.col(state).alias("cur"), weight.alias("__w")
    ).filter(F.col("prev").isNotNull() & F.col("cur").isNotNull())
    return weighted_share(pairs, [slot, "prev"], "cur", "__w", "rate", "n_weighted")


def sequence_rates(seqs: DataFrame, states: Sequence[str] = STATES, w: str | None = "weight", slot: str = "slot") -> DataFrame:
    """The same rates from code vectors: neighbours of a vector are compared in place, without a window."""
    weight = F.col(w) if w else F.lit(1.0)
    names = F.array(*[F.lit(v) for v in states])
    steps = seqs.select(
        weight.alias("__w"), "states", F.explode(F.sequence(F.lit(2), F.size("states"))).alias(slot)
    ).select(
        slot,
        F.get(names, F.get("states", F.col(slot) - 2)).alias("prev"),
        F.get(names, F.get("states", F.col(slot) - 1)).alias("cur"),
        "__w",
    )
    return weighted_share(steps, [slot, "prev"], "cur", "__w", "rate", "n_weighted")


def dynamic_costs(rates: DataFrame, states: Sequence[str] = STATES, n_slots: int = 144, slot: str = "slot") -> DataFrame:
    """Substitution cost per slot and pair of states: (slot, a, b, cost), 0 on the diagonal.

    4 minus the four transition rates between a and b around the slot. The first and last slot
    have one neighbour, whose rates count twice.
    """
    both = rates.select(slot, F.col("prev").alias("a"), F.col("cur").alias("b"), "rate")
    both = both.unionByName(rates.select(slot, F.col("cur").alias("a"), F.col("prev").alias("b"), "rate"))
    mutual = both.filter(F.col("a") != F.col("b")).groupBy(slot, "a", "b").agg(F.sum("rate").alias("rate"))
    # Rates into slot t act on t and on t - 1; at the ends they act twice.
    here = F.when(F.col(slot) == n_slots, 2).otherwise(1)
    before = F.when(F.col(slot) == 2, 2).otherwise(1)
    parts = mutual.select(
        F.explode(
            F.array(
                F.struct(F.col(slot).alias("t"), (F.col("rate") * here).alias("r")),
                F.struct((F.col(slot) - 1).alias("t"), (F.col("rate") * before).alias("r")),
            )
        ).alias("p"),
        "a",
        "b",
    )
    near = parts.groupBy(F.col("p.t").alias(slot), "a", "b").agg(F.sum("p.r").alias("__near"))
    names = F.array(*[F.lit(s) for s in states])
    grid = (
        rates.sparkSession.range(1, n_slots + 1)
        .select(F.col("id").cast("int").alias(slot))
        .withColumn("a", F.explode(names))
        .withColumn("b", F.explode(names))
    )
    cost = F.when(F.col("a") == F.col("b"), 0.0).otherwise(4.0 - F.coalesce(F.col("__near"), F.lit(0.0)))
    return grid.join(near, [slot, "a", "b"], "left").select(slot, "a", "b", cost.alias("cost"))


def cost_array(costs: DataFrame, states: Sequence[str] = STATES, n_slots: int = 144, slot: str = "slot") -> np.ndarray:
    """The cost table (slots x states x states rows) as an array."""
    place = {s: i for i, s in enumerate(states)}
    out = np.zeros((n_slots, len(states), len(states)))
    for r in costs.select(slot, "a", "b", "cost").collect():
        out[r[0] - 1, place[r[1]], place[r[2]]] = r[3]
    return out


def onehot(x: np.ndarray, k: int) -> np.ndarray:
    n, t = x.shape
    out = np.zeros((n, t * k), dtype=np.float64)
    out[np.arange(n)[:, None], np.arange(t)[None, :] * k + x] = 1.0
    return out


def reference_costs(refs: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """(slots * states) x references: cost of being in a state where the reference is in its own."""
    t, k, _ = costs.shape
    return costs[np.arange(t)[:, None], :, refs.T].transpose(0, 2, 1).reshape(t * k, len(refs))


def collect_references(refs: DataFrame, id: str = "diaryid") -> tuple[list, np.ndarray]:
    """Ids and code matrix of a reference set: the medoids, as many as the caller asked for."""
    rows = refs.select(id, "states").orderBy(id).collect()
    return [r[0] for r in rows], np.array([list(r[1]) for r in rows], dtype=np.int64).reshape(len(rows), -1)


def _reference_blocks(refs: DataFrame, costs: np.ndarray, id: str) -> Iterator[tuple[list, Column]]:
    """(ids, distances to them as an array column), for blocks of references of a task's size."""
    ids, codes = collect_references(refs, id)
    for at in range(0, len(ids), REFERENCE_BLOCK):
        block = slice(at, at + REFERENCE_BLOCK)
        yield ids[block], _distance_column(reference_costs(codes[block], costs), costs.shape[1])("states")


def _distance_column(table: np.ndarray, k: int):
    """Arrow-batched distances from code vectors to every column of a cost table."""

    @F.pandas_udf("array<double>")
    def distances(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch.to_numpy()).astype(np.int64)
                yield pd.Series(list(onehot(x, k) @ table))
            else:
                yield pd.Series([], dtype=object)

    return distances


def distances_to(seqs: DataFrame, refs: DataFrame, costs: np.ndarray, id: str = "diaryid") -> DataFrame:
    """Distances from every sequence to every reference: (id, ref, dist).

    A map over the sequences, without a shuffle: the references travel to the tasks, a block at
    a time.
    """
    out = None
    for ids, distances in _reference_blocks(refs, costs, id):
        pairs = F.arrays_zip(F.array(*[F.lit(r) for r in ids]).alias("ref"), distances.alias("dist"))
        block = seqs.select(id, F.explode(pairs).alias("d"))
        block = block.select(id, F.col("d.ref").alias("ref"), F.col("d.dist").alias("dist"))
        out = block if out is None else out.unionByName(block)
    if out is None:
        return seqs.select(id, F.col(id).alias("ref"), F.lit(0.0).alias("dist")).limit(0)
    return out


def distinct_sequences(seqs: DataFrame, id: str = "diaryid") -> DataFrame:
    """Identical days merged: (id of the first copy, states, n_copies).

    Copies are counted map-side, so a day shared by a third of all diaries is one row per task.
    """
    return seqs.groupBy("states").agg(F.min(id).alias(id), F.count(F.lit(1)).alias("n_copies")).select(
        id, "states", "n_copies"
    )


def _code_text(c: str = "states"):
    """A code vector as text, a grouping key that hashes and compares cheaply."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "")


def seed_medoids(seqs: DataFrame, k: int, id: str = "diaryid") -> DataFrame:
    """k distinct days to start k-medoids from: (id, states, n_copies).

    Those with the smallest hash, a uniform draw of the distinct days; fewer if there are fewer.
    """
    return distinct_sequences(seqs, id).orderBy(F.md5(_code_text())).limit(k)


def recluster(clusters: DataFrame, key: DataFrame, raw: str = "cluster60") -> DataFrame:
    """Raw cluster -> named routine, numbered by the median raw number of its description."""
    from dayloom.operators.reshape import reorder_levels

    order = reorder_levels(key, "description", F.percentile("original_cluster", 0.5))
    named = key.join(order.select("description", F.col("description_ord").alias("cluster")), "description")
    return (
        clusters.join(named, F.col(raw) == F.col("original_cluster"), "left").drop("original_cluster")
    )


def assign_to_medoids(seqs: DataFrame, medoids: DataFrame, costs: np.ndarray, id: str = "diaryid") -> DataFrame:
    """Nearest medoid of every sequence: seqs plus (medoid, dist). Ties go to the smaller id.

    Distances are rounded before they are compared, so the order of additions decides nothing.
    """
    nearest = []
    out = seqs
    for ids, distances in _reference_blocks(medoids, costs, id):
        names, column = F.array(*[F.lit(i) for i in ids]), f"__d{len(nearest)}"
        out = out.withColumn(column, F.transform(distances, lambda d: F.round(d, 9)))
        # Ids of a block and the blocks are in order, so the first smallest distance is wanted.
        best = F.array_min(column)
        medoid = F.element_at(names, F.array_position(column, best).cast("int"))
        nearest.append(F.struct(best.alias("dist"), medoid.alias("medoid")))
    best = F.array_min(F.array(*nearest))
    dropped = [f"__d{i}" for i in range(len(nearest))]
    return out.withColumns({"dist": best["dist"], "medoid": best["medoid"]}).drop(*dropped)


def cluster_profiles(assigned: DataFrame, group: str, weight: str | None = None) -> DataFrame:
    """State counts per group and slot: (group, slot, code, n). Bounded by groups x slots x states."""
    w = F.col(weight) if weight else F.lit(1)
    return (
        assigned.select(group, w.alias("__w"), F.posexplode("states").alias("pos", "code"))
        .groupBy(group, (F.col("pos") + 1).alias("slot"), "code")
        .agg(F.sum("__w").alias("n"))
    )


def group_costs(profiles: DataFrame, group: str, costs: np.ndarray) -> DataFrame:
    """(group, row): the total cost over the group's members of being in each state at each slot.

    A group has at most slots x states profile rows and one row here, an array of that size.
    """
    t, k, _ = costs.shape

    def row_of(profile: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((t, k))
        counts[profile["slot"] - 1, profile["code"]] = profile["n"]
        row = np.einsum("tab,tb->ta", costs, counts).reshape(-1)
        return pd.DataFrame({group: profile[group].iloc[:1], "row": [row]})

    kind = profiles.schema[group].dataType.simpleString()
    return profiles.groupBy(group).applyInPandas(row_of, f"`{group}` {kind}, row array<double>")


def group_medoids(assigned: DataFrame, group: str, costs: np.ndarray, id: str = "diaryid", weight: str | None = None) -> DataFrame:
    """Member with the smallest total distance to its group: (group, id, states, total).

    The total distance from a sequence to all members is its cost against the group's state
    counts, so no member pairs are formed. The groups' cost rows are joined, one copy per salt,
    so a group of any size is scored by many tasks.
    """
    k = costs.shape[1]
    rows = group_costs(cluster_profiles(assigned, group, weight), group, costs)
    joined = join_group_facts(assigned.select(group, id, "states"), rows, [group], id, "inner")
    total = F.aggregate(
        F.sequence(F.lit(0), F.size("states") - 1),
        F.lit(0.0),
        lambda sum_, i: sum_ + F.get("row", i * k + F.get("states", i)),
    )
    # Rounded so that the order of float additions cannot decide between copies.
    totals = joined.select(group, id, "states", F.round(total, 9).alias("total"))
    best = totals.groupBy(group).agg(F.min_by(F.struct(id, "states", "total"), F.struct("total", id)).alias("m"))
    return best.select(group, "m.*")


@dataclass
class Typology:
    """k-medoids: `assigned` sequences with (medoid, dist), the `medoids`, rounds taken, whether they settled."""

    assigned: DataFrame
    medoids: DataFrame
    rounds: int
    settled: bool


def k_medoids(seqs: DataFrame, seeds: DataFrame, costs: np.ndarray, id: str = "diaryid") -> Typology:
    """Alternate assignment and medoid update over all sequences until the medoids stay; runs jobs.

    Equal days are worked on once, weighted by their copies. Each round is two passes over the
    distinct days; only the medoids' ids come to the driver. Rounds never raise the total
    distance; should they return to medoids they had before, the run ends unsettled and says so.
    """
    days = cut_lineage(distinct_sequences(seqs, id))
    current = cut_lineage(seeds.select(id, "states"))
    seen: list[frozenset] = [frozenset(r[0] for r in current.select(id).collect())]
    while True:
        # Kept, as the profiles and the totals both need it: distances are worked out once a round.
        assigned = cut_lineage(assign_to_medoids(days, current, costs, id))
        current = cut_lineage(group_medoids(assigned, "medoid", costs, id, "n_copies").select(id, "states"))
        now = frozenset(r[0] for r in current.select(id).collect())
        if now in seen:
            break
        seen.append(now)
    return Typology(assign_to_medoids(seqs, current, costs, id), current, len(seen), now == seen[-1])


def routine_typology(typology: Typology, id: str = "diaryid") -> DataFrame:
    """Raw routine of every diary, the medoids numbered by id: (label, cluster60)."""
    ids = sorted(r[0] for r in typology.medoids.select(id).collect())
    place = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("medoid"))
    return typology.assigned.select(F.col(id).alias("label"), place.cast("int").alias("cluster60"))
