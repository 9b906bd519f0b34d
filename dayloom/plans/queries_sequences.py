"""Queries: whole-day sequences, distances and routines."""

from pyspark.sql import functions as F

from dayloom.functions import recode as R
from dayloom.operators import routines as Rt
from dayloom.operators import sequences as Q
from dayloom.operators.aggregate import filter_matches
from dayloom.plans import sql_tables as T
from dayloom.plans.registry import query
from dayloom.sources import keys, standin

N_SLOTS = 144
# Routines of the published typology, as many as the naming key has rows, and a smaller number that
# leaves several days to a routine also in small tables.
N_ROUTINES, N_FEW = 60, 12
# Groups that the routine tree starts from.
N_GROUPS = 120

STATE_CODE = "case coded5_activity " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(R.STATES)) + " end"
STATE_ROWS = ", ".join(f"('{s}', {i})" for i, s in enumerate(R.STATES))

# The complete in-sample diaries, and what is built on them.
SEQ_SQL = f"""
with complete as (
  select diaryid from diaries group by diaryid having count(coded5_activity) = {N_SLOTS}),
cells2 as (
  select d.diaryid, d.slot, d.coded5_activity as state, d.weight, {STATE_CODE} as code
  from diaries d join complete c on c.diaryid = d.diaryid),
state_dim(state, code) as (values {STATE_ROWS}),
pairs as (
  select slot, lag(state) over w as prev, state as cur, weight
  from cells2 window w as (partition by diaryid order by slot)),
rates as (
  select slot, prev, cur, coalesce(sum(weight), 0) as n_weighted,
         coalesce(sum(weight), 0) / nullif(sum(coalesce(sum(weight), 0)) over (partition by slot, prev), 0) as rate
  from pairs where prev is not null group by slot, prev, cur),
mutual as (
  select slot, a, b, sum(rate) as rate from (
    select slot, prev as a, cur as b, rate from rates union all select slot, cur, prev, rate from rates) x
  where a <> b group by slot, a, b),
costs as (
  select g.slot, x.state as a, y.state as b, x.code as ca, y.code as cb,
         case when x.state = y.state then 0.0
              else 4.0 - coalesce(m.rate, 0) * (case when g.slot = {N_SLOTS} then 2 else 1 end)
                       - coalesce(n.rate, 0) * (case when g.slot = 1 then 2 else 1 end) end as cost
  from (select cast(unnest(range(1, {N_SLOTS + 1})) as int) as slot) g cross join state_dim x cross join state_dim y
  left join mutual m on m.slot = g.slot and m.a = x.state and m.b = y.state
  left join mutual n on n.slot = g.slot + 1 and n.a = x.state and n.b = y.state),
texts as (
  select diaryid, string_agg(cast(code as varchar), '' order by slot) as day, max(weight) as weight from cells2 group by diaryid),
days as (select day, min(diaryid) as diaryid, count(*) as n_copies from texts group by day),
meds as (select * from days order by md5(day) limit {N_FEW})
"""


def sequence_table(s):
    """Code vectors of the complete in-sample diaries."""
    return Q.sequences(s.diaries.select("diaryid", "slot", "coded5_activity", "weight"))


def complete_slots(s):
    """Slots of the complete in-sample diaries, for transition rates."""
    from pyspark.sql import Window

    known = F.count("coded5_activity").over(Window.partitionBy("diaryid"))
    return (
        s.diaries.select("diaryid", "slot", "coded5_activity", "weight")
        .withColumn("__known", known)
        .filter(F.col("__known") == N_SLOTS)
        .drop("__known")
    )


def prepared(s):
    """The sequences, kept for repeated use, and the substitution costs computed from them."""
    seqs = Q.cut_lineage(sequence_table(s))
    return seqs, Q.cost_array(Q.dynamic_costs(Q.sequence_rates(seqs)))


TEMPOGRAM = f"""
with c as (
  select cluster, slot, coded5_activity, coalesce(sum(weight), 0) as n from diaries group by all),
p as (select cluster, slot, coded5_activity, n / nullif(sum(n) over (partition by cluster, slot), 0) as percent from c),
f as (select cluster, count(*) as group_size, max(description) as description from diaries group by cluster)
select f.cluster, t.slot, v.state as coded5_activity, coalesce(p.percent, 0) as percent,
       timestamp '2020-01-01 04:00:00' + to_minutes(10 * (t.slot - 1)) as slot_time, f.group_size, f.description
from f cross join (select cast(unnest(range(1, {N_SLOTS + 1})) as int) as slot) t
cross join (values {', '.join(f"('{s}')" for s in R.STATES)}) v(state)
left join p on p.cluster is not distinct from f.cluster and p.slot = t.slot and p.coded5_activity = v.state"""


@query("tempogram", TEMPOGRAM, "percent")
def tempogram(s):
    return Q.tempogram(s.diaries)


@query(
    "tempogram_overall",
    f"""
with c as (select slot, coded5_activity, coalesce(sum(weight), 0) as n from diaries group by all)
select t.slot, v.state as coded5_activity, coalesce(max(case when c.coded5_activity = v.state then n end) / nullif(sum(n), 0), 0) as percent,
       timestamp '2020-01-01 04:00:00' + to_minutes(10 * (t.slot - 1)) as slot_time
from (select cast(unnest(range(1, {N_SLOTS + 1})) as int) as slot) t
cross join (values {', '.join(f"('{s}')" for s in R.STATES)}) v(state) left join c on c.slot = t.slot group by t.slot, v.state""",
    "percent",
)
def tempogram_overall(s):
    return Q.tempogram(s.diaries, None)


# Day profiles of chosen routines, by a pattern of their description (filtered after the shares are made).
CHOSEN_ROUTINES = {"workdays": "Workday", "unpaid": "[Uu]npaid", "leisure": "[Ll]eisure", "disrupted": "[Dd]isrupted|[Rr]est"}

for _name, _pattern in CHOSEN_ROUTINES.items():
    query(
        f"tempogram_{_name}", f"select * from ({TEMPOGRAM}) x where regexp_matches(description, '{_pattern}')", "percent"
    )(lambda s, pattern=_pattern: filter_matches(Q.tempogram(s.diaries), "description", pattern))


@query(
    "sequences",
    SEQ_SQL + "select diaryid, weight, day from texts",
    "weight",
)
def sequences(s):
    return sequence_table(s).select("diaryid", "weight", Q._code_text().alias("day"))


@query("transition_rates", SEQ_SQL + "select slot, prev, cur, n_weighted, rate from rates", "n_weighted rate")
def transition_rates(s):
    return Q.transition_rates(complete_slots(s))


@query("dynamic_costs", SEQ_SQL + "select slot, a, b, cost from costs", "cost")
def dynamic_costs(s):
    return Q.dynamic_costs(Q.sequence_rates(sequence_table(s)))


@query("distinct_sequences", SEQ_SQL + "select day, diaryid, n_copies from days")
def distinct_sequences(s):
    return Q.distinct_sequences(sequence_table(s)).select(Q._code_text().alias("day"), "diaryid", "n_copies")


@query(
    "distances_to",
    SEQ_SQL
    + """
select a.diaryid, m.diaryid as ref, sum(c.cost) as dist
from cells2 a join meds m on true join cells2 b on b.diaryid = m.diaryid and b.slot = a.slot
join costs c on c.slot = a.slot and c.ca = a.code and c.cb = b.code
group by a.diaryid, m.diaryid""",
    "dist",
)
def distances_to(s):
    """Every complete diary against the seeds of the typology."""
    seqs, costs = prepared(s)
    return Q.distances_to(seqs, Q.seed_medoids(seqs, N_FEW), costs)


@query(
    "assign_medoids",
    SEQ_SQL
    + """
select diaryid, medoid, dist from (
  select a.diaryid, m.diaryid as medoid, sum(c.cost) as dist,
         row_number() over (partition by a.diaryid order by round_even(sum(c.cost), 9), m.diaryid) as rn
  from cells2 a join meds m on true join cells2 b on b.diaryid = m.diaryid and b.slot = a.slot
  join costs c on c.slot = a.slot and c.ca = a.code and c.cb = b.code
  group by a.diaryid, m.diaryid) x where rn = 1""",
    "dist",
)
def assign_medoids(s):
    seqs, costs = prepared(s)
    medoids = Q.seed_medoids(seqs, N_FEW)
    return Q.assign_to_medoids(seqs, medoids, costs).select("diaryid", "medoid", "dist")


# Rounds written out in SQL, more than the test tables need; settled medoids stay as they are.
SQL_ROUNDS = 12


def _rounds_sql(k: int) -> str:
    """Medoids after SQL_ROUNDS rounds (`final`) from k seeds, from distances between distinct days."""
    ctes = [
        SEQ_SQL
        + """,
dist as materialized (
  select x.diaryid as a, y.diaryid as b, y.n_copies as n, round_even(sum(c.cost), 9) as d
  from days x cross join days y join cells2 p on p.diaryid = x.diaryid join cells2 q on q.diaryid = y.diaryid and q.slot = p.slot
  join costs c on c.slot = p.slot and c.ca = p.code and c.cb = q.code group by x.diaryid, y.diaryid, y.n_copies),
m0 as materialized (select diaryid as m from days order by md5(day) limit """
        + f"{k})"
    ]
    for r in range(SQL_ROUNDS):
        ctes.append(f"""
g{r} as materialized (select b as day, n, m from (
  select b, n, m, row_number() over (partition by b order by d, m) as rn from dist join m{r} on m = a) x where rn = 1),
m{r + 1} as materialized (select day as m from (
  select x.day, row_number() over (partition by x.m order by round_even(sum(d.d * y.n), 6), x.day) as rn
  from g{r} x join g{r} y on y.m = x.m join dist d on d.a = x.day and d.b = y.day group by x.m, x.day) x where rn = 1)""")
    ctes.append(f"""
final as materialized (select diaryid, medoid, dist from (
  select t.diaryid, m as medoid, d.d as dist, row_number() over (partition by t.diaryid order by d.d, m) as rn
  from texts t join days y on y.day = t.day join dist d on d.b = y.diaryid join m{SQL_ROUNDS} on m = d.a) x where rn = 1)""")
    return ",".join(ctes)


def typology_of(s, k=N_ROUTINES):
    """k-medoids over all complete diaries."""
    seqs, costs = prepared(s)
    return Q.k_medoids(seqs, Q.seed_medoids(seqs, k), costs)


NUMBERED_SQL = """,
numbers as (select medoid, row_number() over (order by medoid) as cluster60 from (select distinct medoid from final) x)"""

MEDOID_PROFILE_SQL = NUMBERED_SQL + f""",
w as (select n.cluster60, d.slot, d.coded5_activity, d.weight from diaries d join final f on f.diaryid = d.diaryid join numbers n on n.medoid = f.medoid),
c as (select cluster60, slot, coded5_activity, coalesce(sum(weight), 0) as n from w group by all),
p as (select cluster60, slot, coded5_activity, n / nullif(sum(n) over (partition by cluster60, slot), 0) as percent from c),
f2 as (select cluster60, count(*) as group_size from w group by cluster60)
select cast(f2.cluster60 as int) as cluster60, t.slot, v.state as coded5_activity, coalesce(p.percent, 0) as percent,
       timestamp '2020-01-01 04:00:00' + to_minutes(10 * (t.slot - 1)) as slot_time, f2.group_size
from f2 cross join (select cast(unnest(range(1, {N_SLOTS + 1})) as int) as slot) t
cross join (values {', '.join(f"('{s}')" for s in R.STATES)}) v(state)
left join p on p.cluster60 = f2.cluster60 and p.slot = t.slot and p.coded5_activity = v.state"""

ROUTINES_SQL = NUMBERED_SQL + """
select f.diaryid as label, cast(n.cluster60 as int) as cluster60, k.description, k.cluster
from final f join numbers n on n.medoid = f.medoid
left join routines k on k.original_cluster = n.cluster60"""


def medoid_profile(s, k):
    """The day profile of every computed routine."""
    raw = Q.routine_typology(typology_of(s, k)).withColumnRenamed("label", "diaryid")
    slots = s.diaries.select("diaryid", "slot", "coded5_activity", "weight").join(raw, "diaryid")
    return Q.tempogram(slots, "cluster60", label=None)


def routine_typology(s, k):
    """Computed routines, named like the published ones."""
    return Q.recluster(Q.routine_typology(typology_of(s, k)), keys.recluster_key(s.spark))


# The 60 routines of the naming key, and the same with 12, where routines are shared in small tables too.
for _suffix, _k in {"": N_ROUTINES, "_60": N_ROUTINES, "_12": N_FEW}.items():
    _sql = _rounds_sql(_k)
    if _suffix != "_60":
        query(f"k_medoids{_suffix}", _sql + "select diaryid, medoid, dist from final", "dist")(
            lambda s, k=_k: typology_of(s, k).assigned.select("diaryid", "medoid", "dist")
        )
    query(f"medoid_profile{_suffix}", _sql + MEDOID_PROFILE_SQL, "percent")(lambda s, k=_k: medoid_profile(s, k))
    query(f"routine_typology{_suffix}", _sql + ROUTINES_SQL)(lambda s, k=_k: routine_typology(s, k))


@query(
    "group_medoids",
    SEQ_SQL
    + """,
total as (
  select a.diaryid, cl.cluster % 5 as grp, sum(c.cost) as total
  from cells2 a join clusters cl on cl.label = a.diaryid
  join clusters cm on cm.cluster % 5 = cl.cluster % 5 join cells2 b on b.diaryid = cm.label and b.slot = a.slot
  join costs c on c.slot = a.slot and c.ca = a.code and c.cb = b.code group by a.diaryid, cl.cluster % 5)
select grp, diaryid, round_even(total, 6) as total from (
  select *, row_number() over (partition by grp order by round_even(total, 9), diaryid) as rn from total) x where rn = 1""",
    "total",
)
def group_medoids(s):
    seqs, costs = prepared(s)
    grouped = seqs.join(
        s.clusters.select(F.col("label").alias("diaryid"), (F.col("cluster") % 5).alias("grp")), "diaryid"
    )
    return Q.group_medoids(grouped, "grp", costs).select("grp", "diaryid", "total")


@query("recluster", "select label, cluster60, description, cluster from clusters")
def recluster(s):
    return Q.recluster(standin.raw_clusters(s.spark, s.folder), keys.recluster_key(s.spark))


# ---- the routine tree --------------------------------------------------------------------------


def tree_groups(s):
    """Complete diaries in the groups of the published typology: (diaryid, node, states), and the costs."""
    seqs, costs = prepared(s)
    groups = s.clusters.select(F.col("label").alias("diaryid"), F.col("cluster").alias("node"))
    return seqs.join(groups, "diaryid").select("diaryid", "node", "states"), costs


def _tree_sql(groups: int) -> str:
    """Average linkage step by step: `m<step>` is the join of a step, `g<step>` the pairs and `l<step>` the groups' places after it.

    A step without a pair left has no row and leaves all as it is.
    """
    ctes = [
        SEQ_SQL
        + """,
gs as materialized (select x.cluster as node, c.diaryid, c.slot, c.code from cells2 c join clusters x on x.label = c.diaryid),
ns as materialized (select node, count(distinct diaryid) as n from gs group by node),
cnt as materialized (select node, slot, code, count(*) as n from gs group by all),
g0 as materialized (
  select a.node as a, b.node as b, sum(c.cost * a.n * b.n) as total, any_value(p.n) as a_n, any_value(q.n) as b_n
  from cnt a join cnt b on b.slot = a.slot and a.node < b.node join costs c on c.slot = a.slot and c.ca = a.code and c.cb = b.code
  join ns p on p.node = a.node join ns q on q.node = b.node group by a.node, b.node),
l0 as materialized (select node, node as root, 0::bigint as place, n from ns)"""
    ]
    for i in range(1, groups):
        ctes.append(f"""
m{i} as materialized (select a as kept, b as gone, round_even(total / (a_n * b_n), 9) as height, a_n + b_n as n
  from g{i - 1} order by 3, 1, 2 limit 1),
h{i} as materialized (select m.*, (select count(*) from l{i - 1} l where l.root = m.kept) as kept_groups, (select count(*) from l{i - 1} l where l.root in (m.kept, m.gone)) as groups from m{i} m),
g{i} as materialized (select least(a, b) as a, greatest(a, b) as b, sum(total) as total,
    any_value(case when least(a, b) = a then x_n else y_n end) as a_n, any_value(case when least(a, b) = a then y_n else x_n end) as b_n
  from (select case when g.a = m.gone then m.kept else g.a end as a, case when g.b = m.gone then m.kept else g.b end as b, total,
      case when g.a in (m.kept, m.gone) then m.n else g.a_n end as x_n, case when g.b in (m.kept, m.gone) then m.n else g.b_n end as y_n
    from g{i - 1} g cross join m{i} m) x where a <> b group by least(a, b), greatest(a, b)),
l{i} as materialized (select l.node, case when l.root = h.gone then h.kept else l.root end as root,
    case when l.root = h.gone then l.place + h.kept_groups else l.place end as place, l.n from l{i - 1} l left join h{i} h on true)""")
    steps = "\nunion all ".join(f"select {i} as step, kept, gone, height, kept_groups, groups, n from h{i}" for i in range(1, groups))
    return ",".join(ctes) + f""",
tree as materialized ({steps})
"""


# The published typology has this many named routines.
N_NAMED = len({description for _, description in keys.RECLUSTER_KEY})
TREE_SQL = _tree_sql(N_NAMED)
N_CUT = 6


def tree_of(s):
    """The merge history of the published routines."""
    days, costs = tree_groups(s)
    return Rt.agglomerate(days, "node", costs)


@query(
    "agglomerate",
    TREE_SQL
    + "select step, kept, gone, height, cast(kept_groups as int) as kept_groups, cast(groups as int) as groups, cast(n as bigint) as n from tree",
    "height",
)
def agglomerate(s):
    return tree_of(s)


@query(
    "cut_tree",
    TREE_SQL
    + f"""
select node, cast(dense_rank() over (order by start) as int) as cluster from (
  select last.node, min(last.place) over (partition by cut.root) as start from l{N_NAMED - 1} last
  join ({' union all '.join(f"select *, {i} as step from l{i}" for i in range(N_NAMED))}) cut on cut.node = last.node
  where cut.step = greatest(0, (select count(*) from ns) - {N_CUT})) x""",
)
def cut_tree(s):
    return Rt.cut_tree(tree_of(s), N_CUT)


@query(
    "merge_heights",
    TREE_SQL + "select cast(rank as int) as rank, height from (select row_number() over (order by step desc) as rank, height from tree) x where rank between 2 and 51",
    "height",
)
def merge_heights(s):
    return Rt.merge_heights(tree_of(s))


@query("routine_tree")
def routine_tree(s):
    """Days in groups by k-medoids, the groups in a tree, the tree cut into 60 routines, and these named."""
    seqs, costs = prepared(s)
    typology = Q.k_medoids(seqs, Q.seed_medoids(seqs, N_GROUPS), costs)
    days = Q.cut_lineage(typology.assigned.select("diaryid", F.col("medoid").alias("node"), "states"))
    cut = Rt.cut_tree(Rt.agglomerate(days, "node", costs), N_ROUTINES)
    named = days.join(cut, "node").select(F.col("diaryid").alias("label"), F.col("cluster").alias("cluster60"))
    return Q.recluster(named, keys.recluster_key(s.spark))


# Diaries of the test tables are far apart: only a wide radius has pairs in it.
RADIUS = 345.0


@query(
    "pairs_within",
    SEQ_SQL
    + f"""
select * from (
  select a.diaryid as a, b.diaryid as b, round_even(sum(c.cost), 9) as dist
  from days x join cells2 a on a.diaryid = x.diaryid join cells2 b on b.slot = a.slot join days y on y.diaryid = b.diaryid
  join costs c on c.slot = a.slot and c.ca = a.code and c.cb = b.code
  where a.diaryid < b.diaryid group by a.diaryid, b.diaryid) d where dist <= {RADIUS}""",
    "dist",
)
def pairs_within(s):
    seqs, costs = prepared(s)
    return Rt.pairs_within(seqs, costs, RADIUS)
