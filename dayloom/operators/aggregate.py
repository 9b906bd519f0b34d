"""Counts, shares, weighted means, distributions and their summaries.

Group columns (`group`) may hold NULL, which is a group of its own. Weights and values that are
missing are left out, unless `strict`, where one missing input makes the group's result NULL.
Every aggregate here combines map-side, so a hot group is reduced before it is shuffled;
windows run on aggregated rows only.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.functions.semantics import col, join_null_safe, share, strict as strict_agg, sum_or_zero
from dayloom.operators.reshape import explode_grid
from dayloom.runtime import cut_lineage


def _names(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def count_by(df: DataFrame, cols: str | Sequence[str], name: str = "n") -> DataFrame:
    """Rows per key."""
    return df.groupBy(*_names(cols)).agg(F.count(F.lit(1)).alias(name))


def count_of_counts(df: DataFrame, group: Sequence[str], unit: str, name: str = "n_rows") -> DataFrame:
    """How many units of each group have 1, 2, ... rows."""
    per_unit = count_by(df, [*group, unit], name)
    return count_by(per_unit, [*group, name])


def weighted_count(
    df: DataFrame, cols: str | Sequence[str], w: str = "weight", n: str = "n", n_weighted: str = "n_weighted"
) -> DataFrame:
    """Rows and summed weights per cell."""
    return df.groupBy(*_names(cols)).agg(
        F.count(F.lit(1)).alias(n), sum_or_zero(w).alias(n_weighted)
    )


def share_of_group(cells: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """value / sum of value over the group, on already aggregated cells."""
    if group:
        total = F.sum(value).over(Window.partitionBy(*group))
    else:
        total = cells.agg(F.sum(value)).scalar()
    return cells.withColumn(name, share(F.col(value), total))


def weighted_share(
    df: DataFrame,
    group: str | Sequence[str],
    level: str | Sequence[str],
    w: str = "weight",
    name: str = "share",
    n: str = "n",
    strict: bool = False,
) -> DataFrame:
    """Summed weight per level over summed weight per group."""
    group, level = _names(group), _names(level)
    total = F.sum(w)
    total = strict_agg(total, F.col(w)) if strict else sum_or_zero(w)
    cells = df.groupBy(*group, *level).agg(total.alias(n))
    out = share_of_group(cells, group, n, name)
    if strict and group:
        unknown = F.count_if(F.col(n).isNull()).over(Window.partitionBy(*group))
        out = out.withColumn(name, F.when(unknown == 0, F.col(name)))
    return out


def plain_share(
    df: DataFrame, group: str | Sequence[str], level: str | Sequence[str], name: str = "share", n: str = "n"
) -> DataFrame:
    """Rows per level over rows per group."""
    group, level = _names(group), _names(level)
    return share_of_group(count_by(df, [*group, *level], n), group, n, name)


def conditional_share(
    df: DataFrame,
    group: str | Sequence[str],
    tests: Mapping[str, Column],
    w: str | None = "weight",
    strict: Sequence[str] = (),
) -> DataFrame:
    """Weight of the rows that pass each test over the weight of all rows, in one pass.

    Tests named in `strict` give NULL where one row's answer is unknown; the others count
    unknown as not passing. Rows without a weight count nowhere.
    """
    weight = F.lit(1) if w is None else F.col(w)
    aggs = []
    for name, test in tests.items():
        out = share(sum_or_zero(F.when(test, weight)), F.sum(weight))
        aggs.append((strict_agg(out, test) if name in strict else out).alias(name))
    return df.groupBy(*_names(group)).agg(*aggs)


def mean_of(x: str | Column, w: str | Column = "weight", strict: bool = False) -> Column:
    """The weighted mean as an aggregate column."""
    x, w = col(x), col(w)
    used = x.isNotNull() & w.isNotNull()
    mean = share(F.sum(F.when(used, w * x)), F.sum(F.when(used, w)))
    return strict_agg(mean, x, w) if strict else mean


def weighted_mean(
    df: DataFrame,
    group: str | Sequence[str],
    cols: str | Sequence[str] | Mapping[str, Column],
    w: str = "weight",
    strict: bool = False,
) -> DataFrame:
    """Weighted means of one or many columns per group."""
    named = cols if isinstance(cols, Mapping) else {c: F.col(c) for c in _names(cols)}
    return df.groupBy(*_names(group)).agg(*[mean_of(x, w, strict).alias(n) for n, x in named.items()])


def slot_totals(
    df: DataFrame, tests: Mapping[str, Column], id: str | Sequence[str] = "diaryid", strict: Sequence[str] = ()
) -> DataFrame:
    """Slots per diary that pass each test; strict tests are NULL if any slot is unknown."""
    aggs = []
    for name, test in tests.items():
        total = sum_or_zero(test.cast("int"))
        aggs.append((strict_agg(total, test) if name in strict else total).alias(name))
    return df.groupBy(*_names(id)).agg(*aggs)


def company_slots(
    slots: DataFrame,
    companions: Sequence[str] = ("whoa", "whob", "whoc", "whod"),
    id: str = "diaryid",
    not_household: str | None = None,
    alone: str | None = None,
) -> DataFrame:
    """Slots with at least one, two, three companions and person-slots, inside and outside the household.

    The companions of a slot are columns of one row, so the per-slot count is an expression and
    a single aggregate per diary is left.
    """
    test_in, test_out = _company_tests(not_household, alone)
    inside, outside = F.lit(0), F.lit(0)
    for c in companions:
        inside = inside + F.coalesce(test_in(c).cast("int"), F.lit(0))
        outside = outside + F.coalesce(test_out(c).cast("int"), F.lit(0))
    return _company_totals(slots.select(id, inside.alias("with_household"), outside.alias("with_not_household")), id)


def _company_tests(not_household: str | None = None, alone: str | None = None):
    """Tests of a companion column: a member of the household, someone from outside it."""
    from dayloom.functions.recode import ALONE_LABEL, NOT_HOUSEHOLD_PATTERN

    outside = not_household or NOT_HOUSEHOLD_PATTERN
    other = f"{outside}|{alone or ALONE_LABEL}"
    return lambda c: ~F.col(c).rlike(other), lambda c: F.col(c).rlike(outside)


def _company_totals(counted: DataFrame, id: str) -> DataFrame:
    """Totals per diary from (id, with_household, with_not_household) per slot."""
    aggs = []
    for c in ("with_household", "with_not_household"):
        for word, least in (("one", 1), ("two", 2), ("three", 3)):
            aggs.append(F.count_if(F.col(c) >= least).alias(f"{c}_Xat_least_{word}"))
        aggs.append(F.sum(c).alias(f"{c}_Xperson_hours"))
    return counted.groupBy(id).agg(*aggs)


def company_slots_long(who_long: DataFrame, id: str = "diaryid", slot: str = "slot", value: str = "who_value") -> DataFrame:
    """The same totals from the (diary, slot, companion) form, with any number of companions in a slot."""
    test_in, test_out = _company_tests()
    per_slot = who_long.groupBy(id, slot).agg(
        F.count_if(test_in(value)).alias("with_household"), F.count_if(test_out(value)).alias("with_not_household")
    )
    return _company_totals(per_slot, id)


def weighted_total(
    df: DataFrame, group: Sequence[str], unit: Sequence[str], w: str = "weight", name: str = "total"
) -> DataFrame:
    """Sum over units of (rows of the unit times its weight), per group."""
    per_unit = count_by(df, [*group, *unit, w], "__n")
    return per_unit.groupBy(*group).agg(F.sum(F.col("__n") * F.col(w)).alias(name))


def simple_aggs(df: DataFrame, group: str | Sequence[str], x: str) -> DataFrame:
    """n, mean, minimum, maximum, standard deviation of a column per group."""
    return df.groupBy(*_names(group)).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("mean"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.stddev_samp(x).alias("sd"),
    )


def with_total_row(df: DataFrame, label_col: str, label: str) -> DataFrame:
    """Append a row of column totals, labelled in `label_col` (which becomes a string)."""
    numeric = [f.name for f in df.schema.fields if f.name != label_col]
    totals = df.agg(*[F.sum(c).alias(c) for c in numeric]).withColumn(label_col, F.lit(label))
    return df.withColumn(label_col, F.col(label_col).cast("string")).unionByName(totals)


def by_each(
    df: DataFrame,
    fixed: Sequence[str],
    dims: Sequence[str],
    aggs: Sequence[Column],
    all_label: str = "All",
    extra: Sequence[str] = (),
) -> DataFrame:
    """The same aggregates for each dimension in turn and for all rows, stacked.

    One GROUPING SETS pass. Gives (*fixed, *extra, dimension, category, *aggs); the dimension is
    `all_label` for the overall rows, and a missing category stays apart from them.
    """
    fixed, dims = [*fixed, *extra], list(dims)
    sets = [[F.col(c) for c in [*fixed, d]] for d in dims] + [[F.col(c) for c in fixed]]
    # In each set exactly one dimension is not rolled up, so its flag is zero.
    flags = [F.grouping(d).alias(f"__g_{d}") for d in dims]
    grouped = df.groupingSets(sets, *[F.col(c) for c in [*fixed, *dims]]).agg(*aggs, *flags)
    dimension, category = None, None
    for d in dims:
        here = F.col(f"__g_{d}") == 0
        dimension = F.when(here, d) if dimension is None else dimension.when(here, d)
        value = F.col(d).cast("string")
        category = F.when(here, value) if category is None else category.when(here, value)
    known = set(fixed) | set(dims) | {f"__g_{d}" for d in dims}
    results = [c for c in grouped.columns if c not in known]
    return grouped.select(
        *fixed,
        dimension.otherwise(all_label).alias("dimension"),
        category.otherwise(all_label).alias("category"),
        *results,
    )


def weighted_mode(
    df: DataFrame, group: str | Sequence[str], level: str, w: str = "weight", n: str = "n"
) -> DataFrame:
    """The level with the largest summed weight per group, ties kept.

    Sums are rounded first, so that the order of additions cannot break a tie.
    """
    group = _names(group)
    cells = df.groupBy(*group, level).agg(F.round(sum_or_zero(w), 9).alias(n))
    # A row per level meets here, not the data.
    best = F.max(n).over(Window.partitionBy(*group)) if group else cells.agg(F.max(n)).scalar()
    return cells.withColumn("__best", best).filter(F.col(n) == F.col("__best")).drop("__best")


def n_distinct(
    df: DataFrame, group: str | Sequence[str], counts: Mapping[str, tuple[str, Column | None]]
) -> DataFrame:
    """Distinct values per group for {name: (column, test or None)}; a NULL value counts as one.

    Rows failing the test, or of which it is unknown, do not count.
    """
    aggs = []
    for name, (c, test) in counts.items():
        passes = F.lit(True) if test is None else F.coalesce(test, F.lit(False))
        seen = F.count_distinct(F.when(passes, F.col(c)))
        missing = F.coalesce(F.max(F.when(passes, F.col(c).isNull()).cast("int")), F.lit(0))
        aggs.append((seen + missing).alias(name))
    return df.groupBy(*_names(group)).agg(*aggs)


def correlation(df: DataFrame, x: str, y: str, name: str = "corr") -> DataFrame:
    """Pearson correlation of two columns."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.agg(F.corr(x, y).alias(name))


def cronbach_alpha(df: DataFrame, items: Sequence[str], name: str = "alpha") -> DataFrame:
    """Scale reliability from the covariance matrix, all of it in one aggregate pass."""
    k = len(items)
    variances, covariances = F.lit(0.0), F.lit(0.0)
    for i, a in enumerate(items):
        variances = variances + F.var_samp(a)
        for b in items[i + 1 :]:
            covariances = covariances + F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double"))
    mean_var, mean_cov = variances / k, covariances / (k * (k - 1) / 2)
    return df.agg(share(k * mean_cov, mean_var + (k - 1) * mean_cov).alias(name))


def mean_entropy(
    df: DataFrame, group: str | Sequence[str], state: str, slot: str = "slot"
) -> DataFrame:
    """Shannon entropy of the states of a slot, averaged over slots, and as a share of the maximum.

    The maximum is the log of the number of states seen anywhere, a missing state included.
    """
    group = _names(group)
    # The counts are kept, so that the number of states does not cost a second pass over the data.
    counts = cut_lineage(count_by(df, [*group, slot, state]))
    cells = share_of_group(counts, [*group, slot], "n", "p")
    per_slot = cells.groupBy(*group, slot).agg((-F.sum(F.col("p") * F.ln("p"))).alias("h"))
    states = counts.agg(
        (F.count_distinct(state) + F.max(F.col(state).isNull().cast("int"))).alias("k")
    ).scalar()
    return per_slot.groupBy(*group).agg(F.avg("h").alias("mean_h")).withColumn(
        "prop_max_h", share(F.col("mean_h"), F.ln(states))
    )


def weighted_ecdf(
    df: DataFrame,
    group: str | Sequence[str],
    x: str,
    points: tuple[int, int],
    side: str = "below",
    w: str = "weight",
    point: str = "time",
    name: str = "share",
) -> DataFrame:
    """Share of the weight with x < t ('below') or x > t ('above') for each integer t of a range.

    Rows whose x is missing stay in the denominator. Weights are summed per value once; a
    running sum over the values and grid points of a group replaces one rescan per t.
    """
    group = _names(group)
    lo, hi = points
    # x < t includes the weight at t - 1 and before: each value acts from the first t that sees
    # it. 'above' counts what is left, so a value at t is already gone at t. Values before the
    # range act from its first point, those after it beyond its last.
    first_t = F.floor(F.col(x)) + 1 if side == "below" else F.ceil(F.col(x))
    step = F.least(F.greatest(first_t, F.lit(lo)), F.lit(hi + 1)).cast("int")
    step = F.when(F.col(x).isNotNull(), step)
    steps = df.groupBy(*group, step.alias(point)).agg(sum_or_zero(w).alias("__w"))
    present = F.col(point).isNotNull()
    # A group has at most one step per grid point here.
    per_group = steps.groupBy(*group).agg(
        F.sum("__w").alias("__total"),
        sum_or_zero(F.when(present, F.col("__w"))).alias("__known"),
        F.map_from_entries(F.collect_list(F.when(present, F.struct(point, "__w")))).alias("__steps"),
    )
    grid = explode_grid(per_group, point, lo, hi)
    running = F.sum(F.coalesce(F.try_element_at("__steps", F.col(point)), F.lit(0.0))).over(
        Window.partitionBy(*group).orderBy(point).rowsBetween(Window.unboundedPreceding, 0)
    )
    part = running if side == "below" else F.col("__known") - running
    return grid.select(*group, point, share(part, F.col("__total")).alias(name))


def weighted_histogram(
    df: DataFrame,
    group: str | Sequence[str],
    x: str,
    width: float,
    w: str = "weight",
    name: str = "n_weighted",
) -> DataFrame:
    """Summed weight per bin; bins are centred on the multiples of the width."""
    bin_no = F.floor(F.col(x) / F.lit(width) + 0.5).cast("bigint")
    return (
        df.filter(F.col(x).isNotNull())
        .groupBy(*_names(group), bin_no.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), sum_or_zero(w).alias(name))
    )


def weighted_density(
    df: DataFrame,
    group: str | Sequence[str],
    x: str,
    lo: float,
    hi: float,
    bandwidth: float,
    points: int = 512,
    w: str = "weight",
    name: str = "density",
) -> DataFrame:
    """Gaussian kernel density on `points` equally spaced values of [lo, hi].

    Linear binning on the grid of the result: a value's weight is split between the grid points
    around it, summed map-side. The grid goes on for six bandwidths on either side; farther
    values count in the total only. Then a group's bins, whose number doesn't grow with the data,
    meet its points.
    """
    group = _names(group)
    step = (hi - lo) / (points - 1)
    pad = int(6 * bandwidth / step) + 1
    place = (F.col(x).cast("double") - F.lit(lo)) / F.lit(step)
    below = F.greatest(F.least(F.floor(place), F.lit(points + pad)), F.lit(-pad - 2)).cast("long")
    part = F.least(F.greatest(place - below, F.lit(0.0)), F.lit(1.0))
    halves = F.array(
        F.struct(below.alias("bin"), (F.col(w) * (1 - part)).alias("w")),
        F.struct((below + 1).alias("bin"), (F.col(w) * part).alias("w")),
    )
    known = df.filter(F.col(x).isNotNull() & F.col(w).isNotNull())
    bins = known.select(*group, F.explode(halves).alias("__h")).groupBy(*group, F.col("__h.bin").alias("__bin"))
    bins = bins.agg(F.sum("__h.w").alias("__w"))
    grid = explode_grid(bins, "point", 0, points - 1)
    z = (F.col("point") - F.col("__bin")) * F.lit(step / bandwidth)
    near = (F.col("__bin") >= -pad) & (F.col("__bin") <= points - 1 + pad)
    sums = grid.groupBy(*group, "point").agg(
        sum_or_zero(F.when(near, F.col("__w") * F.exp(-z * z / 2))).alias("__k"), F.sum("__w").alias("__total")
    )
    at = F.lit(lo) + F.col("point") * F.lit(step)
    scale = bandwidth * (2 * 3.141592653589793) ** 0.5
    return sums.select(
        *group, "point", at.alias("x_at"), share(F.col("__k"), F.col("__total") * F.lit(scale)).alias(name)
    )


def overall_rates(df: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    """Share of all rows passing each test; unknown counts as not passing, in the denominator too."""
    return df.agg(*[share(F.count_if(t), F.count(F.lit(1))).alias(n) for n, t in tests.items()])


def null_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing values per column, one row per column, from a single pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.unpivot([], list(cols), "column", "n_missing")


def frequency(df: DataFrame, c: str, levels: Sequence[str] | None = None) -> DataFrame:
    """Table of a column without its missing values, with the place of each level."""
    from dayloom.functions.recode import level_position

    table = count_by(df.filter(F.col(c).isNotNull()), c)
    return table.withColumn(f"{c}_ord", level_position(c, levels)) if levels else table


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows without a missing value in `cols`."""
    known = F.lit(True)
    for c in cols:
        known = known & F.col(c).isNotNull()
    return df.filter(known)


def filter_matches(df: DataFrame, c: str, pattern: str) -> DataFrame:
    """Rows whose text matches; apply it after shares are computed, or their base changes."""
    return df.filter(F.col(c).rlike(pattern))


def first_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key by `order`, all columns.

    min_by keeps one candidate per key and task, so a hot key never meets in one place.
    """
    keys = _names(key)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def sample_join(sample: DataFrame, indicators: Sequence[DataFrame], id: str = "diaryid") -> DataFrame:
    """Every in-sample diary with its indicators, NULL where a diary has none."""
    for ind in indicators:
        sample = sample.join(ind, id, "left")
    return sample


def lookup_join(df: DataFrame, key: DataFrame, on: str, key_col: str, null_safe: bool = False) -> DataFrame:
    """Left join of a lookup table; Spark broadcasts it if its measured size allows."""
    renamed = key.withColumnRenamed(key_col, "__key")
    cond = F.col(on).eqNullSafe(F.col("__key")) if null_safe else F.col(on) == F.col("__key")
    return df.join(renamed, cond, "left").drop("__key")


def interval(
    df: DataFrame,
    group: str | Sequence[str],
    x: str = "value",
    widths: Sequence[float] = (0.5, 0.8, 0.95),
    point: str = "median",
) -> DataFrame:
    """Central quantile intervals and a point value per group: (group, point, width, lower, upper).

    Quantiles interpolate linearly; `exact_quantiles` spreads a group over many tasks.
    """
    group = _names(group)
    probs = sorted({round((1 - q) / 2, 10) for q in widths} | {round((1 + q) / 2, 10) for q in widths} | {0.5})
    quantiles = exact_quantiles(df, group, x, probs)
    in_order = F.array_sort(F.collect_list(F.struct("prob", "value")))
    arrays = quantiles.groupBy(*group).agg(F.transform(in_order, lambda s: s["value"]).alias("__q"))
    means = df.groupBy(*group).agg(F.avg(x).alias("__mean"))
    wide = join_null_safe(arrays, means, group, "inner")
    centre = F.col("__mean") if point == "mean" else F.col("__q")[probs.index(0.5)]
    rows = [
        F.struct(
            F.lit(float(q)).alias("width"),
            F.col("__q")[probs.index(round((1 - q) / 2, 10))].alias("lower"),
            F.col("__q")[probs.index(round((1 + q) / 2, 10))].alias("upper"),
        )
        for q in widths
    ]
    return wide.select(*group, centre.alias("point"), F.explode(F.array(*rows)).alias("i")).select(
        *group, "point", "i.width", "i.lower", "i.upper"
    )


def exact_quantiles(df: DataFrame, group: str | Sequence[str], x: str, probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group: (group, prob, value), for groups of any size.

    1. Equal values of a group are merged into counts, the only pass over the data. 2. The
    counted values are range partitioned by group and value, so a group is cut into as many
    cells as its size asks for, wherever its values lie. 3. The cell sizes of a group, summed in
    order, tell which cells hold the wanted ranks. 4. Only those cells are ordered, each on its
    own.
    """
    group = _names(group)
    values = df.filter(F.col(x).isNotNull()).select(*group, F.col(x).cast("double").alias("__v"))
    counts = values.groupBy(*group, "__v").agg(F.count(F.lit(1)).alias("__c"))
    # Kept, because a cell is the partition a value came to.
    bucketed = cut_lineage(counts.repartitionByRange(*group, "__v").withColumn("__b", F.spark_partition_id()))
    cells = bucketed.groupBy(*group, "__b").agg(F.sum("__c").alias("__n"))
    # At most one cell per partition meets in this window.
    upto = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cells.select(
        *group,
        "__b",
        "__n",
        F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy(*group)).alias("__total"),
    )
    wanted = ranked.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn(
        "__pos", F.col("prob") * (F.col("__total") - 1)
    )
    # Zero-based ranks below and above the position; the cells that hold either are kept.
    low, high = F.floor("__pos"), F.ceil("__pos")
    first, last = F.col("__before"), F.col("__before") + F.col("__n") - 1
    hit = ((low >= first) & (low <= last)) | ((high >= first) & (high <= last))
    wanted = wanted.filter(hit)
    inside = Window.partitionBy(*group, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    chosen = wanted.select(*group, "__b").distinct()
    placed = join_null_safe(bucketed, chosen, [*group, "__b"], "left_semi").withColumn(
        "__end", F.sum("__c").over(inside)
    )
    matched = join_null_safe(wanted, placed, [*group, "__b"], "inner")
    start = F.col("__before") + F.col("__end") - F.col("__c")
    end = F.col("__before") + F.col("__end") - 1
    low_v = F.max(F.when((low >= start) & (low <= end), F.col("__v")))
    high_v = F.max(F.when((high >= start) & (high <= end), F.col("__v")))
    frac = F.max(F.col("__pos") - low)
    return matched.groupBy(*group, "prob").agg((low_v + (high_v - low_v) * frac).alias("value"))


def weighted_quantiles(df: DataFrame, group: str | Sequence[str], x: str, probs: Sequence[float], w: str = "weight") -> DataFrame:
    """(group, prob, value): the smallest value up to which a share `prob` of a group's weight lies.

    Weights are measures here and not counts. They are summed as decimals of nine places, so that no
    order of additions moves a quantile. As in `exact_quantiles` a group of any size is cut into
    cells by value, and only the cells that hold a wanted share are ordered.
    """
    group = _names(group)
    weight = F.col(w).cast("decimal(20, 9)")
    values = df.filter(F.col(x).isNotNull() & (weight > 0)).select(*group, F.col(x).cast("double").alias("__v"), weight.alias("__w"))
    sums = values.groupBy(*group, "__v").agg(F.sum("__w").alias("__w"))
    bucketed = cut_lineage(sums.repartitionByRange(*group, "__v").withColumn("__b", F.spark_partition_id()))
    cells = bucketed.groupBy(*group, "__b").agg(F.sum("__w").alias("__n"))
    upto = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cells.select(*group, "__b", "__n", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(*group)).alias("__total"))
    share_of = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.lit(str(p)).cast("decimal(10, 9)").alias("exact")) for p in probs]))
    wanted = ranked.withColumn("__p", share_of).select(*group, "__b", "__n", "__before", "__p.prob", (F.col("__p.exact") * F.col("__total")).alias("__need"))
    wanted = wanted.filter((F.col("__before") < F.col("__need")) & (F.col("__need") <= F.col("__before") + F.col("__n")))
    inside = Window.partitionBy(*group, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    chosen = wanted.select(*group, "__b").distinct()
    placed = join_null_safe(bucketed, chosen, [*group, "__b"], "left_semi").withColumn("__end", F.sum("__w").over(inside))
    matched = join_null_safe(wanted, placed, [*group, "__b"], "inner").filter(F.col("__before") + F.col("__end") >= F.col("__need"))
    return matched.groupBy(*group, "prob").agg(F.min("__v").alias("value"))


def bandwidths(df: DataFrame, group: str | Sequence[str], x: str, adjust: float = 1.0, w: str = "weight") -> DataFrame:
    """(group, n, bandwidth): a kernel width per group from its data.

    0.9 times the smaller of the weighted deviation and the weighted quartile distance over 1.34,
    by the fifth root of the number of values, times `adjust`. Where that is zero the deviation
    stands in, and one where that is zero too.
    """
    group = _names(group)
    used = df.filter(F.col(x).isNotNull() & (F.col(w).cast("decimal(20, 9)") > 0))
    weight, value = F.col(w).cast("double"), F.col(x).cast("double")
    sums = used.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("__t"), F.sum(weight * value).alias("__s"), F.sum(weight * value * value).alias("__q"))
    ends = weighted_quantiles(used, group, x, [0.25, 0.75], w)
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("value")))
    quartiles = ends.groupBy(*group).agg((at(0.75) - at(0.25)).alias("__iqr"))
    mean = F.col("__s") / F.col("__t")
    deviation = F.sqrt(F.greatest(F.round(F.col("__q") / F.col("__t") - mean * mean, 9), F.lit(0.0)))
    narrow = F.least(deviation, F.col("__iqr") / 1.34)
    width = F.when(narrow > 0, narrow).when(deviation > 0, deviation).otherwise(1.0)
    joined = join_null_safe(sums, quartiles, group, "inner")
    return joined.select(*group, "n", (0.9 * width * F.pow(F.col("n").cast("double"), -0.2) * adjust).alias("bandwidth"))


def adaptive_density(
    df: DataFrame, group: str | Sequence[str], x: str, lo: float, hi: float, points: int = 512, adjust: float = 1.0, w: str = "weight", name: str = "density"
) -> DataFrame:
    """Gaussian kernel density per group on equally spaced points, its bandwidth taken from the group's data.

    (group, point, x_at, bandwidth, density). Binned as in `weighted_density`; values farther outside
    [lo, hi] than it is wide count in the total only.
    """
    group = _names(group)
    step = (hi - lo) / (points - 1)
    place = (F.col(x).cast("double") - F.lit(lo)) / F.lit(step)
    below = F.greatest(F.least(F.floor(place), F.lit(2 * points)), F.lit(-points - 2)).cast("long")
    part = F.least(F.greatest(place - below, F.lit(0.0)), F.lit(1.0))
    weight = F.col(w).cast("double")
    halves = F.array(F.struct(below.alias("bin"), (weight * (1 - part)).alias("w")), F.struct((below + 1).alias("bin"), (weight * part).alias("w")))
    known = df.filter(F.col(x).isNotNull() & (F.col(w).cast("decimal(20, 9)") > 0))
    bins = known.select(*group, F.explode(halves).alias("__h")).groupBy(*group, F.col("__h.bin").alias("__bin")).agg(F.sum("__h.w").alias("__w"))
    bins = join_null_safe(bins, bandwidths(df, group, x, adjust, w).drop("n"), group, "inner")
    grid = explode_grid(bins, "point", 0, points - 1)
    z = (F.col("point") - F.col("__bin")) * F.lit(step) / F.col("bandwidth")
    near = (F.col("__bin") >= -points) & (F.col("__bin") <= 2 * points - 1)
    sums = grid.groupBy(*group, "point", "bandwidth").agg(sum_or_zero(F.when(near, F.col("__w") * F.exp(-z * z / 2))).alias("__k"), F.sum("__w").alias("__total"))
    scale = F.col("bandwidth") * F.lit((2 * 3.141592653589793) ** 0.5)
    at = F.lit(lo) + F.col("point") * F.lit(step)
    return sums.select(*group, "point", at.alias("x_at"), "bandwidth", share(F.col("__k"), F.col("__total") * scale).alias(name))


def sorted_output(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Ascending order on several keys, for the final output only."""
    return df.orderBy(*cols)


def weights_over(df: DataFrame, bound: float, sample: Column, w: str = "weight") -> DataFrame:
    """Mean weight of all rows and of a sample, and how many weights of each exceed a bound."""
    over = F.col(w) > bound
    return df.agg(
        F.avg(w).alias("mean_all"),
        F.avg(F.when(sample, F.col(w))).alias("mean_sample"),
        F.count_if(over).alias("n_over"),
        F.count_if(sample & over).alias("n_over_sample"),
    )


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """The first k rows by an order: each task keeps k, and k rows per task meet."""
    return df.orderBy(*order).limit(k)
