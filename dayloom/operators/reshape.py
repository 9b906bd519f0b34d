"""Wide and long forms, grids and unions."""

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.functions.semantics import join_null_safe


def slot_columns(df: DataFrame, prefix: str) -> dict[int, str]:
    """Slot number -> column for the columns named `prefix` plus digits.

    Look-alike names such as pricrech do not match.
    """
    found = {}
    for c in df.columns:
        m = re.fullmatch(re.escape(prefix) + r"(\d+)", c)
        if m:
            found[int(m.group(1))] = c
    return dict(sorted(found.items()))


def unpivot_slots(
    df: DataFrame, prefix: str, value: str, id: str = "diaryid", slot: str = "slot", carry: Sequence[str] = ()
) -> DataFrame:
    """prefix1..prefixN -> one row per slot, missing values kept; a map-side explode."""
    return unpivot_measures(df, {value: prefix}, id, slot, carry)


def unpivot_measures(
    df: DataFrame,
    prefixes: Sequence[str] | Mapping[str, str],
    id: str = "diaryid",
    slot: str = "slot",
    carry: Sequence[str] = (),
) -> DataFrame:
    """All measures at once: one row per slot, one column per measure, in a single pass.

    Each row emits an array of one struct per slot, so nothing is shuffled and no pivot is
    needed to put the measures side by side again.
    """
    named = prefixes if isinstance(prefixes, Mapping) else {p: p for p in prefixes}
    columns = {name: slot_columns(df, prefix) for name, prefix in named.items()}
    slots = sorted({s for found in columns.values() for s in found})
    cells = []
    for s in slots:
        fields = [F.lit(s).alias(slot)]
        for name, found in columns.items():
            cell = F.col(found[s]) if s in found else F.lit(None).cast(df.schema[next(iter(found.values()))].dataType)
            fields.append(cell.alias(name))
        cells.append(F.struct(*fields))
    return df.select(id, *carry, F.explode(F.array(*cells)).alias("__cell")).select(
        id, *carry, *[F.col(f"__cell.{f}").alias(f) for f in [slot, *named]]
    )


def unpivot(df: DataFrame, cols: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """Wide measures -> (name, value) rows, missing values kept."""
    keep = [c for c in df.columns if c not in set(cols)]
    return df.unpivot(keep, list(cols), name, value)


def pivot_wide(
    df: DataFrame, id: str | Sequence[str], names: str, values: str, levels: Sequence | Mapping, fill=None
) -> DataFrame:
    """Long -> wide with given levels; a level may be renamed by passing {level: column}.

    Written as conditional maxima, which combine map-side and need no extra job for the levels.
    An (id, name) cell holds one value.
    """
    keys = [id] if isinstance(id, str) else list(id)
    named = levels if isinstance(levels, Mapping) else {v: str(v) for v in levels}
    cells = []
    for level, column in named.items():
        match = F.col(names).eqNullSafe(F.lit(level))
        cells.append(F.max(F.when(match, F.col(values))).alias(column))
    out = df.groupBy(*keys).agg(*cells)
    return out if fill is None else out.fillna(fill, subset=list(named.values()))


def pivot_fill(
    df: DataFrame, id: str | Sequence[str], names: str, values: str, levels: Sequence | Mapping, fill=0
) -> DataFrame:
    """Long -> wide where absent cells become `fill`."""
    return pivot_wide(df, id, names, values, levels, fill)


#: Parts that the rows of a grid are dealt into before they meet the values of its next column.
GRID_SALTS = 16


def complete_grid(
    df: DataFrame,
    cols: Sequence[str],
    fill: Mapping[str, object],
    levels: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """Every combination of the observed values of `cols`; new rows get `fill`.

    `df` is an aggregated table with one row per combination. Values given in `levels` are
    exploded next to the grid. Observed values stay a distributed table: they meet the grid on a
    salt that every grid row takes and every value has once, so no value list is collected and
    no join without a key is planned. NULL is a value of its own.
    """
    levels = dict(levels or {})
    grid = df.select(cols[0]).distinct()
    for c in cols[1:]:
        if c in levels:
            grid = grid.withColumn(c, F.explode(F.array(*[F.lit(v) for v in levels[c]])))
            continue
        salts = F.explode(F.sequence(F.lit(0), F.lit(GRID_SALTS - 1)))
        values = df.select(c).distinct().withColumn("__salt", salts)
        spread = grid.withColumn("__salt", F.pmod(F.xxhash64(*grid.columns), F.lit(GRID_SALTS)).cast("int"))
        grid = spread.join(values, "__salt").drop("__salt")
    filled = join_null_safe(grid, df, cols, "left")
    return filled.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def split_name(df: DataFrame, col: str, into: tuple[str, str], sep: str = "_X") -> DataFrame:
    """One name column -> two, at the first separator."""
    parts = F.split(F.col(col), re.escape(sep), 2)
    return df.withColumns({into[0]: parts.getItem(0), into[1]: F.get(parts, F.lit(1))}).drop(
        *({col} - set(into))
    )


def drop_null_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Keep only the columns without any missing value; one aggregate row decides."""
    cols = list(cols or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if counts[c] > 0])


def explode_grid(df: DataFrame, name: str, start: int, stop: int, step: int = 1) -> DataFrame:
    """Repeat every row for each value of an integer range."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(start), F.lit(stop), F.lit(step))))


def union_by_name(tables: Mapping[str, DataFrame] | Sequence[DataFrame], tag: str | None = None) -> DataFrame:
    """Stack tables by column name, filling missing columns; optionally tag the source."""
    if isinstance(tables, Mapping):
        frames = [df.withColumn(tag, F.lit(k)) if tag else df for k, df in tables.items()]
    else:
        frames = list(tables)
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def with_level_order(df: DataFrame, col: str, levels: Sequence[str], drop_unused: bool = False) -> DataFrame:
    """Add `<col>_ord`, the place of the value in `levels`; optionally renumber without gaps."""
    from dayloom.functions.recode import level_position

    df = df.withColumn(f"{col}_ord", level_position(col, levels))
    if not drop_unused:
        return df
    used = df.agg(F.sort_array(F.collect_set(f"{col}_ord")).alias("u"))
    position = F.array_position(used.scalar(), F.col(f"{col}_ord"))
    return df.withColumn(f"{col}_ord", F.when(position > 0, position.cast("int")))


def reorder_levels(df: DataFrame, col: str, by: Column, reverse: bool = False) -> DataFrame:
    """Level order from an aggregate: (col, order value, `<col>_ord`), one row per level.

    `by` is an aggregate such as F.avg("x"). Levels without an order value come last; a missing
    level has no place. Only the levels meet in the ranking window.
    """
    from pyspark.sql import Window

    per_level = df.groupBy(col).agg(by.alias("order_value"))
    key = F.col("order_value").desc_nulls_last() if reverse else F.col("order_value").asc_nulls_last()
    known = F.col(col).isNotNull()
    return per_level.withColumn(f"{col}_ord", F.when(known, F.dense_rank().over(Window.partitionBy(known).orderBy(key))))


# ---- columns by name, place and kind --------------------------------------------------------

NUMERIC_KINDS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def columns_between(df: DataFrame, first: str, last: str) -> list[str]:
    """The columns from `first` to `last` as the table has them."""
    names = df.columns
    a, b = names.index(first), names.index(last)
    return names[a : b + 1] if a <= b else names[b : a + 1][::-1]


def columns_matching(df: DataFrame, pattern: str = "", kind: str | None = None, but: Sequence[str] = ()) -> list[str]:
    """Columns whose name has a match of a regular expression, of a kind (`numeric` or a type's name), and not among `but`."""

    def fits(name: str, typed: str) -> bool:
        plain = typed.split("(")[0]
        return bool(re.search(pattern, name)) and name not in but and (kind is None or (plain in NUMERIC_KINDS if kind == "numeric" else plain == kind))

    return [name for name, typed in df.dtypes if fits(name, typed)]


def rename_with(df: DataFrame, rule: Mapping[str, str] | tuple[str, str], cols: Sequence[str] | None = None) -> DataFrame:
    """Rename columns by a mapping, or by (pattern, replacement) of a regular expression; others keep their names.

    Two columns must not get the same name.
    """
    cols = list(df.columns if cols is None else cols)
    new = {c: rule.get(c, c) for c in cols} if isinstance(rule, Mapping) else {c: re.sub(rule[0], rule[1], c) for c in cols}
    names = [new.get(c, c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("two columns would have the same name")
    return df.toDF(*names)


def add_affix(df: DataFrame, prefix: str = "", suffix: str = "", cols: Sequence[str] | None = None) -> DataFrame:
    """Put text before and after the names of columns."""
    cols = list(df.columns if cols is None else cols)
    return rename_with(df, {c: f"{prefix}{c}{suffix}" for c in cols}, cols)
