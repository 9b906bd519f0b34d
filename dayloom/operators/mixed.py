"""Linear models on mergeable cross-products: adjusted effects per draw, and partial pooling beside covariates.

A cell is a combination of categories. What a linear model needs from its rows are the sums of
weight, of weighted numbers and outcomes, and of their products: they add up over rows, tasks and
persons, so the number of cells, and not of rows, is what a solve sees.
"""

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.operators.effects import spread_out, uniform


def _products(numeric: Sequence[str]) -> list[tuple[str, str]]:
    """Pairs whose products are summed: of a constant, the numbers and the outcome."""
    return list(combinations_with_replacement(["__1", *numeric, "__y"], 2))


def _complete(df: DataFrame, y: str, categories: Sequence[str], numeric: Sequence[str], w: str | None, *more: str) -> DataFrame:
    """Complete rows with positive weight: categories as text, numbers and outcome as doubles."""
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    columns = [*[F.col(c).cast("string").alias(c) for c in categories], *[F.col(c).cast("double").alias(c) for c in numeric]]
    rows = df.select(*more, *columns, weight.alias("__w"), F.col(y).cast("double").alias("__y")).dropna().filter("__w > 0")
    return rows.withColumn("__1", F.lit(1.0))


def cross_products(rows: DataFrame, keys: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """(keys, __n, sums of products): the accumulator of a linear model per cell, summed map-side."""
    sums = [F.sum(F.col("__w") * F.col(a) * F.col(b)).alias(f"__s{i}") for i, (a, b) in enumerate(_products(numeric))]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *sums)


class Normal:
    """X'WX, X'Wy and y'Wy of cells, for a constant, the categories' levels and the numbers.

    With `every` a category has a column for each of its levels, else for all but the first in order.
    """

    def __init__(self, cells: pd.DataFrame, categories: Sequence[str], numeric: Sequence[str], every: Sequence[str] = ()):
        order = {name: i for i, name in enumerate(["__1", *numeric, "__y"])}
        moments = np.zeros((len(cells), len(order), len(order)))
        for i, (a, b) in enumerate(_products(numeric)):
            moments[:, order[a], order[b]] = moments[:, order[b], order[a]] = cells[f"__s{i}"].to_numpy()
        self.names: list[tuple[str, str | None]] = [("(Intercept)", None)]
        columns = [np.ones(len(cells))]
        for c in [*categories, *every]:
            for level in sorted(cells[c].unique())[0 if c in every else 1 :]:
                self.names.append((c, level))
                columns.append((cells[c] == level).to_numpy(float))
        d = np.column_stack(columns)
        k, m = d.shape[1], len(numeric)
        numbers = slice(1, 1 + m)
        xx = np.zeros((k + m, k + m))
        xx[:k, :k] = (d * moments[:, 0, 0][:, None]).T @ d
        xx[:k, k:] = d.T @ moments[:, 0, numbers]
        xx[k:, :k] = xx[:k, k:].T
        xx[k:, k:] = moments[:, numbers, numbers].sum(axis=0)
        self.names += [(c, None) for c in numeric]
        self.xx, self.xy = xx, np.concatenate([d.T @ moments[:, 0, -1], moments[:, numbers, -1].sum(axis=0)])
        self.yy, self.n = float(moments[:, -1, -1].sum()), int(cells["__n"].sum())


def adjusted_slopes(
    df: DataFrame, y: str, categories: Sequence[str] = (), numeric: Sequence[str] = (), n_draws: int = 200, w: str | None = "weight", unit: str = "mainid"
) -> DataFrame:
    """Reweighted replicates of a linear model with categories and numbers: (draw, term, level, value).

    A level's value is its difference to the category's first level, a number's its slope, each
    adjusted for all others. Products are summed per person and cell, then over persons per draw,
    map-side; a draw's cells meet in one small solve. A covariate that the others determine has no
    value. Rows with anything missing are left out.
    """
    rows = _complete(df, y, categories, numeric, w, unit)
    people = spread_out(cross_products(rows, [unit, *categories], numeric))
    drawn = people.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws)))).withColumn("__e", -F.ln(uniform(unit, "draw")))
    sums = [F.sum(F.col("__e") * F.col(f"__s{i}")).alias(f"__s{i}") for i in range(len(_products(numeric)))]
    cells = drawn.groupBy("draw", *categories).agg(F.sum("__n").alias("__n"), *sums)

    def solve(cell: pd.DataFrame) -> pd.DataFrame:
        model = Normal(cell, categories, numeric)
        # Columns on one scale, so that "determined by the others" doesn't depend on units.
        scale = 1 / np.sqrt(np.maximum(np.diag(model.xx), 1e-300))
        scaled = model.xx * np.outer(scale, scale)
        values = np.linalg.lstsq(scaled, model.xy * scale, rcond=1e-11)[0] * scale
        kernel = np.linalg.svd(scaled)
        loose = (np.abs(kernel.Vh[kernel.S < 1e-11 * kernel.S.max()]) > 1e-6).any(axis=0) if (kernel.S < 1e-11 * kernel.S.max()).any() else np.zeros(len(values), bool)
        values = np.where(loose, np.nan, values)
        return pd.DataFrame({"draw": cell["draw"].iloc[0], "term": [t for t, _ in model.names], "level": [v for _, v in model.names], "value": values})

    out = cells.groupBy("draw").applyInPandas(solve, "draw int, term string, level string, value double")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def pooled_effects(
    df: DataFrame, y: str, fixed: Sequence[str] = (), numeric: Sequence[str] = (), pooled: Sequence[str] = (), w: str | None = "weight", rounds: int = 500
) -> DataFrame:
    """Partial pooling beside covariates: (part, term, level, value, converged).

    y = constant + fixed effects + slopes of numbers + a deviation of every level of each pooled
    grouping + noise of variance sigma^2 / weight. The deviations of a grouping share a variance, so
    small or odd levels are drawn to zero. Parts are `fixed`, `pooled` (deviations) and `sd` (of
    each grouping and of the noise). Variances are those of restricted likelihood: in every round the
    mixed-model equations of the cells' cross-products are solved, and a grouping's variance is its
    squared deviations over the number of levels that its data determine. The equations have a row
    per level, so groupings of some thousands of levels are what it is made for.
    """
    if not pooled:
        raise ValueError("no grouping is pooled")
    keys = list(dict.fromkeys([*fixed, *pooled]))
    cells = cross_products(_complete(df, y, keys, numeric, w), keys, numeric).withColumn("__all", F.lit(0))

    def solve(cell: pd.DataFrame) -> pd.DataFrame:
        # The pooled columns of a grouping are all its levels, moved behind the others.
        model = Normal(cell.sort_values(keys), fixed, numeric, pooled)
        # A grouping can be fixed and pooled in different terms, so places are counted and not looked up.
        n_fixed = 1 + sum(cell[c].nunique() - 1 for c in fixed)
        counts = [cell[c].nunique() for c in pooled]
        first = [*range(n_fixed), *range(n_fixed + sum(counts), len(model.names))]
        order = [*first, *range(n_fixed, n_fixed + sum(counts))]
        xx, xy, names = model.xx[np.ix_(order, order)], model.xy[order], [model.names[i] for i in order]
        p = len(first)
        starts = p + np.concatenate([[0], np.cumsum(counts)])
        groups = [slice(int(a), int(b)) for a, b in zip(starts, starts[1:], strict=False)]
        base = max(model.yy - xy[:p] @ np.linalg.lstsq(xx[:p, :p], xy[:p], rcond=None)[0], 1e-12) / max(model.n - p, 1)
        noise, spread, settled = base / 2, np.full(len(groups), base * model.n / max(xx[0, 0], 1e-300) / 2), False
        for _ in range(rounds):
            ridge = np.zeros(len(names))
            for g, t in zip(groups, spread, strict=True):
                ridge[g] = noise / max(t, 1e-300)
            inverse = np.linalg.pinv(xx + np.diag(ridge), hermitian=True)
            theta = inverse @ xy
            # Levels that the data determine, and not the pooling.
            own = np.array([g.stop - g.start - ridge[g.start] * np.trace(inverse[g, g]) for g in groups])
            new = np.array([theta[g] @ theta[g] for g in groups]) / np.maximum(own, 1e-12)
            left = max((model.yy - theta @ xy) / max(model.n - p, 1), 1e-15)
            change = max(abs(left / noise - 1), np.abs(np.sqrt(new) - np.sqrt(spread)).max() / np.sqrt(left + new.max()))
            noise, spread = left, new
            if change < 1e-9:
                settled = True
                break
        rows = [("fixed", t, level, float(v)) for (t, level), v in zip(names[:p], theta[:p], strict=True)]
        rows += [("pooled", t, level, float(v)) for (t, level), v in zip(names[p:], theta[p:], strict=True)]
        rows += [("sd", c, None, float(np.sqrt(t))) for c, t in zip(pooled, spread, strict=True)] + [("sd", "(Noise)", None, float(np.sqrt(noise)))]
        return pd.DataFrame(rows, columns=["part", "term", "level", "value"]).assign(converged=settled)

    return cells.groupBy("__all").applyInPandas(solve, "part string, term string, level string, value double, converged boolean")
