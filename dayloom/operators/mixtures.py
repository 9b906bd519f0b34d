"""Models whose likelihood has more than a mean: counts with a shape and extra zeros, and heavy tails.

All are fitted on summed covariate cells. Counts are few different numbers, so (covariates, count)
cells say everything and don't grow with the data: they meet in one small solve. For heavy tails
the outcome may be continuous; there every round is one pass that sums with latent weights per
covariate cell, and only a row per cell comes to the driver.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.runtime import cut_lineage

#: Linear predictors on a log or logit scale stay inside this range: a shape beyond it is a Poisson model.
_FAR = 12.0


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for positive numbers: eight steps up, then the asymptotic series."""
    x, down = np.asarray(x, float), 0.0
    for _ in range(8):
        down, x = down - np.log(x), x + 1
    f = 1 / (x * x)
    return down + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - f * (1 / 360 - f / 1260)) / x


def digamma(x: np.ndarray) -> np.ndarray:
    x, down = np.asarray(x, float), 0.0
    for _ in range(8):
        down, x = down - 1 / x, x + 1
    f = 1 / (x * x)
    return down + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def trigamma(x: np.ndarray) -> np.ndarray:
    x, up = np.asarray(x, float), 0.0
    for _ in range(8):
        up, x = up + 1 / (x * x), x + 1
    f = 1 / (x * x)
    return up + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f / 42))


def design(cells: pd.DataFrame, terms: Sequence[str]) -> tuple[list[tuple[str, str | None]], np.ndarray]:
    """Names (term, level) and columns: a constant, then numbers as they are and levels against the first in order."""
    names: list[tuple[str, str | None]] = [("(Intercept)", None)]
    columns = [np.ones(len(cells))]
    for t in terms:
        if pd.api.types.is_numeric_dtype(cells[t]):
            names.append((t, None))
            columns.append(cells[t].to_numpy(float))
        else:
            for level in sorted(cells[t].unique())[1:]:
                names.append((t, level))
                columns.append((cells[t] == level).to_numpy(float))
    return names, np.column_stack(columns)


def _step(x: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """The scoring step of a linear predictor from first derivatives and expected curvatures per cell."""
    root = np.sqrt(np.maximum(curve, 1e-12))
    return np.linalg.lstsq(x * root[:, None], slope / root, rcond=None)[0]


def _climb(b: np.ndarray, step: np.ndarray, value, start: float) -> tuple[np.ndarray, float]:
    """Go along a step, halved until the value doesn't fall."""
    size = 1.0
    while size > 1e-9:
        new = value(b + size * step)
        if new >= start - 1e-12 * abs(start):
            return b + size * step, new
        size /= 2
    return b, start


class CountModel:
    """Zero-inflated negative binomial: log mean, log shape and logit of the extra zeros are linear.

    Without shape terms (None) counts are Poisson; without zero terms (None) no zeros are extra.
    """

    def __init__(self, y: np.ndarray, w: np.ndarray, mean: np.ndarray, shape: np.ndarray | None, zero: np.ndarray | None):
        self.y, self.w, self.x, self.s, self.z = y, w, mean, shape, zero
        overall = max(float((w * y).sum() / w.sum()), 1e-6)
        self.b = np.zeros(mean.shape[1])
        self.b[0] = np.log(overall)
        self.g = None if shape is None else np.zeros(shape.shape[1])
        self.h = None if zero is None else np.zeros(zero.shape[1])
        if zero is not None:
            zeros = float((w * (y == 0)).sum() / w.sum())
            extra = np.clip((zeros - np.exp(-overall)) / (1 - np.exp(-overall) + 1e-9), 0.05, 0.95)
            self.h[0] = np.log(extra / (1 - extra))

    def _mu(self, b: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(self.x @ b, -_FAR, _FAR))

    def _shape(self, g: np.ndarray | None) -> np.ndarray | None:
        return None if g is None else np.exp(np.clip(self.s @ g, -_FAR, _FAR))

    def _count_logs(self, b: np.ndarray, g: np.ndarray | None) -> np.ndarray:
        mu, s, y = self._mu(b), self._shape(g), self.y
        if s is None:
            return y * np.log(mu) - mu - log_gamma(y + 1)
        return log_gamma(y + s) - log_gamma(s) - log_gamma(y + 1) + s * np.log(s / (s + mu)) + y * np.log(mu / (s + mu))

    def extra(self) -> np.ndarray:
        """The chance of an extra zero per cell."""
        return np.zeros(len(self.y)) if self.h is None else 1 / (1 + np.exp(-np.clip(self.z @ self.h, -30, 30)))

    def likelihood(self) -> float:
        logs, p = self._count_logs(self.b, self.g), self.extra()
        return float((self.w * np.where(self.y == 0, np.log(p + (1 - p) * np.exp(logs)), np.log1p(-p) + logs)).sum())

    def latent(self) -> np.ndarray:
        """E step: how much of each cell is an extra zero."""
        p = self.extra()
        return np.where(self.y == 0, p / (p + (1 - p) * np.exp(self._count_logs(self.b, self.g))), 0.0)

    def _fit_count(self, w: np.ndarray) -> None:
        value = lambda b, g: float((w * self._count_logs(b, g)).sum())
        now, y = value(self.b, self.g), self.y
        mu, s = self._mu(self.b), self._shape(self.g)
        pull = 1.0 if s is None else s / (s + mu)
        self.b, now = _climb(self.b, _step(self.x, w * (y - mu) * pull, w * mu * pull), lambda b: value(b, self.g), now)
        if s is not None:
            mu = self._mu(self.b)
            first = digamma(y + s) - digamma(s) + np.log(s / (s + mu)) + 1 - (s + y) / (s + mu)
            second = trigamma(y + s) - trigamma(s) + 1 / s - 1 / (s + mu) - (mu - y) / (s + mu) ** 2
            # The curvature of single cells may have the wrong sign; that of a group of them rarely has.
            curve = -(s * first + s * s * second)
            curve = np.where(curve > 0, curve, np.abs(s * first) + 1e-6)
            self.g, now = _climb(self.g, _step(self.s, w * s * first, w * curve), lambda g: value(self.b, g), now)

    def fit(self, rounds: int = 2000, digits: float = 1e-11) -> bool:
        """EM; each round is an E step and scoring steps of every part. Whether it settled."""
        before = self.likelihood()
        for _ in range(rounds):
            part = self.latent() if self.h is not None else np.zeros(len(self.y))
            if self.h is not None:
                p = self.extra()
                own = lambda h: float((self.w * (part * (self.z @ h) - np.logaddexp(0, self.z @ h))).sum())  # noqa: E731, B023
                self.h, _ = _climb(self.h, _step(self.z, self.w * (part - p), self.w * p * (1 - p)), own, own(self.h))
            self._fit_count(self.w * (1 - part))
            now = self.likelihood()
            if now - before < digits * (abs(before) + 1):
                return True
            before = now
        return False


def count_cells(df: DataFrame, y: str, terms: Sequence[str], w: str | None = "weight") -> DataFrame:
    """(terms, y, weight): rows summed to cells of equal covariates and counts; incomplete rows and those without weight are left out."""
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    rows = df.select(*terms, F.col(y).cast("double").alias("__y"), weight.alias("__w")).dropna().filter("__w > 0")
    return rows.groupBy(*terms, "__y").agg(F.sum("__w").alias("__w"))


def count_fit(
    df: DataFrame, y: str, mean: Sequence[str], shape: Sequence[str] | None = (), zero: Sequence[str] | None = None, w: str | None = "weight"
) -> DataFrame:
    """Coefficients of a count model: (part, term, level, coefficient, likelihood, converged).

    The parts are `mu` (log mean), `shape` (log shape of the negative binomial; None: Poisson) and
    `zi` (logit of an extra zero; None: none), each with a constant and its own covariates, which
    are categories or numbers of few values. A term's level is compared with the first in order.
    Weights count rows. No complete rows give no coefficients.
    """
    parts = {"mu": mean, "shape": shape, "zi": zero}
    terms = list(dict.fromkeys(t for p in parts.values() for t in p or ()))
    cells = count_cells(df, y, terms, w).withColumn("__all", F.lit(0))

    def solve(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values([*terms, "__y"])
        made = {part: design(cell, p) for part, p in parts.items() if p is not None}
        x = {part: columns for part, (_, columns) in made.items()}
        model = CountModel(cell["__y"].to_numpy(), cell["__w"].to_numpy(), x["mu"], x.get("shape"), x.get("zi"))
        settled = model.fit()
        value = {"mu": model.b, "shape": model.g, "zi": model.h}
        rows = [(part, t, level, float(c)) for part, (names, _) in made.items() for (t, level), c in zip(names, value[part], strict=True)]
        return pd.DataFrame(rows, columns=["part", "term", "level", "coefficient"]).assign(likelihood=model.likelihood(), converged=settled)

    return cells.groupBy("__all").applyInPandas(solve, "part string, term string, level string, coefficient double, likelihood double, converged boolean")


def student_fit(
    df: DataFrame, y: str, mean: Sequence[str], sigma: Sequence[str] = (), w: str | None = "weight", rounds: int = 100, digits: float = 1e-6
) -> DataFrame:
    """Coefficients of a Student-t model: (part, term, level, coefficient, converged). Runs jobs.

    The parts are `mu`, `sigma` (on the log scale) and `nu` (the degrees of freedom, at most 200). A
    t variable is a normal one whose precision is multiplied by a latent weight, and outliers are
    those whose expected weight is small. A round gives every distinct (covariates, y) its expected
    weight and sums per covariate cell in one pass; the cells' scores, with the information that a t
    variable has, give the next step, halved where the likelihood would fall.
    """
    spark = df.sparkSession
    terms = list(dict.fromkeys([*mean, *sigma]))
    cells = cut_lineage(count_cells(df, y, terms, w))
    start = cells.groupBy(*terms).agg(F.sum("__w").alias("w"), F.sum(F.col("__w") * F.col("__y")).alias("wy"), F.sum(F.col("__w") * F.col("__y") ** 2).alias("wyy"))
    kinds = "part string, term string, level string, coefficient double, converged boolean"
    if cells.isEmpty():
        return spark.createDataFrame([], kinds)
    small = start.toPandas().sort_values(terms).reset_index(drop=True) if terms else start.toPandas()
    (mean_names, x), (sigma_names, s) = design(small, mean), design(small, sigma)
    total = small["w"].to_numpy()
    p, q = x.shape[1], s.shape[1]
    root = np.sqrt(total)
    b = np.linalg.lstsq(x * root[:, None], small["wy"].to_numpy() / total * root, rcond=None)[0]
    variance = (small["wyy"].sum() - 2 * (x @ b) @ small["wy"] + total @ (x @ b) ** 2) / total.sum()
    low, high = np.log(0.2), np.log(200.0)

    def sums(theta: np.ndarray) -> tuple[float, pd.DataFrame]:
        """The likelihood, and per covariate cell the sums of latent weight times gap, squared gap, and the tails' logs."""
        nu, scale = float(np.exp(theta[-1])), np.exp(s @ theta[p : p + q])
        # A row per covariate cell goes out, a row per covariate cell comes back.
        facts = spark.createDataFrame(small[terms].assign(__mu=x @ theta[:p], __sigma=scale)) if terms else None
        rows = cells.join(facts, terms) if terms else cells.withColumn("__mu", F.lit(float(theta[0]))).withColumn("__sigma", F.lit(float(scale[0])))
        gap = (F.col("__y") - F.col("__mu")) / F.col("__sigma")
        latent = (nu + 1) / (nu + gap * gap)
        out = rows.groupBy(*terms).agg(
            F.sum(F.col("__w") * latent * gap / F.col("__sigma")).alias("pull"), F.sum(F.col("__w") * latent * gap * gap).alias("square"),
            F.sum(F.col("__w") * F.log1p(gap * gap / nu)).alias("tail"),
        ).toPandas()
        out = small[terms].merge(out, on=terms, how="left") if terms else out
        one = log_gamma(np.array([(nu + 1) / 2])) - log_gamma(np.array([nu / 2])) - 0.5 * np.log(nu * np.pi)
        return float(total.sum() * one[0] - total @ np.log(scale) - (nu + 1) / 2 * out["tail"].sum()), out

    theta = np.concatenate([b, np.zeros(q), [np.log(10.0)]])
    theta[p] = 0.5 * np.log(max(variance, 1e-12))
    here, e = sums(theta)
    settled = False
    for _ in range(rounds):
        nu, scale = np.exp(theta[-1]), np.exp(s @ theta[p : p + q])
        half = np.array([nu / 2, (nu + 1) / 2])
        slope = np.concatenate([
            x.T @ e["pull"].to_numpy(), s.T @ (e["square"].to_numpy() - total),
            [nu / 2 * (total.sum() * (digamma(half[1:])[0] - digamma(half[:1])[0] - 1 / nu) - e["tail"].sum() + e["square"].sum() / nu)],
        ])
        info = np.zeros((p + q + 1, p + q + 1))
        info[:p, :p] = (x * (total / scale**2)[:, None]).T @ x * (nu + 1) / (nu + 3)
        info[p : p + q, p : p + q] = (s * total[:, None]).T @ s * 2 * nu / (nu + 3)
        info[p : p + q, -1] = info[-1, p : p + q] = -s.T @ total * 2 * nu / ((nu + 1) * (nu + 3))
        known = trigamma(half)
        info[-1, -1] = max(total.sum() * nu**2 * ((known[0] - known[1]) / 4 - (nu + 5) / (2 * nu * (nu + 1) * (nu + 3))), 1e-12)
        # At its bound, with the likelihood rising beyond it, the number of degrees of freedom stays.
        free = np.ones(len(theta), bool)
        free[-1] = not ((theta[-1] >= high and slope[-1] > 0) or (theta[-1] <= low and slope[-1] < 0))
        step = np.zeros(len(theta))
        step[free] = np.linalg.lstsq(info[np.ix_(free, free)], slope[free], rcond=None)[0]
        step[-1] = np.clip(step[-1], -1.5, 1.5)
        size = 1.0
        while True:
            new = theta + size * step
            new[-1] = np.clip(new[-1], low, high)
            there, after = sums(new)
            if there >= here - 1e-10 * abs(here) or size < 1e-4:
                break
            size /= 4
        moved = np.abs(new - theta).max()
        theta, here, e = new, there, after
        if moved < digits:
            settled = True
            break
    out = [("mu", t, level, float(c)) for (t, level), c in zip(mean_names, theta[:p], strict=True)]
    out += [("sigma", t, level, float(c)) for (t, level), c in zip(sigma_names, theta[p : p + q], strict=True)]
    out.append(("nu", "(Intercept)", None, float(np.exp(theta[-1]))))
    return spark.createDataFrame([(*r, settled) for r in out], kinds)
