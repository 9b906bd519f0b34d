"""Predictive draws from fitted distributions, made by hashes so that every run gives the same."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.functions.semantics import join_group_facts
from dayloom.operators.effects import spread_out, uniform

#: Tries of the rejection sampler: one is refused less than once in twenty, all of them once in 10^8.
TRIES = 6


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _uniform_of(digest: Column, i: int) -> Column:
    """The i-th reproducible number in (0, 1) of a digest."""
    return (F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") + 0.5) / 4294967296.0


def gamma_draw(shape: Column, unit: str, draw: str | Column) -> Column:
    """A gamma variable of scale one, for any positive shape.

    A cubed normal number is kept or refused by its density, the first kept of TRIES counts; should
    all be refused, the distribution's middle stands in. Shapes below one are drawn one higher and
    scaled down by a power of another number. A try is made only where those before it are refused.
    """
    unit_, draw_ = F.col(unit), F.col(draw) if isinstance(draw, str) else draw
    high = F.when(shape < 1, shape + 1).otherwise(shape)
    d = high - 1.0 / 3.0
    c = 1.0 / F.sqrt(9.0 * d)

    def attempt(i: Column) -> Column:
        tag = F.concat(F.lit("g"), draw_.cast("string"), F.lit("."), i.cast("string"))
        return _let(F.md5(F.concat_ws(":", unit_.cast("string"), tag)), of_digest)

    def of_digest(digest: Column) -> Column:
        x = F.sqrt(-2 * F.ln(_uniform_of(digest, 0))) * F.cos(2 * 3.141592653589793 * _uniform_of(digest, 1))
        return _let(x, lambda x: _let(1 + c * x, lambda t: cubed(digest, x, t)))

    def cubed(digest: Column, x: Column, t: Column) -> Column:
        v = t * t * t
        kept = (t > 0) & (F.ln(_uniform_of(digest, 2)) < 0.5 * x * x + d - d * v + d * F.ln(F.when(t > 0, v).otherwise(1.0)))
        return F.when(kept, d * v)

    first = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("double"), lambda kept, i: F.when(kept.isNotNull(), kept).otherwise(attempt(i)))
    drawn = F.coalesce(first, d)
    less = F.when(shape < 1, F.pow(uniform(unit, F.concat(F.lit("b"), draw_.cast("string"))), 1.0 / shape)).otherwise(1.0)
    return drawn * less


def hurdle_gamma(df: DataFrame, groups: Sequence[str], y: str, w: str = "weight") -> DataFrame:
    """The fitted hurdle gamma model per group: (groups, hu, mu, shape).

    `hu` is the weighted share of zeros and `mu` the weighted mean of the rest, which are the
    likelihood's maxima for groups; `shape` is the squared mean over the variance of the rest, and
    NULL where the rest doesn't vary.
    """
    weight, value = F.col(w).cast("double"), F.col(y).cast("double")
    used = df.filter(weight.isNotNull() & value.isNotNull() & (weight > 0) & (value >= 0))
    above = F.when(value > 0, weight)
    sums = used.groupBy(*groups).agg(F.sum(weight).alias("t"), F.sum(above).alias("w"), F.sum(above * value).alias("wy"), F.sum(above * value * value).alias("wyy"))
    mu = F.col("wy") / F.col("w")
    # Rounded, as sums of equal values leave a tiny variance.
    variance = F.round(F.col("wyy") / F.col("w") - mu * mu, 9)
    return sums.select(*groups, (1 - F.coalesce(F.col("w"), F.lit(0.0)) / F.col("t")).alias("hu"), mu.alias("mu"), F.when(variance > 0, mu * mu / variance).alias("shape"))


def hurdle_draws(df: DataFrame, groups: Sequence[str], y: str, n_draws: int = 30, w: str = "weight", unit: str = "diaryid") -> DataFrame:
    """The rows of `df` with (draw, predicted): outcomes drawn from the fitted hurdle gamma model of their group.

    A draw is zero with the group's chance of a zero and else a gamma number of its mean and shape
    (the mean itself where the shape is unknown). Rows of groups without a model predict nothing.
    """
    rows = join_group_facts(df, hurdle_gamma(df, groups, y, w), list(groups), unit)
    drawn = spread_out(rows).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
    zero = uniform(unit, F.concat(F.lit("z"), F.col("draw").cast("string"))) < F.col("hu")
    positive = F.when(F.col("shape").isNull(), F.col("mu")).otherwise(gamma_draw(F.col("shape"), unit, "draw") * F.col("mu") / F.col("shape"))
    return drawn.withColumn("predicted", F.when(zero, 0.0).otherwise(positive)).drop("hu", "mu", "shape")
