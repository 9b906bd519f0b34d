"""Registry of queries and of the SQL each is checked against."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.plans.base import Study
from dayloom.plans.sql_base import with_base

DIGITS = 6


@dataclass
class Query:
    """A query, and its SQL with the columns that hold floating-point results."""

    run: Callable[[Study], DataFrame]
    sql: str | None
    floats: list[str]


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, floats: str = "") -> Callable:
    """Register a function of a Study under a name."""

    def register(fn: Callable[[Study], DataFrame]) -> Callable[[Study], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(fn, sql, floats.split())
        return fn

    return register


def rounded(df: DataFrame) -> DataFrame:
    """Floating-point columns rounded half to even, so that two engines agree on them."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.bround(F.col(c), DIGITS) for c in doubles}) if doubles else df


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: rounded(q.run(Study(spark, folder)))


def oracle_text(q: Query) -> str:
    """The check SQL with the base tables in front and its float columns rounded."""
    body = q.sql
    if q.floats:
        cols = ", ".join(f"round_even({c}, {DIGITS}) + 0.0 as {c}" for c in q.floats)
        body = f"select * replace ({cols}) from (\n{q.sql}\n) as result"
    return with_base(body)
