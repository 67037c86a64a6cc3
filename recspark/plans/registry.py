"""Named query plans: one Spark builder and (when SQL can express it) one
DuckDB oracle statement per operator of the survey inventory.

Results are normalised the same way on both sides: floating columns rounded
to 6 decimals, integer columns widened to bigint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recspark.plans.views import with_views
from recspark.session import configure

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

DIGITS = 6


def normalise(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), DIGITS)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def oracle_sql(body: str, views=(), round_cols=(), bigint_cols=()) -> str:
    """Wrap ``body`` so DuckDB output is normalised like ``normalise``."""
    repl = [f"round(cast({c} AS DOUBLE), {DIGITS}) AS {c}" for c in round_cols]
    repl += [f"cast({c} AS BIGINT) AS {c}" for c in bigint_cols]
    head = f"SELECT * REPLACE ({', '.join(repl)})" if repl else "SELECT *"
    outer = f"{head} FROM (\n{body}\n) q"
    return with_views(outer, views)


def register(name: str, sql: str | None = None, views=(), round_cols=(), bigint_cols=()):
    """Decorator: register a Spark query builder and its oracle SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return normalise(fn(spark, sf_dir))

        run.__name__ = f"query_{name}"
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = oracle_sql(sql, views, round_cols, bigint_cols)
        return fn

    return deco


def load_all() -> None:
    """Import every plan module so their queries register."""
    from recspark.plans import prep_plans, scoring_plans, metric_plans  # noqa: F401
    from recspark.plans import ab_plans, serving_plans, model_plans, tracking_plans  # noqa: F401
    from recspark.plans import stream_plans  # noqa: F401
