"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame``
and, where the result is SQL-expressible, the DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.plans.fixture_sql import with_fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, extra_ctes: dict[str, str] | None = None):
    """Register ``fn`` under ``name``; ``sql`` (may use fixture CTEs) is its oracle."""
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normalise(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_fixtures(positive_zero_rounding(sql), extra_ctes)
        return fn
    return deco


def positive_zero_rounding(sql: str) -> str:
    """Rewrite every ``round(...)`` call as ``(round(...) + 0.0)`` so that a
    value rounded to zero is +0.0 (DuckDB keeps the sign of -0.0).
    Text inside single-quoted literals is left alone."""
    out, i, n, quote = [], 0, len(sql), False
    while i < n:
        ch = sql[i]
        if ch == "'":
            quote = not quote
        elif (not quote and sql[i:i + 6].lower() == "round("
              and (i == 0 or not (sql[i - 1].isalnum() or sql[i - 1] == "_"))):
            depth, k, q = 0, i + 5, False
            while k < n:
                c = sql[k]
                if c == "'":
                    q = not q
                elif not q and c == "(":
                    depth += 1
                elif not q and c == ")":
                    depth -= 1
                    if depth == 0:
                        break
                k += 1
            out.append("(round(" + positive_zero_rounding(sql[i + 6:k]) + ") + 0.0)")
            i = k + 1
            continue
        out.append(ch)
        i += 1
    return "".join(out)


def normalise(df: DataFrame) -> DataFrame:
    """Widen integers to long and floats to double (with -0.0 as +0.0) at the
    query boundary so results compare type-for-type with the oracle."""
    cols = []
    changed = False
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            cols.append(F.col(f"`{f.name}`").cast("long").alias(f.name))
            changed = True
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            # + 0.0 turns -0.0 into +0.0
            cols.append((F.col(f"`{f.name}`").cast("double") + F.lit(0.0)).alias(f.name))
            changed = True
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols) if changed else df
