"""Registry of named queries over the driver tables with their DuckDB oracles.

Each entry is a callable ``(spark, sf_dir) -> DataFrame`` plus, where the
operator is SQL-expressible, an equivalent DuckDB SQL text.  Output hygiene
shared by both sides: integral columns are BIGINT, floating columns DOUBLE
rounded to 6 decimals, column names identical.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

# Relations materialized during one query call (see bindings.shared).
_SCOPE: dict = {"cache": None}


def scope_cache() -> dict | None:
    return _SCOPE["cache"]


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark, sf_dir):
            outer = _SCOPE["cache"]
            _SCOPE["cache"] = {}
            try:
                return normalize(fn(spark, sf_dir))
            finally:
                _SCOPE["cache"] = outer
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run
    return deco


def normalize(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (Ty.ByteType, Ty.ShortType, Ty.IntegerType, Ty.LongType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (Ty.FloatType, Ty.DoubleType, Ty.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, Ty.BooleanType):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)
