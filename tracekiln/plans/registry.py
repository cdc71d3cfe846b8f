"""Query registry: name -> (Spark builder, oracle SQL or None).

Builders take ``(spark, sf_dir)`` and return a lazy DataFrame.  Outputs are
normalised on the way out (integral -> bigint, float -> double) so the
schemas line up with the DuckDB oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def _norm_type(dt):
    if isinstance(dt, (T.IntegerType, T.ShortType, T.ByteType)):
        return T.LongType()
    if isinstance(dt, T.FloatType):
        return T.DoubleType()
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(_norm_type(dt.elementType), dt.containsNull)
    return dt


def normalise(df: DataFrame) -> DataFrame:
    cols = []
    changed = False
    for f in df.schema.fields:
        nt = _norm_type(f.dataType)
        if nt != f.dataType:
            changed = True
            cols.append(F.col(f"`{f.name}`").cast(nt).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols) if changed else df


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark, sf_dir):
            return normalise(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco
