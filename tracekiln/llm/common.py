"""Shared helpers: tables, shared scratch storage, Arrow batch size.

Scratch tables are written below ``spark.checkpoint.dir`` (the folder that the
driver and all executors share), never to a machine-local folder.  A written
table cuts the lineage: a lost executor re-reads files instead of recomputing.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

ARROW_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_workers(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Prepare a session for operators with Python tasks.

    Executors get this package (``addPyFile``, once per application), so that it
    need not be installed there.  Arrow batches get at most ``rows`` rows: a
    batch of very long texts must fit in a worker next to its results.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    if _SHIPPED.get("to") != spark.sparkContext.applicationId:
        spark.sparkContext.addPyFile(_package_zip())
        _SHIPPED["to"] = spark.sparkContext.applicationId


_SHIPPED: dict[str, str] = {}


def _package_zip() -> str:
    """The package's sources as a zip file on the driver, from where Spark serves it."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sources = sorted(os.path.join(d, f) for d, _, names in os.walk(top) for f in names if f.endswith(".py"))
    name = hashlib.sha256(b"".join(open(f, "rb").read() for f in sources)).hexdigest()[:12]
    path = os.path.join(tempfile.mkdtemp(prefix="tracekiln-"), f"tracekiln-{name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sources:
            z.write(f, os.path.relpath(f, os.path.dirname(top)))
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to shared scratch storage and read back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cast_long(df: DataFrame) -> DataFrame:
    """Integral columns as bigint, floats as double (what DuckDB returns)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)
