"""Session settings and the few shared guards every operator uses."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app="cohortile", master=None, cpus=8, **conf):
    """A session for tests and the bench; a cluster brings its own.

    Adaptive execution sizes shuffle partitions at run time, so the
    partition count below is only the starting point.
    """
    b = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" not in os.environ:
        b = b.master(master or f"local[{cpus}]")
    defaults = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names. Only a session inside one
    process (a test) gets a folder of its own; a cluster without the setting
    is refused, since its executors share no local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="run-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    The result is computed once, survives lost executors, keeps column
    pruning, and its row count is in the file footers.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.step_folder = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete ``durable`` tables that no later step and no result reads."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.step_folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def join_same_key(left: DataFrame, right: DataFrame, keys, how="inner") -> DataFrame:
    """Join in which a null key matches a null key, as in a window or a
    groupBy over the same keys."""
    keys = list(keys)
    named = right.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return left.join(named, same, how).drop(*[f"_key_{k}" for k in keys])


def require_columns(df: DataFrame, cols) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}; found {df.columns}")
    return df


def r6(col: Column | str) -> Column:
    """Round to 6 digits; the added zero turns -0.0 into 0.0."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col, 6) + F.lit(0.0)
