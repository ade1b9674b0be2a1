"""Session defaults and the folder that intermediate tables are written to."""

from __future__ import annotations

import contextlib
import functools
import os
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def build_session(app: str = "rowrinse", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects.

    Headers that differ only by case are legal, so names are case sensitive.
    Partition counts are left to adaptive execution unless given in ``conf``.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.caseSensitive": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_scopes: list[list[str]] = []


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end, through the file system that Spark uses.

    A result that still reads them must be written, or staged outside, before.
    """
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def leaves_no_scratch(run: Callable) -> Callable:
    """For functions of a DataFrame whose result reads no staged table: writers, and those that return plain values."""

    @functools.wraps(run)
    def scoped(df: DataFrame, *args, **kwargs):
        with scratch_scope(df.sparkSession):
            return run(df, *args, **kwargs)

    return scoped


def scratch_path(spark: SparkSession) -> str:
    """A fresh path under the session's shared checkpoint folder.

    Where none is set, as in tests, it is a path under the warehouse, which is
    shared as well.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        root = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "scratch")
    return os.path.join(root, f"rowrinse-{uuid.uuid4().hex}")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so later passes neither repeat the work above nor see
    it come out in another order, and a lost executor costs a re-read only.
    Inside a :func:`scratch_scope` the table lives until its end.
    """
    typed = df.select(
        *[
            df[_quoted(f.name)].cast("string").alias(f.name)
            if isinstance(f.dataType, T.NullType)
            else df[_quoted(f.name)]
            for f in df.schema.fields
        ]
    )
    path = scratch_path(df.sparkSession)
    if _scopes:
        _scopes[-1].append(path)
    typed.write.parquet(path)
    return df.sparkSession.read.schema(typed.schema).parquet(path)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
