"""Tables in the shared folder that the cluster names, for what is computed once and read several times."""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of this machine only where none is named and the master is this machine too, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scopes = threading.local()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a written table in the shared folder: computed once, and lost with no executor."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.option("compression", "lz4_raw").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if held := getattr(_scopes, "held", None):
        held[-1].append((out, path))
    return out


@contextlib.contextmanager
def scratch():
    """Tables that materialize() writes inside are deleted at the end, but for those given to the function that this yields."""
    held = _scopes.held = [*getattr(_scopes, "held", []), []]
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        made, _scopes.held = held[-1], held[:-1]
        for df, path in made:
            if not any(df is k for k in kept):
                remove(df.sparkSession, path)
            elif _scopes.held:
                _scopes.held[-1].append((df, path))


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_tables(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that no later step reads."""
    for df in tables:
        for path in {os.path.dirname(p) for p in df.inputFiles()}:
            remove(df.sparkSession, path)
