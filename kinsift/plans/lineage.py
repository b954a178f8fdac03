"""Cutting lineage: tables written to the folder all machines of the cluster share, and taken away when they have served."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines see: spark.checkpoint.dir of the session. One is made where it is unset and there is one machine only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        path = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="kinsift-")
        _own[spark.sparkContext.applicationId] = path
    return path.rstrip("/")


#: Folders made here, by application.
_own: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/kinsift/{name}-{uuid.uuid4().hex}"
    for made in _open:
        made.append(path)
    return path


#: Of scratch() blocks that are open, the paths made in each.
_open: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Takes away, at the end, what is materialized within the block, but for the paths that are removed from the list it gives."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)
        for path in made:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Cuts the lineage: writes the table to the shared folder and reads it again, so lost executors cost no recomputation."""
    path = shared_path(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, name: str, made: list[str]) -> DataFrame:
    """Materializes a table that outlives the scratch block whose list this is."""
    out = materialize(df, name)
    made.pop()
    return out
