"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder that spark.checkpoint.dir names, so that it is computed once, every later
    reader sees the same rows and a lost executor costs no recomputation from the sources. A folder of our own is set
    only where the session has none and all its tasks run in this process; elsewhere that is a RuntimeError."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "yakamoz-checkpoints"))
    return df.checkpoint(eager=True)


def clear_cuts(spark: SparkSession) -> None:
    """Delete what cut() wrote in this session; its results can't be read afterwards."""
    if folder := spark.sparkContext.getCheckpointDir():
        path = hadoop_path(spark, folder)
        files(spark, folder).delete(path, True)
        spark.sparkContext.setCheckpointDir(path.getParent().toString())


def at_most(df: DataFrame, rows: int, what: str) -> DataFrame:
    """``df`` if it holds at most so many rows (counted, not guessed), else ValueError: what may be broadcast or collected."""
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"more than {rows} {what}")
    return df


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than the cluster has cores, dealt out over them: for work on each row that costs far more than
    moving the row. Tables that are read in as many partitions or more stay as they are read; rows are the same either way."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def hadoop_path(spark: SparkSession, path: str):  # noqa: ANN201
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def files(spark: SparkSession, path: str):  # noqa: ANN201
    """The file system of a path: local, HDFS or an object store."""
    return hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return files(spark, path).exists(hadoop_path(spark, path))


def names(spark: SparkSession, path: str) -> list[str]:
    """Names within a folder; none if it isn't there."""
    return [s.getPath().getName() for s in files(spark, path).listStatus(hadoop_path(spark, path))] if exists(spark, path) else []


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside its place and moved there. FileExistsError if it is there already."""
    fs, to, tmp = files(spark, path), hadoop_path(spark, path), hadoop_path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp)
    out.write(bytearray(text, "utf-8"))
    out.close()
    if fs.exists(to) or not fs.rename(tmp, to):
        fs.delete(tmp, False)
        raise FileExistsError(path)


def read_file(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
