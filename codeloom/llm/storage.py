"""Files and intermediate tables below the shared folder of the cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codeloom.session import place, scratch_path, ship

#: Spark's own setting by which the shuffle files of a query go when it ends.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

__all__ = ["drop", "folder", "kept", "opened", "publish", "ship"]


def folder(spark: SparkSession, name: str) -> str:
    """A fresh place below the shared folder, as a URI that executors and Spark's readers understand."""
    path = scratch_path(spark, name)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts the lineage and survives lost executors.

    The shuffle files of the write go with it; without that they stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    before = spark.conf.get(SWEEP)
    spark.conf.set(SWEEP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SWEEP, before)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._kept_at = path
    return back


def drop(*tables: DataFrame) -> None:
    """Remove tables made by ``kept`` that nothing reads any more."""
    for t in tables:
        files, path = place(t._kept_at)
        files.delete_dir(path)


def publish(base: str, suffix: str, data: list[bytes]) -> str:
    """Write a file whole under a name of its own; a retried task leaves a file that nobody lists."""
    files, path = place(base)
    files.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    with files.open_output_stream(f"{path}/.{name}", compression=None) as out:
        for x in data:
            out.write(x)
    files.move(f"{path}/.{name}", f"{path}/{name}")
    return f"{base}/{name}"


def opened(uri: str):
    """A random-access file of the shared folder."""
    files, path = place(uri)
    return files.open_input_file(path)
