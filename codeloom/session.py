"""Session defaults, the shared scratch folder and the code on the workers."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import uuid
import zipfile
from pathlib import Path

from pyarrow import fs
from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "codeloom") -> SparkSession:
    """A local session for tests and benches, with a warehouse that goes when Python ends; on a cluster the submitter
    sets all of this."""
    warehouse = f"/tmp/codeloom-{os.getpid()}"
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", warehouse)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # large expressions are built call by call; tracing each call's origin doubles that
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    atexit.register(shutil.rmtree, warehouse, ignore_errors=True)
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in ``spark.checkpoint.dir``, else one below the
    warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named.rstrip("/") if named else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(uri)


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once for each Spark application."""
    context = spark.sparkContext
    if getattr(context, "_codeloom_shipped", False):
        return
    top = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent).as_posix())
    uri = f"{scratch_path(spark, 'code')}.zip"
    files, path = place(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    with files.open_output_stream(path, compression=None) as out:
        out.write(data.getvalue())
    context.addPyFile(uri)
    context._codeloom_shipped = True
