"""What the package needs of a session: its code on the executors, and tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
#: Python gets rows in batches of so many bytes: Spark's own bound (64 MB) takes several times that in a task.
BATCH, BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20, "67108864b"
#: Whether a query's shuffle files are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once a context: they need no copy on their own path.

    Also bounds the batches that Python gets in this session, unless the session says how large they may be.
    """
    if spark.conf.get(BATCH, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_corpuscle_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="corpuscle-")) / "corpuscle.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(PACKAGE.rglob("*.py")):
            out.write(p, p.relative_to(PACKAGE.parent))
    context.addPyFile(str(path))
    context._corpuscle_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary one; on a cluster, whose machines share no such folder,
    ValueError is raised.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="corpuscle-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


#: How many writes of a session are under way, and its own setting, by the session's JVM object.
_writing: dict[str, tuple[int, str]] = {}
_lock = threading.Lock()


def save(df: DataFrame, path: str, *by: str) -> None:
    """Writes ``df`` as a Parquet table, in a folder for each value of ``by``. Its shuffle files go when it is written: the table takes their place.

    Spark deletes them when the driver's memory is collected, which may be much later. The session's own setting
    holds again when the last of the writes that overlap has ended, in whatever threads these are.
    """
    spark = df.sparkSession
    name = spark._jsparkSession.sessionUUID()
    with _lock:
        under_way, before = _writing.get(name, (0, None))
        _writing[name] = under_way + 1, spark.conf.get(CLEANUP, "false") if before is None else before
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        with _lock:
            under_way, before = _writing.pop(name)
            if under_way > 1:
                _writing[name] = under_way - 1, before
            else:
                spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: its lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/corpuscle/{name}-{uuid.uuid4().hex}"
    save(df, path, *by)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._corpuscle_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, once all that is still to be read from them has been written itself."""
    for table in tables:
        spark, path = table.sparkSession, table._corpuscle_path
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
