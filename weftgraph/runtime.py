"""Makes the package importable for Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_done: set[str] = set()
#: Python workers live through many tasks: what a slice needed goes back to the system when it is freed.
WORKER_MEMORY = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


#: Where the shared folder is a mounted one, Hadoop starts a process for the mode of each folder, file and file of checksums; tables
#: that are stored on the way do without the last. Other kinds of file systems don't read these options.
UNSUMMED = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers find this package where their PYTHONPATH doesn't name it: by the
    path in local mode, by a shipped archive on a cluster. Once for each application."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    for name, value in WORKER_MEMORY.items():
        sc.environment.setdefault(name, value)
    if sc.applicationId in _done or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _done.add(sc.applicationId)
    if sc.master.startswith("local[") or sc.master == "local":
        sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(root), sc.environment.get("PYTHONPATH", "")]))
    else:
        folder = tempfile.mkdtemp(prefix="weft-")
        sc.addPyFile(shutil.make_archive(f"{folder}/weftgraph", "zip", root, "weftgraph"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where none is named, a temporary one in
    local mode; on a cluster executors would not see the driver's, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weft-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/weft-{uuid.uuid4().hex}"
    df.write.options(**UNSUMMED).parquet(path)
    _written.append((df.sparkSession, path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``frames``; they and what is derived from them can't be read any more."""
    for frame in frames:
        path = getattr(frame, "_weft_path", None)
        if path:
            delete_path(frame.sparkSession, path)
            frame._weft_path = None


def child_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished (``_SUCCESS``) output folders under ``path``; none if there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(where)]
    return [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]


_written: list[tuple[SparkSession, str]] = []


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete_path(spark, path)
        except Exception:  # the session may be gone; the folder is scratch space
            return
