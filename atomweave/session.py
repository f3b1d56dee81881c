"""Session helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where none is set, as in tests, a temporary one
    of this machine serves a session that runs on this machine alone; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _own[0]


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that what follows doesn't compute it again, nor does the loss of an executor."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark knows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).delete(place, True)


def tidied(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nobody holds: it does so once the driver's garbage is collected, which may else be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers once for each application, so that functions that Spark runs in Python
    find it whatever the working folder of an executor is."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-")) / "atomweave.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


@contextmanager
def scratch_folder(spark: SparkSession) -> Iterator[str]:
    """A folder of its own in the shared one, removed at the end."""
    path = f"{shared_folder(spark)}/atomweave/scratch-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove(spark, path)
