"""Session and checkpoint-folder helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "segue", cpus: int | None = None) -> SparkSession:
    """A session for tests and the local bench; clusters bring their own."""
    n = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SEGUE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder intermediate tables go to: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="segue-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that Python
    functions find it wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="segue-package-")  # on the driver, which serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(os.path.join(folder, "segue-package"), "zip", os.path.dirname(package), os.path.basename(package)))
    _shipped.add(context.applicationId)


_shipped: set[str] = set()
_written: list[str] = []


def record_written(path: str) -> str:
    """``path``, remembered as a folder that `drop_materialised` deletes."""
    _written.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, a lost
    executor costs nothing, and each later step reads only the columns it needs."""
    spark = df.sparkSession
    path = record_written(f"{shared_folder(spark).rstrip('/')}/segue/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again, as `materialise` returned them."""
    for table in tables:
        path = table._written_to
        _delete(table.sparkSession, path)
        _written.remove(path)


def drop_materialised(spark: SparkSession) -> int:
    """Delete the tables this process wrote with `materialise`, once nothing reads them."""
    n = 0
    while _written:
        n += _delete(spark, _written.pop())
    return n


def _delete(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
