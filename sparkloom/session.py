"""Sessions, and this package on the executors."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

HERE = Path(__file__).resolve().parent


#: Rows of an Arrow batch: texts are long, and a batch is held in full on both sides.
BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1024")


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once a context, so that they need no installation of it; a session with
    the default Arrow batches gets smaller ones."""
    context = spark.sparkContext
    name, default, rows = BATCH_ROWS
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, rows)
    if not getattr(context, "_sparkloom_shipped", False):
        path = Path(tempfile.mkdtemp(prefix="sparkloom-")) / "sparkloom.zip"
        with zipfile.ZipFile(path, "w") as out:
            for p in sorted(HERE.rglob("*.py")):
                out.write(p, p.relative_to(HERE.parent))
        context.addPyFile(str(path))
        context._sparkloom_shipped = True
    return spark


def session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster, build your own and pass it in."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("sparkloom")
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"} | conf
    return ship(builder.config(map=conf).getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`; a temporary one for a local master without it.
    Raises on a cluster without that setting, as executors would write where nobody else reads."""
    context = spark.sparkContext
    if folder := context.getConf().get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[\d*]+\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(context, "_sparkloom_folder", None):
        context._sparkloom_folder = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        _local.append(context._sparkloom_folder)
    return context._sparkloom_folder


_local: list[str] = []
_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in reversed(_made):
        if path.startswith("file:"):
            shutil.rmtree(re.sub("^file:/*", "/", path), ignore_errors=True)
            continue
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended before: nothing more can be removed through it
            break
    for folder in _local:
        shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` computed once, as Parquet in the shared folder: its lineage is cut, it survives the loss of executors, and the
    planner knows its size.  It goes when the driver ends."""
    path = scratch(df.sparkSession, "stored")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def forget(df: DataFrame) -> None:
    """Removes what `stored` wrote; for tables that nothing lazy reads any more."""
    remove(df.sparkSession, df._stored_path)


def freed(spark: SparkSession) -> None:
    """Lets the shuffle files of steps that are done go now: Spark removes them when the driver has collected what refers to
    them, which it may not do before the query ends."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A partition that the planner takes for smaller than this is worth a move.
SPREAD_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where the planner takes it for small, as a file of one row group comes in one partition; a large
    input is never moved for it.  Asks the plan alone, runs nothing."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df
