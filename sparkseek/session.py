"""Session settings, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("sparkseek").config(map=SETTINGS)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application; it need not be installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="sparkseek-")  # on the driver, which serves it to executors as long as it lives
    atexit.register(shutil.rmtree, folder, True)
    archive = Path(folder, "sparkseek.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data directory, a file or a folder of parquet files."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where the session names none a local one makes a temporary folder; a
    cluster has no such place, so there it is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if named is None and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparkseek-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def work_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder below the shared one, which goes when the application ends; the folder itself is not there yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{path}/{name}"


def cut(df: DataFrame, partitioned: bool = False, parts: int | None = None) -> DataFrame:
    """Materialise df reliably and forget its lineage.

    partitioned: the copy keeps df's partitioning, so that joins and aggregations by its keys move nothing. An adaptive plan does not
    tell its partitioning, so this one plan is made in a clone of the session without adaptive execution (other queries keep theirs); use
    it where no key is skewed. parts is the number of partitions of its exchanges, by default the session's.
    """
    spark = df.sparkSession
    shared_dir(spark)
    if not partitioned:
        return df.checkpoint(eager=True)
    session = spark._jsparkSession
    plain = session.cloneSession()
    plain.conf().set("spark.sql.adaptive.enabled", "false")
    if parts is not None:
        plain.conf().set("spark.sql.shuffle.partitions", str(parts))
    dataset = spark._jvm.org.apache.spark.sql.classic.Dataset
    kept = dataset.ofRows(plain, df._jdf.logicalPlan()).checkpoint(True)
    return DataFrame(dataset.ofRows(session, kept.logicalPlan()), spark)


def broadcast_if(df: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """df with a broadcast hint if it has at most so many rows (counted now), else as it is; and whether it has."""
    small = df.limit(most + 1).count() <= most
    return (F.broadcast(df), True) if small else (df, False)


def release(spark: SparkSession) -> None:
    """Let an iterative job free what its finished rounds left: Spark drops shuffle files, broadcasts and (with
    spark.cleaner.referenceTracking.cleanCheckpoints) checkpoints only when the driver's collector finds them unused, which a driver
    with a roomy heap puts off beyond the job's end."""
    gc.collect()
    spark._jvm.System.gc()
