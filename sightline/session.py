"""Session defaults used by the tests, the bench and stand-alone scripts.

A cluster session is configured by whoever submits the job; ``local_session`` only
exists so that small runs behave like one (adaptive execution, UTC, RocksDB state).
"""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 21
#: Bytes that Spark takes for the size of a table it knows nothing of.
UNKNOWN_SIZE = (1 << 63) - 1


def local_session(cores: str = "*", app: str = "sightline", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for cut lineage and stream progress, shared by the driver and all executors.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, whose executors
    are the driver itself, makes a temporary one where the setting is absent.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="sightline-ckpt-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def small_batches(spark: SparkSession) -> None:
    """Rows go to the Python workers ``BATCH_BYTES`` at a time, unless the submitter has set a limit.

    Spark's own limit is 64 MB; executor and worker hold several copies of a batch for each task, and
    much of the memory stays with the two processes afterwards.
    """
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate result that several branches read, and go on from the files.

    The files lie in the shared folder, so the result outlives the executors that made it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return _estimated(df.checkpoint())


def _estimated(df: DataFrame) -> DataFrame:
    """A checkpoint whose estimated size is a long at most.

    Spark estimates a join as the product of its sides, and a checkpoint keeps the estimate. In a loop
    the number gets several times the digits each round, until the driver has neither time nor memory
    for it. A size that no table can have is replaced by Spark's size of an unknown table.
    """
    plan = df._jdf.queryExecution().logical()
    if plan.stats().sizeInBytes() <= UNKNOWN_SIZE:
        return df
    jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
    facts = plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream()
    known = jvm.scala.Option.empty(), jvm.scala.Option.apply(plan.constraints())
    bare = jvm.org.apache.spark.sql.execution.LogicalRDD(*facts, session, *known)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, bare), df.sparkSession)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate tables, wherever the session's file systems have it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may not see the driver's folders.

    The archive is made on the driver, and Spark serves it from there.
    """
    context = spark.sparkContext
    if getattr(context, "_sightline_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    folder = pathlib.Path(tempfile.mkdtemp(prefix="sightline-pkg-"))
    archive = folder / "sightline.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._sightline_shipped = True
