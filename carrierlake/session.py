"""Session defaults and the one place that cuts lineage."""

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("carrierlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", f"file://{local_folder()}")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir`` or given to ``setCheckpointDir``.

    Only a local master without either takes a folder of its own; a cluster without the setting is
    an error, because a machine-local folder does not survive an executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return folder or local_folder()


@cache
def local_folder() -> str:
    """A folder of this process, removed when it ends."""
    folder = tempfile.mkdtemp(prefix="carrierlake-scratch-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the table to the shared scratch folder and read it back; the driver's JVM deletes it when it ends.

    Unlike ``checkpoint()`` the reader sees the true size on disk. A checkpointed plan keeps the
    estimate of the plan it replaced, and in a loop of joins that estimate squares every pass.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark).rstrip('/')}/carrierlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_exit(spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


#: Bytes of input files per partition where rows are dealt by ``spread``.
SPREAD_BYTES = 8 << 20


def spread(*tables: tuple[DataFrame, list[str]]) -> list[DataFrame]:
    """Each table dealt by its columns into one number of partitions that follows the size of all their input files.

    A fixed number of shuffle partitions lets the rows of a task, and the memory of its sorts and hash tables, grow with the input. Where the
    session's number is enough, the tables stay as they are. Tables dealt together can be joined without another shuffle.
    """
    spark = tables[0][0].sparkSession
    bytes_read = 0
    for name in {f for table, _ in tables for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        bytes_read += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    n = -(-bytes_read // SPREAD_BYTES)
    if n <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return [table for table, _ in tables]
    return [table.repartition(n, *columns) for table, columns in tables]


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Let the driver's JVM delete a written folder when it ends."""
    written = spark._jvm.org.apache.hadoop.fs.Path(path)
    written.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(written)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written folder now."""
    written = spark._jvm.org.apache.hadoop.fs.Path(path)
    written.getFileSystem(spark._jsc.hadoopConfiguration()).delete(written, True)


def discard(*tables: DataFrame, collect: bool = True) -> None:
    """Delete tables of ``cut_lineage`` that no later plan reads, and let the driver clean up shuffle files of plans that are gone.

    ``collect=False`` leaves that to a later call.
    """
    for table in tables:
        remove(table.sparkSession, table._scratch_path)
    if tables and collect:
        release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let the driver clean up shuffle files of plans that are gone.

    Spark drops shuffle files when their plan is garbage; a long job on a quiet driver otherwise keeps all of them on its disks.
    """
    gc.collect()
    spark._jvm.System.gc()
