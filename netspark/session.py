"""Session helpers: construction for local runs, and the shared staging folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "netspark") -> SparkSession:
    """A session for tests and benches. On a cluster, use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. A machine-local folder is
    only ever chosen for a local-mode session that names none.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="netspark-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


#: Stored bytes a shuffle partition stands for at most, and the shuffled bytes up to which small ones are joined.
STORED_PER_PARTITION = 4 << 20
SHUFFLED_PER_PARTITION = 16 << 20


def small_partitions(spark: SparkSession, inputs: list[str]) -> None:
    """Let shuffle partitions grow in number with the stored inputs, and not in size.

    Sorted text rows take many times their shuffled bytes, so partitions of Spark's default size spill where many
    tasks share an executor. A session with more partitions, or without adaptive joining, keeps what it has.
    """
    files = [spark._jvm.org.apache.hadoop.fs.Path(path) for path in inputs]
    stored = sum(f.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(f).getLength() for f in files)
    if stored // STORED_PER_PARTITION > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(stored // STORED_PER_PARTITION))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(SHUFFLED_PER_PARTITION))


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
