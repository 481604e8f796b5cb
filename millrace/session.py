"""Session construction and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names in ``spark.checkpoint.dir``.

    The written copy survives lost executors. Only a local session without that setting uses a
    folder below its warehouse; on a cluster a missing setting is an error, since a machine-local folder would lose data.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def write_and_read(df: DataFrame) -> DataFrame:
    """The same through a Parquet table in that folder. For loops: a checkpointed frame keeps the constraints the
    optimizer has inferred, and they pile up from round to round; a table starts clean."""
    path = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables, set up on first use."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def in_pieces(df: DataFrame, key: str, rows: int = 100_000) -> DataFrame:
    """Rows dealt by a hash of their key into as many partitions as they fill with ``rows`` each: for fits whose result depends
    on which rows share a partition, which is then the same on every cluster. One count and one shuffle."""
    return df.repartition(max(1, -(-df.count() // rows)), key)
