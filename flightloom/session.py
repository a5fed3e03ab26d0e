"""Session settings the operators are written for, and the checkpoint folder they use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: The folder of a local master whose session names none.
_LOCAL: list[str] = []


def local_session(cores: str = "8", shuffle_partitions: int = 8, name: str = "flightloom") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables, as the cluster names it.

    Only a local master may fall back to a temporary folder of its own machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="flightloom-"))
    return _LOCAL[0]


def cut_lineage(df: DataFrame) -> DataFrame:
    """The result as a table written to the shared folder: it survives the loss of any executor,
    and what reads it later prunes columns and knows its size."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/flightloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
