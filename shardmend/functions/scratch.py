"""Tables written once into the folder that driver and executors share, and read back; bounds of Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch, the same for all operators, so that the order in which plans are made does not matter.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20
_DIR = "spark.checkpoint.dir"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of Python functions: ten thousand rows of long texts or whole files may not fit a worker. A larger row is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local session gets a folder of its own; a cluster has to name one that all its machines share."""
    found = spark.conf.get(_DIR, None) or spark.sparkContext.getConf().get(_DIR)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_DIR} must name a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="shardmend-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = f"file://{local}"
        spark.conf.set(_DIR, found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, its lineage cut by a Parquet table in the shared folder. The application's tables are removed when its JVM ends."""
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/shardmend/{spark.sparkContext.applicationId}"
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
