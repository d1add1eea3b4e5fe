"""Where intermediate tables are written.

Small aggregates that several later steps need (thresholds, group means, cut
points) and the shared derived tables are written as Parquet under the folder
the cluster names in ``spark.checkpoint.dir``.  Reading them back gives the
optimizer their true size, so it broadcasts them only below
``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise, and a lost
executor costs nothing but a re-read.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes an Arrow batch of texts should hold.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediates, one sub-folder per application.

    A cluster has to name it.  Only a local session that names none gets a folder of its
    own, which goes when the process ends.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local["):
            raise RuntimeError("Set spark.checkpoint.dir to a folder all executors can reach.")
        base = tempfile.mkdtemp(prefix="levelfield-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/levelfield/{context.applicationId}"


def discard(spark: SparkSession) -> None:
    """Delete what this application has written; its stored tables can no longer be read."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(shared_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, name: str, by: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` once and return a scan of the written table.

    With ``by`` the table is partitioned by that column, and a filter on it reads only the
    partitions it names.  With ``codec`` its files are compressed by that one.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])


def grown(df: DataFrame) -> DataFrame:
    """Side of a join that grows with the input: never broadcast, however small its files are.

    Files of names shrink to a tenth of what their rows take as a hash table, so the
    optimizer's size, and with it the driver's memory, cannot be trusted here.
    """
    return df.hint("merge")


def bound_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to a few megabytes in a session that does not set their size.

    By default 10,000 rows or 64 MB go to a Python worker at a time; of whole texts that is
    tens of megabytes, several times over in the worker and in the executor's direct memory.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan evenly, for steps whose cost is in the parsing."""
    partitions = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return df.repartition(int(partitions))
