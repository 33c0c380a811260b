"""Where results are kept between jobs, so that iterative plans stay short and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset (tests, local mode) a temporary one is set."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lattix-")
    spark.sparkContext.setCheckpointDir(named)
    return context.getCheckpointDir().get()


def new_path(spark: SparkSession) -> str:
    """A folder in the shared one that isn't there yet."""
    return f"{shared_dir(spark)}/lattix-{uuid.uuid4().hex}"


def gone_at_end(spark: SparkSession, path: str) -> None:
    """Deletes a written folder when Spark ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


#: Shuffle files of a statement go when it ends, so a written table's own shuffles don't stay beside it.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: When off, a join on (block, key) of rows that are placed by block leaves them where they are.
_WHOLE_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def stored(df: DataFrame, *, placed: bool = False) -> DataFrame:
    """Written to the shared folder and read again; its shuffle files go at once, the table when dropped() or when Spark ends.

    With ``placed``, rows that are placed by some of a join's keys, in as many parts on both sides, aren't shuffled by all of them."""
    spark = df.sparkSession
    path = new_path(spark)
    wanted = {_CLEANUP: "true"} | ({_WHOLE_KEYS: "false"} if placed else {})
    before = {k: spark.conf.get(k, "true" if k == _WHOLE_KEYS else "false") for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    gone_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete tables that stored() wrote and that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        for f in df.inputFiles()[:1]:
            at = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
            if at.getName().startswith("lattix-"):
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one task, where their number is known: partitions grow in number with the input, not in size.
TASK_ROWS = 1 << 20


def task_count(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: a task a core at least, none of much more than TASK_ROWS."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
