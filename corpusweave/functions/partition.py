"""Partitions of small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SMALL = 1 << 30
#: Rows and bytes of an Arrow batch at most.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
# Physical nodes that keep the rows and the order of their one input; nodes that scan begin with "Scan".
KEEP = frozenset(("Project", "Filter", "Generate", "Union", "LocalTableScan", "Range", "Coalesce"))


def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small: pages and texts differ in length by four orders of magnitude, and a worker holds a batch, and what it
    makes of it, whole. Plans read these settings when they run."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if not 0 < int(spark.conf.get(size).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def is_scan(df: DataFrame) -> bool:
    """Whether df's rows come straight from tables: a task that is repeated has the same rows in the same order."""
    nodes = [df._jdf.queryExecution().sparkPlan()]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name not in KEEP and not name.startswith("Scan"):
            return False
        below = node.children()
        nodes += [below.apply(i) for i in range(below.size())]
    return True


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if it's a scan of at most SMALL bytes in fewer partitions, before costly work in Python.

    One small file is one task, however many cores are free. Larger inputs and results of a shuffle stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not is_scan(df) or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL:
        return df
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
