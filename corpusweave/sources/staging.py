"""Tables written between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it's unset, a local session gets a folder of its own
    (a process on one machine shares its disk); on a cluster that's an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _local.get(spark.sparkContext.applicationId)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _local[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="corpusweave-")
        atexit.register(shutil.rmtree, folder, True)
    return folder.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet. All of a session's lie in one folder named by its application id."""
    return f"{shared_folder(spark)}/corpusweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Deletes all staged tables of this session; to be called when the results that read them are written."""
    fs, path = hadoop_path(spark, f"{shared_folder(spark)}/corpusweave/{spark.sparkContext.applicationId}")
    fs.delete(path, True)
    _kept.clear()


def staged(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors. partition: a column of few values,
    each of which is a folder."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    schema = df.schema
    (df.write.partitionBy(partition) if partition else df.write).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in tables:
        fs, path = hadoop_path(df.sparkSession, df.staged_at)
        fs.delete(path, True)


_kept: dict[tuple, str] = {}


def fingerprint(spark: SparkSession, *paths: str) -> tuple:
    """Names, sizes and times of the files of tables: what they hold as long as it's equal."""
    out = []
    for path in paths:
        fs, p = hadoop_path(spark, path)
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            out.append((str(f.getPath()), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def kept_folder(spark: SparkSession, name: str, paths: list[str], make) -> str:
    """A folder that make(path) has written, once for a session and the files of these paths as they are; a changed file makes it again."""
    key = (spark.sparkContext.applicationId, name, fingerprint(spark, *paths))
    if key not in _kept:
        path = new_folder(spark, name)
        make(path)
        _kept[key] = path
    return _kept[key]


def kept(spark: SparkSession, name: str, paths: list[str], make) -> DataFrame:
    """make() as a table written once, as above."""
    schemas: list = []

    def write(path: str) -> None:
        df = make()
        schemas.append(df.schema)
        df.write.parquet(path)

    path = kept_folder(spark, name, paths, write)
    return spark.read.schema(schemas[0]).parquet(path) if schemas else spark.read.parquet(path)
