"""Pages of a long listing at any offset, over a layout sorted by id.

The rows lie in files that follow each other by id, and a small table says how many rows each file has. The files that an offset falls into follow
from running sums of these counts; a page reads them alone, however far the offset, and the total is the sum. A filter on rows needs counts of
its own: build the layout over the filtered rows, or count per file.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import new_folder

COUNTS = "file string, rows bigint, least bigint"


class PagedTable:
    """Rows in the order of an id, the largest first where ``newest`` is set."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", newest: bool = True):
        self.spark, self.path, self.key, self.newest = spark, path.rstrip("/"), key, newest
        self._held: tuple[list[str], list[int]] | None = None

    @classmethod
    def build(cls, rows: DataFrame, path: str | None = None, key: str = "id", files: int | None = None, newest: bool = True) -> PagedTable:
        """Writes rows by key, in so many files or Spark's number, and their counts. Rows of one key are in one file."""
        spark = rows.sparkSession
        own = cls(spark, path or new_folder(spark, "paged"), key, newest)
        parts = rows.repartitionByRange(files, key) if files else rows.repartitionByRange(key)
        parts.sortWithinPartitions(key).write.parquet(f"{own.path}/rows")
        counts = spark.read.parquet(f"{own.path}/rows").groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"), F.min(key).alias("least"))
        counts.coalesce(1).write.parquet(f"{own.path}/counts")
        return own

    def _files(self) -> tuple[list[str], list[int]]:
        """Files in the listing's order and running sums of their rows. One row a file comes to the driver, once."""
        if self._held is None:
            rows = self.spark.read.schema(COUNTS).parquet(f"{self.path}/counts").orderBy(F.desc("least") if self.newest else F.asc_nulls_last("least")).collect()
            self._held = [r.file for r in rows], [0, *accumulate(r.rows for r in rows)]
        return self._held

    def total(self) -> int:
        return self._files()[1][-1]

    def files_of(self, limit: int, offset: int) -> tuple[list[str], int]:
        """(the files that hold a page, rows of the first of them before the page)."""
        files, sums = self._files()
        if offset >= sums[-1] or limit <= 0:
            return [], 0
        first = bisect_right(sums, offset) - 1
        last = bisect_right(sums, min(offset + limit, sums[-1]) - 1) - 1
        return files[first : last + 1], offset - sums[first]

    def page(self, limit: int, offset: int, schema: T.StructType | None = None) -> DataFrame:
        """The rows from offset on, at most limit, in the listing's order."""
        files, skip = self.files_of(limit, offset)
        schema = schema or self.spark.read.parquet(f"{self.path}/rows").schema
        if not files:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*files)
        return rows.orderBy(F.desc(self.key) if self.newest else F.asc_nulls_last(self.key)).offset(skip).limit(limit)
