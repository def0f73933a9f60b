"""The crawl's queue and its fetches as Spark data sources.

``crawl_queue`` is a sink: a stream (or a table) of addresses becomes numbered commits of a queue folder. Tasks write the addresses to files by host
bucket and send the files' names as commit messages; the driver publishes a commit by one small file named by the micro-batch, so a batch
that is written again after a failure is there once.

``crawl_pages`` reads such a queue as a stream: an offset is a number of commits, a partition is a host bucket, so one host's addresses are fetched by
one task, one after the other. A batch that is read again after a failure asks for the same addresses, and a sink that
commits by batch has each once.

Both take ``path``, a folder that driver and executors can open (any file system that pyarrow knows). One query writes a queue.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from .fetch import RESULT, HttpFetcher

BUCKETS = 16


class Folder:
    """A queue folder: ``parts`` of addresses by host bucket, and ``commits`` that name them."""

    def __init__(self, path: str):
        self.fs, self.path = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        self.path = self.path.rstrip("/")

    def write(self, name: str, text: str) -> None:
        """A file is whole when it has its name."""
        draft = f"{self.path}/{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(draft.rpartition("/")[0], recursive=True)
        with self.fs.open_output_stream(draft) as out:
            out.write(text.encode())
        self.fs.move(draft, f"{self.path}/{name}")

    def read(self, name: str) -> str:
        with self.fs.open_input_stream(f"{self.path}/{name}") as f:
            return f.read().decode()

    def exists(self, name: str) -> bool:
        return self.fs.get_file_info(f"{self.path}/{name}").type != pafs.FileType.NotFound

    def commits(self) -> int:
        """How many commits there are, without a gap."""
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.path}/commits", allow_not_found=True))
        names = {int(x.base_name) for x in found if x.base_name.isdigit()}
        n = 0
        while n in names:
            n += 1
        return n

    def put(self, urls: Iterator[str]) -> list[str]:
        """Writes addresses to one file a bucket; the files' names."""
        by: dict[int, list[str]] = {}
        for url in urls:
            by.setdefault(bucket_of(url), []).append(url)
        names = []
        for bucket, own in sorted(by.items()):
            names.append(f"parts/{bucket}-{uuid.uuid4().hex}")
            self.write(names[-1], "".join(json.dumps(u) + "\n" for u in own))
        return names

    def drop(self, names: list[str]) -> None:
        for name in names:
            if self.exists(name):
                self.fs.delete_file(f"{self.path}/{name}")


def bucket_of(url: str) -> int:
    return zlib.crc32(urlsplit(url).netloc.lower().encode()) % BUCKETS


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class _Writer:
    """Tasks write parts; a commit names them."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> Written:
        return Written(Folder(self.path).put(r.url for r in rows if r.url is not None))

    def _publish(self, messages: list, number: int) -> None:
        folder, names = Folder(self.path), [n for m in messages if m is not None for n in m.names]
        if folder.exists(f"commits/{number}"):  # this batch was published before the failure that repeated it
            folder.drop(names)
        else:
            folder.write(f"commits/{number}", json.dumps(names))


class _StreamWriter(_Writer, DataSourceStreamWriter):
    def commit(self, messages, batchId: int) -> None:  # noqa: N803
        self._publish(messages, batchId)

    def abort(self, messages, batchId: int) -> None:  # noqa: N803
        Folder(self.path).drop([n for m in messages if m is not None for n in m.names])


class _TableWriter(_Writer, DataSourceWriter):
    def commit(self, messages) -> None:
        self._publish(messages, Folder(self.path).commits())

    def abort(self, messages) -> None:
        Folder(self.path).drop([n for m in messages if m is not None for n in m.names])


class QueueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "crawl_queue"

    def schema(self) -> str:
        return "url string"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _StreamWriter(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _TableWriter(self.options["path"])


@dataclass
class Bucket(InputPartition):
    names: list[str]

    def __init__(self, names: list[str]):
        super().__init__(names[0] if names else None)
        self.names = names


class _PageReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.delay, self.timeout = options["path"], float(options.get("delayMs", 0)) / 1000, float(options.get("timeoutS", 20))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"commits": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"commits": Folder(self.path).commits()}

    def partitions(self, start: dict, end: dict) -> list[Bucket]:
        folder, by = Folder(self.path), {}
        for n in range(start["commits"], end["commits"]):
            for name in json.loads(folder.read(f"commits/{n}")):
                by.setdefault(int(name.removeprefix("parts/").partition("-")[0]), []).append(name)
        return [Bucket(names) for _, names in sorted(by.items())] or [Bucket([])]

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        folder, fetcher, last, seen = Folder(self.path), HttpFetcher(timeout=self.timeout), {}, set()
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
        for name in partition.names:
            for line in folder.read(name).splitlines():
                url = json.loads(line)
                if url in seen:
                    continue
                seen.add(url)
                host = urlsplit(url).netloc
                time.sleep(max(0.0, last.get(host, 0.0) + self.delay - time.monotonic()))
                last[host] = time.monotonic()
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((url, *fetcher.page(url)), kinds)], ["url", "status", "html", "final_url"])


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "crawl_pages"

    def schema(self) -> str:
        return RESULT

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _PageReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(QueueSource)
    spark.dataSource.register(PageSource)
