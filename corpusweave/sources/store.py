"""Stage tables as numbered parts: snapshots, appended rows, and changes by key that are merged when they're read.

A part is written beside the others and counts once it's finished; no part is changed afterwards, so every write can be repeated and
every reader sees one state. A writer claims its number by creating a file that must not exist, so two writers at once have two
numbers and neither's rows are lost; where both change a key, the larger number wins.

Parts, by the first letter of their folder: ``s`` a snapshot, which stands for all parts with smaller numbers, or, with a manifest, for the
parts that it names (a compaction: what other writers finished meanwhile stays); ``d`` rows appended; ``u`` rows by key, which replace
or (``_gone``) delete those before them. Changes lie in buckets of the key's hash. Where the table under them lies in the same buckets, those
that no change touches are read as they are, and compaction writes the touched buckets alone and names the others where they are.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import hadoop_path

BUCKETS = 16
MANIFEST = "_manifest.json"


class Store:
    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        """keep: snapshots that stay, with the parts between them; readers that are older lose their files."""
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    # ------------------------------------------------------------ files

    def _exists(self, path: str) -> bool:
        fs, p = hadoop_path(self.spark, path)
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        fs, p = hadoop_path(self.spark, path)
        fs.delete(p, True)

    def _text(self, path: str) -> str:
        fs, p = hadoop_path(self.spark, path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, path: str, text: str = "") -> bool:
        """Creates a file with its text at once; False if it's there. On a local disk by a link, elsewhere by a rename that doesn't replace."""
        draft = f"{path}.{uuid.uuid4().hex}"
        fs, p = hadoop_path(self.spark, draft)
        out = fs.create(p, False)
        out.write(bytearray(text.encode()))
        out.close()
        target = hadoop_path(self.spark, path)[1]
        try:
            if fs.getUri().getScheme() != "file":
                return fs.rename(p, target)
            link, of = (self.spark._jvm.java.io.File(x.toUri().getPath()).toPath() for x in (target, p))
            self.spark._jvm.java.nio.file.Files.createLink(link, of)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        finally:
            fs.delete(p, False)

    def _names(self, path: str) -> list[str]:
        fs, p = hadoop_path(self.spark, path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    # ------------------------------------------------------------ parts

    def _parts(self, name: str) -> list[tuple[int, str]]:
        """(number, kind) of the finished parts, in the order of their numbers."""
        found = [n for n in self._names(f"{self.root}/{name}") if n[:1] in "sdu" and n[1:].isdigit()]
        return sorted((int(n[1:]), n[0]) for n in found if self._exists(f"{self.root}/{name}/{n}/_SUCCESS"))

    def _claim(self, name: str) -> int:
        """A number of its own, larger than those of all finished parts."""
        fs, p = hadoop_path(self.spark, f"{self.root}/{name}/_numbers")
        fs.mkdirs(p)
        taken = [int(n) for n in self._names(f"{self.root}/{name}/_numbers") if n.isdigit()] + [n for n, _ in self._parts(name)]
        number = max(taken, default=0) + 1
        while not self._create(f"{self.root}/{name}/_numbers/{number}"):
            number += 1
        return number

    def _manifest(self, name: str, number: int) -> dict | None:
        path = f"{self.root}/{name}/s{number}/{MANIFEST}"
        return json.loads(self._text(path)) if self._exists(path) else None

    def _live(self, name: str) -> tuple[list[tuple[str, list[int] | None]], list[tuple[int, str]]]:
        """(folders of the last snapshot with their live buckets, None for all; the parts upon it)."""
        parts = self._parts(name)
        manifests = {n: self._manifest(name, n) for n, kind in parts if kind == "s"}
        plain = max((n for n, m in manifests.items() if m is None), default=0)
        last = max((n for n, m in manifests.items() if n >= plain), default=0)
        if not last:
            return [], parts
        m = manifests[last] or {"merged": [n for n, _ in parts if n < last], "bases": []}
        after = [(n, kind) for n, kind in parts if n not in m["merged"] and n != last and (kind != "s") and n > (plain if manifests[last] else 0)]
        return [*((folder, buckets) for folder, buckets in m["bases"]), (f"s{last}", None)], after

    def _read(self, name: str, folder: str, schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
        path = f"{self.root}/{name}/{folder}"
        if not any(n.startswith("bucket=") for n in self._names(path)):
            return self.spark.read.schema(schema).parquet(path)
        rows = self.spark.read.schema(T.StructType([*schema, T.StructField("bucket", T.IntegerType())])).parquet(path)
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).select(*schema.names)

    def _buckets(self, name: str, folder: str) -> set[int]:
        return {int(n.partition("=")[2]) for n in self._names(f"{self.root}/{name}/{folder}") if n.startswith("bucket=")}

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        """The table as it is now; an empty one before the first write."""
        bases, after = self._live(name)
        return self._merged(name, schema, bases, after, None)

    def _merged(self, name: str, schema: T.StructType, bases, after, only: set[int] | None) -> DataFrame:
        """The state of parts. only: of bucketed bases these buckets alone."""
        changed = set().union(*(self._buckets(name, f"u{n}") for n, kind in after if kind == "u"))
        still, open_ = [], []
        for folder, buckets in bases:
            own = self._buckets(name, folder)
            mine = own & set(buckets) if buckets is not None else own
            if not own:
                open_.append(self._read(name, folder, schema))
                continue
            mine = mine & only if only is not None else mine
            for some, to in ((mine - changed, still), (mine & changed, open_)):
                if some:
                    to.append(self._read(name, folder, schema, sorted(some)))
        i = 0
        while i < len(after):
            j = i
            while j < len(after) and after[j][1] == after[i][1]:
                j += 1
            run = [f"{kind}{n}" for n, kind in after[i:j]]
            if after[i][1] == "d":
                open_.append(self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{folder}" for folder in run]))
            else:
                open_ = [self._changed(name, schema, open_, run)]
            i = j
        rows = still + open_
        if not rows:
            return self.spark.createDataFrame([], schema)
        out = rows[0]
        for more in rows[1:]:
            out = out.unionByName(more)
        return out

    def _changed(self, name: str, schema: T.StructType, before: list[DataFrame], run: list[str]) -> DataFrame:
        """before, with the changes of some parts in their order. Few changes are broadcast by Spark, so that before isn't shuffled."""
        key = json.loads(self._text(f"{self.root}/{name}/{run[0]}/_key.json"))
        wide = T.StructType([*schema, T.StructField("_gone", T.BooleanType())])
        every = None
        for i, folder in enumerate(run):
            rows = self._read(name, folder, wide).withColumn("_at", F.lit(i))
            every = rows if every is None else every.unionByName(rows)
        if len(run) > 1:
            every = every.groupBy(key).agg(F.max_by(F.struct(*every.columns), "_at").alias("row")).select("row.*")
        out = every.where("not _gone").select(*schema.names)
        for rows in before:
            out = out.unionByName(rows.join(every.select(key), key, "left_anti").select(*schema.names))
        return out

    # ------------------------------------------------------------ writes

    def _shaped(self, df: DataFrame, schema: T.StructType) -> DataFrame:
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    @staticmethod
    def _bucket(key: str):
        return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")

    def write(self, name: str, df: DataFrame, schema: T.StructType) -> None:
        """The next snapshot, in place of all there is. Columns that df lacks are null."""
        number = self._claim(name)
        self._shaped(df, schema).write.parquet(f"{self.root}/{name}/s{number}")
        self._clear(name)

    def append(self, name: str, df: DataFrame, schema: T.StructType) -> None:
        """Writes the rows of df and nothing else."""
        self._shaped(df, schema).write.parquet(f"{self.root}/{name}/d{self._claim(name)}")

    def upsert(self, name: str, df: DataFrame, schema: T.StructType, key: str) -> None:
        """Rows of df, one for each key, replace those of their keys or are added; only they are written, in their buckets."""
        self._change(name, self._shaped(df, schema).withColumn("_gone", F.lit(False)), key)

    def delete(self, name: str, keys: DataFrame, schema: T.StructType, key: str) -> None:
        """Rows with these keys go."""
        self._change(name, self._shaped(keys.select(key).distinct(), schema).withColumn("_gone", F.lit(True)), key)

    def _change(self, name: str, rows: DataFrame, key: str) -> None:
        number = self._claim(name)
        path = f"{self.root}/{name}/u{number}"
        self._create_key(path, key)
        rows.withColumn("bucket", self._bucket(key)).repartition("bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").mode("append").parquet(path)

    def _create_key(self, path: str, key: str) -> None:
        fs, p = hadoop_path(self.spark, path)
        fs.mkdirs(p)
        self._create(f"{path}/_key.json", json.dumps(key))

    def compact(self, name: str, schema: T.StructType, key: str | None = None) -> None:
        """One snapshot of a table that has grown by parts. key: it's written in buckets, of which only those that parts touch are made anew."""
        bases, after = self._live(name)
        if not after and (key is None or all(self._buckets(name, f) for f, _ in bases)):
            return
        number = self._claim(name)
        path = f"{self.root}/{name}/s{number}"
        merged = [n for n, _ in after] + [int(f[1:]) for f, _ in bases]
        kept: list = []
        only = None
        if key is not None and bases and all(self._buckets(name, f) for f, _ in bases):
            only = set().union(*(self._buckets(name, f"u{n}") for n, kind in after if kind == "u"))
            for n, kind in after:
                if kind == "d":
                    only |= {r.b for r in self._read(name, f"d{n}", schema).select(self._bucket(key).alias("b")).distinct().collect()}
            for folder, buckets in bases:
                own = self._buckets(name, folder)
                left = sorted((own & set(buckets) if buckets is not None else own) - only)
                if left:
                    kept.append([folder, left])
        rows = self._merged(name, schema, bases, after, only)
        if key is not None:
            rows.withColumn("bucket", self._bucket(key)).repartition("bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{path}.draft")
        else:
            rows.write.parquet(f"{path}.draft")
        self._create(f"{path}.draft/{MANIFEST}", json.dumps({"merged": merged, "bases": kept}))
        fs, draft = hadoop_path(self.spark, f"{path}.draft")
        fs.rename(draft, hadoop_path(self.spark, path)[1])  # with its manifest, at once
        self._clear(name)

    def _clear(self, name: str) -> None:
        """Deletes parts that none of the kept snapshots, nor what is upon them, reads."""
        parts = self._parts(name)
        snapshots = [n for n, kind in parts if kind == "s"][-self.keep :]
        if len(snapshots) < self.keep:
            return
        needed = set(snapshots)
        for n in snapshots:
            needed |= {int(folder[1:]) for folder, _ in (self._manifest(name, n) or {"bases": []})["bases"]}
        first = self._manifest(name, snapshots[0])
        gone = set(first["merged"]) if first else {n for n, _ in parts if n < snapshots[0]}
        for n, kind in parts:
            if n in gone and n not in needed:
                self._delete(f"{self.root}/{name}/{kind}{n}")
