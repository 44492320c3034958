"""Tables as a base snapshot and its deltas, named by numbered manifests.

Files are Parquet; a manifest is a small JSON file, written aside and then given its number in one step that
fails if the number is taken: whoever has number n+1 has committed, and a second writer must look again. So a
reader never meets half a manifest, and a writer that dies leaves none. The file system must rename in one
step, as HDFS does; local files are linked. All access goes through Spark's file systems. A read merges the
deltas by key (they are small) and keeps base rows whose key no delta has.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DELETED, TURN = "_deleted", "_turn"
#: Deltas of a table before a commit folds them into a new base.
MOST_DELTAS = 8


class Conflict(Exception):
    """Another writer has committed this number."""


class Storage:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(f"{self.root}/manifest"))
        self.local = self.fs.getUri().getScheme() == "file"

    def _path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def numbers(self) -> list[int]:
        """The manifests that are there, in order."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.root}/manifest"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def latest(self) -> int:
        return max(self.numbers(), default=0)

    def manifest(self, number: int) -> dict:
        if number == 0:
            return {"tables": {}}
        stream = self.fs.open(self._path(f"{self.root}/manifest/{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, number: int, manifest: dict) -> None:
        """Create that manifest, or raise ``Conflict`` if it is there; other errors are passed on."""
        where, aside = (self._path(f"{self.root}/manifest/{name}") for name in (f"{number:012d}.json", f"{uuid.uuid4().hex}.new"))
        out = self.fs.create(aside, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        try:
            if self.local:
                os.link(aside.toUri().getPath(), where.toUri().getPath())
            else:
                self._rename(aside, where)
        except FileExistsError as e:
            raise Conflict(str(number)) from e
        finally:
            self.fs.delete(aside, False)

    def _rename(self, old, new) -> None:
        """One step that fails if the new name is taken."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(old, new, none)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise FileExistsError(str(new)) from e
            raise

    def vacuum(self, keep: int, older_s: float) -> int:
        """Deletes all manifests but the newest ``keep``, then the data that no remaining one names and that was
        last changed over ``older_s`` ago, so that running writers keep theirs. The number of deleted folders."""
        numbers = self.numbers()
        kept = numbers[-keep:]
        used = {p for n in kept for t in self.manifest(n)["tables"].values() for p in (t["base"], *t["deltas"], *(i["copy"] for i in t.get("indexes", ()) if "copy" in i))}
        for n in numbers[: len(numbers) - len(kept)]:
            self.fs.delete(self._path(f"{self.root}/manifest/{n:012d}.json"), False)
        names = {p.rpartition("/data/")[2] for p in used}
        gone, data = 0, self._path(f"{self.root}/data")
        for table in self.fs.listStatus(data) if self.fs.exists(data) else ():
            for one in self.fs.listStatus(table.getPath()):
                name = f"{table.getPath().getName()}/{one.getPath().getName()}"
                if name not in names and one.getModificationTime() < (time.time() - older_s) * 1000:
                    gone += bool(self.fs.delete(one.getPath(), True))
        return gone

    def write(self, table_id: str, df: DataFrame, by: str | None = None) -> str:
        """The path of a new folder of these rows. In the order of a column, if one is given: a range of it is in
        few files, and the least and largest values in their footers let a scan skip the others."""
        path = f"{self.root}/data/{table_id}/{uuid.uuid4().hex}"
        if by is not None:
            df = df.repartitionByRange(by).sortWithinPartitions(by)
        df.write.parquet(path)
        return path

    def deltas(self, paths: list[str], schema) -> DataFrame:
        """The newest row of each key among the deltas, deleted ones included."""
        rows = None
        for n, p in enumerate(paths):
            some = self.spark.read.schema(schema).parquet(p).withColumn(TURN, F.lit(n))
            rows = some if rows is None else rows.unionAll(some)
        return rows

    def versions(self, table: dict, schema) -> DataFrame:
        """All stored versions of a table entry's rows with ``_deleted`` and ``_turn``: 0 in the base, then the
        deltas in the order of their commits."""
        full = schema.add(DELETED, "boolean") if DELETED not in schema.names else schema
        base = self.spark.read.schema(full).parquet(table["base"]).withColumn(DELETED, F.lit(False)).withColumn(TURN, F.lit(0))
        return base.unionAll(self.deltas(table["deltas"], full).withColumn(TURN, F.col(TURN) + 1)) if table["deltas"] else base

    def read(self, table: dict, schema, key: str) -> DataFrame:
        """The live rows of a table entry ``{base, deltas}``."""
        full = schema.add(DELETED, "boolean") if DELETED not in schema.names else schema
        names = [f.name for f in schema if f.name != DELETED]
        base = self.spark.read.schema(full).parquet(table["base"]).select(*names)
        if not table["deltas"]:
            return base
        newest = Window.partitionBy(key).orderBy(F.desc(TURN))
        rows = self.deltas(table["deltas"], full).withColumn("_n", F.row_number().over(newest)).filter("_n = 1")
        kept = base.join(rows.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
        return kept.unionByName(rows.filter(~F.col(DELETED)).select(*names))
