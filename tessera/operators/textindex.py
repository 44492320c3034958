"""A stored index of documents: postings, lengths and vectors in segments, named by numbered manifests.

An addition is a segment of its own: what it replaces in older segments is known by id, and a deletion is a
segment of ids alone. Postings lie in folders by hash of their term, so a search reads the folders of its terms
in every segment and no text; vectors lie in folders by their partition, so a probe reads the nearest
partitions. A document's newest segment is its live one. After ``MOST_SEGMENTS`` an addition merges them.

A document's row also holds all of its postings (``words``), so what reads every posting meets the live documents
by row and not by posting. Indexes made before have no such column and read their postings by term.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import CommandError
from tessera.operators import search, vectors
from tessera.sources.storage import Conflict, Storage

BUCKETS, MOST_SEGMENTS = 64, 8
NAME = "index"


class TextIndex:
    """``create`` makes an index, the constructor opens one; ``drop`` deletes it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.storage = spark, Storage(spark, root)
        self._entry()

    @classmethod
    def create(cls, spark: SparkSession, root: str, fields: Sequence[str], vector: str | None = None, doc: str = "doc_id") -> TextIndex:
        """An index of text ``fields`` and of ``vector``, if named; ``doc`` is the id's column."""
        if not fields and not vector:
            raise CommandError("an index needs a field")
        store = Storage(spark, root)
        if store.latest():
            raise CommandError("the index exists")
        entry = {"fields": list(fields), "vector": vector, "doc": doc, "id": uuid.uuid4().hex, "base": "", "deltas": [], "types": {}, "centroids": None, "words": bool(fields)}
        store.commit(1, {"tables": {NAME: entry}})
        return cls(spark, root)

    def drop(self) -> None:
        self.storage.fs.delete(self.storage._path(self.storage.root), True)

    def _entry(self) -> dict:
        entry = self.storage.manifest(self.storage.latest())["tables"].get(NAME)
        if entry is None:
            raise CommandError("no such index")
        return entry

    # segments
    def _write(self, entry: dict, docs: DataFrame | None, gone: DataFrame | None = None) -> str:
        """A segment of whole documents or of deleted ids."""
        path, doc = f"{self.storage.root}/data/{entry['id']}/{uuid.uuid4().hex}", entry["doc"]
        if docs is None:
            gone.select(F.col(doc).alias("doc")).distinct().withColumn("live", F.lit(False)).write.parquet(f"{path}/docs")
            return path
        known = search.words(docs, entry["fields"], doc) if entry["fields"] else docs.select(F.col(doc).alias("doc"), F.lit(0).alias("doclen"))
        known.withColumn("live", F.lit(True)).write.parquet(f"{path}/docs")
        if entry["fields"]:
            self._by_term(self._written(path, docs.schema[doc].dataType.simpleString()), path)
        if entry["vector"]:
            v = docs.filter(F.col(entry["vector"]).isNotNull()).select(F.col(doc).alias("doc"), F.col(entry["vector"]).cast("array<double>").alias("vector"))
            v = self._assigned(v, entry["centroids"])
            v.hint("rebalance", "cid").write.partitionBy("cid").parquet(f"{path}/vectors")
        return path

    def _written(self, path: str, kind: str) -> DataFrame:
        """The postings of a segment's documents."""
        return search.of_words(self.spark.read.schema(f"doc {kind}, words {search.WORDS}").parquet(f"{path}/docs"))

    @staticmethod
    def _by_term(rows: DataFrame, path: str) -> None:
        rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/postings")

    @staticmethod
    def _assigned(v: DataFrame, centroids: list | None) -> DataFrame:
        return vectors.assign(v, np.array(centroids)) if centroids else v.withColumn("cid", F.lit(0))

    def _segment(self, path: str, part: str, schema: str) -> DataFrame | None:
        """A part of a segment, or None: a segment of deleted ids has no postings, nor has an empty one."""
        if not self.storage.fs.exists(self.storage._path(f"{path}/{part}")):
            return None
        return self.spark.read.schema(schema).parquet(f"{path}/{part}")

    def _all(self, entry: dict, part: str, columns: str) -> DataFrame:
        """A part of all segments with the segment's number ``turn``."""
        schema = f"doc {entry['types'].get('doc', 'string')}, {columns}"
        rows = None
        for n, path in enumerate(entry["deltas"]):
            some = self._segment(path, part, schema)
            if some is not None:
                some = some.withColumn("turn", F.lit(n))
                rows = some if rows is None else rows.unionByName(some)
        return self.spark.createDataFrame([], f"{schema}, turn int") if rows is None else rows

    def _live(self, entry: dict) -> DataFrame:
        """``doc, turn, doclen`` of the documents that are there."""
        rows = self._all(entry, "docs", "doclen int, live boolean")
        if len(entry["deltas"]) == 1:
            return rows.filter("live").select("doc", "turn", "doclen")
        newest = rows.groupBy("doc").agg(F.max_by(F.struct("turn", "doclen", "live"), "turn").alias("_v"))
        return newest.filter("_v.live").select("doc", "_v.turn", "_v.doclen")

    def _commit(self, change) -> None:
        while True:
            n = self.storage.latest()
            manifest = self.storage.manifest(n)
            change(manifest["tables"][NAME])
            try:
                return self.storage.commit(n + 1, manifest)
            except Conflict:
                continue

    def add(self, docs: DataFrame) -> None:
        """Adds documents, one row an id; an id that is there is replaced."""
        entry = self._entry()
        path, kind, used = self._write(entry, docs), docs.schema[entry["doc"]].dataType.simpleString(), entry["centroids"]

        def change(e: dict) -> None:
            if e["centroids"] != used:
                raise CommandError("the partitions have been built anew; add again")
            e["types"]["doc"] = kind
            e["deltas"].append(path)

        self._commit(change)
        if len(self._entry()["deltas"]) > MOST_SEGMENTS:
            self._merge(used)

    def delete(self, ids: DataFrame) -> None:
        entry = self._entry()
        path = self._write(entry, None, ids)
        self._commit(lambda e: e["deltas"].append(path))

    def _merge(self, centroids: list | None) -> None:
        """All segments as one, with vectors in the partitions of ``centroids``."""
        entry = self._entry()
        live, path = self._live(entry), f"{self.storage.root}/data/{entry['id']}/{uuid.uuid4().hex}"
        if entry.get("words"):
            live = self._of_live(entry, self._all(entry, "docs", f"doclen int, words {search.WORDS}"))
        live.drop("turn").withColumn("live", F.lit(True)).write.parquet(f"{path}/docs")
        if entry["fields"]:
            self._by_term(self._written(path, entry["types"].get("doc", "string")) if entry.get("words") else self._postings(entry), path)
        if entry["vector"]:
            self._assigned(self._vectors(entry).select("doc", "vector"), centroids).hint("rebalance", "cid").write.partitionBy("cid").parquet(f"{path}/vectors")
        merged = len(entry["deltas"])

        def change(e: dict) -> None:
            if e["deltas"][:merged] != entry["deltas"] or (e["centroids"] != centroids and len(e["deltas"]) > merged):
                raise CommandError("the index has changed; try again")
            e["deltas"], e["centroids"] = [path, *e["deltas"][merged:]], centroids

        self._commit(change)

    # reading
    def _of_live(self, entry: dict, rows: DataFrame) -> DataFrame:
        return rows.join(self._live(entry).drop("doclen"), ["doc", "turn"], "left_semi").drop("turn")

    def _postings(self, entry: dict, terms: Sequence[str] | None = None) -> DataFrame:
        rows = self._all(entry, "postings", "field string, term string, tf long, bucket int")
        if terms is not None:
            wanted = [F.lit(t) for t in dict.fromkeys(terms)]
            buckets = self.spark.range(1).select(F.array(*[F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int") for t in wanted])).first()[0]
            rows = rows.filter(F.col("bucket").isin(buckets) & F.col("term").isin(list(terms)))
        return self._of_live(entry, rows.drop("bucket"))

    def postings(self) -> DataFrame:
        """``doc, field, term, tf`` of all live documents."""
        entry = self._entry()
        if entry.get("words"):
            return search.of_words(self._of_live(entry, self._all(entry, "docs", f"words {search.WORDS}")))
        return self._postings(entry)

    def _vectors(self, entry: dict, cids: Sequence[int] | None = None) -> DataFrame:
        rows = self._all(entry, "vectors", "vector array<double>, cid int")
        return self._of_live(entry, rows if cids is None else rows.filter(F.col("cid").isin([int(c) for c in cids])))

    def search(self, text: str, offset: int = 0, count: int = 10, mode: str = "any", withscores: bool = True, nocontent: bool = True, contents: DataFrame | None = None, knn: tuple[int, Sequence[float]] | None = None, nprobe: int | None = None) -> DataFrame:
        """``doc, score`` by BM25; with ``knn`` = (k, vector) the nearest of the documents that hold all asked
        terms, ``doc, dist, score``. Without ``withscores`` the ids alone; ``contents`` (a table with the id) is
        joined to the page unless ``nocontent``."""
        entry = self._entry()
        query = search.parse_query(text, entry["fields"])
        asked = search._asked(query, entry["fields"])
        if knn is not None:
            only = None if query.everything or not asked else self._having(entry, asked)
            found = self._nearest(entry, knn[1], knn[0], nprobe, only).offset(offset).limit(count)
        elif query.everything:
            found = search.match_all(self._live(entry), offset, count, "doc")
        else:
            found = self._scored(entry, asked, mode).offset(offset).limit(count)
        found = found if withscores else found.select("doc")
        return found if nocontent or contents is None else found.join(contents.withColumnRenamed(entry["doc"], "doc"), "doc")

    def _counts(self, entry: dict, asked: list[tuple[str, str]]) -> tuple[DataFrame, int]:
        kinds = list(dict.fromkeys(asked))
        rows = self._postings(entry, [t for _, t in kinds])
        tf = [F.sum(F.when((F.col("field") == f) & (F.col("term") == t), F.col("tf")).otherwise(0)).alias(f"_f{i}") for i, (f, t) in enumerate(kinds)]
        return rows.groupBy("doc").agg(*(tf or [F.lit(0).alias("_f0")])), len(kinds)

    def _scored(self, entry: dict, asked: list[tuple[str, str]], mode: str) -> DataFrame:
        live = self._live(entry)
        if not asked:
            return live.select("doc", F.lit(0.0).alias("score")).limit(0)
        counts, kinds = self._counts(entry, asked)
        size = live.agg(F.count("*").alias("n"), F.avg("doclen").alias("avgdl"))
        stats = size.join(F.broadcast(counts.agg(*search._df(kinds))))  # one row each
        return search.ranked(counts.join(live.select("doc", "doclen"), "doc"), stats, asked, mode)

    def _having(self, entry: dict, asked: list[tuple[str, str]]) -> DataFrame:
        counts, kinds = self._counts(entry, asked)
        every: Column = F.col("_f0") > 0
        for i in range(1, kinds):
            every = every & (F.col(f"_f{i}") > 0)
        return counts.filter(every).select("doc")

    # vectors
    def build(self, k: int = 32, iterations: int = 8, seed: int = 0, sample: int = 10_000) -> None:
        """Partitions for the vectors: centroids from at most ``sample`` of them, the first by hash of their id;
        all segments become one. Later additions go to the nearest partition."""
        entry = self._entry()
        if not entry["vector"]:
            raise CommandError("the index has no vectors")
        some = self._vectors(entry).orderBy(F.xxhash64("doc"), "doc").limit(sample).select("vector").collect()
        centroids = vectors.kmeans(np.array([r[0] for r in some], np.float64), k, iterations, seed)
        self._merge([[float(x) for x in c] for c in centroids] or None)

    def knn(self, query: Sequence[float], k: int, nprobe: int | None = None) -> DataFrame:
        """``doc, dist, score`` of the nearest ``k``, from the ``nprobe`` nearest partitions or from all."""
        return self._nearest(self._entry(), query, k, nprobe, None)

    def _nearest(self, entry: dict, query: Sequence[float], k: int, nprobe: int | None, only: DataFrame | None) -> DataFrame:
        cids = None
        if nprobe is not None and entry["centroids"]:
            dist = ((np.array(entry["centroids"]) - np.asarray(query)) ** 2).sum(1)
            cids = np.argsort(dist, kind="stable")[:nprobe]
        rows = self._vectors(entry, cids)
        rows = rows if only is None else rows.join(only, "doc", "left_semi")
        return vectors.knn(rows, query, k, "doc", "vector")

    def info(self) -> DataFrame:
        entry = self._entry()
        size = self._live(entry).agg(F.count("*").alias("num_docs"), F.coalesce(F.sum("doclen"), F.lit(0)).alias("sum_doclen"), F.coalesce(F.avg("doclen"), F.lit(0.0)).alias("avg_doclen"))
        built = F.lit(entry["centroids"] is not None)
        return size.select("*", F.lit(",".join(entry["fields"])).alias("fields"), built.alias("ann_built"), F.lit(len(entry["centroids"] or [])).cast("long").alias("ann_centroids"))
