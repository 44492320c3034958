"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is one frame a document, holding its ids as little-endian unsigned 32-bit integers, then a skippable
frame with the document ids, then the seek table of the public seekable format: for each frame its compressed
size, its size and the low 32 bits of its content's XXH64. A reader finds a document by the two trailing
frames and decompresses that frame alone. Any zstandard reader can decode the whole file.

Files are rows of a table in the shared folder (part, seq, n_docs, n_ids, first_id, last_id, content),
committed by Spark's own writer: a task that is lost or run twice leaves nothing half written, on any file
system that Spark reads. The range of ids tells which files a reader of some documents needs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.llm.common import doc_text, slices, stage, together
from tessera.llm.tokens import TOGETHER, Encoder, loaded

INDEX_MAGIC, TABLE_MAGIC, FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Stands for a null document id in a file.
NO_ID = -(1 << 63)
FILE_BYTES = 4 << 20


class FileWriter:
    """Collects documents and makes the bytes of one file."""

    def __init__(self, level: int = 1):
        self.zip = zstandard.ZstdCompressor(level=level)
        self.frames, self.table, self.ids, self.size, self.n_ids = [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.zip.compress(ids)
        self.frames.append(frame)
        self.table.append(struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.size += len(frame)
        self.n_ids += len(ids) // 4

    def content(self) -> bytes:
        index = np.array(self.ids, "<i8").tobytes()
        table = b"".join(self.table) + struct.pack("<IBI", len(self.frames), 0x80, FOOT_MAGIC)
        return b"".join([*self.frames, struct.pack("<II", INDEX_MAGIC, len(index)), index, struct.pack("<II", TABLE_MAGIC, len(table)), table])


class FileReader:
    """Documents of one file; ``read`` decompresses one frame and checks its sum."""

    def __init__(self, content: bytes):
        n, flags, magic = struct.unpack_from("<IBI", content, len(content) - 9)
        if magic != FOOT_MAGIC or not flags & 0x80:
            raise ValueError("the seek table is missing")
        at = len(content) - 9 - 12 * n
        if struct.unpack_from("<II", content, at - 8) != (TABLE_MAGIC, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        self.content, self.table = content, np.frombuffer(content, "<u4", 3 * n, at).reshape(n, 3)
        self.ends = np.cumsum(self.table[:, 0], dtype=np.int64)
        self.starts = np.cumsum(self.table[:, 1] // 4, dtype=np.int64) - self.table[:, 1] // 4
        self.doc_ids = np.frombuffer(content, "<i8", n, at - 8 - 8 * n)
        self.zip = zstandard.ZstdDecompressor()

    def read(self, k: int) -> bytes:
        packed, size, total = map(int, self.table[k])
        end = int(self.ends[k])
        ids = self.zip.decompress(self.content[end - packed : end], max_output_size=size) if size else b""
        if len(ids) != size or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != total:
            raise ValueError(f"the checksum of frame {k} differs")
        return ids

    def find(self, doc_id: int | None) -> list[bytes]:
        """The ids of each document with that id, ``b""`` for none of them."""
        return [self.read(int(k)) for k in np.flatnonzero(self.doc_ids == (NO_ID if doc_id is None else doc_id))]


FILES = "part int, seq int, n_docs long, n_ids long, first_id long, last_id long, content binary"


def write_token_files(docs: DataFrame, path: str, end: int = 2, file_bytes: int = FILE_BYTES) -> DataFrame:
    """The files of all documents in ascending ``doc_id`` (null first, equal ones by hash of the text), as a
    staged table.

    Each document's ids are followed by ``end``; null and empty texts are ``end`` alone; repeated rows repeat.
    Texts are dealt by ranges of this order and sorted within each; a task cuts its range into files of about
    ``file_bytes``, so it holds one file at a time. Order of files: ``part``, then ``seq``.
    """
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()]
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq, file = loaded(Encoder, path).batch, TaskContext.get().partitionId(), 0, FileWriter()

        def done() -> pa.RecordBatch:
            row = part, seq, len(file.frames), file.n_ids, min(file.ids), max(file.ids), file.content()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=[x.split()[0] for x in FILES.split(", ")])

        for b in together(slices(batches), TOGETHER):
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(b.column(1))):
                file.add(doc_id, ids + last)
                if file.size >= file_bytes:
                    yield done()
                    seq, file = seq + 1, FileWriter()
        if file.frames:
            yield done()

    texts = doc_text(docs).withColumn("tie", F.xxhash64("text"))
    ordered = texts.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    return stage(ordered.mapInArrow(run, FILES), "tokenfiles")


def read_token_files(files: DataFrame, wanted: Sequence[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` from the files: of all documents or the ``wanted`` ids, for which
    only files whose range holds one of them are opened.

    ``start`` counts the ids of all documents before, from the files' own totals: within a part, and over the
    parts' sums, one small row for each task that wrote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            file = FileReader(b.column(2)[0].as_py())
            picked = range(len(file.doc_ids)) if wanted is None else np.flatnonzero(np.isin(file.doc_ids, np.array(wanted, np.int64))).tolist()
            for at in range(0, len(picked), 1000):
                some = picked[at : at + 1000]
                ids = [file.read(k) for k in some]
                own = file.doc_ids[list(some)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column(0)[0].as_py()] * len(some), pa.int32()), pa.array([b.column(1)[0].as_py()] * len(some), pa.int32()), pa.array(own, mask=own == NO_ID), pa.array(file.starts[list(some)]), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["part", "seq", "doc_id", "_start", "n_tokens", "ids_crc32", "ids"],
                )

    opened = files
    if wanted is not None:
        held = F.exists(F.lit(np.array(sorted(wanted), np.int64)), lambda x: x.between(F.col("first_id"), F.col("last_id")))
        opened = files.filter(F.lit(False)) if not len(wanted) else files.filter((F.col("first_id") <= max(wanted)) & (F.col("last_id") >= min(wanted)) & held)
    rows = opened.select("part", "seq", "content").mapInArrow(run, "part int, seq int, doc_id long, _start long, n_tokens long, ids_crc32 long, ids binary")

    def before(n: str, w: WindowSpec) -> Column:
        return F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    parts = files.groupBy("part").agg(F.sum("n_ids").alias("_n")).select("part", before("_n", Window.orderBy("part")).alias("_part"))
    starts = files.select("part", "seq", before("n_ids", Window.partitionBy("part").orderBy("seq")).alias("_seq")).join(parts, "part")
    starts = starts.select("part", "seq", (F.col("_part") + F.col("_seq")).alias("_before"))
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("_before") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32", "ids")
