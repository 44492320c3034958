"""What the operators share: staged tables in the shared folder, clean inputs and Arrow batches."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_staged: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Where the setting is absent and Spark runs in one process, a folder beside the warehouse serves; on a
    cluster its absence is an error, since a machine-local folder would be lost with the machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "/tmp/checkpoints/tessera"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _staged:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended already
            return


def stage(df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage with one computation, so neither a lost executor nor a second use repeats what is
    above. Use ``unstage`` once nothing reads it any more; what is left goes when the driver exits.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.mode(mode).option("compression", "zstd").parquet(path)
    _staged.append((spark, path))
    out = spark.read.schema(schema).parquet(path)
    out._tessera_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in tables:
        path = getattr(df, "_tessera_path", None)
        if path:
            _delete(df.sparkSession, path)
            _staged[:] = [x for x in _staged if x[1] != path]


#: What empties a worker's caches, by the operator that owns them.
_caches: dict[str, Callable[[], None]] = {}


def sole_cache(owner: str, clear: Callable[[], None]) -> None:
    """Called where a task begins to use caches that outlive it: those of other operators go, so that a worker
    that serves one stage after another holds one operator's at a time."""
    for name in [n for n in _caches if n != owner]:
        _caches.pop(name)()
    _caches[owner] = clear


#: Most rows and bytes of a batch that goes to Python; texts and images are long rows.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` and ``BATCH_BYTES``; a smaller setting stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.match(r"-?\d+", spark.conf.get(key))[0])
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def doc_text(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id``, the columns of ``keep``, and ``text`` with null as the empty text."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", *keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most so many rows, to bound what Python holds of one batch."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def together(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches joined until they have so many bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


#: A key is hot if it has more than this share of the rows.
HOT = 1 / 5000


def join_hot(rows: DataFrame, keys: DataFrame, on: str, n: str, total: int) -> DataFrame:
    """``rows`` joined to ``keys``, which has one row a key and in ``n`` how many of the ``total`` rows have it.

    Hot keys, under 5,000 by that count, are broadcast, so none of their rows moves; the others are shuffled.
    """
    hot = keys.filter(F.col(n) > total * HOT)
    others = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(keys.filter(F.col(n) <= total * HOT), on)
    return rows.join(F.broadcast(hot), on).unionByName(others)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
