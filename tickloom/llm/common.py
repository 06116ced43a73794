"""What the text operators share: shared storage, folds, batches of documents."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of most contracts: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step handles; it bounds a Python worker's memory.
STEP_BYTES = 1 << 20
#: Rows of an Arrow batch, which bound what a task holds of long texts: set for a session that names no number of its own.
BATCH_ROWS = 1000

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that names none gets one of its own, under its warehouse folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    import tempfile

    own = tempfile.mkdtemp(prefix="tickloom-")
    spark.sparkContext.setCheckpointDir(own)
    return f"file://{own}"


def _forget() -> None:
    for spark, path in _MADE:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended first
            continue


atexit.register(_forget)


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here and survives lost executors.

    Nothing after the write reads its shuffles again, so their files are removed as soon as it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tickloom-{name}-{uuid.uuid4().hex}"
    with _settings(spark, **{_CLEANUP: "true", _BATCH: str(batch_rows)}):
        df.write.option("compression", "zstd").parquet(path)
    _MADE.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def placed(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """``columns`` of every row with its place, unique: ``file`` (a hash of its path) and ``row``. What is no plain scan of files is stored first."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return placed(stored(docs.select(*columns), "rows"), "*")
    at = docs.metadataColumn("_metadata")
    return docs.select(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("row"), *columns)


def crc_fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, mod ``folds``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """Texts of an Arrow column as UTF-8 bytes; None stays."""
    return column.cast(pa.binary()).to_pylist()


def steps(texts: list[bytes | None], limit: int = STEP_BYTES) -> Iterator[slice]:
    """Slices of at most ``limit`` bytes, of one text at least."""
    begin = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > limit:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield slice(begin, len(texts))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with per-task state: ``make()`` runs once a task and gives the function for its batches (of BATCH_ROWS, unless the session names a number)."""
    if df.sparkSession.conf.get(_BATCH, None) is None:
        df.sparkSession.conf.set(_BATCH, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            out = step(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


#: One step of the 64-bit mixer used for all hashes here (splitmix64); fixed values.
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 of each uint64."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(_MIX[0])
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
        return x ^ (x >> np.uint64(31))


_BYTE_VALUE = np.random.default_rng(19).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(_MIX[0])
_BASE_INVERSE = np.uint64(pow(_MIX[0], -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), base, np.uint64)]))


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [begin, end) of ``data``: equal spans, equal hashes, wherever they stand."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUE[data] * _powers(_BASE, len(data)))])
        return mix64((prefix[end] - prefix[begin]) * _powers(_BASE_INVERSE, len(data))[begin])


#: ASCII white space of WORD as a table for bytes.translate and lookups.
SPACE_BYTES = bytes([9, 10, 11, 12, 13, 32])
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ALPHA = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return _ALPHA.search(text) is not None
