"""What the training-data operators share: shared storage, stable hashes and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: ASCII white space of the contracts, [\x20\x09-\x0D]; bytes.split() splits on exactly these.
SPACES = " \t\n\x0b\f\r"
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. It is the cluster's setting; only a session
    without one (tests on one machine) gets a folder of its own."""
    root = spark.conf.get(CHECKPOINT, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT} isn't set, and a folder of one machine can't stand in for it on a cluster")
        root = "file://" + tempfile.mkdtemp(prefix="riskloom-")
        spark.conf.set(CHECKPOINT, root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, records: int | None = None) -> DataFrame:
    """df written to the shared folder and read again: a cut in the lineage that outlives executors. What the write
    shuffled is freed at its end, not when the driver's heap is next collected. records: rows of an Arrow batch at most,
    where a batch of the session's size would hold too much text."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    now = {CLEANUP: "true"} | ({RECORDS: str(records)} if records else {})
    own = {k: spark.conf.get(k, None) for k in now}
    for k, v in now.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in own.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._riskloom_path = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Frees what stored() wrote, once nothing reads it any more."""
    remove(df.sparkSession, df._riskloom_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(uri: str):
    """pyarrow file system and path of a URI; it works on executors for any store pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _S33
    x *= _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


def hash_words(words: Iterable[bytes]) -> np.ndarray:
    """Stable 64-bit hashes of byte strings, the same on every machine."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter(map(h, words), np.uint64)


class WordHasher(dict):
    """Word -> hash with a bounded memo (a memo only: a word that isn't in it is hashed)."""

    def __init__(self, limit: int = 400_000):
        import xxhash

        super().__init__()
        self.limit, self.h = limit, xxhash.xxh3_64_intdigest

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        v = self[w] = self.h(w)
        return v

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Whole texts; null is empty."""
    return [x or "" for x in column(batch, name).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], by: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices with at most about limit bytes of the string column (a single longer text stays whole)."""
    import pyarrow.compute as pc

    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column(b, by)), 0).to_numpy(zero_copy_only=False), np.int64))
        at = 0
        while at < b.num_rows:
            before = int(size[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + limit, "right")))
            yield b.slice(at, to - at)
            at = to


def shuffle_parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lower_ascii(col):
    """A-Z to a-z only."""
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(col, up, up.lower())
