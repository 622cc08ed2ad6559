"""Token-ID / binary output: tokenised documents in Simple-8b shard files.

A shard file holds, little endian: MAGIC; counts of documents, ids, words and blocks and the block size
(five uint64) and of leading documents without an id (uint64); doc_id (int64) and number of ids (uint32) of each document, in ascending doc_id; the first
word of each block (uint64); the words (uint64).

Documents are dealt by ranges of doc_id, length and a hash of the text and sorted within a range, so shards in order
are the corpus in order, and rows of one id may be in several shards. Each task writes its own file in the shared folder under a name of its own and reports it in a
manifest that Spark commits; a repeated task leaves a file that no manifest names.

Defined results: null text counts as empty (its end id is written); a null doc_id stays null and
comes first; repeated rows are each written, next to each other; an empty table gives no shard and no
rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import simple8b
from riskloom.llm.bpe import WordEncoder
from riskloom.llm.common import column, filesystem, shared_path, shuffle_parts, small_batches, stored, texts

MAGIC = b"RLTOKS8B"
MANIFEST = "shard int, path string, n_docs long, n_ids long, n_bytes long"
_HEAD = struct.Struct("<6Q")
#: ids that are coded at a time: a whole number of blocks, so memory doesn't grow with the shard
FLUSH = 1024 * simple8b.BLOCK


class ShardWriter:
    """Codes ids as they come; holds words and two numbers a document, not ids."""

    def __init__(self, end_id: int):
        self.end = np.array([end_id], "<u4").tobytes()
        self.ids, self.held, self.nulls = [], 0, 0
        self.doc_ids, self.counts, self.words, self.offsets, self.n_words = [], [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids += [ids, self.end]
        self.held += len(ids) // 4 + 1
        self.nulls += doc_id is None
        self.doc_ids.append(doc_id or 0)
        self.counts.append(len(ids) // 4 + 1)
        if self.held >= FLUSH:
            self._code(self.held // simple8b.BLOCK * simple8b.BLOCK)

    def _code(self, n: int) -> None:
        flat = np.frombuffer(b"".join(self.ids), "<u4")
        words, offsets = simple8b.encode(flat[:n])
        self.words.append(words.astype("<u8").tobytes())
        self.offsets.append(offsets + np.uint64(self.n_words))
        self.n_words += len(words)
        self.ids, self.held = [flat[n:].tobytes()], self.held - n

    def chunks(self) -> list[bytes]:
        self._code(self.held)
        offsets = np.concatenate(self.offsets)
        counts = np.array(self.counts, "<u4")
        head = _HEAD.pack(len(counts), int(counts.sum(dtype=np.int64)), self.n_words, len(offsets), simple8b.BLOCK, self.nulls)
        return [MAGIC, head, np.array(self.doc_ids, "<i8").tobytes(), counts.tobytes(), offsets.astype("<u8").tobytes(), *self.words]


class ShardReader:
    def __init__(self, uri: str):
        store, path = filesystem(uri)
        with store.open_input_file(path) as f:
            self.data = f.read()
        if self.data[:8] != MAGIC:
            raise ValueError(f"{uri} isn't a token file")
        self.n_docs, self.n_ids, n_words, n_blocks, self.block, self.nulls = _HEAD.unpack_from(self.data, 8)
        at = 8 + _HEAD.size
        parts = []
        for n, kind in ((self.n_docs, "<i8"), (self.n_docs, "<u4"), (n_blocks, "<u8"), (n_words, "<u8")):
            parts.append(np.frombuffer(self.data, kind, n, at))
            at += parts[-1].nbytes
        self.doc_ids, self.counts, self.offsets, self.words = parts

    def ids(self) -> Iterator[tuple[int, np.ndarray]]:
        """(place of the first id, ids), some blocks at a time."""
        step = FLUSH // self.block
        for k in range(0, len(self.offsets), step):
            lo = int(self.offsets[k])
            hi = int(self.offsets[k + step]) if k + step < len(self.offsets) else len(self.words)
            n = min(step * self.block, self.n_ids - k * self.block)
            yield k * self.block, simple8b.decode(self.words[lo:hi], self.offsets[k : k + 1], n, self.block).astype("<u4")

    def block_of(self, place: int) -> np.ndarray:
        """Ids of the block that holds a place, decoded alone."""
        return simple8b.decode_block(self.words, self.offsets, self.n_ids, place // self.block, self.block)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, parts: int | None = None) -> DataFrame:
    """Writes every document's ids and its end id; returns the manifest, one row per shard file."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    parts = parts or shuffle_parts(spark)
    by_id = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.length("text"), F.xxhash64("text")]  # one id, null too, may have very many rows
    dealt = by_id.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = dealt.select("doc_id", "text", F.spark_partition_id().alias("shard"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shard = writer = None
        for batch in small_batches(batches, "text"):
            if writer is None:
                encoder, writer, shard = WordEncoder(tokenizer), ShardWriter(end_id), column(batch, "shard")[0].as_py()
            for doc_id, ids in zip(column(batch, "doc_id").to_pylist(), encoder.encode(texts(batch))):
                writer.add(doc_id, ids)
        if writer is None:
            return
        uri = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        store, path = filesystem(uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        chunks = writer.chunks()
        with store.open_output_stream(path) as f:
            for c in chunks:
                f.write(c)
        row = ([shard], [uri], [len(writer.counts)], [int(np.sum(writer.counts, dtype=np.int64))], [sum(map(len, chunks))])
        yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1]), *(pa.array(x, pa.int64()) for x in row[2:])], names=["shard", "path", "n_docs", "n_ids", "n_bytes"])

    return stored(dealt.mapInArrow(write, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """Documents of the shard files: doc_id, start (ids of all documents before it), n_tokens and ids
    (little-endian uint32), or with digest ids_crc32 in place of ids."""
    from pyspark.sql import Window

    # one row per shard file: the sum over earlier shards is over files, not documents
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("shard", "path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(column(batch, "path").to_pylist(), column(batch, "base").to_pylist()):
                r = ShardReader(path)
                ends = np.cumsum(r.counts, dtype=np.int64)
                starts = ends - r.counts
                values: list = []
                done, held, held_at = 0, b"", 0
                for at, ids in r.ids():
                    held, to = held + ids.tobytes(), at + len(ids)
                    last = int(np.searchsorted(ends, to, "right"))
                    for a, b in zip((starts[done:last] - held_at).tolist(), (ends[done:last] - held_at).tolist()):
                        raw = held[4 * a : 4 * b]
                        values.append(zlib.crc32(raw) if digest else raw)
                    rows = slice(done, last)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r.doc_ids[rows], mask=np.arange(done, last) < r.nulls), pa.array(starts[rows] + base), pa.array(r.counts[rows].astype(np.int64)), pa.array(values, pa.int64() if digest else pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                    )
                    cut = int(starts[last]) if last < r.n_docs else to
                    held, held_at, done, values = held[4 * (cut - held_at) :], cut, last, []

    parts = shuffle_parts(manifest.sparkSession)
    last = "ids_crc32 long" if digest else "ids binary"
    return files.repartition(parts, "shard").mapInArrow(read, f"doc_id long, start long, n_tokens long, {last}")
