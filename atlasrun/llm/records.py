"""Length-delimited binary records of token ids, in files with a separate offset index.

A file is records one after the other. A record is its payload's length (unsigned 64-bit), the masked checksum of those
eight bytes (32-bit), the payload, and the masked checksum of the payload (32-bit); all little-endian. The
payload is the document id (signed 64-bit), the bytes of an id (8-bit; 2 if all ids of the file's vocabulary fit, else 4; 128 more
and a document id of 0 if the document has none), and the ids (unsigned). A checksum is CRC-32, rotated right by 15
bits, plus a fixed number, so that checksums of data that holds checksums stay useful. The index beside
each file has three unsigned 64-bit numbers for each record: its byte offset, its length, and the ids before it in the file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut_lineage, ensure_checkpoint_dir
from .common import byte_texts, slices
from .tokens import encoder, SPACED_WORDS

END_ID = 2
#: Documents of a file, about.
FILE_DOCS = 20_000
#: Bytes of a file that are read at a time.
READ_BYTES = 4 << 20
_MASK = 0xA282EAD8  # a fixed value of the format
_HEAD = struct.Struct("<QI")
_DOC = struct.Struct("<qB")
_NO_ID = 128

MANIFEST = "shard long, path string, records long, tokens long, bytes long, index_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def payload_of(doc: int | None, ids: np.ndarray) -> bytes:
    return (_DOC.pack(0, ids.itemsize | _NO_ID) if doc is None else _DOC.pack(doc, ids.itemsize)) + ids.tobytes()


def read_frame(data: memoryview, at: int = 0) -> tuple[bytes, int]:
    """The payload at a place and the place after it; damaged data is an error."""
    size, check = _HEAD.unpack_from(data, at)
    if check != masked(bytes(data[at:at + 8])):
        raise ValueError(f"damaged length at byte {at}")
    at += _HEAD.size
    payload = bytes(data[at:at + size])
    if len(payload) != size or struct.unpack_from("<I", data, at + size)[0] != masked(payload):
        raise ValueError(f"damaged record at byte {at}")
    return payload, at + size + 4


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _writer(folder: str, tokenizer: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _place(folder)
        shard = TaskContext.get().partitionId()
        # Every attempt writes files of its own; the manifest names those of the attempt that Spark accepted.
        name = f"{shard:07d}-{uuid.uuid4().hex}"
        path = f"{root}/{name}"
        known = encoder(tokenizer, SPACED_WORDS)
        wide = 2 if max(known.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        index, at, tokens = [], 0, 0
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{path}.rec") as out:
            for batch in slices(batches, "text"):
                framed = []
                for doc, ids in zip(batch["doc_id"].to_pylist(), known.encode(list(byte_texts(batch["text"])))):
                    numbers = np.append(np.frombuffer(ids, "<u4"), np.uint32(end)).astype(f"<u{wide}")
                    framed.append(frame(payload_of(doc, numbers)))
                    index.append((at, len(framed[-1]), tokens))
                    at, tokens = at + len(framed[-1]), tokens + len(ids) // 4 + 1
                out.write(b"".join(framed))
        packed = np.array(index, "<u8").tobytes()
        with store.open_output_stream(f"{path}.idx") as out:
            out.write(packed)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{folder}/{name}", "records": len(index), "tokens": tokens, "bytes": at, "index_crc32": zlib.crc32(packed)}])

    return run


def write_records(docs: DataFrame, folder: str, tokenizer: str, end: int = END_ID, doc: str = "doc_id", text: str = "text",
                  file_docs: int = FILE_DOCS, without_id: bool = False) -> DataFrame:
    """Encodes whole texts and writes them in ascending order of id; the manifest, one row per file.

    ``folder`` is one that all executors share. Each id sequence ends with ``end``; a null text is empty. Rows are
    range-partitioned, so files are ordered among themselves and inside. Rows with a null id come first
    ``without_id``, else they are not written; rows of one id are all written, one after the other by a hash of the text. An empty table has files without records.

    A task writes files under a name of its own and reports them when done. Only reported files are in
    the manifest, which is kept in the shared checkpoint folder, so retried or doubled tasks leave no trace in it.
    """
    named = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = named if without_id else named.where("doc_id is not null")
    cores = docs.sparkSession.sparkContext.defaultParallelism
    files = cores * max(1, -(-round(named.count() / file_docs) // cores))  # whole rounds of tasks
    # The text's hash parts rows of one id or without one, so that no task gets them all; equal texts of one id may be dealt either way.
    part = F.xxhash64("text")
    ordered = named.withColumn("part", part).repartitionByRange(files, "doc_id", "part").sortWithinPartitions("doc_id", "part", "text").drop("part")
    return cut_lineage(ordered.mapInArrow(_writer(folder, tokenizer, end), MANIFEST))


def _index(store: fs.FileSystem, path: str, crc: int) -> np.ndarray:
    with store.open_input_file(f"{path}.idx") as file:
        data = file.read()
    if zlib.crc32(data) != crc:
        raise ValueError(f"damaged index {path}.idx")
    return np.frombuffer(data, "<u8").reshape(-1, 3)


def _row(payload: bytes, start: int) -> tuple[int | None, int, bytes]:
    doc, wide = _DOC.unpack_from(payload)
    doc, wide = None if wide & _NO_ID else doc, wide & ~_NO_ID
    return doc, start, np.frombuffer(payload, f"<u{wide}", offset=_DOC.size).astype("<u4").tobytes()


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.to_pylist():
            store, path = _place(file["path"])
            index = _index(store, path, file["index_crc32"])
            order = np.arange(len(index))
            if file["seed"] is not None:
                np.random.default_rng([file["seed"], file["shard"]]).shuffle(order)
            with store.open_input_file(f"{path}.rec") as data:
                rows, size, at = [], 0, -1
                for k in order.tolist():
                    offset, length, before = (int(x) for x in index[k])
                    if at != offset:
                        data.seek(offset)
                    payload, _ = read_frame(memoryview(data.read(length)))
                    at = offset + length
                    rows.append(_row(payload, file["base"] + before))
                    size += length
                    if size > READ_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)


def _batch(rows: list[tuple[int | None, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                       pa.array([len(r[2]) // 4 for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
                                      names=["doc_id", "start", "n_tokens", "ids"])


def read_records(manifest: DataFrame, seed: int | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files of a manifest; ``start`` counts the ids of all records before.

    Each file is a task. Every length, record and index is checked. With a ``seed`` the records of each file come in a
    random order by way of its index, and files are dealt to tasks in a random order.
    """
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # a row per file, so this is small
    placed = manifest.select("shard", "path", "index_crc32", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"),
                             F.lit(seed).cast("long").alias("seed"))
    files = manifest.count()
    order = F.col("shard") if seed is None else F.xxhash64("shard", F.lit(seed))
    return placed.repartitionByRange(max(1, files), order).mapInArrow(_reader, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{spark.sparkContext.getCheckpointDir() or ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
