"""Token-id output as bit-plane shuffled binary shards.

Documents are encoded whole with a public vocabulary, an end id is appended,
and the ids go to shard files in ascending doc_id order. A shard is

    b"EVBP0002" | chunk* | index | index length (8 bytes) | b"EVBPEND2"

A chunk holds up to ``block`` ids: the 32 bit planes of the block (plane p: bit
p of every id, packed eight to a byte), each compressed with zstandard; planes
of zeros are left out. The index (little-endian arrays, compressed with zstandard)
lists for each chunk its file offset, its number of ids and the byte size of each
plane, and for each document its id and number of ids, so a reader can seek to
any document.

Ids cross the network once, as the text of a range shuffle on doc_id; there are
so many ranges that each holds about ``range_bytes`` of text. A task starts a new
shard after ``shard_ids`` ids or ``shard_docs`` documents, so neither a file nor its
index grows with the corpus or with the number of partitions. Shards are written
under a name of the task attempt, so a repeated task never touches a finished
file; only files named in the written index table count, and the others are
removed once it is there.

Defined results: a null text is empty and yields the end id alone; a very long
text may fill a shard by itself; rows of equal doc_id follow each other by a hash
of their texts (a tie); repeated rows are written each; doc_ids are integers or
null, nulls first; an empty table gives no rows; other columns are ignored,
whatever they are called.
"""
from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import vocab
from .runtime import fresh_path, listing, remove, texts, written

MAGIC, TAIL = b"EVBP0002", b"EVBPEND2"
BLOCK = 1 << 16
#: Stands for a null doc_id in the index.
NO_ID = -(1 << 63)


def to_planes(ids: np.ndarray) -> list[bytes]:
    """The 32 bit planes of a block of ids; a plane of zeros is empty."""
    ids = np.ascontiguousarray(ids, "<u4")
    bits = np.unpackbits(ids.view(np.uint8).reshape(len(ids), 4), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    return [row.tobytes() if row.any() else b"" for row in packed]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block from its planes."""
    bits = np.zeros((len(planes), n), np.uint8)
    for p, plane in enumerate(planes):
        if plane:
            bits[p] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").reshape(n)


class Writer:
    """Writes one shard to a binary stream; holds at most one block of ids."""

    def __init__(self, out, block: int = BLOCK, level: int = 3) -> None:
        import zstandard

        self.out, self.block = out, block
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.at = out.write(MAGIC)
        #: Offset, number of ids and sizes of the planes of each chunk; doc_id and number of ids of each document.
        self.chunks, self.docs = array("q"), array("q")
        self.n_docs = self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.extend((NO_ID if doc_id is None else doc_id, len(ids)))
        self.n_docs += 1
        self.n_ids += len(ids)
        self.held.append(np.array(ids, np.uint32))
        self.n_held += len(ids)
        if self.n_held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([*self.held, np.zeros(0, np.uint32)])
        end = len(ids) if last else len(ids) // self.block * self.block
        for i in range(0, end, self.block):
            own = ids[i : min(i + self.block, end)]
            planes = [self.pack(p) if p else b"" for p in to_planes(own)]
            self.chunks.extend((self.at, len(own), *map(len, planes)))
            self.at += self.out.write(b"".join(planes))
        self.held, self.n_held = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        parts = [np.array([len(self.chunks), len(self.docs)], "<i8"), np.array(self.chunks, "<i8"), np.array(self.docs, "<i8")]
        index = self.pack(b"".join(p.tobytes() for p in parts))
        self.out.write(index + struct.pack("<Q", len(index)) + TAIL)


class Reader:
    """Reads a shard from a seekable binary stream."""

    def __init__(self, stream, size: int) -> None:
        import zstandard

        self.stream = stream
        self.unpack = zstandard.ZstdDecompressor().decompress
        stream.seek(0)
        if bytes(stream.read(8)) != MAGIC:
            raise ValueError("not a shard")
        stream.seek(size - 16)
        tail = bytes(stream.read(16))
        if tail[8:] != TAIL:
            raise ValueError("shard is cut off")
        (n,) = struct.unpack("<Q", tail[:8])
        stream.seek(size - 16 - n)
        index = np.frombuffer(self.unpack(bytes(stream.read(n))), "<i8")
        self.chunks, self.docs = index[2 : 2 + index[0]].reshape(-1, 34), index[2 + index[0] :].reshape(-1, 2)

    def chunk(self, k: int) -> np.ndarray:
        at, n, *sizes = self.chunks[k].tolist()
        self.stream.seek(at)
        raw = bytes(self.stream.read(sum(sizes)))
        ends = np.cumsum(sizes).tolist()
        return from_planes([self.unpack(raw[e - s : e]) if s else b"" for s, e in zip(sizes, ends)], n)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document's id and token ids in turn; holds the chunks of one document."""
        held, k = np.zeros(0, np.uint32), 0
        for doc_id, n in self.docs.tolist():
            parts = [held]
            have = len(held)
            while have < n:
                parts.append(self.chunk(k))
                have += len(parts[-1])
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield None if doc_id == NO_ID else doc_id, held[:n]
            held = held[n:]


def _filesystem(url: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(url if "://" in url or url.startswith(("/", "file:")) else f"/{url}")


def _as_uri(path: str) -> str:
    return path.replace("file:///", "/").replace("file:/", "/") if path.startswith("file:") else path


@dataclass(frozen=True)
class Sizes:
    block: int = BLOCK
    #: Bytes of text a range, and ids or documents after which a task starts a new shard.
    range_bytes: int = 64 << 20
    shard_ids: int = 1 << 26
    shard_docs: int = 1 << 20


def write_shards(docs: DataFrame, out: str, path: str, end_id: int, sizes: Sizes = Sizes()) -> DataFrame:
    """Encode and write all documents; returns the shard table (order, file, size, documents, ids), written."""
    schema = "part int, piece int, file string, size long, n_docs long, n_ids long"
    folder = _as_uri(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocab.encoder(path, keep_space=False)
        task = TaskContext.get()
        writer = stream = name = None
        piece = 0
        files, base = _filesystem(folder)
        tail = np.array([end_id], np.uint32)

        def closed() -> pa.RecordBatch:
            writer.close()
            stream.close()
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([task.partitionId()], pa.int32()), "piece": pa.array([piece], pa.int32()), "file": [name.removeprefix(base + "/")], "size": [files.get_file_info(name).size], "n_docs": [writer.n_docs], "n_ids": [writer.n_ids]}
            )

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, own in encoder.rows(batch.column("text")):
                if writer is not None and (writer.n_ids >= sizes.shard_ids or writer.n_docs >= sizes.shard_docs):
                    yield closed()
                    writer, piece = None, piece + 1
                if writer is None:
                    files.create_dir(base, recursive=True)
                    name = f"{base}/shard-{task.partitionId():07d}-{piece:05d}-{task.taskAttemptId()}.evbp"
                    stream = files.open_output_stream(name)
                    writer = Writer(stream, sizes.block)
                writer.add(ids[i], np.concatenate([own, tail]))
        if writer is not None:
            yield closed()

    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("key"), text.alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = -(-n_bytes // sizes.range_bytes)
    # the session's own number of ranges, which the engine may lower, does for a smaller corpus
    number = [ranges] if ranges > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    ranged = texts(rows, vocab.SLICE).repartitionByRange(*number, "doc_id", "key").sortWithinPartitions("doc_id", "key").select("doc_id", "text")
    index = written(ranged.mapInArrow(run, schema), "shard-index")
    remove_unnamed(index, out)
    return index


def remove_unnamed(shards: DataFrame, out: str) -> None:
    """Remove files that no row of the index names: what is left of attempts that failed or came second."""
    spark = shards.sparkSession
    named = {r["file"] for r in shards.select("file").toLocalIterator()}  # one name a shard, as in the folder's listing
    for name in listing(spark, out):
        if name.endswith(".evbp") and name not in named:
            remove(spark, f"{out}/{name}")


def read_shards(shards: DataFrame, out: str, id_type: T.DataType = T.LongType()) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    folder = _as_uri(out)
    # one row a shard, so the running total is over a small table
    placed = shards.withColumn("before", F.sum("n_ids").over(Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.select("file", "size", F.coalesce("before", F.lit(0)).cast("long").alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_file(f"{base}/{row['file']}") as stream:
                    start, out_rows = row["before"], []
                    for doc_id, ids in Reader(stream, row["size"]).documents():
                        out_rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(out_rows) == 10_000:
                            yield _rows(out_rows)
                            out_rows = []
                    if out_rows:
                        yield _rows(out_rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.from_numpy_dtype(np.int64)), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = max(1, shards.count())
    return placed.repartition(parts, "file").mapInArrow(run, schema)


def token_table(docs: DataFrame, path: str, end_id: int, sizes: Sizes = Sizes()) -> DataFrame:
    """Write all documents' ids as shards in the shared folder and read them back."""
    out = fresh_path(docs.sparkSession, "token-shards")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return read_shards(write_shards(docs, out, path, end_id, sizes), out)
