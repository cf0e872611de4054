"""Packing token ids into sequences of a fixed length.

A document's ids are cut into full sequences and one remainder. Shortest-pack-
first histogram packing then places the remainders: only the histogram of their
lengths (at most ``length - 1`` numbers) goes to the driver, which takes the
lengths from the longest down and puts each on the pack with the most room left,
counting equal packs as one pattern. Patterns are joined back by rank: the r-th
remainder of a length gets the slot that covers rank r. Packs that stay well
under full are cut at powers of two, where sequences need no padding.

Ranks are global without a global sort: tasks number their own remainders of
each length, and the totals of the tasks before are added.

Defined results: a null text is empty and yields its end id alone; a very long
text is encoded whole and gives as many full sequences as it fills; packs with
equally much room are filled in the order in which they were opened, the last
first (a tie); repeated rows and rows of equal doc_id are packed as separate
documents; an empty table gives no rows; extra columns are ignored, whatever
they are called.
"""
from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import vocab
from .runtime import texts, written


@dataclass(frozen=True)
class Params:
    path: str
    end_id: int = 0
    length: int = 1024
    keep_space: bool = True
    #: Packs with at most this much padding are padded rather than cut.
    slack: int = 8


class Pattern(NamedTuple):
    """Equal packs: how many there are, and the lengths that each holds, in order."""

    count: int
    lengths: tuple[int, ...]


def pack_histogram(histogram: dict[int, int], length: int) -> list[Pattern]:
    """Shortest-pack-first packing of a length histogram; the work depends on the lengths that occur, not on the counts."""
    room: dict[int, list[Pattern]] = defaultdict(list)
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            most = max((r for r, packs in room.items() if packs), default=0)
            if most < size:
                room[length - size].append(Pattern(left, (size,)))
                break
            pack = room[most].pop()
            used = min(left, pack.count)
            if used < pack.count:
                room[most].append(pack._replace(count=pack.count - used))
            room[most - size].append(Pattern(used, (*pack.lengths, size)))
            left -= used
    return sorted((p for packs in room.values() for p in packs), key=lambda p: (-sum(p.lengths), p.lengths))


def cut_points(total: int, length: int, slack: int) -> list[int]:
    """Ends of the sequences that a pack of total ids becomes."""
    if length - total <= slack:
        return [total]
    ends, at = [], 0
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


class Plan(NamedTuple):
    """For each length its slots by rank: first ranks, and (first sequence, sequences a pack, pieces) of each."""

    slots: dict[int, tuple[np.ndarray, list[tuple[int, int, list[tuple[int, int, int, int]]]]]]
    sequences: int


def plan(histogram: dict[int, int], params: Params) -> Plan:
    """Number the sequences of all packs and lay their slots out by rank."""
    starts, slots = defaultdict(list), defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    sequences = 0
    for pattern in pack_histogram(histogram, params.length):
        ends = cut_points(sum(pattern.lengths), params.length, params.slack)
        at = 0
        for own in [(k, n) for k, n in _runs(pattern.lengths)]:
            size, n = own
            for _ in range(n):
                pieces, lo = [], at
                while lo < at + size:
                    k = int(np.searchsorted(ends, lo, "right"))
                    hi = min(ends[k], at + size)
                    pieces.append((lo - at, hi - lo, k, lo - (ends[k - 1] if k else 0)))
                    lo = hi
                starts[size].append(ranks[size])
                slots[size].append((sequences, len(ends), pieces))
                ranks[size] += pattern.count
                at += size
        sequences += pattern.count * len(ends)
    return Plan({k: (np.array(starts[k]), slots[k]) for k in starts}, sequences)


def _runs(lengths: tuple[int, ...]) -> Iterator[tuple[int, int]]:
    """Equal neighbours as (length, how many)."""
    at = 0
    while at < len(lengths):
        end = at
        while end < len(lengths) and lengths[end] == lengths[at]:
            end += 1
        yield lengths[at], end - at
        at = end


def _measured(docs: DataFrame, params: Params, keep_ids: bool) -> DataFrame:
    """Per document: its task, ids of the remainder (or all), checksums of the full sequences, and its task-wide numbers."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("part", T.IntegerType()), T.StructField("doc_tokens", T.LongType()),
            T.StructField("rest", T.IntegerType()), T.StructField("rank", T.LongType()), T.StructField("full_rank", T.LongType()),
            T.StructField("full_crcs", T.ArrayType(T.LongType())), T.StructField("ids", T.BinaryType()),
        ]
    )
    names, length = schema.names, params.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocab.encoder(params.path, params.keep_space)
        part = TaskContext.get().partitionId()
        seen, full = np.zeros(length, np.int64), 0
        tail = np.array([params.end_id], np.uint32)
        for batch in batches:
            column, done = batch.column("doc_id"), 0
            out: list[tuple] = []

            def flush() -> pa.RecordBatch:
                types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                own = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                return pa.RecordBatch.from_arrays([column.slice(done, len(out)), *own], names)

            for _, ids in encoder.rows(batch.column("text")):
                ids = np.concatenate([ids, tail]).astype("<u4")
                n = len(ids) // length
                rest = len(ids) - n * length
                crcs = [zlib.crc32(ids[k * length : (k + 1) * length].tobytes()) for k in range(n)]
                out.append((part, len(ids), rest, int(seen[rest]), full, crcs, (ids if keep_ids else ids[n * length :]).tobytes()))
                seen[rest] += 1
                full += n
                if len(out) == 1000:
                    yield flush()
                    done, out = done + len(out), []
            if out:
                yield flush()

    return texts(docs).select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, params: Params, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, little-endian, with keep_ids)."""
    table = written(_measured(docs, params, keep_ids), "packing")
    counts = table.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.size("full_crcs")).cast("long").alias("n_full"))
    counts = written(counts, "packing-counts")
    histogram = {r["rest"]: r["n"] for r in counts.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    placed = plan(histogram, params)
    # totals of the tasks before: one row a task and length, never one a document; they grow with the tasks, so no broadcast
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = counts.groupBy("part").agg(F.sum("n_full").alias("n_full"))
    tasks = tasks.select("part", F.coalesce(F.sum("n_full").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("full_before"))
    shift = counts.select("part", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("rank_before")).join(tasks, "part")
    joined = table.join(shift.hint("merge"), ["part", "rest"]).select(
        "doc_id", "doc_tokens", "rest", (F.col("rank") + F.col("rank_before")).alias("rank"), (F.col("full_rank") + F.col("full_before")).alias("full_rank"), "full_crcs", "ids"
    )
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(k, T.LongType()) for k in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * keep_ids)
    length = params.length

    def pieces(row: dict) -> Iterator[tuple[int, int, int, int, bytes]]:
        ids, shift_by = row["ids"], 0 if keep_ids else row["doc_tokens"] - row["rest"]
        for k, crc in enumerate(row["full_crcs"]):
            yield k * length, length, crc, placed.sequences + row["full_rank"] + k, 0, ids[4 * k * length : 4 * (k + 1) * length] if keep_ids else b""
        if row["rest"]:
            first = row["doc_tokens"] - row["rest"]
            ranks, slots = placed.slots[row["rest"]]
            at = int(np.searchsorted(ranks, row["rank"], "right")) - 1
            base, each, own = slots[at]
            base += (row["rank"] - int(ranks[at])) * each
            for start, size, k, offset in own:
                raw = ids[4 * (first + start - shift_by) : 4 * (first + start + size - shift_by)]
                yield first + start, size, zlib.crc32(raw), base + k, offset, raw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(batch.schema.names[1:]).to_pylist()
            for first in range(0, len(rows), 1000):
                out = [(first + i, *p, row["doc_tokens"]) for i, row in enumerate(rows[first : first + 1000]) for p in pieces(row)]
                if not out:
                    continue
                at, start, size, crc, sequence, offset, raw, tokens = zip(*out)
                columns = [batch.column("doc_id").take(pa.array(at)), *(pa.array(c, pa.int64()) for c in (start, size, crc, tokens, sequence, offset))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * keep_ids, schema.names)

    return joined.mapInArrow(run, schema)
