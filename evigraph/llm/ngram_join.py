"""N-gram Jaccard self-join by vertical partitioning, and its components.

A text's set holds its distinct k-word shingles (64-bit hashes of lower-cased
words). Two texts link when their sets' Jaccard similarity reaches the threshold.

1. One global order of all shingles: by how common they are, then by hash. How
   common comes from a counting sketch of fixed size over all texts; any order
   gives exact results, this one keeps common passages out of the prefixes.
   The order is cut into fragments that hold about equally many shingles, so
   each set is cut vertically: one segment a fragment.
2. Equal sets are joined by fingerprint; one row a set goes on.
3. Linked sets share a shingle in their prefixes (the first quarter of the
   order, so mostly the first fragments). The prefix shingles that two or more
   sets hold form buckets.
4. Sets that share much of their prefix with a bucket's first set (a star) are
   checked against it, and the links found give first components. What is left to
   check are the pairs of a bucket that lie in different components.
5. Of a bucket's pairs only those count for which its shingle can be the first
   that they share: what each set has from there on in the order must hold the
   overlap that both sizes need. A passage that many texts share stands late in
   the order, where texts that do not link have too little left; so it gives no
   pairs. Partial overlaps in the prefixes are counted by fragment and summed per
   pair, and pairs that can no longer reach the threshold are dropped. Buckets
   with many members are compared by bitmaps whose popcounts bound the overlap
   from above; buckets of equal members are compared once.
6. For the pairs that remain partial overlaps are counted fragment by fragment
   and summed per pair; the sums decide.

Every step that could drop a pair uses a bound that no linked pair violates, so
no link between different texts is lost; pairs inside a component are not
listed. Nothing that grows with the input reaches the driver: the sketch and a
filter on candidate ids have fixed sizes.

A set's node in the graph of links is its least doc_id; where ids are no integers,
or one id has several texts, it is a 64-bit hash of the set's fingerprint.

Defined results: a null or empty text has no shingles and is linked with
nothing; with fewer than k words the whole sequence is one shingle; a very long
text is one set like any other; rows of one doc_id are one node for ``linked``,
and texts of their own for ``keep_one``; of equal texts the least doc_id stands
for all (a tie); a null doc_id is no node but shows its set's component; ids of
any ordered type are taken; an empty table gives no rows; other columns are
ignored (or carried through by ``keep_one``), whatever they are called.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.components import components
from . import kernels as K
from .runtime import Scratch, free_name, texts, written


@dataclass(frozen=True)
class Params:
    k: int = 5
    #: The threshold as a fraction.
    over: int = 3
    under: int = 4
    sketch_bits: int = 21
    filter_bits: int = 23
    fragments: int = 4
    #: Buckets with more members are compared by blocks of this many.
    large: int = 128
    block: int = 1024
    #: A shingle that is this common, and this many times as common as the mean, is dealt to several tasks.
    hot: int = 1 << 20
    hot_times: int = 64

    def prefix(self, size):
        return size - -(-self.over * size // self.under) + 1

    def prefix_column(self, size):
        return size - F.ceil(self.over * size / self.under) + 1

    def needed(self, total):
        """Least overlap of linked sets whose sizes add up to total."""
        return -(-self.over * total // (self.over + self.under))


CHUNK = 1 << 16
_LOW28 = (1 << 28) - 1


def shingle_sets(part: K.Slice, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    w = K.words(part, lower=True)
    first = w.first.tolist()
    grams = K.windows(w.hashes, k)
    short = {n: K.windows(w.hashes, n) for n in range(1, k)}
    for a, b in zip(first, first[1:]):
        if b - a >= k:
            own = np.sort(grams[a : b - k + 1])
            fresh = np.ones(len(own), bool)
            fresh[1:] = own[1:] != own[:-1]
            yield own[fresh]
        elif b > a:
            yield short[b - a][a : a + 1]
        else:
            yield np.zeros(0, np.uint64)


def _texts(docs: DataFrame, *more) -> DataFrame:
    return texts(docs).select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), *more)


def _text_key():
    return F.xxhash64(F.col("text").cast("string"))


class Order(NamedTuple):
    """The global order; its size is fixed.

    A commonness level for each hash cell (about twice the binary logarithm of its
    count), the borders of the fragments, and by level to how many tasks a shingle is dealt.
    """

    levels: np.ndarray
    borders: np.ndarray
    tasks: np.ndarray


def sketch(docs: DataFrame, params: Params) -> Order:
    """The global order from counts of all shingles."""
    cells = 1 << params.sketch_bits
    schema = "part int, chunk int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.uint32)
        for batch in batches:
            for part in K.slices(batch.column("text")):
                own = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(part, params.k)])
                total += np.bincount((own & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint32)
        yield from rows(TaskContext.get().partitionId() // 64, {c: total[c * CHUNK : (c + 1) * CHUNK] for c in range(-(-cells // CHUNK))})

    def rows(part: int, chunks: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for c, own in chunks.items():
            # small counts travel as single bytes
            raw = own.astype(np.uint8).tobytes() if own.max(initial=0) < 256 else own.astype(np.uint32).tobytes()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "chunk": pa.array([c], pa.int32()), "counts": pa.array([raw], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        size = min(CHUNK, cells)
        for batch in batches:
            for c, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                own = np.frombuffer(raw, np.uint8 if len(raw) == size else np.uint32).astype(np.uint32)
                totals[c] = totals[c] + own if c in totals else own
        yield from rows(0, totals)

    partial = _texts(docs).select("text").mapInArrow(count, schema)
    # sums of 64 tasks, then of all; a task holds a few chunks
    groups = partial.repartition("part", "chunk").mapInArrow(add, schema)
    total = np.zeros(cells, np.uint64)
    for row in groups.repartition("chunk").mapInArrow(add, schema).select("chunk", "counts").toLocalIterator():
        size = min(CHUNK, cells)
        total[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] += np.frombuffer(row["counts"], np.uint8 if len(row["counts"]) == size else np.uint32)
    levels = np.minimum(np.floor(2 * np.log2(total + 1.0)), 126).astype(np.uint8)
    hot = max(params.hot, params.hot_times * float(total.mean()))
    tasks = np.clip(np.ceil(2.0 ** (np.arange(127) / 2) / hot), 1, 127).astype(np.int64)
    return Order(levels, _borders(np.bincount(levels, total.astype(np.float64), 127), params.fragments), tasks)


def _borders(mass: np.ndarray, fragments: int) -> np.ndarray:
    """Places that cut the global order into fragments of about equal mass: hashes spread evenly within a level."""
    before = np.concatenate([[0.0], np.cumsum(mass)])
    out = []
    for f in range(1, fragments):
        want = before[-1] * f / fragments
        level = min(int(np.searchsorted(before, want, "right")) - 1, len(mass) - 1)
        inside = (want - before[level]) / mass[level] if mass[level] else 0.0
        out.append((level << 56) + min(int(inside * (1 << 56)), (1 << 56) - 1))
    return np.array(out, np.int64)


def _ranks(own: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Places of shingles in the global order, as signed 64-bit numbers."""
    level = levels[(own & np.uint64(len(levels) - 1)).astype(np.int64)]
    return ((level.astype(np.uint64) << np.uint64(56)) | (own >> np.uint64(8))).astype(np.int64)


def records(docs: DataFrame, order: Order, params: Params) -> DataFrame:
    """Per row: id, hash of the text, set size, fingerprint of the set, and the prefix shingles in order."""
    schema = T.StructType([T.StructField("id", docs.schema["doc_id"].dataType), *(T.StructField(k, t) for k, t in (("text_key", T.LongType()), ("size", T.IntegerType()), ("print", T.BinaryType()), ("prefix", T.ArrayType(T.LongType()))))])
    shared = docs.sparkSession.sparkContext.broadcast(order.levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch.column("text")):
                sizes, prints, prefixes = [], [], [np.zeros(0, np.uint64)]
                for own in shingle_sets(part, params.k):
                    sizes.append(len(own))
                    prints.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    if len(own):
                        prefixes.append(own[np.argsort(_ranks(own, shared.value), kind="stable")[: params.prefix(len(own))]])
                    else:
                        prefixes.append(own)
                ends = np.cumsum([len(x) for x in prefixes]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes).view(np.int64)))
                rows = batch.slice(part.first, part.last - part.first)
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("text_key"), pa.array(sizes, pa.int32()), pa.array(prints, pa.binary()), lists], schema.names)

    return _texts(docs, _text_key().alias("text_key")).mapInArrow(run, schema)


def _exploded(sets: DataFrame, order: Order) -> DataFrame:
    """(token, node, place) for each prefix shingle of a set; place packs a hot shingle's task (from 1), the set's size, and what it has from the shingle on."""
    shared = sets.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                lists = part.column("prefix")
                tokens, ends = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
                at = np.repeat(np.arange(part.num_rows), ends)
                inside = np.arange(len(at)) - np.repeat(np.cumsum(ends) - ends, ends)
                node, size = part.column("node").to_numpy()[at], part.column("size").to_numpy()[at].astype(np.int64)
                own = shared.value
                tasks = own.tasks[own.levels[tokens & (len(own.levels) - 1)]]
                task = np.where(tasks > 1, 1 + K.mix(node.view(np.uint64)).astype(np.int64) % tasks, 0)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(node), pa.array((task << 56) | (size << 28) | (size - inside))], ["token", "node", "place"])

    return sets.select("node", "size", "prefix").mapInArrow(run, "token long, node long, place long")


def buckets(sets: DataFrame, order: Order) -> DataFrame:
    """(token, node, size, rest, hub) of the prefix shingles that two or more sets hold, and of hot ones.

    rest is what a set has from the shingle on in the global order. The hub is the
    least node of the bucket, or of a task's part of it: a hot shingle is dealt to several tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # first row of a run whose second has not come yet
        last = hub = None  # (token, task) of the run under way
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(3)]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            held = None
            t, nodes, place = cols
            if not len(t):
                continue
            task = place >> 56
            fresh = np.ones(len(t), bool)
            fresh[1:] = (t[1:] != t[:-1]) | (task[1:] != task[:-1])
            goes_on = last == (t[0], task[0])
            run_of = np.cumsum(fresh) - 1
            starts = np.flatnonzero(fresh)
            length = np.diff(np.append(starts, len(t)))
            hubs = nodes[starts]
            keep = (length > 1) | (task[starts] > 0)
            if goes_on:
                hubs, keep[0] = hubs.copy(), True
                hubs[0] = hub
            if not keep[-1]:
                held = [c[-1:] for c in cols]
                last = hub = None
            else:
                last, hub = (t[-1], task[-1]), hubs[-1]
            rows = np.flatnonzero(keep[run_of])
            if len(rows):
                size, rest = (place[rows] >> 28) & _LOW28, place[rows] & _LOW28
                yield pa.RecordBatch.from_arrays([pa.array(t[rows]), pa.array(nodes[rows]), pa.array(size.astype(np.int32)), pa.array(rest.astype(np.int32)), pa.array(hubs[run_of[rows]])], ["token", "node", "size", "rest", "hub"])

    task = F.shiftright("place", 56)
    dealt = _exploded(sets, order).repartition("token", task).sortWithinPartitions("token", task, "node")
    return dealt.mapInArrow(run, "token long, node long, size int, rest int, hub long")


def _bit(id, params: Params):
    return F.pmod(F.xxhash64(id.cast("string")), F.lit(1 << params.filter_bits))


def _id_filter(ids: DataFrame, params: Params) -> np.ndarray:
    """A bit set of fixed size that holds all ids; others may slip through."""
    bit = _bit(F.col("id"), params)
    rows = ids.select(F.floor(bit / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros((1 << params.filter_bits) // 64, np.int64)
    for row in rows.collect():  # at most one a word of the bit set
        out[row["word"]] = row["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def segments(docs: DataFrame, nodes: DataFrame, sets: DataFrame, order: Order, params: Params) -> DataFrame:
    """(node, size, fragment, tokens): the whole sets of the given nodes, cut into fragments of the global order.

    Texts of other ids are passed over before they are read into shingles.
    """
    schema = "print binary, size int, fragment int, tokens binary"
    wanted = sets.select("node", "print", "id").join(nodes.distinct().hint("merge"), "node", "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast((_id_filter(wanted.select("id"), params), order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, order = shared.value
        for batch in batches:
            batch = batch.filter(pa.array(listed[batch.column("bit").to_numpy()]))
            for part in K.slices(batch.column("text")):
                out: list[tuple] = []
                for own in shingle_sets(part, params.k):
                    if not len(own):
                        continue
                    mark = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    of = np.searchsorted(order.borders, _ranks(own, order.levels), "right")
                    by = np.argsort(of, kind="stable")  # in each fragment by hash
                    cuts = np.searchsorted(of[by], np.arange(params.fragments + 1)).tolist()
                    out += [(mark, len(own), f, own[by[a:b]].tobytes()) for f, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                if out:
                    types = (pa.binary(), pa.int32(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["print", "size", "fragment", "tokens"])

    bit = _bit(F.col("doc_id"), params).cast("int").alias("bit")
    cut = _texts(docs, bit).where("id is not null").select("text", "bit").mapInArrow(run, schema)
    # one row of each set: equal texts of other ids may have passed the filter
    named = cut.join(wanted.select("print", "node").hint("merge"), "print")
    return named.groupBy("node", "fragment").agg(F.max(F.struct("size", "tokens")).alias("s")).select("node", "fragment", "s.*")


def verified(docs: DataFrame, pairs: DataFrame, sets: DataFrame, order: Order, params: Params, scratch: Scratch) -> DataFrame:
    """Of the pairs (a, b) those that link: partial overlaps by fragment, summed per pair."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    own = scratch.written(segments(docs, ends, sets, order, params), "ngram-segments")
    side = lambda c: own.select(F.col("node").alias(c), "fragment", *(F.col(x).alias(f"{x}_{c}") for x in ("size", "tokens")))
    both = pairs.join(side("a"), "a").join(side("b"), ["b", "fragment"])
    names = ["a", "b", "size_a", "size_b", "fragment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [
                len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True))
                for x, y in zip(batch.column("tokens_a"), batch.column("tokens_b"))
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(shared, pa.int32())], [*names, "shared"])

    partial = both.select(*names, "tokens_a", "tokens_b").mapInArrow(run, "a long, b long, size_a int, size_b int, fragment int, shared int")
    summed = partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("shared").alias("shared"))
    links = summed.where((params.over + params.under) * F.col("shared") >= params.over * (F.col("size_a").cast("long") + F.col("size_b")))
    return links.select("a", "b")


def _near_sizes(params: Params):
    return params.under * F.least("size_a", "size_b").cast("long") >= params.over * F.greatest("size_a", "size_b")


def _first_shared(params: Params):
    """Whether a bucket's shingle can be the first that a linked pair shares: both sets have enough from there on."""
    return (params.over + params.under) * F.least("rest_a", "rest_b").cast("long") >= params.over * (F.col("size_a").cast("long") + F.col("size_b"))


def _listed(members: DataFrame, crowded: DataFrame, params: Params) -> DataFrame:
    """Pairs of small buckets in different components whose summed partial overlaps can still reach the threshold.

    crowded: (node, many), how many prefix shingles of a set lie in large buckets, which are not counted here.
    """
    side = lambda c: members.select("token", *(F.col(x).alias(f"{x}_{c}") for x in ("node", "size", "rest", "component")))
    pairs = side("a").join(side("b"), "token").where((F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & _near_sizes(params))
    keys = ["node_a", "node_b", "size_a", "size_b"]
    summed = pairs.groupBy(*keys).agg(F.count("*").alias("shared"), F.max(_first_shared(params)).alias("first")).where("first")
    for c in ("a", "b"):
        summed = summed.join(crowded.select(F.col("node").alias(f"node_{c}"), F.col("many").alias(f"many_{c}")).hint("merge"), f"node_{c}", "left")
    counted = F.col("shared") + F.least(F.coalesce("many_a", F.lit(0)), F.coalesce("many_b", F.lit(0)))
    # beyond the end of the prefix that ends first in the order, at most the rest of that set is shared
    rest = F.greatest(*(F.col(f"size_{c}") - params.prefix_column(F.col(f"size_{c}")) for c in ("a", "b")))
    total = params.over + params.under
    return summed.where(total * (counted + rest) >= params.over * (F.col("size_a").cast("long") + F.col("size_b"))).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """A bitmap of a set, 8 to 16 bits a member: its bits that another set's lacks count members that the other lacks."""
    bits = 1 << max(6, (8 * len(tokens) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def _folded(maps: list[np.ndarray], words: int) -> np.ndarray:
    """Bitmaps as rows of the given number of words; longer ones are folded, which keeps the bound."""
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, words), axis=0) for m in maps])


def compare_blocks(a: tuple, b: tuple, params: Params, same: bool) -> Iterator[tuple[int, int]]:
    """Index pairs of two blocks (sizes, rests, components, bitmaps) whose overlap bound reaches the threshold."""
    for wa in sorted({len(m) for m in a[3]}):
        ia = [i for i, m in enumerate(a[3]) if len(m) == wa]
        for wb in (wa // 2, wa, wa * 2):
            ib = np.array([j for j, m in enumerate(b[3]) if len(m) == wb], np.int64)
            if not len(ib):
                continue
            words = min(wa, wb)
            mb = _folded([b[3][j] for j in ib], words)
            sb, rb, cb = b[0][ib], b[1][ib], b[2][ib]
            for i in ia:
                s = int(a[0][i])
                need = params.needed(s + sb)
                ok = (cb != a[2][i]) & (params.under * np.minimum(sb, s) >= params.over * np.maximum(sb, s)) & (np.minimum(rb, a[1][i]) >= need)
                if same:
                    ok &= ib > i
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                ma = _folded([a[3][i]], words)[0]
                lack_a = np.bitwise_count(ma & ~mb[at]).sum(axis=1, dtype=np.int64)
                lack_b = np.bitwise_count(mb[at] & ~ma).sum(axis=1, dtype=np.int64)
                most = np.minimum(s - lack_a, sb[at] - lack_b)
                for j in at[most >= need[at]]:
                    yield i, int(ib[j])


def _blocked(docs: DataFrame, members: DataFrame, sets: DataFrame, order: Order, params: Params, scratch: Scratch) -> DataFrame:
    """Pairs of large buckets in different components that bitmaps cannot rule out."""
    # a passage gives many buckets of equal members: the earliest in the order stands for them, as pairs share them all
    marks = members.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"), F.min(F.struct("node", "rest")).alias("least"))
    first = marks.groupBy("n", "mark").agg(F.max_by("token", F.struct("least.rest", "token")).alias("token")).select("token", "n")
    own = members.join(first.hint("merge"), "token")
    # sizes of linked sets differ by at most one class
    step = math.log(params.under / params.over)
    level = F.floor(F.log(F.col("size")) / step).cast("int")
    cells = own.select("token", "node", "size", "rest", "component", F.explode(F.array(level, level + 1)).alias("class"))
    blocks = cells.groupBy("token", "class").agg(F.ceil(F.count("*") / params.block).cast("int").alias("blocks"), F.max("rest").alias("most"), F.min("size").alias("least"), F.count("*").alias("n"))
    # classes in which even the longest rest is too short for two sets of the least size hold no first shared shingle
    blocks = blocks.where((F.col("n") > 1) & ((params.over + params.under) * F.col("most").cast("long") >= 2 * params.over * F.col("least"))).drop("most", "least", "n")
    cells = scratch.written(cells.join(blocks.hint("merge"), ["token", "class"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "ngram-cells")
    maps = _bitmaps(segments(docs, cells.select("node"), sets, order, params))
    cells = cells.join(maps.hint("merge"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("token", "class", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "size", "rest", "component", "bits")

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        low = table.column("low")[0].as_py()
        block = table.column("block").to_numpy()
        ids, sizes, rests, parts = (table.column(c).to_numpy() for c in ("node", "size", "rest", "component"))
        maps = [np.frombuffer(x, np.uint64) for x in table.column("bits").to_pylist()]
        same = table.column("high")[0].as_py() == low
        sides = [np.flatnonzero(block == low)] * 2 if same else [np.flatnonzero(block == low), np.flatnonzero(block != low)]
        a, b = ((sizes[s].astype(np.int64), rests[s].astype(np.int64), parts[s], [maps[k] for k in s]) for s in sides)
        for i, j in compare_blocks(a, b, params, same):
            x, y = int(ids[sides[0][i]]), int(ids[sides[1][j]])
            out.append((min(x, y), max(x, y)))
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return cells.groupBy("token", "class", "low", "high").applyInArrow(run, "a long, b long").where("a < b").distinct()


def _bitmaps(sets: DataFrame) -> DataFrame:
    """A bitmap of each whole set."""

    def run(table: pa.Table) -> pa.Table:
        tokens = np.frombuffer(b"".join(table.column("tokens").to_pylist()), np.uint64)
        return pa.table({"node": table.column("node")[:1], "bits": pa.array([bitmap(tokens).tobytes()], pa.binary())})

    return sets.select("node", "tokens").groupBy("node").applyInArrow(run, "node long, bits binary")


def _several(full: DataFrame) -> DataFrame:
    """Ids of more than one set, with the least of their prints."""
    return full.groupBy("id").agg(F.min("print").alias("p0"), F.max("print").alias("p1")).where("p0 <> p1").select("id", "p0")


def _sets(full: DataFrame) -> DataFrame:
    """One row of each set: print, its least id, size, prefix, and its node."""
    sets = full.groupBy("print").agg(F.min(F.struct("id", "size", "prefix")).alias("s")).select("print", "s.*")
    hashed = F.xxhash64("print")
    if not isinstance(full.schema["id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return sets.withColumn("node", hashed)
    named = sets.join(_several(full).hint("merge"), "id", "left")
    return named.withColumn("node", F.when(F.col("p0").isNull() | (F.col("p0") == F.col("print")), F.col("id").cast("long")).otherwise(hashed)).drop("p0")


def _same_id(full: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the sets of one id."""
    pairs = full.select("id", "print").join(_several(full).hint("merge"), "id").where("print <> p0").select("p0", "print").distinct()
    node = lambda key, out: sets.select(F.col("print").alias(key), F.col("node").alias(out)).hint("merge")
    return pairs.join(node("p0", "a"), "p0").join(node("print", "b"), "print").select("a", "b")


def candidates(docs: DataFrame, sets: DataFrame, found: DataFrame, first: DataFrame, order: Order, params: Params, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of buckets in different components that may link."""
    labelled = found.join(first.hint("merge"), "node", "left").select("token", "node", "size", "rest", F.coalesce("component", "node").alias("component"))
    open_ = labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")).where("low < high")
    left = scratch.written(labelled.join(open_.select("token", "members").hint("merge"), "token"), "ngram-open")
    crowd = left.where(F.col("members") > params.large)
    pairs = _listed(left.where(F.col("members") <= params.large), crowd.groupBy("node").agg(F.count("*").alias("many")), params)
    return pairs.unionByName(_blocked(docs, crowd, sets, order, params, scratch)).distinct()


def clusters(docs: DataFrame, params: Params = Params(), by_id: bool = True) -> tuple[DataFrame, DataFrame]:
    """(id, text_key, size, print) of every row, and (print, component, least) of every set: a node for all sets that it reaches by links, and their least id.

    by_id: texts of one id are linked as well.
    """
    order, scratch = sketch(docs, params), Scratch()
    rows = written(records(docs, order, params), "ngram-records")
    full = rows.where("size > 0 and id is not null")
    sets = scratch.written(_sets(full), "ngram-set-rows")
    found = scratch.written(buckets(sets, order), "ngram-buckets")
    # a first guess only, so few are tried: sets that share a third of their prefix with one hub, and are of a like size
    near = found.where("node <> hub").groupBy("hub", "node", "size").agg(F.count("*").alias("n")).where(3 * F.col("n") >= params.prefix_column(F.col("size")))
    near = near.join(sets.select(F.col("node").alias("hub"), F.col("size").alias("size_b")).hint("merge"), "hub").withColumnRenamed("size", "size_a").where(_near_sizes(params))
    star = scratch.written(near.select(F.col("hub").alias("a"), F.col("node").alias("b")), "ngram-star")
    links = verified(docs, star, sets, order, params, scratch)
    if by_id:
        links = links.unionByName(_same_id(full, sets))
    first = scratch.written(components(scratch.written(links, "ngram-links")), "ngram-first")
    pairs = scratch.written(candidates(docs, sets, found, first, order, params, scratch), "ngram-pairs")
    more = scratch.written(verified(docs, pairs, sets, order, params, scratch), "ngram-more")
    last = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = scratch.written(sets.select("print", "node", "id").join(last.hint("merge"), "node", "left").select("print", "id", F.coalesce("component", "node").alias("component")), "ngram-nodes")
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    named = written(named.join(least.hint("merge"), "component").select("print", "component", "least"), "ngram-named")
    scratch.clear()
    return rows.select("id", "text_key", "size", "print"), named


def linked(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    rows, named = clusters(docs, params)
    return rows.join(named.hint("merge"), "print", "left").select(F.col("id").alias("doc_id"), F.col("size").cast("long").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def keep_one(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """docs, all columns, with one row of each component of texts: that of the least doc_id, then of the least hash of its text.

    Rows of one doc_id with different texts are judged each by its own text.
    Of rows with equal doc_id and text one stays: the least of all its columns in
    their order (of types without an order, any). Rows without a doc_id or without
    words stay, but for such repetitions.
    """
    rows, named = clusters(docs, params, by_id=False)
    # of each (id, text): whether another stands for it (2), or it occurs more than once (1)
    places = rows.where("id is not null").join(named.select("print", "component").hint("merge"), "print", "left")
    places = written(places.groupBy("id", "text_key").agg(F.min("component").alias("component"), F.count("*").alias("n")), "ngram-places")
    chosen = places.where("component is not null").groupBy("component").agg(F.min(F.struct("id", "text_key")).alias("best"))
    marks = places.join(chosen.hint("merge"), "component", "left")
    mark = F.when(F.col("best.id").isNotNull() & ~((F.col("id") == F.col("best.id")) & (F.col("text_key") == F.col("best.text_key"))), 2).when(F.col("n") > 1, 1)
    marks = written(marks.select("id", "text_key", mark.alias("mark")).where("mark is not null"), "ngram-marks")
    key, node, node_key, found = (free_name(docs, x) for x in ("text_key", "node", "node_key", "mark"))
    left = docs.withColumn(key, F.coalesce(_text_key(), F.lit(0)))
    right = marks.select(F.col("id").alias(node), F.coalesce("text_key", F.lit(0)).alias(node_key), F.col("mark").alias(found))
    # always a merge join: the marks grow with the corpus, so they are never broadcast
    # null-safe, though marks hold no null, so that both readers of the join share one exchange
    both = left.join(right.hint("merge"), F.col("doc_id").eqNullSafe(F.col(node)) & F.col(key).eqNullSafe(F.col(node_key)), "left")
    own = [F.col(f"`{x}`") for x in docs.columns]
    once = both.where(F.col(found).isNull()).select(*own)
    again = both.where(F.col(found) == 1).groupBy("doc_id", key)
    whole = F.struct(*own)
    try:
        one = again.agg(F.min(whole).alias(found))
    except AnalysisException:  # a type without an order
        one = again.agg(F.first(whole).alias(found))
    return once.unionByName(one.select(f"{found}.*"))
