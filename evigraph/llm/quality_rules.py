"""Quality rules with an isolation forest over the rules' statistics.

Every whole text gets rule statistics in one pass of vectorised byte kernels.
Two base rules reject outright (too few words, mostly repeated words). For the
rest an isolation forest, grown by random splits of the statistics of labelled
good rows, gives path lengths; documents that random splits isolate early are
anomalous. The cut on the score is calibrated on labelled rows.

No part of the model comes from a sample. Every labelled good row is dealt to
one tree at least (to more where there are few, so that a tree has about
``Params.tree_rows``), by hashes of id and statistics; a task grows a whole
tree. Centres and spreads come from counts of all rows in narrow bins, the box
from all rows' least and greatest values, and the cut from the scores of all
labelled rows: counts in bins lead to the bin that holds it, and the bin's
scores, which have nine digits, to the exact value. What reaches the driver
(bins, trees of at most ``2 ** limit`` leaves) has a fixed size; a task that
grows a tree holds its share of the rows, the labelled good rows over the
number of trees.

Defined results: a null text has no words and fails the base rules; a very long
text is measured whole; repeated rows are judged alike, and rows of equal scores
fall on the same side of the cut (a tie); an empty table gives an empty result;
without labelled rows of both kinds no document beyond the base rules is
rejected. Extra columns are ignored (or carried through by ``keep_good``),
whatever they are called.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import kernels as K
from .runtime import texts, written

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_digits", "n_marks", "n_lines")
FEATURES = ("symbols_per_word", "marks_per_word", "upper_share", "digit_share", "letter_share", "dup_line_share", "repeat_share", "word_length")


@dataclass(frozen=True)
class Params:
    min_words: int = 50
    repeat_percent: int = 50
    trees: int = 100
    #: About so many rows at least for each tree, if need be by dealing rows to several.
    tree_rows: int = 256
    #: Without effect: once the most labelled rows to fit on, now all are used.
    sample: int = 20_000
    #: Largest share of labelled good rows that the calibrated cut may reject.
    good_loss: float = 0.001
    #: Added to each feature's spread, so that constant features have one.
    least_spread: float = 0.02
    seed: int = 7


def _lut(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL = _lut(SYMBOLS)
_UPPER, _DIGIT = _lut("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _lut("0123456789")
_MARK = _lut("!?~^=_+@\\{}[]`")
_LETTER = _UPPER | _lut("abcdefghijklmnopqrstuvwxyz")
_LETTER[0xC0:] = True
_HEAD = np.ones(256, bool)
_HEAD[0x80:0xC0] = False


def _repeats(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which values occur twice or more in their row; row: each value's row."""
    keys = K.mix(hashes ^ K.mix(row.astype(np.uint64)))
    run = np.sort(keys)
    twice = np.unique(run[1:][run[1:] == run[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def statistics(part: K.Slice) -> dict[str, np.ndarray]:
    """The rule statistics of each row of a slice."""
    data, offsets = part.data, part.offsets
    n = part.last - part.first
    w = K.words(part)
    count = np.diff(w.first)
    solid = ~K.SPACE[data]
    out = {"n_words": count, "word_chars": K.per_row(solid & _HEAD[data], offsets), "n_symbols": K.per_row(_SYMBOL[data], offsets)}
    starts, ends = K.runs(data != 0x0A, offsets)
    line_row = np.searchsorted(offsets, starts, "right") - 1
    full = np.zeros(len(data) + 1, np.int64)
    np.cumsum(solid, out=full[1:])
    keep = full[ends] > full[starts]
    starts, ends, line_row = starts[keep], ends[keep], line_row[keep]
    out["n_lines"] = np.bincount(line_row, minlength=n)
    keys = K.mix(K.span_hashes(data, starts, ends) ^ K.mix(line_row.astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    out["n_dup_lines"] = np.bincount(line_row[same], minlength=n)
    word_row = np.repeat(np.arange(n), count)
    triples = K.windows(w.hashes, 3)
    whole = word_row[: len(triples)] == word_row[2:] if len(triples) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    hit = at[_repeats(triples[at], word_row[at])]
    covered = np.zeros(len(w.hashes) + 1, bool)
    for j in range(3):
        covered[hit + j] = True
    out["n_repeat_words"] = K.per_row(covered[:-1], w.first)
    out["n_upper"], out["n_letters"] = K.per_row(_UPPER[data], offsets), K.per_row(_LETTER[data], offsets)
    out["n_digits"], out["n_marks"] = K.per_row(_DIGIT[data], offsets), K.per_row(_MARK[data], offsets)
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """One row of FEATURES for each row of statistics."""
    s = {k: np.asarray(v, np.float64) for k, v in s.items()}
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    return np.stack(
        [
            s["n_symbols"] / words, s["n_marks"] / words, s["n_upper"] / np.maximum(s["n_letters"], 1), s["n_digits"] / chars, s["n_letters"] / chars,
            s["n_dup_lines"] / np.maximum(s["n_lines"], 1), s["n_repeat_words"] / words, s["word_chars"] / words,
        ],
        axis=1,
    )


def _expected(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, np.float64)
    safe = np.maximum(n, 2.0)
    return np.where(n > 2, 2 * (np.log(safe - 1) + 0.5772156649015329) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays: split feature (-1: leaf), split value, first child (the second follows), path length at a leaf."""

    feature: np.ndarray = field(repr=False)
    value: np.ndarray = field(repr=False)
    child: np.ndarray = field(repr=False)
    depth: np.ndarray = field(repr=False)
    rows: int
    centre: np.ndarray = field(repr=False)
    spread: np.ndarray = field(repr=False)
    cut: float = float("inf")

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1): near 1 when random splits isolate a row early."""
        if not len(self.feature) or not len(x):
            return np.zeros(len(x))
        x = _scaled(x, self.centre, self.spread)
        total = np.zeros(len(x))
        here = np.arange(len(x))
        for f, v, c, d in zip(self.feature, self.value, self.child, self.depth):
            node = np.zeros(len(x), np.int64)
            active = here
            while len(active):
                at = node[active]
                active, at = active[f[at] >= 0], at[f[at] >= 0]
                node[active] = c[at] + (x[active, f[at]] >= v[at])
            total += d[node]
        return np.round(2.0 ** (-total / len(self.feature) / _expected(float(self.rows))), 9)


def _limit(rows: int) -> int:
    """The most levels of a tree."""
    return max(1, int(np.ceil(np.log2(max(rows, 2))))) + 2


def _copies(n: int, params: Params) -> int:
    """To how many trees each of n rows is dealt: the trees form as many blocks, and a row goes to one tree of each."""
    return min(params.trees, max(1, -(-params.trees * params.tree_rows // max(n, 1))))


def _tree(x: np.ndarray, box: np.ndarray, limit: int, rng: np.random.Generator) -> list[np.ndarray]:
    """A tree over the rows of x as flat arrays, as Forest names them.

    Half of the splits fall into the range of a node's own rows, as usual, and
    half into the whole box of the node, which starts as ``box`` (lowest and
    highest value of each feature). So regions that the rows of x leave empty
    are cut off early, although no row of x lies there.
    """
    feature, value, child, depth = [-1], [0.0], [0], [0.0]
    todo = [(0, np.arange(len(x)), 0, box[0], box[1])]
    while todo:
        node, rows, level, low, high = todo.pop()
        own = x[rows]
        if level < limit and len(rows) > 1 and rng.random() < 0.5:
            a, b = own.min(axis=0), own.max(axis=0)
        else:
            a, b = low, high
        open_ = np.flatnonzero(b > a)
        if level >= limit or len(rows) < 2 or not len(open_):
            depth[node] = level + float(_expected(float(len(rows))))
            continue
        f = int(rng.choice(open_, p=(b - a)[open_] / (b - a)[open_].sum()))
        v = rng.uniform(a[f], b[f])
        right = own[:, f] >= v
        feature[node], value[node], child[node] = f, v, len(feature)
        left_high, right_low = high.copy(), low.copy()
        left_high[f] = right_low[f] = v
        todo += [(len(feature), rows[~right], level + 1, low, left_high), (len(feature) + 1, rows[right], level + 1, right_low, high)]
        for flat, empty in ((feature, -1), (value, 0.0), (child, 0), (depth, 0.0)):
            flat += [empty, empty]
    return [np.array(feature, np.int64), np.array(value, np.float64), np.array(child, np.int64), np.array(depth, np.float64)]


def _forest(trees: dict[int, list[np.ndarray]], n: int, centre: np.ndarray, spread: np.ndarray, params: Params) -> Forest:
    """Trees by number as one forest; one without rows is a leaf at its root."""
    size = min(params.tree_rows, n)
    shape = (params.trees if size > 1 else 0, 2 ** (_limit(size) + 1))
    flat = [np.full(shape, -1), np.zeros(shape), np.zeros(shape, np.int64), np.zeros(shape)]
    for t in range(shape[0]):
        for whole, own in zip(flat, trees.get(t, ())):
            whole[t, : len(own)] = own
    return Forest(*flat, size, centre, spread)


def _scaled(x: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.arcsinh((x - centre) / spread)


def grow(x: np.ndarray, box: np.ndarray, params: Params) -> Forest:
    """An isolation forest over rows in memory, every row in one tree at least."""
    rng = np.random.default_rng(params.seed)
    centre = np.median(x, axis=0) if len(x) else np.zeros(x.shape[1])
    spread = (np.quantile(np.abs(x - centre), 0.99, axis=0) if len(x) else 0) + params.least_spread
    x, box = _scaled(x, centre, spread), _scaled(box, centre, spread)
    blocks = _copies(len(x), params)
    trees = {}
    for j in range(blocks):
        own = range(j, params.trees, blocks)
        to = rng.integers(0, len(own), len(x))
        for i, t in enumerate(own):
            trees[t] = _tree(x[to == i], box, _limit(min(params.tree_rows, len(x))), np.random.default_rng((params.seed, t)))
    return _forest(trees, len(x), centre, spread, params)


#: Bins for centres and spreads: as wide as a thousandth of the value, or as a millionth of 1 below a thousandth.
BINS = 1000.0
_X = [f"x{i}" for i in range(len(FEATURES))]


def _scale(rows: DataFrame, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Median of each feature, and the 0.99 quantile of distances from it, by counts of all rows in narrow bins."""
    bins = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.floor(F.asinh(F.col(x) * BINS) * BINS).alias("bin")) for i, x in enumerate(_X)))).alias("b")
    found = rows.select(bins).groupBy("b.f", "b.bin").agg(F.count("*").alias("n")).toPandas()
    centre, spread = np.zeros(len(_X)), np.zeros(len(_X))

    def at(value: np.ndarray, n: np.ndarray, share: float) -> float:
        order = np.argsort(value, kind="stable")
        total = np.cumsum(n[order])
        return float(value[order][np.searchsorted(total, share * total[-1])])

    for i in range(len(_X)):
        own = found[found["f"] == i].sort_values("bin")
        value, n = np.sinh(own["bin"].to_numpy(np.float64) / BINS) / BINS, own["n"].to_numpy(np.int64)
        centre[i] = at(value, n, 0.5)
        spread[i] = at(np.abs(value - centre[i]), n, 0.99)
    return centre, spread + params.least_spread


def _grown(rows: DataFrame, n: int, box: np.ndarray, params: Params) -> Forest:
    """The forest of n labelled rows, each tree grown whole in one task."""
    centre, spread = _scale(rows, params)
    blocks, limit = _copies(n, params), _limit(min(params.tree_rows, n))
    inner = _scaled(box, centre, spread)
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    size = F.floor((F.lit(params.trees - 1) - F.col("block")) / blocks) + 1
    dealt = rows.select("hash_", *_X, block).withColumn("tree", (F.col("block") + blocks * F.pmod(F.xxhash64("hash_", "block"), size)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, []

        def done() -> pa.RecordBatch:
            own = _tree(_scaled(np.concatenate(held), centre, spread), inner, limit, np.random.default_rng((params.seed, number)))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in own)], ["tree", "feature", "value", "child", "depth"])

        for batch in batches:
            tree = batch.column("tree").to_numpy()
            x = np.stack([batch.column(k).to_numpy() for k in _X], axis=1)
            edges = [0, *(np.flatnonzero(np.diff(tree)) + 1).tolist(), len(tree)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    if number is not None and tree[a] != number:
                        yield done()
                        held = []
                    number = int(tree[a])
                    held.append(x[a:b])
        if held:
            yield done()

    parts = dealt.repartition("tree").sortWithinPartitions("tree", "hash_", *_X).mapInArrow(run, "tree int, feature binary, value binary, child binary, depth binary")
    kinds = {"feature": np.int64, "value": np.float64, "child": np.int64, "depth": np.float64}
    return _forest({r["tree"]: [np.frombuffer(r[k], kind) for k, kind in kinds.items()] for r in parts.collect()}, n, centre, spread, params)


def calibrate(scores: DataFrame, n_good: int, params: Params) -> float:
    """The lowest cut that rejects at most good_loss of the labelled good rows, if any labelled bad row lies above it; from all (good, score) rows."""
    rank = min(int(params.good_loss * n_good), n_good - 1)
    good = scores.where("good").withColumn("bin", F.floor(F.col("score") * (1 << 14)))

    def passed(rows: DataFrame, key: str, rank: int) -> tuple[float, int]:
        """The value of key that holds the rank from above, and the rank among its rows."""
        for value, n in sorted(((r[key], r["n"]) for r in rows.groupBy(key).agg(F.count("*").alias("n")).collect()), reverse=True):
            if rank < n:
                return value, rank
            rank -= n
        raise ValueError("rank beyond the rows")

    found, rank = passed(good, "bin", rank)
    cut = float(passed(good.where(F.col("bin") == found), "score", rank)[0])
    above = scores.where(~F.col("good") & (F.col("score") > cut)).agg(F.min("score")).first()[0]
    return float("inf") if above is None else (cut + float(above)) / 2


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the rule statistics of every whole text."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(k, T.LongType()) for k in STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for part in K.slices(batch.column("text")):
                s = statistics(part)
                yield pa.RecordBatch.from_arrays([ids.slice(part.first, part.last - part.first), *(pa.array(s[k], pa.int64()) for k in STATS)], ["doc_id", *STATS])

    return texts(docs).select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def base_failed(s: dict[str, np.ndarray], params: Params) -> np.ndarray:
    return (s["n_words"] < params.min_words) | (100 * s["n_repeat_words"] > params.repeat_percent * s["n_words"])


def _labelled(stats: DataFrame, labels: DataFrame, params: Params) -> DataFrame:
    """(hash_, good, features) of every labelled row that passes the base rules."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality_"))
    rows = stats.join(one, "doc_id").select(F.xxhash64("doc_id", *STATS).alias("hash_"), (F.col("quality_") == 1).alias("good"), *STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = {k: batch.column(k).to_numpy() for k in STATS}
            x = features(s)
            own = pa.RecordBatch.from_arrays([batch.column("hash_"), batch.column("good"), *(pa.array(x[:, i]) for i in range(len(_X)))], ["hash_", "good", *_X])
            yield own.filter(pa.array(~base_failed(s, params)))

    return rows.mapInArrow(run, T.StructType([T.StructField("hash_", T.LongType()), T.StructField("good", T.BooleanType()), *(T.StructField(x, T.DoubleType()) for x in _X)]))


def _scores(rows: DataFrame, forest: Forest) -> DataFrame:
    """(good, score) of labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(forest.score(np.stack([batch.column(k).to_numpy() for k in _X], axis=1)))], ["good", "score"])

    return rows.select("good", *_X).mapInArrow(run, "good boolean, score double")


def fit(stats: DataFrame, labels: DataFrame, params: Params = Params()) -> Forest:
    """Grow the forest and calibrate its cut, on all labelled rows that pass the base rules."""
    rows = written(_labelled(stats, labels, params), "quality-labelled")
    seen = rows.agg(F.count("*").alias("n"), F.count_if("good").alias("good"), *(f(x).alias(f"{x}_{i}") for i, f in enumerate((F.min, F.max)) for x in _X)).first()
    if not seen["n"]:
        return _forest({}, 0, np.zeros(len(_X)), np.ones(len(_X)), params)
    box = np.array([[seen[f"{x}_{i}"] for x in _X] for i in range(2)])
    forest = _grown(rows.where("good"), seen["good"], box, params) if seen["good"] else _grown(rows, seen["n"], box, params)
    if seen["good"] in (0, seen["n"]):
        return forest
    return replace(forest, cut=calibrate(written(_scores(rows, forest), "quality-scores"), seen["good"], params))


_VERDICT = [T.StructField("base_failed", T.BooleanType()), T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())]


def _verdict(s: dict[str, np.ndarray], forest: Forest, params: Params) -> list[pa.Array]:
    failed, score = base_failed(s, params), forest.score(features(s))
    return [pa.array(failed), pa.array(score), pa.array(~failed & (score <= forest.cut))]


def judge(stats: DataFrame, forest: Forest, params: Params = Params()) -> DataFrame:
    """The statistics with base_failed, anomaly score and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = {k: batch.column(k).to_numpy() for k in STATS}
            yield pa.RecordBatch.from_arrays([*batch.columns, *_verdict(s, forest, params)], [*batch.schema.names, "base_failed", "anomaly", "kept"])

    return stats.mapInArrow(run, T.StructType([*stats.schema.fields, *_VERDICT]))


def quality(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, statistics and verdict of each document."""
    stats = written(measured(docs), "quality-stats")
    return judge(stats, fit(stats, labels, params), params)


def keep_good(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of docs, all their columns, that the rules keep."""
    forest = fit(written(measured(docs), "quality-stats"), labels, params)

    # plain names on the way, as the engine's Arrow pass takes no dots in them
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    plain = docs.toDF(*names).withColumn(text, F.col(text).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch.column(text)):
                rows = batch.slice(part.first, part.last - part.first)
                yield rows.filter(_verdict(statistics(part), forest, params)[2])

    return texts(plain).mapInArrow(run, plain.schema).toDF(*docs.columns)
