"""Language-model scoring by masked pseudo-likelihood.

Words are counted over the whole corpus. The commonest get ids of their own; the
others share hashed buckets. A small network, written and trained in numpy,
predicts a masked token from the tokens of a window on both sides: embeddings
for each window position are summed, squashed, and fed to a two-level softmax
(class, then token in the class).

Training goes in rounds; a round masks one position in ``mask_every`` of every
document, and the rounds of an epoch cover all positions. Documents are dealt to
shards by a hash of id and text, so many that each holds about ``shard_tokens``
tokens; every shard trains from the same weights in an order of its own hashes,
and after each round the weights of all shards are averaged, weighted by tokens
and summed in the order of shards. So neither files, partitions nor the order in
which tasks end change the model.

A document's score sums, over all its tokens, the log-probability of the token
given both sides; a bucket's token adds the log of its word's share of the
bucket's occurrences. The counts of all words stay a table, and the words of the
texts outside the vocabulary are joined with it; a word that the corpus lacks
counts as one occurrence. Tasks that score hold the counts of the commonest of
these words in a table of a fixed size, so only the others cross the network.

What tasks hand on grows with the corpus (word counts, ids, one set of weights a
shard and round, words to be joined); what reaches the driver has a fixed size
(the vocabulary, bucket sizes, counts of common words, one set of weights a round). The sizes of the
vocabulary and the network are parameters.

Defined results: a null or empty text has no tokens, log-probability 0 and a
null mean; a very long text is one row of its shard and scored whole; repeated
rows score alike up to the rounding of 32-bit sums (some 1e-6 a token), and words that are equally common get their ids by hash (a
tie); an empty table gives no rows; other columns are ignored, whatever they
are called.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernels as K
from .runtime import fresh_path, texts, written


@dataclass(frozen=True)
class Params:
    own: int = 1024
    buckets: int = 1024
    classes: int = 64
    window: int = 2
    width: int = 24
    mask_every: int = 4
    batch: int = 8192
    rate: float = 0.15
    epochs: int = 1
    #: About so many tokens train together between two averages.
    shard_tokens: int = 1 << 20
    seed: int = 11

    @property
    def tokens(self) -> int:
        return self.own + self.buckets

    @property
    def shapes(self) -> dict[str, tuple[int, ...]]:
        each = self.tokens // self.classes
        return {
            "embed": (2 * self.window, self.tokens + 1, self.width), "class_w": (self.classes, self.width), "class_b": (self.classes,),
            "token_w": (self.classes, each, self.width), "token_b": (self.classes, each),
        }


Weights = dict[str, np.ndarray]
CHUNK = 1 << 15
#: Parts of one in which logs of counts are summed.
FINE = 1_000_000_000
#: The most words whose counts tasks hold when they score, and the places of the table for them; all others are joined.
COMMON, PLACES = 1 << 17, 1 << 19


@dataclass(frozen=True)
class Vocabulary:
    """Sorted hashes of the words with ids of their own, their ids, logs of the buckets' occurrences, and where the counts of all words lie."""

    hashes: np.ndarray
    ids: np.ndarray
    penalty: np.ndarray
    counts: np.ndarray
    own: int
    words: str = ""

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        out = self.own + ((hashes >> np.uint64(20)) % np.uint64(len(self.penalty))).astype(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[at] == hashes
            out[known] = self.ids[at[known]]
        return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word hash, count) over all documents; tasks add up their own counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([h[1] for h in held]), len(keys)).astype(np.int64)

        for batch in batches:
            for part in K.slices(batch.column("text")):
                keys, n = np.unique(K.words(part, lower=True).hashes, return_counts=True)
                held.append((keys, n))
                size += len(keys)
                if size > 2_000_000:  # bounded: what does not shrink goes out
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield out(*held[0])
                        held, size = [], 0
        if held:
            yield out(*merged())

    def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return _texts(docs).select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _texts(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", F.col("text").cast("string").alias("text"))


def vocabulary(spark: SparkSession, path: str, params: Params) -> Vocabulary:
    """From a written table of word counts."""
    counts = spark.read.parquet(path)
    top = counts.orderBy(F.desc("n"), "word").limit(params.own).collect()
    hashes = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    rest = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(r["word"],) for r in top], "word long")), "word", "left_anti")
    # the unsigned shift of the hash, as encode() does it
    bucket = F.pmod(F.shiftrightunsigned("word", 20), F.lit(params.buckets)).alias("bucket")
    totals = np.zeros(params.buckets)
    for r in rest.groupBy(bucket).agg(F.sum("n").alias("n")).collect():
        totals[r["bucket"]] = r["n"]
    own = np.zeros(params.own)
    own[: len(top)] = [r["n"] for r in top]
    return Vocabulary(hashes[order], order.astype(np.int64), np.log(np.maximum(totals, 1)), np.concatenate([own, totals]), params.own, path)


def start(vocab: Vocabulary, params: Params) -> Weights:
    """Small random weights, and biases that give the unigram distribution."""
    rng = np.random.default_rng(params.seed)
    out = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in params.shapes.items()}
    share = (vocab.counts + 0.5).reshape(params.classes, -1)
    out["class_b"] = np.log(share.sum(axis=1) / share.sum()).astype(np.float32)
    out["token_b"] = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
    return out


def contexts(ids: np.ndarray, first: np.ndarray, params: Params, at: np.ndarray | None = None) -> np.ndarray:
    """For every token, or those at the given places, the ids at the window's positions; beyond a document's ends stands the id ``tokens``."""
    w = params.window
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(ids)) if at is None else at
    low, high = first[:-1][row[at]], first[1:][row[at]]
    out = np.full((2 * w, len(at)), params.tokens, np.int32)
    for p, shift in enumerate([s for s in range(-w, w + 1) if s]):
        place = at + shift
        inside = (place >= low) & (place < high)
        out[p, inside] = ids[place[inside]]
    return out


def _small(weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Whether the logits of each softmax need no shift before exp: hidden units lie in -1 to 1, which bounds them."""
    return (np.abs(weight).sum(axis=-1) + np.abs(bias)).max(axis=-1) < 70


def _log_softmax(z: np.ndarray, target: np.ndarray, small: bool) -> np.ndarray:
    """The log-probability of each row's target; the logits z are overwritten."""
    if not small:
        z -= z.max(axis=1, keepdims=True)
    own = z[np.arange(len(z)), target]
    np.exp(z, out=z)
    return own - np.log(z @ np.ones(z.shape[1], z.dtype))


def _error(z: np.ndarray, target: np.ndarray, n: int, small: bool) -> np.ndarray:
    """The gradient of a mean over n positions by the logits z, in place: softmax less the target, over n."""
    if not small:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z *= (1 / (n * (z @ np.ones(z.shape[1], z.dtype))))[:, None]
    z[np.arange(len(z)), target] -= z.dtype.type(1 / n)
    return z


def _hidden(weights: Weights, around: np.ndarray) -> np.ndarray:
    h = weights["embed"][0].take(around[0], axis=0)
    for p in range(1, len(around)):
        h += weights["embed"][p].take(around[p], axis=0)
    return np.tanh(h, out=h)


def _edges(target: np.ndarray, params: Params) -> list[tuple[int, int, int]]:
    """(class, first, end) of the classes that occur among sorted targets."""
    each = params.tokens // params.classes
    at = np.searchsorted(target, np.arange(params.classes + 1) * each)
    return [(int(c), int(at[c]), int(at[c + 1])) for c in np.flatnonzero(np.diff(at))]


def _by_value(ids: np.ndarray) -> np.ndarray:
    """An order that sorts ids; short ones are sorted by radix."""
    return np.argsort(ids.astype(np.uint16) if len(ids) and int(ids.max()) < 1 << 16 else ids, kind="stable")


def log_probs(weights: Weights, around: np.ndarray, target: np.ndarray, params: Params) -> np.ndarray:
    """log P(target | window) of each position."""
    each = params.tokens // params.classes
    out = np.empty(len(target))
    small, all_small = _small(weights["token_w"], weights["token_b"]), bool(_small(weights["class_w"], weights["class_b"]))
    for at in range(0, len(target), 1 << 14):
        order = at + _by_value(target[at : at + (1 << 14)])
        own, h = target[order], _hidden(weights, around[:, order])
        score = _log_softmax(h @ weights["class_w"].T + weights["class_b"], own // each, all_small)
        for c, a, b in _edges(own, params):
            score[a:b] += _log_softmax(h[a:b] @ weights["token_w"][c].T + weights["token_b"][c], own[a:b] - c * each, small[c])
        out[order] = score
    return out


class Trainer:
    """Stochastic gradient steps with a rate for each weight (Adagrad)."""

    def __init__(self, weights: Weights, params: Params) -> None:
        self.weights = {k: v.copy() for k, v in weights.items()}
        self.params = params
        self.square = {k: np.full_like(v, 0.01) for k, v in weights.items()}
        self.seen = 0

    def _update(self, key: str, grad: np.ndarray, at=...) -> None:
        square, weights = self.square[key][at], self.weights[key][at]
        square += grad * grad
        weights -= self.params.rate * grad / np.sqrt(square)

    def step(self, around: np.ndarray, target: np.ndarray) -> None:
        order = _by_value(target)
        around, target = around[:, order], target[order]
        w, p, n = self.weights, self.params, len(target)
        each = p.tokens // p.classes
        h = _hidden(w, around)
        small = _small(w["token_w"], w["token_b"])
        d = _error(h @ w["class_w"].T + w["class_b"], target // each, n, bool(_small(w["class_w"], w["class_b"])))
        back = d @ w["class_w"]
        class_w, class_b = d.T @ h, d.sum(axis=0)
        token_w, token_b = np.zeros_like(w["token_w"]), np.zeros_like(w["token_b"])
        for c, a, b in _edges(target, p):
            d = _error(h[a:b] @ w["token_w"][c].T + w["token_b"][c], target[a:b] - c * each, n, small[c])
            back[a:b] += d @ w["token_w"][c]
            token_w[c], token_b[c] = d.T @ h[a:b], d.sum(axis=0)
        # the types that bincount works with, converted once
        back = np.ascontiguousarray((back * (1 - h * h)).T, np.float64)
        for place, ids in enumerate(around.astype(np.intp)):
            grad = np.empty((p.width, p.tokens + 1), h.dtype)
            for unit in range(p.width):
                grad[unit] = np.bincount(ids, back[unit], p.tokens + 1)
            self._update("embed", grad.T, place)
        for key, grad in (("class_w", class_w), ("class_b", class_b), ("token_w", token_w), ("token_b", token_b)):
            self._update(key, grad)
        self.seen += n


def _positions(first: np.ndarray, params: Params, turn: int) -> np.ndarray:
    """The masked positions of a round: one in mask_every of each document."""
    inside = np.arange(int(first[-1])) - np.repeat(first[:-1], np.diff(first))
    return np.flatnonzero(inside % params.mask_every == turn % params.mask_every)


def _id_type(params: Params) -> str:
    return "<u2" if params.tokens <= 1 << 16 else "<u4"


def shard_count(vocab: Vocabulary, params: Params) -> int:
    return max(1, -(-int(vocab.counts.sum()) // params.shard_tokens))


def encoded(docs: DataFrame, vocab: Vocabulary, params: Params) -> DataFrame:
    """(shard, place, ids) of every document with a word, written, a shard whole in one file and in the order of its places.

    Both come from hashes of id and text, and their number from the count of all words.
    """
    shards = shard_count(vocab, params)
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    kind = _id_type(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch.column("text")):
                w = K.words(part, lower=True)
                ids = shared.value.encode(w.hashes).astype(kind)
                size = ids.itemsize
                full = np.flatnonzero(np.diff(w.first))
                # documents follow one another, so the rows' bytes are those of the slice
                offsets = np.append(w.first[full], w.first[-1]) * size
                raw = pa.Array.from_buffers(pa.large_binary(), len(full), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())])
                own = batch.slice(part.first, part.last - part.first).take(pa.array(full))
                yield pa.RecordBatch.from_arrays([own.column("shard"), own.column("place"), raw.cast(pa.binary())], ["shard", "place", "ids"])

    text = F.col("text").cast("string")
    key = F.xxhash64(F.col("doc_id").cast("string"), text)
    rows = texts(docs).select(F.pmod(key, F.lit(shards)).cast("int").alias("shard"), F.xxhash64(key).alias("place"), text.alias("text"))
    return written(rows.mapInArrow(run, "shard int, place long, ids binary").repartition(shards, "shard").sortWithinPartitions("shard", "place", "ids"), "lm-ids")


def train(ids: DataFrame, vocab: Vocabulary, params: Params) -> Weights:
    """The network after all rounds over encoded documents."""
    weights = start(vocab, params)
    for turn in range(params.epochs * params.mask_every):
        weights = _round(ids, weights, params, turn, shard_count(vocab, params))
    return weights


def _round(ids: DataFrame, weights: Weights, params: Params, turn: int, shards: int) -> Weights:
    """Every shard trains on its masked positions of this round; the weights are averaged by tokens."""
    shared = ids.sparkSession.sparkContext.broadcast(weights)
    names = list(params.shapes)
    kind = _id_type(params)

    def flat(trained: Weights) -> np.ndarray:
        return np.concatenate([trained[k].ravel() for k in names])

    def steps(trainer: Trainer, held: list[np.ndarray], number: int) -> None:
        own = np.concatenate(held).astype(np.int64)
        first = np.concatenate([[0], np.cumsum([len(h) for h in held])])
        at = _positions(first, params, turn)
        at = at[np.random.default_rng((params.seed, turn, number)).permutation(len(at))]
        for k in range(0, len(at), params.batch):
            place = at[k : k + params.batch]
            trainer.step(contexts(own, first, params, place), own[place])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = trainer = None
        held: list[np.ndarray] = []
        size = number = 0

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                steps(trainer, held, number)
            if trainer is not None and trainer.seen:
                yield from rows(shard, flat(trainer.weights).astype(np.float64) * trainer.seen, float(trainer.seen))

        for batch in batches:
            for own, raw in zip(batch.column("shard").to_pylist(), batch.column("ids")):
                if own != shard:
                    yield from done()
                    shard, trainer, held, size, number = own, Trainer(shared.value, params), [], 0, 0
                held.append(np.frombuffer(raw.as_buffer(), kind))
                size += len(held[-1])
                if size >= params.mask_every * params.batch:
                    steps(trainer, held, number)
                    held, size, number = [], 0, number + 1
        yield from done()

    def rows(shard: int, values: np.ndarray, seen: float) -> Iterator[pa.RecordBatch]:
        for c in range(-(-len(values) // CHUNK)):
            own = values[c * CHUNK : (c + 1) * CHUNK].astype(np.float32).tobytes()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "chunk": pa.array([c], pa.int32()), "seen": [seen], "weights": pa.array([own], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of equal (shard // 64, chunk), which follow one another."""
        key, seen, total = None, 0.0, np.zeros(0)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"shard": pa.array([key[0]], pa.int32()), "chunk": pa.array([key[1]], pa.int32()), "seen": [seen], "weights": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        for batch in batches:
            for s, c, n, raw in zip(*(batch.column(x).to_pylist() for x in ("shard", "chunk", "seen", "weights"))):
                own = np.frombuffer(raw, np.float32).astype(np.float64)
                if key != (s // 64, c):
                    if key is not None:
                        yield out()
                    key, seen, total = (s // 64, c), 0.0, np.zeros(len(own))
                seen, total = seen + n, total + own
        if key is not None:
            yield out()

    schema = "shard int, chunk int, seen double, weights binary"
    sums = ids.select("shard", "ids").mapInArrow(run, schema)
    # sums of 64 shards, each in the order of shards, until one sum a chunk is left; the driver holds one set of weights
    left = shards
    while True:
        group = F.floor(F.col("shard") / 64).cast("int")
        sums = sums.repartition(group, "chunk").sortWithinPartitions(group, "chunk", "shard").mapInArrow(add, schema)
        left = -(-left // 64)
        if left == 1:
            break
    parts: dict[int, tuple[float, np.ndarray]] = {}
    for r in sums.orderBy("chunk", "shard").collect():
        own = np.frombuffer(r["weights"], np.float32).astype(np.float64)
        seen, total = parts.get(r["chunk"], (0.0, np.zeros(len(own))))
        parts[r["chunk"]] = (seen + r["seen"], total + own)
    if not parts:
        return weights
    mean = np.concatenate([total / seen for _, (seen, total) in sorted(parts.items())])
    out, at = {}, 0
    for k, shape in params.shapes.items():
        n = int(np.prod(shape))
        out[k] = mean[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def fit(docs: DataFrame, params: Params = Params()) -> tuple[Vocabulary, Weights]:
    """The vocabulary and the trained network of a corpus."""
    path = fresh_path(docs.sparkSession, "lm-words")
    word_counts(docs).write.option("compression", "zstd").parquet(path)
    vocab = vocabulary(docs.sparkSession, path, params)
    return vocab, train(encoded(docs, vocab, params), vocab, params)


def _logs(spark: SparkSession, path: str) -> DataFrame:
    """(word, log_n) from a written table of word counts; the log of one occurrence is 0, so words counted once need no row."""
    return spark.read.parquet(path).where("n > 1").select("word", F.round(F.log("n") * FINE).cast("long").alias("log_n"))


def _place(hashes: np.ndarray, places: int) -> np.ndarray:
    return (hashes >> np.uint64(20)) % np.uint64(places)


def common_logs(logs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A table by place of the commonest words: their hashes, and logs of their counts (0: none there); of words with one place the commonest is kept."""
    step = F.floor(F.col("log_n") * 8 / FINE)
    least, size = None, 0
    for r in sorted(logs.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        size += r["n"]
        if size > COMMON:
            break
        least = r["step"]
    words, values = np.zeros(PLACES, np.uint64), np.zeros(PLACES, np.int64)
    if least is not None:
        found = logs.where(step >= least).toArrow()
        word, log_n = found["word"].to_numpy(), found["log_n"].to_numpy()
        order = np.lexsort((word, log_n))
        own = word[order].view(np.uint64)
        at = _place(own, PLACES)
        # the last of equal places, which is the commonest
        at, last = np.unique(at[::-1], return_index=True)
        words[at], values[at] = own[::-1][last], log_n[order][::-1][last]
    return words, values


def score(docs: DataFrame, model: tuple[Vocabulary, Weights], params: Params = Params()) -> DataFrame:
    """doc_id, n_tokens, log_prob and mean_log_prob of every document."""
    logs = _logs(docs.sparkSession, model[0].words)
    shared = docs.sparkSession.sparkContext.broadcast((*model, *common_logs(logs)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, weights, common, common_log = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in K.slices(batch.column("text")):
                w = K.words(part, lower=True)
                ids = vocab.encode(w.hashes)
                own = log_probs(weights, contexts(ids, w.first, params), ids, params)
                rare = np.flatnonzero(ids >= vocab.own)
                own[rare] -= vocab.penalty[ids[rare] - vocab.own]
                place = _place(w.hashes[rare], len(common))
                known = (common[place] == w.hashes[rare]) & (common_log[place] > 0)
                own[rare[known]] += common_log[place[known]] / FINE
                rare = rare[~known]
                total = np.concatenate([[0.0], np.cumsum(own)])
                n = np.diff(w.first)
                # the different rare words of each row, and how often each stands there
                at, word = np.repeat(np.arange(len(n)), n)[rare], w.hashes[rare]
                order = np.lexsort((word, at))
                at, word = at[order], word[order]
                new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (word[1:] != word[:-1]))) if len(at) else np.zeros(0, np.int64)
                times = pa.StructArray.from_arrays([pa.array(word[new].view(np.int64)), pa.array(np.diff(np.append(new, len(at))))], ["word", "k"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at[new], np.arange(len(n) + 1)).astype(np.int32)), times)
                own_rows = batch.column("doc_id").slice(part.first, part.last - part.first)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(n))), own_rows, pa.array(n), pa.array(total[w.first[1:]] - total[w.first[:-1]]), lists], ["row", "doc_id", "n_tokens", "base", "rare"])
                row += len(n)

    rows = written(_texts(docs).mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, base double, rare array<struct<word:long,k:long>>"), "lm-scores")
    # sums of integers do not depend on the order
    rare = rows.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.k")
    gains = rare.join(logs.hint("merge"), "word").groupBy("row").agg(F.sum(F.col("log_n") * F.col("k")).alias("gain"))
    log_prob = F.round(F.col("base") + F.coalesce("gain", F.lit(0)) / FINE, 6)
    mean = F.when(F.col("n_tokens") > 0, F.round(log_prob / F.col("n_tokens"), 6))
    return rows.join(gains.hint("merge"), "row", "left").select("doc_id", "n_tokens", log_prob.alias("log_prob"), mean.alias("mean_log_prob"))
