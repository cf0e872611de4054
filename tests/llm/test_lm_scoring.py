import math
import time

import numpy as np
import pyarrow as pa
from conftest import ODD, docs_frame

from evigraph.llm import kernels as K, lm_scoring as L

SMALL = L.Params(own=48, buckets=16, classes=8, width=12, batch=64, mask_every=2, epochs=8)


def sentences(rng, n):
    """Words that follow and precede one another by rule."""
    out = []
    for _ in range(n):
        k, own = int(rng.integers(0, 30)), []
        for _ in range(30):
            own.append(f"w{k}")
            k = (k * 3 + int(rng.integers(0, 2))) % 30
        out.append(" ".join(own))
    return out


def test_gradients_lower_the_loss_and_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    vocab = L.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(16), np.ones(64), 48)
    weights = L.start(vocab, SMALL)
    around = rng.integers(0, 65, (4, 200)).astype(np.int32)
    total = sum(np.exp(L.log_probs(weights, around, np.full(200, t), SMALL)) for t in range(64))
    assert np.allclose(total, 1, atol=1e-4)
    target = around[1] % 64
    trainer = L.Trainer(weights, SMALL)
    before = L.log_probs(trainer.weights, around, target, SMALL).mean()
    for _ in range(60):
        trainer.step(around, target)
    assert L.log_probs(trainer.weights, around, target, SMALL).mean() > before + 1


def test_step_matches_numeric_gradient():
    rng = np.random.default_rng(2)
    params = L.Params(own=4, buckets=4, classes=2, width=3)
    weights = {k: rng.standard_normal(s) * 0.5 for k, s in params.shapes.items()}
    around, target = rng.integers(0, 9, (4, 7)).astype(np.int32), rng.integers(0, 8, 7)
    seen = {k: np.zeros_like(v) for k, v in weights.items()}

    class Probe(L.Trainer):
        def _update(self, key, grad, at=...):
            seen[key][at] += grad

    Probe(weights, params).step(around, target)
    for key, at in (("embed", (1, int(around[1][0]), 2)), ("class_w", (1, 0)), ("class_b", (0,)), ("token_w", (int(target[0] // 4), 1, 1)), ("token_b", (int(target[0] // 4), 2))):
        loss = []
        for eps in (1e-5, -1e-5):
            moved = {k: v.copy() for k, v in weights.items()}
            moved[key][at] += eps
            loss.append(-L.log_probs(moved, around, target, params).mean())
        assert np.isclose((loss[0] - loss[1]) / 2e-5, seen[key][at], atol=1e-5), key


def test_word_order_matters_on_held_out_texts(spark):
    rng = np.random.default_rng(3)
    train, held = sentences(rng, 200), sentences(rng, 40)
    model = L.fit(docs_frame(spark, train).repartition(2), SMALL)
    shuffled = [" ".join(rng.permutation(t.split())) for t in held]
    got = [r.mean_log_prob for r in L.score(docs_frame(spark, held + shuffled), model, SMALL).orderBy("doc_id").collect()]
    real, mixed = np.array(got[:40]), np.array(got[40:])
    unigram = L.start(model[0], SMALL)
    base = [r.mean_log_prob for r in L.score(docs_frame(spark, held), (model[0], unigram), SMALL).collect()]
    assert (real > mixed).mean() > 0.95 and real.mean() > np.mean(base) + 0.3


def test_counts_cover_all_words(spark):
    texts = ["A a b", "a c é É", None, ""]
    counts = sorted(r.n for r in L.word_counts(docs_frame(spark, texts)).collect())
    assert counts == [1, 1, 1, 1, 3]


def test_odd_rows(spark):
    docs = docs_frame(spark, ODD + ODD[:1] + ["a"], ids=[*range(len(ODD)), 0, 3])
    rows = L.score(docs, L.fit(docs, SMALL), SMALL).collect()
    assert len(rows) == len(ODD) + 2
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.n_tokens, r.log_prob, r.mean_log_prob))
    assert by[0] == {(0, 0.0, None)} and np.ptp([p for _, p, _ in by[3]]) < 1e-3 and all(p <= 0 for own in by.values() for _, p, _ in own)
    empty = docs.limit(0)
    assert L.score(empty, L.fit(empty, SMALL), SMALL).count() == 0


def test_rare_words_score_by_their_own_counts(spark):
    params = L.Params(own=4, buckets=4, classes=2, width=4, batch=64)
    often = ["a b c d"] * 60
    model = L.fit(docs_frame(spark, often + [f"r{i}" for i in range(24) for _ in range(i + 1)]), params)
    rows = L.score(docs_frame(spark, [*(f"r{i}" for i in range(24)), "r23 r23 unseen"]), model, params).orderBy("doc_id").collect()
    # in one bucket and context, words differ by the logs of their counts
    left = np.array([r.log_prob - np.log(i + 1) for i, r in enumerate(rows[:24])])
    assert len(set(np.round(left, 5))) <= 4 and rows[24].n_tokens == 3


def test_an_epoch_trains_every_position():
    first, params = np.array([0, 1, 1, 4, 15]), L.Params()
    turns = [L._positions(first, params, i) for i in range(params.epochs * params.mask_every)]
    assert sorted(np.concatenate(turns)) == list(range(15)) and set(turns[0]) == {0, 1, 4, 8, 12}


def test_the_model_does_not_depend_on_the_layout(spark):
    texts = sentences(np.random.default_rng(5), 60) + [None, "", "one"] + sentences(np.random.default_rng(6), 1) * 2
    docs = docs_frame(spark, texts)
    params = L.Params(own=32, buckets=8, classes=8, width=6, batch=32, mask_every=2, shard_tokens=300)
    (va, a), (vb, b) = L.fit(docs.repartition(2), params), L.fit(docs.orderBy("text").repartition(7, "lang", "text"), params)
    assert L.shard_count(va, params) > 4 and all((a[k] == b[k]).all() for k in a) and (va.hashes == vb.hashes).all()
    start = L.start(va, params)
    assert any((a[k] != start[k]).any() for k in a)


def plain_scores(texts, model, params, counts):
    """Scores by loops over tokens, window places and units."""
    vocab, w = model
    each = params.tokens // params.classes
    own = dict(zip(vocab.hashes.tolist(), vocab.ids.tolist()))
    out = []
    for text in texts:
        (part,) = K.slices(pa.array([text or ""])) if text else (None,)
        hashes = K.words(part, lower=True).hashes.tolist() if part else []
        ids = [own.get(h, params.own + (h >> 20) % params.buckets) for h in hashes]
        total = 0.0
        for i, t in enumerate(ids):
            hidden = [0.0] * params.width
            for p, shift in enumerate((-2, -1, 1, 2)):
                around = ids[i + shift] if 0 <= i + shift < len(ids) else params.tokens
                for u in range(params.width):
                    hidden[u] += float(w["embed"][p][around][u])
            hidden = [math.tanh(x) for x in hidden]
            unit = lambda weights, bias: bias + sum(float(a) * b for a, b in zip(weights, hidden))
            classes = [unit(w["class_w"][c], float(w["class_b"][c])) for c in range(params.classes)]
            tokens = [unit(w["token_w"][t // each][k], float(w["token_b"][t // each][k])) for k in range(each)]
            total += classes[t // each] - math.log(sum(map(math.exp, classes))) + tokens[t % each] - math.log(sum(map(math.exp, tokens)))
            if t >= params.own:
                bucket = sum(n for h, n in counts.items() if h not in own and (h >> 20) % params.buckets == t - params.own)
                total += math.log(counts.get(hashes[i], 1)) - math.log(max(bucket, 1))
        out.append((len(ids), total))
    return out


def test_scores_against_loops(spark):
    params = L.Params(own=16, buckets=8, classes=4, width=5, batch=64, mask_every=2, shard_tokens=500)
    train = sentences(np.random.default_rng(7), 20) + ["rare words here", "rare again"]
    model = L.fit(docs_frame(spark, train), params)
    counts = {}
    for t in train:
        (part,) = K.slices(pa.array([t]))
        for h in K.words(part, lower=True).hashes.tolist():
            counts[h] = counts.get(h, 0) + 1
    texts = [*train[:4], "Rare unseen w3 w9", "a", "", None, "w1 " * 30]
    got = [(r.n_tokens, r.log_prob) for r in L.score(docs_frame(spark, texts), model, params).orderBy("doc_id").collect()]
    want = plain_scores(texts, model, params, counts)
    assert [n for n, _ in got] == [n for n, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], atol=2e-3)


def test_columns_of_any_name(spark):
    docs = docs_frame(spark, ["a b c", "b c d"]).selectExpr("*", "1 AS shard", "2 AS place", "3 AS ids", "4 AS row", "5 AS word", "6 AS rare")
    assert L.score(docs, L.fit(docs, SMALL), SMALL).columns == ["doc_id", "n_tokens", "log_prob", "mean_log_prob"]


def plain_log_probs(weights, around, target, params):
    """Scores with every softmax shifted by its greatest logit, in chunks of the operator's size."""
    each, out = params.tokens // params.classes, np.empty(len(target))
    for at in range(0, len(target), 1 << 14):
        order = at + np.argsort(target[at : at + (1 << 14)], kind="stable")
        own = target[order]
        h = np.tanh(sum(weights["embed"][p][around[p, order]] for p in range(len(around))))
        z = h @ weights["class_w"].T + weights["class_b"]
        z -= z.max(axis=1, keepdims=True)
        score = z[np.arange(len(own)), own // each] - np.log(np.exp(z).sum(axis=1))
        for c in np.unique(own // each):
            a, b = np.searchsorted(own, [c * each, (c + 1) * each])
            z = h[a:b] @ weights["token_w"][c].T + weights["token_b"][c]
            z -= z.max(axis=1, keepdims=True)
            score[a:b] += z[np.arange(b - a), own[a:b] - c * each] - np.log(np.exp(z).sum(axis=1))
        out[order] = score
    return out


def test_scores_are_those_of_shifted_softmaxes_in_less_time():
    rng, params = np.random.default_rng(8), L.Params()
    weights = {k: (rng.standard_normal(s) * 0.3).astype(np.float32) for k, s in params.shapes.items()}
    around, target = rng.integers(0, params.tokens + 1, (4, 1 << 16)).astype(np.int32), rng.integers(0, params.tokens, 1 << 16)
    took = {L.log_probs: [], plain_log_probs: []}
    for _ in range(7):
        for f, own in took.items():
            began = time.perf_counter()
            f(weights, around, target, params)
            own.append(time.perf_counter() - began)
    assert np.allclose(L.log_probs(weights, around, target, params), plain_log_probs(weights, around, target, params), atol=1e-4)
    assert min(took[L.log_probs]) < 0.75 * min(took[plain_log_probs]), took


def test_large_logits_stay_finite():
    rng, params = np.random.default_rng(9), L.Params(own=16, buckets=16, classes=4, width=6)
    weights = {k: (rng.standard_normal(s) * 80).astype(np.float32) for k, s in params.shapes.items()}
    around, target = rng.integers(0, params.tokens + 1, (4, 500)).astype(np.int32), rng.integers(0, params.tokens, 500)
    got = L.log_probs(weights, around, target, params)
    assert np.isfinite(got).all() and got.min() < -200 and np.allclose(got, plain_log_probs(weights, around, target, params), rtol=1e-4, atol=1e-3)
    trainer = L.Trainer(weights, params)
    trainer.step(around, target)
    assert all(np.isfinite(v).all() for v in trainer.weights.values())


def test_counts_of_common_words_need_no_join(spark, monkeypatch):
    params = L.Params(own=4, buckets=4, classes=2, width=4, batch=64)
    docs = docs_frame(spark, ["a b c d"] * 60 + [f"r{i}" for i in range(24) for _ in range(i + 1)])
    model = L.fit(docs, params)
    asked = docs_frame(spark, [*(f"r{i} a r{i}" for i in range(24)), "r23 r23 unseen", None])
    seen = []
    written = L.written
    monkeypatch.setattr(L, "written", lambda df, name: seen.append(written(df, name)) or seen[-1])
    got = {}
    for common, places in ((1 << 17, 1 << 19), (12, 1 << 19), (1 << 17, 8), (0, 1 << 19)):
        monkeypatch.setattr(L, "COMMON", common)
        monkeypatch.setattr(L, "PLACES", places)
        got[common, places] = [r.log_prob for r in L.score(asked, model, params).orderBy("doc_id").collect()]
    assert all(np.allclose(x, got[0, 1 << 19], atol=1e-5) for x in got.values())
    joined = [sum(len(r.rare) for r in df.select("rare").collect()) for df in seen]
    # without a table every rare word of a text, with one those counted once or never
    assert joined[0] == 2 and joined[3] == 26 and joined[0] < min(joined[1:3]) and max(joined[1:3]) < 26, joined
