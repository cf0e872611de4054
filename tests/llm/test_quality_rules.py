import numpy as np
from brute import rules
from conftest import ODD, docs_frame

from evigraph.llm import quality_rules as Q

JUNK = ["symbol### heavy%%% text*** more&&& " * 20, "SHOUT!! ALL!! DAY!! LONG!! " * 20, "a | b | c | " * 60]
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n)) + "."


def test_statistics_match_plain_python(spark):
    rng = np.random.default_rng(1)
    texts = [t for t in ODD if len(t or "") < 5000] + JUNK + [prose(rng, 80), "a b c a b c d\nx\nx\n x\n"]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.quality(docs_frame(spark, texts), labels).collect()}
    for i, t in enumerate(texts):
        want = rules(t)
        assert {k: got[i][k] for k in BASE} == want, (i, t)
        assert got[i].kept == (not want["base_failed"])  # no labels: nothing beyond the base rules


def test_long_text_and_repeated_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.quality(docs_frame(spark, ["long tail " * 30_000] * 2 + ["x y"], ids=[5, 5, 5]), labels).collect()
    assert sorted(r.n_words for r in got) == [2, 60_000, 60_000]


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(2)
    texts, quality = [], []
    for i in range(600):
        bad = i % 6 == 0
        words = prose(rng, int(rng.integers(60, 200))).split()
        texts.append(" ".join(w + "###"[: 1 + k % 3] for k, w in enumerate(words)) if bad else " ".join(words))
        quality.append(0 if bad else 1)
    docs = docs_frame(spark, texts)
    labels = spark.createDataFrame([(i, q) for i, q in enumerate(quality) if i // 6 % 2], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in Q.quality(docs, labels).collect()}
    held = [i for i in range(600) if i // 6 % 2 == 0]
    assert np.mean([got[i] for i in held if quality[i] == 1]) > 0.97
    assert np.mean([not got[i] for i in held if quality[i] == 0]) > 0.9
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_empty_table(spark):
    empty = docs_frame(spark, []).limit(0)
    assert Q.quality(empty, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def plain_score(forest, row):
    """A row's score by walking each tree with plain numbers."""
    import math

    expected = lambda n: 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)
    x = [math.asinh((v - c) / s) for v, c, s in zip(row, forest.centre.tolist(), forest.spread.tolist())]
    paths = []
    for feature, value, child, depth in zip(forest.feature.tolist(), forest.value.tolist(), forest.child.tolist(), forest.depth.tolist()):
        node = 0
        while feature[node] >= 0:
            node = child[node] + (x[feature[node]] >= value[node])
        paths.append(depth[node])
    return 2 ** (-sum(paths) / len(paths) / expected(forest.rows))


def plain_depths(forest, t, rows):
    """Path lengths of a tree's leaves from its splits: the level, and the mean path of a search among the rows that end there."""
    out, todo = {}, [(0, 0)]
    while todo:
        node, level = todo.pop()
        if forest.feature[t, node] < 0:
            out[node] = level
        else:
            todo += [(int(forest.child[t, node]), level + 1), (int(forest.child[t, node]) + 1, level + 1)]
    return out


def test_scores_against_plain_walks():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    forest = Q.grow(x, np.stack([x.min(axis=0) - 3, x.max(axis=0) + 3]), Q.Params(trees=12, tree_rows=64))
    probe = np.concatenate([x[:50], x[:20] + 4])
    assert np.allclose(forest.score(probe), [plain_score(forest, r) for r in probe.tolist()], atol=1e-8)
    for t in range(12):
        for node, level in plain_depths(forest, t, x).items():
            assert level <= forest.depth[t, node] <= level + 12
    assert forest.score(x[:20] + 4).mean() > forest.score(x).mean()


def test_sample_is_bounded_in_every_partitioning(spark):
    words = " ".join(f"w{i}" for i in range(60))
    docs = docs_frame(spark, [f"{words} x{i}" for i in range(900)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(900)], "doc_id long, quality int")
    stats = Q.measured(docs)
    params = Q.Params(sample=100, trees=5, tree_rows=32)
    a, b = Q.fit(stats.repartition(3), labels, params), Q.fit(stats.repartition(11), labels, params)
    assert (a.value == b.value).all() and a.cut == b.cut and a.rows == 32


def test_columns_of_any_name(spark):
    docs = docs_frame(spark, ["word " * 20, None]).selectExpr("*", "1 AS quality_", "2 AS hash_", "3 AS kept", "4 AS anomaly", "5 AS quality")
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    assert Q.keep_good(docs, labels).columns == docs.columns and Q.quality(docs, labels).count() == 2


def test_every_labelled_good_row_is_in_a_tree(spark):
    text = " ".join(f"w{i}" for i in range(60))
    stats = Q.measured(docs_frame(spark, [text] * 900))
    labels = spark.createDataFrame([(i, 1) for i in range(900)], "doc_id long, quality int")
    path = Q._expected(np.arange(901.0))
    for trees, rows, want in ((5, 32, 900), (5, 400, 3 * 900), (3, 900, 3 * 900)):
        forest = Q.fit(stats, labels, Q.Params(sample=100, trees=trees, tree_rows=rows))
        # equal rows leave nothing to split, so a root's path length tells the number of its rows
        held = [int(np.abs(path - d).argmin()) for d in forest.depth[:, 0]]
        assert sum(held) == want and min(held) > 100, held


def test_scale_and_cut_come_from_all_labelled_rows(spark):
    rng = np.random.default_rng(4)
    texts = [prose(rng, 60) + " ###" * int(rng.integers(0, 12 if i % 3 else 40)) for i in range(600)]
    stats = Q.measured(docs_frame(spark, texts))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)], "doc_id long, quality int")
    params = Q.Params(sample=100, trees=10, tree_rows=32, good_loss=0.02)
    forest = Q.fit(stats, labels, params)
    rows = stats.orderBy("doc_id").toPandas()
    x, good = Q.features({k: rows[k].to_numpy(np.int64) for k in Q.STATS}), rows["doc_id"].to_numpy() % 3 > 0
    middle = np.median(x[good], axis=0)
    assert np.allclose(forest.centre, middle, rtol=0.01, atol=1e-5)
    assert np.allclose(forest.spread - params.least_spread, np.quantile(np.abs(x[good] - middle), 0.99, axis=0), rtol=0.03, atol=1e-4)
    score = forest.score(x)
    cut = np.sort(score[good])[::-1][int(0.02 * good.sum())]
    assert forest.cut == (cut + score[~good & (score > cut)].min()) / 2


def test_labels_of_one_kind(spark):
    rng = np.random.default_rng(5)
    stats = Q.measured(docs_frame(spark, [prose(rng, 60) for _ in range(20)]))
    for quality in (0, 1):
        labels = spark.createDataFrame([(i, quality) for i in range(20)], "doc_id long, quality int")
        assert Q.judge(stats, Q.fit(stats, labels)).where("kept").count() == 20
