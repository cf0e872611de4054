"""Vector search against plain loops, and the index's recall."""
import numpy as np
from pyspark.sql import functions as F

from evigraph.operators import vectors as V


def plain(queries, points, k, least, same):
    out = []
    for q in queries:
        scored = []
        for p in points:
            if p[0] == q[0] or q[1] is None or p[1] is None or same and q[2] != p[2] or same and q[2] is None:
                continue
            a, b = np.array(q[1]), np.array(p[1])
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            score = round(float(a @ b / norm) if norm else 0.0, 6)
            if score >= least:
                scored.append((-score, p[0]))
        out += [(q[0], i, -s) for s, i in sorted(scored)[:k]]
    return sorted(out)


def test_exact_search_against_loops(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist(), ("a", "b", None)[i % 3]) for i in range(90)] + [(90, [0.0] * 4, "a"), (91, None, "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kind string")
    monkeypatch.setattr(V, "QUERY_BLOCK", 20)
    monkeypatch.setattr(V, "POINT_BLOCK", 7)
    for same in (None, "kind"):
        for least, k in ((-1.0, 5), (0.3, 3)):
            got = sorted((r.query_id, r.vec_id, r.score + 0.0) for r in V.nearest(df.where("vec_id % 2 = 0"), df, k, least, same).collect())
            assert got == plain([r for r in rows if r[0] % 2 == 0], rows, k, least, same)
    assert V.nearest(df.limit(0), df, 3).count() == V.nearest(df, df.limit(0), 3).count() == 0


def test_recall_of_the_index(spark):
    vec = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    params = V.IndexParams(split=40)
    exact = {(r.query_id, r.vec_id) for r in V.nearest(vec, vec, 10).collect()}
    found = V.nearest_indexed(vec, vec, 10, params=params)
    pairs = [(r.query_id, r.vec_id) for r in found.collect()]
    assert len(set(pairs)) == len(pairs) and len(exact & set(pairs)) >= 0.9 * len(exact)
    # looking into every cell is exact
    every = V.nearest_indexed(vec, vec, 10, params=V.IndexParams(cells=8, probes=8, split=64))
    assert {(r.query_id, r.vec_id) for r in every.collect()} == exact
    assert found.groupBy("query_id").agg(F.count("*").alias("n")).where("n > 10").count() == 0
