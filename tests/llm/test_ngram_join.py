import re

import numpy as np
import pytest
from conftest import ODD, docs_frame
from hypothesis import HealthCheck, given, settings, strategies as st

from evigraph.llm import ngram_join as N
from evigraph.operators.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(ids, texts):
    """Every pair compared; rows of one id are one node."""
    sets = [shingles(t) for t in texts]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(ids[i]), find(ids[j])))
                root[b] = a
    return sorted((i, len(s), find(i)) for i, s in zip(ids, sets))


def result(spark, texts, ids=None, **kw):
    ids = list(range(len(texts))) if ids is None else ids
    return sorted(tuple(r) for r in N.linked(docs_frame(spark, texts, ids=ids), N.Params(sketch_bits=12, filter_bits=12, **kw)).collect())


def family(rng, n, words=80, edits=6):
    base = ["".join(rng.choice(list("abcdef"), 4)) for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(int(rng.integers(0, edits))):
            own[int(rng.integers(0, words))] = "".join(rng.choice(list("uvwxyz"), 4))
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("kw", [{}, {"large": 4, "block": 3}, {"large": 2, "block": 1000, "fragments": 1}, {"hot": 1, "hot_times": 0, "fragments": 7}])
def test_families_against_every_pair(spark, kw):
    rng = np.random.default_rng(4)
    texts = [t for t in ODD if len(t or "") < 5000] + family(rng, 25) + family(rng, 25, 40, 4) + family(rng, 6, 9, 2)
    texts += [texts[-1].upper(), texts[-1] + " tail", "one two three four five", "One two  three\nfour five", "a b c", "A b c", "b c a"]
    texts += ["shared passage of many words that is long enough to count " * 2 + " ".join(family(rng, 1, 30)) for _ in range(12)]
    ids = [int(x) for x in rng.permutation(len(texts)) + 100]
    assert result(spark, texts, ids, **kw) == brute(ids, texts)


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), min_size=1, max_size=14), st.integers(1, 6))
@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
def test_random_against_every_pair(spark, docs, large):
    texts = [" ".join(d) for d in docs]
    assert result(spark, texts, large=large, block=4) == brute(list(range(len(texts))), texts)


def test_repeated_rows_null_ids_and_long_texts(spark):
    rng = np.random.default_rng(6)
    long = " ".join("".join(rng.choice(list("abcdef"), 5)) for _ in range(40_000))
    texts, ids = [long, long + " end", "x y", "x y", "p q r", long, None, "x y"], [9, 5, 7, 7, 7, 3, 1, None]
    got = N.linked(docs_frame(spark, texts, ids=ids)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(1, 1), (3, 3), (5, 3), (7, 7), (7, 7), (7, 7), (9, 3)]
    assert [r.component_id for r in got if r.doc_id is None] == [7] and {r.n_shingles for r in got if r.doc_id == 9} == {39_996}


def test_keep_one(spark):
    docs = docs_frame(spark, ["a b c", "a b c", "", None, "z"], ids=[4, 2, 3, 1, 0])
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3]
    assert sorted(r.doc_id for r in N.keep_one(docs_frame(spark, ["a", "a"], ids=[1, 1])).collect()) == [1]


def test_keep_one_judges_every_text_of_a_repeated_id(spark):
    a, b = "one two three four five six", "red green blue white black grey"
    docs = docs_frame(spark, [a, b, a, b, None, "", a + " ", None], ids=[1, 1, 1, 0, 1, 1, None, 1])
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns and sorted((str(r.doc_id), r.text or "-") for r in kept.collect()) == sorted([("1", a), ("0", b), ("1", "-"), ("1", "-"), ("None", a + " ")])


def test_ids_of_other_types_and_clashing_columns(spark):
    docs = docs_frame(spark, ["a b c", "A b c", "x", "x", None]).selectExpr("concat('id', doc_id) AS doc_id", "text", *(f"doc_id AS `{x}`" for x in ("node", "node_", "node_key", "text_key", "mark", "mark_", "component", "component_", "rows_", "id", "print", "size", "a.b")), "map('k', doc_id) AS m")
    got = {r.doc_id: r.component_id for r in N.linked(docs).collect()}
    assert got == {"id0": "id0", "id1": "id0", "id2": "id2", "id3": "id2", "id4": "id4"}
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.node, r["a.b"], r.m["k"]) for r in kept.collect()) == [("id0", 0, 0, 0), ("id2", 2, 2, 2), ("id4", 4, 4, 4)]


def listed_pairs(spark, texts, monkeypatch, **kw):
    """What linked() gives, and how many pairs it verified beyond the stars."""
    seen = []
    plain = N.candidates

    def counted(*args):
        out = plain(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(N, "candidates", counted)
    ids = list(range(len(texts)))
    return result(spark, texts, ids, **kw), brute(ids, texts), seen[0]


def test_passages_of_many_texts_give_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    own = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    passage = own(80)
    # four fifths of each text are one passage, and so is three quarters of longer ones: near the threshold, and no link
    texts = [f"{own(20)} {passage}" for _ in range(160)] + [f"{passage} {own(26)}" for _ in range(60)]
    got, want, pairs = listed_pairs(spark, texts, monkeypatch, large=32, block=50)
    assert got == want and pairs < len(texts), pairs


def test_a_chain_of_passages_is_no_group(spark, monkeypatch):
    rng = np.random.default_rng(12)
    passages = [" ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(50)) for _ in range(200)]
    texts = [f"{passages[i]} {passages[i + 1]}" for i in range(199)]
    got, want, pairs = listed_pairs(spark, texts, monkeypatch, large=1, block=8)
    assert got == want and pairs < 2 * len(texts), pairs


def test_empty_table(spark):
    assert N.linked(docs_frame(spark, []).limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100 + int(a), 100 + int(b)) for a, b in rng.integers(0, 80, (50, 2))] + [(7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)
