import hashlib
import re
import time

import numpy as np
import pytest
from conftest import ODD, docs_frame
from hypothesis import HealthCheck, given, settings, strategies as st

from evigraph.llm import decontaminate as D

LOW = str.maketrans(D.UPPER, D.LOWERED)


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(text, items, n=10):
    w = word_list(text)
    hit, found = set(), set()
    for item, t in items:
        v = word_list(t)
        k = min(n, len(v))
        for j in range(len(v) - k + 1 if k else 0):
            for i in range(len(w) - k + 1):
                if w[i : i + k] == v[j : j + k]:
                    hit |= set(range(i, i + k))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


PASSAGE = "the Quick brown fox jumps over the lazy dog and then É runs home again today"


def test_cases(spark):
    items = [(1, PASSAGE), (2, "short one É"), (10, "a a a a a a a a a a a a a"), (3, None), (4, " ,. "), (7, PASSAGE.upper().replace("É", "é"))]
    w = PASSAGE.split()
    texts = [t for t in ODD if len(t or "") < 5000]
    texts += [PASSAGE, PASSAGE.upper(), " ".join(w[:10]), " ".join(w[1:10]), "x " * 7 + ", ".join(w[3:]) + " y", "SHORT-one..É", "a " * 40, " ".join(w[:9] + ["z"] + w[9:]), "pre " + PASSAGE + " mid " + PASSAGE, "İstanbul Kelvin K short one É"]
    rows = D.contamination(docs_frame(spark, texts), bench(spark, items)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == [brute(t, items) for t in texts]


@given(st.lists(st.lists(st.sampled_from("aB"), max_size=30), min_size=1, max_size=6), st.lists(st.lists(st.sampled_from("ab"), max_size=16), max_size=4))
@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
def test_random(spark, docs, items):
    texts, own = [" ".join(d) for d in docs], [(i, " ".join(x)) for i, x in enumerate(items)]
    rows = D.contamination(docs_frame(spark, texts), bench(spark, own)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == [brute(t, own) for t in texts]


def test_without_broadcast_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_WORDS", 0)
    items = [(1, PASSAGE), (2, "short one")]
    texts = ["x " + PASSAGE, "x " + PASSAGE, "a short one", None]
    rows = D.contamination(docs_frame(spark, texts, ids=[5, 5, 5, None]), bench(spark, items)).collect()
    assert sorted(tuple(r)[1:] for r in rows) == sorted(brute(t, items) for t in texts)


def test_long_text(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcde"), 4)) for _ in range(60_000)]
    words[30_000:30_000] = word_list(PASSAGE)
    (row,) = D.contamination(docs_frame(spark, [" ".join(words)]), bench(spark, [(1, PASSAGE)])).collect()
    assert (row.n_words, row.n_hit, row.n_items) == (60_016, 16, 1)


def test_removal(spark):
    items = bench(spark, [(1, PASSAGE)])
    texts = [f"Keep, this! {PASSAGE}. And  this\n", "clean text", None, ""]
    docs = docs_frame(spark, texts)
    kept = D.remove_documents(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    cut = D.remove_spans(docs, items).orderBy("doc_id").collect()
    assert [r.text for r in cut] == ["Keep, this! . And  this\n", *texts[1:]] and cut[0].n_chars == len(cut[0].text)


def test_empty_tables(spark):
    docs = docs_frame(spark, ["a b"])
    none = bench(spark, []).limit(0)
    assert [tuple(r) for r in D.contamination(docs, none).collect()] == [(0, *brute("a b", []))]
    assert D.contamination(docs.limit(0), bench(spark, [(1, PASSAGE)])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = D.contamination(docs_frame(spark, ["a"]), bench(spark, [(1, PASSAGE)]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


@pytest.mark.parametrize("chunk", [5, 10, 35])
def test_chunks_meet(spark, chunk):
    items = [(1, PASSAGE), (2, "short one É"), (3, "a b")]
    rng = np.random.default_rng(3)
    texts = [" ".join([*rng.choice(["a", "b", "short", "one", "é"], int(n)), *word_list(PASSAGE)[: 10 + int(n) % 7], *rng.choice(["a", "b"], 7)]) for n in range(12)]
    rows = D.contamination(docs_frame(spark, texts), bench(spark, items), D.Params(chunk=chunk)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == [brute(t, items) for t in texts]


def test_time_in_proportion_to_a_text(spark):
    item = bench(spark, [(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")])
    seconds = {}
    for n in (100_000, 100_000, 400_000):
        docs = docs_frame(spark, [" ".join(f"w{i % 5000}" for i in range(n))])
        began = time.time()
        (row,) = D.contamination(docs, item).collect()
        seconds[n] = time.time() - began
        assert row.n_hit == 12 * (n // 5000)
    assert seconds[400_000] < 4.5 * seconds[100_000] + 2, seconds
    began = time.time()
    (row,) = D.remove_spans(docs, item).collect()
    assert row.n_chars == len(row.text) and "w10 w11" not in row.text and time.time() - began < 4.5 * seconds[100_000] + 20


def test_counting_costs_less_than_scanning(spark):
    rng = np.random.default_rng(7)
    vocab = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(3000)]
    docs = docs_frame(spark, [" ".join(rng.choice(vocab, 400)) for _ in range(250)]).crossJoin(spark.range(20)).drop("id").repartition(4).cache()
    item, jvm = bench(spark, [(1, PASSAGE)]), spark.sparkContext._jvm.java.lang.ProcessHandle
    assert docs.count() == 5000

    def cpu_ms(df):
        began = jvm.current().info().totalCpuDuration().get().toMillis()
        df.write.format("noop").mode("overwrite").save()
        return jvm.current().info().totalCpuDuration().get().toMillis() - began

    scan, whole = (min(cpu_ms(f(docs, item)) for _ in range(3)) for f in (D.hits, D.contamination))
    docs.unpersist()
    assert whole < 2 * scan + 500, (whole, scan)


def test_columns_of_any_name_pass_through(spark):
    item = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string")
    names = ("text_key", "doc_id_", "text_key_", "row_key_", "spans_", "items_", "own", "between", "own_", "w", "at", "h", "c", "base", "normal_", "spaced_", "a.b")
    docs = docs_frame(spark, ["plain words", "x " + " ".join(f"w{i}" for i in range(12)) + " y"]).selectExpr("*", *(f"doc_id + {k} as `{x}`" for k, x in enumerate(names)))
    kept, cut = D.remove_documents(docs, item), D.remove_spans(docs, item)
    assert kept.columns == cut.columns == docs.columns
    assert kept.collect() == docs.where("doc_id = 0").collect()
    rest = [x for x in docs.columns if x not in ("text", "n_chars")]
    both = [sorted(tuple(r[x] for x in rest) for r in df.collect()) for df in (cut, docs)]
    assert [r.text.split() for r in cut.orderBy("doc_id").collect()] == [["plain", "words"], ["x", "y"]] and both[0] == both[1]
    assert D.contamination(docs, item).count() == 2
