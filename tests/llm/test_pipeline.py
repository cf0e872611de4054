import numpy as np
import pytest
from brute import rules
from conftest import docs_frame
from test_decontaminate import PASSAGE, brute as hit
from test_ngram_join import brute as joined

import corpus_pipeline as C
from evigraph.llm import pii, vocab


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [prose(80) for _ in range(30)]
    texts += [t + " extra words" for t in texts[:5]] + texts[5:8]
    texts += [f"{prose(60)} {PASSAGE} {prose(20)}", PASSAGE, f"{prose(60)} mail a.b@c.example.com or 42.144.35.254", "short one", None, "", "x y z " * 40]
    ids = [int(x) for x in rng.permutation(len(texts)) * 3]
    path = tmp_path_factory.mktemp("sf")
    docs_frame(spark, texts, extra=False, ids=ids).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), dict(zip(ids, texts))


def test_stages_against_brute_force(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {i: t for i, t in texts.items() if not rules(t)["base_failed"]}
    expected = [set(kept)]
    kept = {i: kept[i] for i, _, c in joined(list(kept), list(kept.values())) if i == c}
    expected.append(set(kept))
    kept = {i: t for i, t in kept.items() if not hit(t, [(1, PASSAGE)])[4]}
    expected += [set(kept), set(kept)]
    for (name, stage), want in zip(C.STAGES[:-1], expected):
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert sorted(r.doc_id for r in rows) == sorted(want), name
        assert all(r.text == texts[r.doc_id] for r in rows) or name == "personal_data"
        docs = spark.createDataFrame(rows, docs.schema)
    rows = docs.collect()
    changed = [r for r in rows if r.text != texts[r.doc_id]]
    assert len(changed) == 1 and "42.144.35.254" not in changed[0].text and "a.b@c" not in changed[0].text
    assert all(r.n_chars == len(r.text) for r in rows)
    pieces = C.run(spark, path).collect()
    tokenizer = vocab.Encoder(vocab.default_path("byte_bpe_50k.json"), True).tokenizer
    want = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows}
    got: dict = {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == want


def test_empty_table(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0


def test_names():
    assert len(C.STAGES) == 5 and pii.KINDS


def test_repeated_ids_clashing_columns_and_long_texts(spark, folder):
    path, _ = folder
    rng = np.random.default_rng(4)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    a, b, long = prose(80), prose(80), prose(120_000)
    names = ("text_key", "doc_id_", "spans", "found", "found_", "component", "node", "mark", "row_key", "n_words", "kept", "part", "rest", "ids", "own", "between", "best", "quality_", "a.b")
    docs = docs_frame(spark, [a, b, a, a, None, long, long + " tail", f"{b} mail x.y@c.example.com"], extra=False, ids=[1, 1, 1, 2, None, 3, 4, 5]).selectExpr("*", *(f"cast(n_chars AS string) AS `{x}`" for x in names))
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        rows = out.collect()
        docs = spark.createDataFrame(rows, out.schema)
        if name == "quality_rules":
            assert len(rows) == 7
        if name == "ngram_jaccard_join":
            # both texts of id 1 stay, one of each set of near copies
            assert sorted((r.doc_id, r.text) for r in rows) == sorted([(1, a), (1, b), (3, long)])
    assert all(r["a.b"] == str(len(r.text)) for r in rows)
    pieces = C.STAGES[-1][1](spark, docs, path).collect()
    assert sum(p.length for p in pieces if p.doc_id == 3) == max(p.doc_tokens for p in pieces if p.doc_id == 3)
