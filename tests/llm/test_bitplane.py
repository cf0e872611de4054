import io

import numpy as np
import pytest
from brute import crc
from conftest import ODD, docs_frame
from hypothesis import given, settings, strategies as st

from evigraph.llm import bitplane as B, vocab


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300))
@settings(max_examples=60, deadline=None)
def test_planes_round_trip(ids):
    ids = np.array(ids, np.uint32)
    assert (B.from_planes(B.to_planes(ids), len(ids)) == ids).all()


@given(st.lists(st.lists(st.integers(0, 50_000), max_size=40), max_size=30), st.integers(1, 64))
@settings(max_examples=60, deadline=None)
def test_shard_round_trip(docs, block):
    out = io.BytesIO()
    w = B.Writer(out, block)
    for i, d in enumerate(docs):
        w.add(i, np.array(d, np.uint32))
    w.close()
    got = [(i, x.tolist()) for i, x in B.Reader(out, out.tell()).documents()]
    assert got == list(enumerate(docs))


def test_cut_off_shard_is_refused():
    out = io.BytesIO()
    w = B.Writer(out, 8)
    w.add(1, np.arange(20))
    w.close()
    raw = out.getvalue()[:-1]
    with pytest.raises(ValueError):
        B.Reader(io.BytesIO(raw), len(raw))


@pytest.mark.parametrize("name,space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_equal_the_library(name, space):
    import pyarrow as pa

    e = vocab.Encoder(vocab.default_path(name), space)
    texts = [*ODD, "Uppercase ÉCOLE x<|startoftext|>y  z", "tab\tsep\r\nnew  \n  two", " lead", "trail \n"]
    want = [x.ids for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):
        assert [x.tolist() for _, x in e.rows(pa.array(texts))] == want


def test_token_table(spark):
    path = vocab.default_path("word_bpe_49k.json")
    texts = [*ODD, "tie one", "tie one"]
    ids = [9, 3, 8, 1, 2, 7, 6, 5, 4, 0, 11, 11]
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in B.token_table(docs_frame(spark, texts, ids=ids), path, 1, B.Sizes(block=1000)).orderBy("start").collect()]
    e = vocab.Encoder(path, False)
    want, start = [], 0
    for i, t in sorted(zip(ids, texts), key=lambda x: x[0]):
        own = [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(own), crc(own)))
        start += len(own)
    assert got == want


def test_empty_table(spark):
    assert B.token_table(docs_frame(spark, []).limit(0), vocab.default_path("word_bpe_49k.json"), 1).count() == 0


def test_shards_are_cut_and_left_over_files_removed(spark, tmp_path):
    path = vocab.default_path("word_bpe_49k.json")
    docs = docs_frame(spark, [f"some words {i}" for i in range(60)] + [None], ids=[*range(60), None]).selectExpr("*", "1 AS key", "2 AS part", "3 AS file")
    out = f"{tmp_path}/shards"
    (tmp_path / "shards").mkdir()
    (tmp_path / "shards" / "shard-0000000-00000-999.evbp").write_bytes(b"half")
    index = B.write_shards(docs, out, path, 1, B.Sizes(shard_docs=4, range_bytes=80))
    rows = index.orderBy("part", "piece").collect()
    assert sum(r.n_docs for r in rows) == 61 and max(r.n_docs for r in rows) <= 4 and len({r.part for r in rows}) > 4
    assert {r.file for r in rows} == {p.name for p in (tmp_path / "shards").glob("*.evbp")}
    got = B.read_shards(index, out).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, *range(60)] and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
