import numpy as np
from brute import crc
from conftest import ODD, docs_frame
from hypothesis import given, settings, strategies as st

from evigraph.llm import packing as P, vocab

PATH = vocab.default_path("byte_bpe_50k.json")


@given(st.dictionaries(st.integers(1, 63), st.integers(1, 500), max_size=40))
@settings(max_examples=80, deadline=None)
def test_histogram_is_packed_whole(histogram):
    packs = P.pack_histogram(histogram, 64)
    got: dict[int, int] = {}
    for p in packs:
        assert 0 < sum(p.lengths) <= 64 and p.count > 0
        for n in p.lengths:
            got[n] = got.get(n, 0) + p.count
    assert got == histogram


def check(spark, texts, length=64, ids=None, df=None):
    params = P.Params(PATH, length=length, slack=2)
    df = df if df is not None else docs_frame(spark, texts, ids=ids)
    rows = P.pack(df, params, keep_ids=True).collect()
    tokenizer = vocab.Encoder(PATH, True).tokenizer
    want = sorted([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts)
    # every id lies in exactly one piece; equal doc_ids are told apart by their texts
    docs: dict = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.doc_tokens, r.start)):
        own = np.frombuffer(r.ids, "<u4").tolist()
        assert r.length == len(own) <= length and r.ids_crc32 == crc(own)
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, own))
    if ids is None:
        got = []
        for (_, tokens), pieces in docs.items():
            joined = [x for _, own in pieces for x in own]
            assert [s for s, _ in pieces] == np.cumsum([0, *(len(o) for _, o in pieces[:-1])]).tolist() and len(joined) == tokens
            got.append(joined)
        assert sorted(got) == want
    else:
        assert sum(r.length for r in rows) == sum(map(len, want))
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own[:-1])]).tolist()
        total = sum(n for _, n in own)
        assert total <= length
        padding += 0 if total & (total - 1) == 0 else length - total
    return rows, padding / max(1, sum(r.length for r in rows))


def test_odd_texts(spark):
    rows, _ = check(spark, ODD)
    again = P.pack(docs_frame(spark, ODD), P.Params(PATH, length=64, slack=2))
    assert "ids" not in again.columns and sorted(map(tuple, again.select("doc_id", "start", "ids_crc32").collect())) == sorted((r.doc_id, r.start, r.ids_crc32) for r in rows)


def test_many_with_little_padding(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(["ab", "cd", "xyzzy"][k] for k in rng.integers(0, 3, n)) for n in rng.integers(0, 120, 400)]
    df = docs_frame(spark, texts).repartition(7)
    _, padding = check(spark, texts, df=df)
    assert padding < 0.02


def test_repeated_rows(spark):
    check(spark, ["same text here"] * 30 + ["other"], ids=[1] * 31)


def test_empty_table(spark):
    assert P.pack(docs_frame(spark, []).limit(0), P.Params(PATH)).count() == 0
