"""The registered queries over a whole small table, against plain Python, the library itself, or DuckDB."""
import html
import os
import re
import sys

import numpy as np
import pyarrow.parquet as pq
import pytest
from brute import crc, rules
from test_ngram_join import shingles
from test_secret_scan import brute as secrets, digest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from oracle import compare  # noqa: E402

from evigraph.llm import queries as Q, vocab  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def test_op1(spark, docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small and 4 * small >= 3 * large and 100 * (k := len(sets[i] & sets[j])) >= 75 * (small + large - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op1_ngram_jaccard_join(spark, SF).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in ids}
    assert any(find(i) != i for i in ids)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracles(spark, name):
    _, differences = compare(Q.QUERIES[name](spark, SF), Q.ORACLES[name], SF)
    assert not differences, differences


def test_op3(spark, docs):
    tokenizer = vocab.Encoder(vocab.default_path("byte_bpe_50k.json"), True).tokenizer
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in docs.items()}
    rows = Q.op3_packing(spark, SF).collect()
    seen, sequences = {i: 0 for i in docs}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length])
        seen[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in ids.items()}
    padding = 0
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own[:-1])]).tolist()
        total = sum(n for _, n in own)
        padding += 0 if total & (total - 1) == 0 else 1024 - total
    assert padding < 0.005 * sum(seen.values())


def test_op7(spark, docs):
    for r in Q.op7_quality_rules(spark, SF).collect():
        want = rules(docs[r.doc_id])
        assert {k: r[k] for k in want} == want and not (r.base_failed and r.kept)


def test_op8(spark, docs):
    rows = Q.op8_secret_scan(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = secrets(docs[r.doc_id])
        assert r.base_sha256 == digest(docs[r.doc_id]) and [r.n_assign, r.n_access, r.n_hex] == [sum(b[1] == k for b in base) for k in range(3)]


def test_op9(spark):
    pages = {r["page_id"]: r["html"] for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    for r in Q.op9_html_extraction(spark, SF).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_op10(spark, docs):
    tokenizer = vocab.Encoder(vocab.default_path("word_bpe_49k.json"), False).tokenizer
    start = 0
    rows = sorted(Q.op10_bit_plane_ids(spark, SF).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == sorted(docs)
    for r in rows:
        ids = [*tokenizer.encode(docs[r.doc_id], add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_op5_and_op6_cover_every_document(spark, docs):
    scores = Q.op5_lm_scoring(spark, SF).collect()
    assert sorted(r.doc_id for r in scores) == sorted(docs) and all(r.log_prob <= 0 for r in scores)
    for r in Q.op6_pii(spark, SF).collect():
        found = sum(r[k] for k in r.asDict() if k.startswith("n_"))
        assert (r.text == docs[r.doc_id]) == (found == 0)
        assert not re.search(r"[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) 555-", r.text) or found
