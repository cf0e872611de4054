"""Sources, store, streaming ingest, resolution, vectors, models."""
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.operators import models as M, patterns, resolve as R, store as ST, vectors as V
from evigraph.plans import retrieval as RT
from evigraph.sources import citations, records
from evigraph.streaming import ingest as S

RECORD = {
    "id": "TEST0", "title": "Paper 0", "authors": "Alice Smith, Bob Jones, Charlie Brown", "abstract": "a", "content": "# TITLE\n## ABSTRACT\nsum\n## 1 INTRODUCTION\nintro text\n## 2 METHOD\nwe do", "year": "2023",
    "conference": "ICLR", "content_meta": json.dumps({"table_of_contents": [{"title": "T", "heading_level": None, "page_id": 1}]}),
    "related_notes": repr([{"id": "n1", "content": {"rating": "6: x", "weaknesses": "weak point long enough"}}]),
}


@pytest.fixture
def jsonl(tmp_path):
    lines = [json.dumps({**RECORD, "id": f"TEST{i}", "title": f"Paper {i}"}) for i in range(3)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join([lines[0], "", "{broken", lines[1], lines[2], json.dumps({"id": "E", "title": "Empty", "content": ""})]))
    return str(tmp_path / "in")


def test_records(spark, jsonl):
    rows = records.records(spark, jsonl)
    assert sorted(r.id for r in rows.collect()) == ["E", "TEST0", "TEST1", "TEST2"]
    skip = spark.createDataFrame([("TEST0",), ("TEST2",), ("E",)], "id string")
    assert [r.id for r in records.records(spark, jsonl, skip=skip).collect()] == ["TEST1"] and records.records(spark, jsonl, limit=2).count() == 2
    own = {r.id: r for r in records.normalised(rows).collect()}
    assert own["TEST0"].authors == ["Alice Smith", "Bob Jones", "Charlie Brown"] and own["TEST0"].year == 2023 and own["TEST0"].toc[0].page_id == 1 and own["E"].authors == []
    assert records.decode_notes('[{"id": 1}, 2]') == [{"id": 1}] and records.decode_notes(" ") == [] and records.decode_notes("{bad") == []
    note = records.notes(records.paper_sources(records.normalised(rows))).where("paper_id = 'TEST0'").first()
    assert note.note_id == "n1" and note.content["rating"] == "6: x"


def test_files_and_conversion(spark, tmp_path):
    (tmp_path / "b one.txt").write_text("two\nlines")
    (tmp_path / "a.txt").write_text("first")
    (tmp_path / "c.pdf").write_bytes(b"%x")
    (tmp_path / "d.pdf").write_bytes(b"%y")
    rows = records.text_files(spark, str(tmp_path)).collect()
    assert [(r.title, r.text) for r in rows] == [("a", "first"), ("b one", "two\nlines")]

    def convert(raw):
        if raw.endswith(b"y"):
            raise ValueError("bad")
        return raw.decode()

    got = sorted((r.text, r.error) for r in records.converted(spark, str(tmp_path), convert).collect())
    assert got == [("", "ValueError: bad"), ("%x", None)]
    assert records.render("Hi {{ a }} {{ b }}", a="x") == "Hi x {{ b }}"


def test_citation_source(spark):
    citations.register(spark)
    read = spark.read.format("paper_citations").option("ids", "p,q").option("answers", json.dumps({"p": [{"title": "T", "year": 2001}, {"title": ""}]}))
    assert [tuple(r) for r in read.load().collect()] == [("p", "T", 2001, "COMPARISON", 0.6)]


def test_store_is_idempotent(spark, tmp_path):
    s = ST.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "a", 2000), (2, "b", None)], "paper_id long, title string, year int")
    assert s.read("paper") is None
    for _ in range(2):
        s.upsert("paper", rows)
    assert sorted(map(tuple, s.read("paper").select("paper_id", "title", "year").collect())) == [(1, "a", 2000), (2, "b", None)]
    s.upsert("paper", spark.createDataFrame([(2, "new", 7, "v")], "paper_id long, title string, year int, venue string"))
    s.delete("paper", spark.createDataFrame([(1,)], "paper_id long"))
    want = [(2, "new", 7, "v")]
    assert [tuple(r) for r in s.read("paper").select("paper_id", "title", "year", "venue").collect()] == want
    s.compact("paper")
    assert len(s.batches("paper")) == 1 and [tuple(r) for r in s.read("paper").select("paper_id", "title", "year", "venue").collect()] == want
    (tmp_path / "paper" / "seq=000000099").mkdir()  # a write that never finished
    assert len(s.batches("paper")) == 1
    with pytest.raises(ValueError):
        s.upsert("cites", rows)


def test_entity_attributes(spark):
    df = spark.createDataFrame([("METHOD", {"good_key": "1", "bad key": "2", "n": None})], "entity_type string, attributes map<string,string>")
    row = ST.entity_rows(df).first()
    assert row.label == "Method" and row.attributes == {"good_key": "1"}


def tables_of(store):
    return {t: sorted(map(str, store.read(t).collect())) for t in ("paper", "section", "claim", "processed")}


def test_batch_and_stream_give_the_same_tables(spark, jsonl, tmp_path):
    batch, stream = ST.Store(spark, str(tmp_path / "b")), ST.Store(spark, str(tmp_path / "s"))
    first = S.ingest(batch, records.records(spark, jsonl)).first()
    assert (first.success, first.failed, first.skipped) == (3, 1, 0)
    again = S.ingest(batch, records.records(spark, jsonl)).first()
    assert (again.success, again.skipped) == (0, 3)
    seen = []
    S.ingest_stream(stream, jsonl, str(tmp_path / "cp"), lambda n, t: seen.append(t.first().success)).awaitTermination(120)
    S.ingest_stream(stream, jsonl, str(tmp_path / "cp")).awaitTermination(120)
    assert seen == [3] and tables_of(stream) == tables_of(batch)
    assert batch.read("claim").count() == 3


def test_stream_windows_equal_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", i % 3, "click" if i % 2 else "view", float(i)) for i in range(50)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "e"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = S.windowed(source).writeStream.format("memory").queryName("w_test").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(str, spark.table("w_test").collect())) == sorted(map(str, S.windowed(events).collect()))
    assert S.sessions(events, "5 minutes").count() == 3


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)]
    root: dict = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.component for r in R.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_resolution(spark):
    ent = spark.createDataFrame([(1, "METHOD", "Graph Nets"), (2, "METHOD", "graph-net"), (3, "DATASET", "graph net"), (4, "METHOD", "Other"), (5, "METHOD", "graph net")], "entity_id long, entity_type string, name string")
    merges = {r.dupe: r.keeper for r in R.exact_merges(ent).collect()}
    assert merges == {1: 2, 5: 2}
    edges = spark.createDataFrame([(9, "USES", 1, 0.5, "b"), (9, "USES", 5, 0.7, "a"), (1, "EXTENDS", 5, 0.1, "x"), (9, "USES", 4, None, "z")], "src long, rel string, dst long, confidence double, source_rule string")
    got = sorted(map(tuple, R.rewrite_edges(edges, R.exact_merges(ent)).collect()))
    assert got == [(9, "USES", 1, 0.7, "a"), (9, "USES", 4, None, "z")]
    chunks = R.cluster_chunks(spark.createDataFrame([(0, i) for i in range(64)], "component int, node int"))
    by: dict = {}
    for r in chunks.collect():
        by.setdefault(r.chunk, []).append(r.node)
    want = {k: list(range(s, min(s + 30, 64))) for k, s in enumerate(range(0, 64, 28)) if min(s + 30, 64) - s >= 2}
    assert {k: sorted(v) for k, v in by.items()} == want


def test_nearest_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 8))
    df = spark.createDataFrame([(i, [float(v) for v in row], i % 2) for i, row in enumerate(x)], "vec_id long, embedding array<float>, kind int").repartition(5)
    unit = np.float32(x).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 6)
    want = set()
    for i in range(60):
        order = sorted((j for j in range(60) if j != i and j % 2 == i % 2), key=lambda j: (-score[i, j], j))[:4]
        want |= {(i, j) for j in order}
    assert {(r.query_id, r.vec_id) for r in V.nearest(df, df, 4, same="kind").collect()} == want
    assert V.nearest(df.limit(0), df, 3).count() == 0


def test_models(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id long, t string")
    got = {r.id: r.embedding for r in M.embedded(df, "t", M.HashEmbedder(16)).collect()}
    assert got[1] == got[2] and len(got[1]) == 16 and got[3] is None
    answers = M.EchoCompleter((("p1", '{"entities": [{"name": "A", "type": "method"}, {"name": " "}], "relations": [{"source": "a", "target": "B", "type": "uses"}], "new": 1}'),))
    out = M.completed(spark.createDataFrame([("x", "ask p1"), ("y", "ask p2")], "paper_id string, prompt string"), "prompt", answers, M.ENTITIES)
    assert [(r.paper_id, r.entity_type, r.name) for r in M.entities(out).collect()] == [("x", "METHOD", "A")]
    ids = spark.createDataFrame([("x", "A", 1), ("x", "b", 2)], "paper_id string, name string, entity_id long")
    assert [tuple(r) for r in M.relations(out, ids).collect()] == [(1, "USES", 2)]
    pauses = []
    with pytest.raises(ZeroDivisionError):
        M.retried(lambda: 1 / 0, sleep=pauses.append)
    assert pauses == [1.0, 2.0]
    keep = spark.range(1).select(M.in_range(F.array(F.lit(0), F.lit(99), F.lit(-1)), F.array(F.lit("a"))).alias("x")).first().x
    assert keep == [0]


def test_evolution_links(spark):
    methods = spark.createDataFrame([(1, "A"), (2, "B")], "method_id long, method_name string")
    run = lambda *links: {(r.prev, r.cur) for r in M.evolution_links(spark.createDataFrame([(i, *x, "d") for i, x in enumerate(links)], "seq int, from_method string, to_method string, delta string"), methods).collect()}
    assert run(("a", "b")) == {(1, 2)} and run(("a", "a")) == set() and run(("a", "b"), ("b", "a")) == {(1, 2)} and run(("a", "zz")) == set()


def test_rerank_keeps_small_results(spark):
    rows = spark.createDataFrame([(1, 0.9), (2, 0.8)], "paper_id long, score double")
    rank = spark.createDataFrame([(2, 0), (1, 1)], "paper_id long, position int")
    assert [(r.paper_id, r.rerank_position) for r in RT.reranked(rows, rank).orderBy("rerank_position").collect()] == [(1, 0), (2, 1)]
    three = rows.unionByName(spark.createDataFrame([(3, 0.99)], rows.schema))
    assert [r.paper_id for r in RT.reranked(three, rank).orderBy("rerank_position").collect()] == [2, 1, 3]


def test_index_links(spark):
    left = spark.createDataFrame([("p", 1, [0, 99, -1]), ("p", 2, []), ("q", 3, [])], "paper_id string, item_id long, ids array<int>")
    right = spark.createDataFrame([("p", 10, 0), ("p", 11, 1), ("q", 12, 0), ("q", 13, 1)], "paper_id string, item_id long, seq int")
    assert sorted((r.left_id, r.right_id) for r in ST.index_links(left, right, "ids").collect()) == [(1, 10), (3, 12), (3, 13)]


def test_chain_refuses_cycles(spark):
    from types import SimpleNamespace

    method = spark.createDataFrame([(i, "m", 2000) for i in range(3)], "method_id long, name string, year int")
    edges = spark.createDataFrame([(0, 1, "d"), (1, 2, "d"), (2, 0, "d")], "cur long, prev long, delta string")
    with pytest.raises(ValueError):
        patterns.evolution_chain(SimpleNamespace(method=method, evolves=edges), 16)
