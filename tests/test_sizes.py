"""Pattern queries whose work must grow with their tables or their result, counted by the rows that joins and exchanges pass on."""
from types import SimpleNamespace

import pytest
from oracle import compare
from pyspark.sql import functions as F

from evigraph.operators import parse, patterns as P
from evigraph.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "part", "orders", "lineitem", "conversations", "embeddings")


def passed_on(spark, df, kind: str, metric: str) -> tuple[list, int]:
    """The rows of df, and the sum of a metric over the plan's nodes of one kind."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = df.collect()
        todo, total = [df._jdf.queryExecution().executedPlan()], 0
        while todo:
            node = todo.pop()
            if kind in node.nodeName() and node.metrics().contains(metric):
                total += node.metrics().apply(metric).value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return rows, total
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_gaps_for_methods_shuffles_no_product(spark):
    n = 300
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    g = SimpleNamespace(
        entity=table([(1, "plate"), (2, " Plate "), (3, "rod")], "entity_id long, name string"),
        paper_entity=table([(i, rel, 1 + i % 2) for i in range(n) for rel in ("PROPOSES", "INTRODUCES")] + [(0, "USES", 3)], "src long, rel string, dst long"),
        has_problem=table([(i, 7) for i in range(n)] * 2, "paper_id long, problem_id long"),
        problem=table([(7, "p")], "problem_id long, description string"),
        has_gap=table([(7, i) for i in range(n)] * 2, "problem_id long, gap_id long"),
        gap=table([(i, "same", "same") for i in range(n)], "gap_id long, failure_mode string, constraint_text string"),
    )
    rows, shuffled = passed_on(spark, P.gaps_for_methods(g, ["plate"]), "Exchange", "shuffleRecordsWritten")
    assert len(rows) == len(set(rows)) == n * n
    assert {(r.method, r.paper_id, r.gap_id) for r in rows} == {(" Plate " if i % 2 else "plate", i, j) for i in range(n) for j in range(n)}
    assert shuffled < 20 * n


def test_link_claims_compares_only_names_without_an_equal_key(spark):
    n = 400
    tree = spark.createDataFrame([("p", i, i, f"Part {i}", f"part {i}") for i in range(n)] + [("p", n, n, "Closing words", None)], "paper_id string, node_id long, seq int, title string, section_key string")
    claims = spark.createDataFrame([("p", i, f" PART {i}") for i in range(n)] + [("p", n + i, "the closing words") for i in range(n)], "paper_id string, claim_id long, source_section string")
    rows, joined = passed_on(spark, parse.link_claims(claims, tree), "Join", "numOutputRows")
    assert {r.claim_id: r.node_id for r in rows} == {i: min(i, n) for i in range(2 * n)}
    assert joined < 20 * n


def test_link_claims_takes_the_first_of_equals_and_passes_nulls_over(spark):
    tree = spark.createDataFrame(
        [("p", "b", 2, "Method", "method"), ("p", "a", 1, "Method", "method"), ("p", "c", 3, "Own data set", None), ("p", "d", 0, None, None), ("q", "e", None, "Method", "method"), (None, "f", 0, "Method", "method")],
        "paper_id string, node_id string, seq int, title string, section_key string",
    )
    claims = spark.createDataFrame(
        [("p", 1, "Method"), ("p", 2, "Data set"), ("p", 3, None), ("q", 4, "METHOD "), (None, 5, "Method"), ("p", 6, ""), ("p", 7, "Data set"), ("p", 7, "method"), ("p", 1, "Method")],
        "paper_id string, claim_id long, source_section string",
    )
    assert {r.claim_id: r.node_id for r in parse.link_claims(claims, tree).collect()} == {1: "a", 2: "c", 4: "e", 7: "a"}


@pytest.mark.parametrize("name", ["jn04_gaps_for_methods", "jn06_unaddressed_gaps", "jn18_claim_sections"])
def test_repeated_suppliers(spark, tmp_path, name):
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    own = spark.read.parquet(f"{SF}/supplier.parquet")
    shift = own.agg(F.max("s_suppkey") + 1).first()[0]
    copies = own.unionByName(own.withColumn("s_suppkey", F.col("s_suppkey") + shift)).unionByName(own.withColumn("s_suppkey", F.col("s_suppkey") + 2 * shift))
    copies.coalesce(1).write.parquet(str(tmp_path / "out"))
    next((tmp_path / "out").glob("*.parquet")).rename(tmp_path / "supplier.parquet")
    rows, differences = compare(QUERIES[name](spark, str(tmp_path)), ORACLES[name], str(tmp_path))
    assert rows and not differences, differences
