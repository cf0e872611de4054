"""The property graph as typed tables, and its projection from the test tables.

Node and edge tables have fixed columns. ``Graph`` holds them as DataFrames;
``graph_of`` projects them from the relational test tables, and ``SQL`` states
the same projection as common table expressions.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


@dataclass(frozen=True)
class Graph:
    """Nodes: paper, entity, problem, gap, idea, claim, evidence, section, method. The rest are edges; vec holds vectors."""

    paper: DataFrame
    entity: DataFrame
    paper_entity: DataFrame
    claim: DataFrame
    evidence: DataFrame
    supported_by: DataFrame
    problem: DataFrame
    has_problem: DataFrame
    gap: DataFrame
    has_gap: DataFrame
    idea: DataFrame
    addressed_by: DataFrame
    idea_claim: DataFrame
    cites: DataFrame
    method: DataFrame
    evolves: DataFrame
    section: DataFrame
    vec: DataFrame


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SQL = """paper AS (SELECT o_orderkey AS paper_id, concat('order-', o_orderkey) AS title, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(year(o_orderdate) AS BIGINT) END AS year, o_orderpriority AS venue FROM orders),
entity AS (SELECT p_partkey AS entity_id, p_name AS name, p_type AS entity_type, p_brand AS description FROM part),
paper_entity AS (SELECT l_orderkey AS src, CASE l_returnflag WHEN 'R' THEN 'PROPOSES' WHEN 'A' THEN 'INTRODUCES' ELSE 'USES' END AS rel, l_partkey AS dst, CASE WHEN max(l_discount) = 0 THEN NULL ELSE round(max(l_discount) * 10, 6) END AS confidence, concat('rule.', min(l_linestatus)) AS source_rule FROM lineitem GROUP BY 1, 2, 3),
claim AS (SELECT l_orderkey * 10 + l_linenumber AS claim_id, min(l_orderkey) AS paper_id, concat('the ', min(p_name), ' improves the score') AS text, CASE min(l_linestatus) WHEN 'F' THEN 'PERFORMANCE' ELSE 'NOVELTY' END AS claim_type, CASE min(l_returnflag) WHEN 'R' THEN 'P2' WHEN 'A' THEN 'P0' ELSE 'P1' END AS severity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 2 GROUP BY 1),
evidence AS (SELECT l_orderkey * 10 + l_linenumber AS evidence_id, min(l_orderkey) AS paper_id, min(p_name) AS dataset, CASE WHEN max(l_linenumber) = 7 THEN NULL ELSE concat('measured on ', min(p_name)) END AS summary, min(l_returnflag) AS flag, min(l_linestatus) AS status FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber > 2 GROUP BY 1),
supported_by AS (SELECT c.claim_id, e.evidence_id, CASE WHEN flag = 'R' THEN 'FULL' WHEN flag = 'A' THEN 'PARTIAL' WHEN status = 'O' THEN 'REFUTED' ELSE 'UNVERIFIABLE' END AS strength FROM claim c JOIN evidence e ON c.paper_id = e.paper_id WHERE (c.claim_id + e.evidence_id) % 2 = 0),
problem AS (SELECT CAST(n_nationkey AS BIGINT) AS problem_id, n_name AS description FROM nation),
has_problem AS (SELECT o_orderkey AS paper_id, CAST(c_nationkey AS BIGINT) AS problem_id FROM orders JOIN customer ON o_custkey = c_custkey),
gap AS (SELECT s_suppkey AS gap_id, s_name AS failure_mode, concat('limit ', s_nationkey) AS constraint_text FROM supplier),
has_gap AS (SELECT CAST(s_nationkey AS BIGINT) AS problem_id, s_suppkey AS gap_id FROM supplier),
idea AS (SELECT c_custkey AS idea_id, c_name AS mechanism, c_mktsegment AS novelty_type FROM customer WHERE c_acctbal > 9000),
addressed_by AS (SELECT s_suppkey AS gap_id, c_custkey AS idea_id FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_acctbal > 9000 AND s_acctbal >= 5000),
idea_claim AS (SELECT o_custkey AS idea_id, claim_id FROM orders JOIN claim ON o_orderkey = paper_id JOIN idea ON o_custkey = idea_id),
cites AS (SELECT citing, cited, CASE venue WHEN '1-URGENT' THEN 'EVOLVES_FROM' WHEN '2-HIGH' THEN 'CITES_FOR_FOUNDATION' ELSE 'COMPARISON' END AS intent, CASE WHEN venue = '5-LOW' THEN NULL ELSE CAST(citing % 10 AS DOUBLE) / 10 END AS confidence FROM (SELECT o_orderkey AS citing, o_orderpriority AS venue, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS cited FROM orders) x WHERE cited IS NOT NULL),
method AS (SELECT conv_id * 1000 + turn AS method_id, min(role) AS name, min(2000 + turn) AS year FROM conversations GROUP BY 1),
evolves AS (SELECT a.method_id AS cur, b.method_id AS prev, concat('from ', b.name) AS delta FROM method a JOIN method b ON b.method_id = a.method_id - 1 WHERE a.method_id % 1000 > 0),
section AS (SELECT CAST(r_regionkey AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id, r_name AS title FROM region UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), n_name FROM nation UNION ALL SELECT 1000 + s_suppkey, CAST(100 + s_nationkey AS BIGINT), s_name FROM supplier),
vec AS (SELECT vec_id, embedding, CASE WHEN label < 4 THEN 'entity' WHEN label < 6 THEN 'section' WHEN label < 8 THEN 'claim' WHEN label < 9 THEN 'evidence' ELSE 'citation' END AS doc_kind, CASE label % 3 WHEN 0 THEN 'METHOD' WHEN 1 THEN 'DATASET' ELSE 'TASK' END AS entity_type, CAST(vec_id % 97 AS BIGINT) AS paper_id FROM embeddings)"""


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def graph_of(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph, projected from the relational test tables."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders, lines, part, customer, supplier, nation = map(read, ("orders", "lineitem", "part", "customer", "supplier", "nation"))
    c = F.col
    paper = orders.select(
        c("o_orderkey").alias("paper_id"), F.concat(F.lit("order-"), c("o_orderkey").cast("string")).alias("title"),
        F.when(c("o_orderstatus") != "P", F.year("o_orderdate").cast("long")).alias("year"), c("o_orderpriority").alias("venue"),
    )
    entity = part.select(c("p_partkey").alias("entity_id"), c("p_name").alias("name"), c("p_type").alias("entity_type"), c("p_brand").alias("description"))
    relation = F.when(c("l_returnflag") == "R", "PROPOSES").when(c("l_returnflag") == "A", "INTRODUCES").otherwise("USES")
    paper_entity = lines.groupBy(c("l_orderkey").alias("src"), relation.alias("rel"), c("l_partkey").alias("dst")).agg(
        F.when(F.max("l_discount") != 0, F.round(F.max("l_discount") * 10, 6)).alias("confidence"), F.concat(F.lit("rule."), F.min("l_linestatus")).alias("source_rule")
    )
    line = lines.join(part, c("l_partkey") == c("p_partkey")).withColumn("id", c("l_orderkey") * 10 + c("l_linenumber"))
    claim = line.where("l_linenumber <= 2").groupBy(c("id").alias("claim_id")).agg(
        F.min("l_orderkey").alias("paper_id"), F.concat(F.lit("the "), F.min("p_name"), F.lit(" improves the score")).alias("text"),
        F.when(F.min("l_linestatus") == "F", "PERFORMANCE").otherwise("NOVELTY").alias("claim_type"),
        F.when(F.min("l_returnflag") == "R", "P2").when(F.min("l_returnflag") == "A", "P0").otherwise("P1").alias("severity"),
    )
    evidence = line.where("l_linenumber > 2").groupBy(c("id").alias("evidence_id")).agg(
        F.min("l_orderkey").alias("paper_id"), F.min("p_name").alias("dataset"), F.when(F.max("l_linenumber") != 7, F.concat(F.lit("measured on "), F.min("p_name"))).alias("summary"),
        F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"),
    )
    strength = F.when(c("flag") == "R", "FULL").when(c("flag") == "A", "PARTIAL").when(c("status") == "O", "REFUTED").otherwise("UNVERIFIABLE")
    supported_by = claim.select("claim_id", "paper_id").join(evidence, "paper_id").where("(claim_id + evidence_id) % 2 = 0").select("claim_id", "evidence_id", strength.alias("strength"))
    problem = nation.select(c("n_nationkey").cast("long").alias("problem_id"), c("n_name").alias("description"))
    has_problem = orders.join(customer, c("o_custkey") == c("c_custkey")).select(c("o_orderkey").alias("paper_id"), c("c_nationkey").cast("long").alias("problem_id"))
    gap = supplier.select(c("s_suppkey").alias("gap_id"), c("s_name").alias("failure_mode"), F.concat(F.lit("limit "), c("s_nationkey").cast("string")).alias("constraint_text"))
    has_gap = supplier.select(c("s_nationkey").cast("long").alias("problem_id"), c("s_suppkey").alias("gap_id"))
    rich = customer.where("c_acctbal > 9000")
    idea = rich.select(c("c_custkey").alias("idea_id"), c("c_name").alias("mechanism"), c("c_mktsegment").alias("novelty_type"))
    addressed_by = supplier.where("s_acctbal >= 5000").join(rich, c("s_nationkey") == c("c_nationkey")).select(c("s_suppkey").alias("gap_id"), c("c_custkey").alias("idea_id"))
    idea_claim = orders.join(claim, c("o_orderkey") == c("paper_id")).join(idea, c("o_custkey") == c("idea_id")).select("idea_id", "claim_id")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    intent = F.when(c("o_orderpriority") == "1-URGENT", "EVOLVES_FROM").when(c("o_orderpriority") == "2-HIGH", "CITES_FOR_FOUNDATION").otherwise("COMPARISON")
    cites = orders.withColumn("cited", F.lag("o_orderkey").over(order)).where("cited is not null").select(
        c("o_orderkey").alias("citing"), "cited", intent.alias("intent"), F.when(c("o_orderpriority") != "5-LOW", (c("o_orderkey") % 10).cast("double") / 10).alias("confidence")
    )
    method = read("conversations").groupBy((c("conv_id") * 1000 + c("turn")).alias("method_id")).agg(F.min("role").alias("name"), F.min(2000 + c("turn")).alias("year"))
    old = method.select(c("method_id").alias("prev"), F.concat(F.lit("from "), c("name")).alias("delta"))
    evolves = method.where("method_id % 1000 > 0").select(c("method_id").alias("cur")).join(old, c("prev") == c("cur") - 1).select("cur", "prev", "delta")
    section = (
        read("region").select(c("r_regionkey").cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), c("r_name").alias("title"))
        .unionByName(nation.select((100 + c("n_nationkey")).cast("long").alias("node_id"), c("n_regionkey").cast("long").alias("parent_id"), c("n_name").alias("title")))
        .unionByName(supplier.select((1000 + c("s_suppkey")).alias("node_id"), (100 + c("s_nationkey")).cast("long").alias("parent_id"), c("s_name").alias("title")))
    )
    kind = F.when(c("label") < 4, "entity").when(c("label") < 6, "section").when(c("label") < 8, "claim").when(c("label") < 9, "evidence").otherwise("citation")
    etype = F.when(c("label") % 3 == 0, "METHOD").when(c("label") % 3 == 1, "DATASET").otherwise("TASK")
    vec = read("embeddings").select("vec_id", "embedding", kind.alias("doc_kind"), etype.alias("entity_type"), (c("vec_id") % 97).cast("long").alias("paper_id"))
    return Graph(paper, entity, paper_entity, claim, evidence, supported_by, problem, has_problem, gap, has_gap, idea, addressed_by, idea_claim, cites, method, evolves, section, vec)
