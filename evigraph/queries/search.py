"""Vector search, retrieval, entity resolution, store and ingest queries, each with the same query in SQL where SQL has one."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import loose_json
from ..operators import models as M
from ..operators import parse, resolve, store as ST, vectors as V
from ..plans import retrieval as RT
from ..projection import SQL, graph_of
from ..runtime import fresh_path, shared_dir
from ..sources import citations
from .graph import BRIDGES, GAPS, LEDGER, METHODS, SIDE_A, SIDE_B, _family

QUERIES: dict = {}
ORACLES: dict = {}
c = F.col


def query(sql: str | None = None):
    """Register a function (graph) -> DataFrame under its name, with its SQL if there is one."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(graph_of(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = f"WITH {SQL}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return f

    return add


def query_vector(g) -> list[float]:
    """The vector of the query: that of the first point."""
    return g.vec.where("vec_id = 0").first()["embedding"]


Q = "(SELECT embedding::DOUBLE[] FROM vec WHERE vec_id = 0)"
SCORED = f"sc AS (SELECT vec_id, doc_kind, entity_type, paper_id, round(list_cosine_similarity(embedding::DOUBLE[], {Q}), 6) AS score FROM vec)"


@query(f", {SCORED} SELECT vec_id, entity_type, paper_id, round(score, 5) AS score FROM sc WHERE doc_kind = 'entity' AND entity_type = 'METHOD' ORDER BY sc.score DESC, vec_id LIMIT 10")
def vec01_filtered_top_k(g):
    return V.top_k(g.vec, query_vector(g), 10, (c("doc_kind") == "entity") & (c("entity_type") == "METHOD")).select("vec_id", "entity_type", "paper_id", F.round("score", 5).alias("score"))


PAIRS = """knn AS (SELECT * FROM (SELECT a.vec_id AS qa, b.vec_id AS qb, s, row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) AS rn
FROM vec a JOIN vec b ON a.doc_kind = b.doc_kind AND a.vec_id <> b.vec_id, LATERAL (SELECT round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s) z WHERE s >= 0.2) x WHERE rn <= 10),
pairs AS (SELECT least(qa, qb) AS id_a, greatest(qa, qb) AS id_b, max(s) AS score FROM knn GROUP BY 1, 2)"""


@query(f", {PAIRS} SELECT id_a, id_b, score FROM pairs")
def vec02_similar_pairs(g):
    return V.similar_pairs(g.vec, 0.2, 10, same="doc_kind")


@query(f", {PAIRS} SELECT qa AS query_id, count(*) AS n, max(s) AS best FROM knn GROUP BY 1")
def win09_top_k_per_key(g):
    return V.nearest(g.vec, g.vec, 10, 0.2, same="doc_kind").groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))


def _kind_nn(kind: str) -> str:
    return f"""SELECT * FROM (SELECT a.vec_id AS claim_vec, '{kind}' AS kind, b.vec_id AS vec_id, s AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) AS rn FROM vec a JOIN vec b ON a.vec_id <> b.vec_id,
LATERAL (SELECT round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s) z WHERE a.doc_kind = 'claim' AND b.doc_kind = '{kind}') x WHERE rn <= 5"""


@query(f"SELECT claim_vec, kind, vec_id, score FROM ({_kind_nn('claim')} UNION ALL {_kind_nn('evidence')}) y")
def vec04_verify_claims(g):
    return RT.verified_claims(g.vec.where("doc_kind = 'claim'"), g)


def _hits(kind: str, k: int, path: str) -> str:
    return f"(SELECT paper_id, '{path}' AS path, greatest(score, 0) AS score, entity_type AS payload FROM (SELECT * FROM sc WHERE doc_kind = '{kind}' ORDER BY score DESC, vec_id LIMIT {k}) h)"


COMPETE = f"""{SCORED}, paths AS ({_hits('entity', 40, 'entity')} UNION ALL {_hits('claim', 20, 'claim')} UNION ALL {_hits('section', 20, 'section')}),
best AS (SELECT paper_id, max(score) AS score FROM paths GROUP BY 1)"""


@query(f", {COMPETE} SELECT paper_id, round(score, 5) AS score FROM best")
def agg12_best_per_paper(g):
    q = query_vector(g)
    paths = RT.hits(g, q, "entity", 40, "entity").unionByName(RT.hits(g, q, "claim", 20, "claim")).unionByName(RT.hits(g, q, "section", 20, "section"))
    return paths.groupBy("paper_id").agg(F.round(F.max("score"), 5).alias("score"))


@query(f""", {COMPETE}, own AS (SELECT DISTINCT src, dst FROM paper_entity WHERE rel IN ('PROPOSES', 'INTRODUCES')),
top AS (SELECT paper_id FROM best ORDER BY score DESC, paper_id LIMIT 10),
near AS (SELECT DISTINCT paper_id FROM (SELECT a.src AS seed, b.src AS paper_id, row_number() OVER (PARTITION BY a.src ORDER BY count(*) DESC, b.src) AS rn FROM own a JOIN own b ON a.dst = b.dst WHERE a.src <> b.src AND a.src IN (SELECT paper_id FROM top) GROUP BY 1, 2) x WHERE rn <= 5)
SELECT paper_id, round(score, 5) AS score FROM (SELECT * FROM best UNION ALL SELECT paper_id, CAST(0.3 AS DOUBLE) FROM near WHERE paper_id NOT IN (SELECT paper_id FROM best)) y ORDER BY y.score DESC, paper_id LIMIT 20""")
def ret01_competition_space(g):
    return RT.competition_space(g, query_vector(g)).withColumn("score", F.round("score", 5))


TREND = f"""{SCORED}, h AS (SELECT * FROM sc WHERE doc_kind = 'entity' ORDER BY score DESC, vec_id LIMIT 50)"""


@query(f", {TREND} SELECT entity_type, count(*) AS n, count(DISTINCT paper_id) AS papers FROM h WHERE paper_id IN (SELECT paper_id FROM paper WHERE year BETWEEN 1993 AND 1997) GROUP BY 1")
def agg09_research_trends(g):
    return RT.research_trends(g, query_vector(g), (1997, 1993))


@query(", f AS (SELECT doc_kind, count(*) AS n FROM vec GROUP BY 1) SELECT CASE WHEN doc_kind IN ('entity', 'section') THEN 'entities' ELSE 'claims' END AS collection, CAST(sum(n) AS BIGINT) AS points FROM f GROUP BY 1")
def agg17_collection_counts(g):
    return g.vec.groupBy(F.when(c("doc_kind").isin("entity", "section"), "entities").otherwise("claims").alias("collection")).agg(F.count("*").alias("points"))


@query(f", {GAPS} SELECT DISTINCT problem_id, g.gap_id, failure_mode, i.idea_id, mechanism, coalesce((SELECT count(DISTINCT claim_id) FROM idea_claim x WHERE x.idea_id = i.idea_id), 0) AS claim_count FROM gm g LEFT JOIN addressed_by a ON a.gap_id = g.gap_id LEFT JOIN idea i ON i.idea_id = a.idea_id")
def ret06_innovation_paths(g):
    return RT.innovation_paths(g, METHODS)


@query(f", {BRIDGES}, bp AS (SELECT title, year FROM {_family(SIDE_A, 'ma')} a JOIN {_family(SIDE_B, 'mb')} b ON a.paper_id = b.paper_id JOIN paper p ON p.paper_id = a.paper_id ORDER BY year DESC NULLS FIRST, p.paper_id LIMIT 20) SELECT 'concept' AS kind, concat(entity_type, ':', name) AS item, papers_a_count + papers_b_count AS weight FROM (SELECT * FROM br ORDER BY papers_a_count + papers_b_count DESC, entity_type, name, papers_a_count LIMIT 30) z UNION ALL SELECT 'paper', title, year FROM bp")
def ret07_bridge_report(g):
    return RT.bridge_report(g, SIDE_A, SIDE_B)


@query(f", {LEDGER} SELECT paper_id, claim_id, severity, support_status, evidence_count FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY claim_id) AS rn FROM led) x WHERE rn <= 5")
def ret10_aligned_ledgers(g):
    return RT.aligned_ledgers(g, g.paper)


@query(f"""SELECT q.vec_id, x.paper_id, title, year, round(s, 5) AS score FROM vec q LEFT JOIN (SELECT * FROM (SELECT a.vec_id AS qa, b.paper_id, s, row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) AS rn FROM vec a JOIN vec b ON a.vec_id <> b.vec_id,
LATERAL (SELECT round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s) z WHERE a.doc_kind = 'citation' AND b.doc_kind IN ('entity', 'claim')) y WHERE rn = 1) x ON x.qa = q.vec_id LEFT JOIN paper p ON p.paper_id = x.paper_id WHERE q.doc_kind = 'citation'""")
def ret11_verify_citations(g):
    return RT.verified_citations(g.vec.where("doc_kind = 'citation'"), g).withColumn("score", F.round("score", 5))


MERGES = """merges AS (SELECT entity_id AS dupe, first_value(entity_id) OVER (PARTITION BY entity_type, CASE WHEN length(name) > 3 AND right(name, 1) = 's' AND right(name, 2) <> 'ss' THEN left(name, length(name) - 1) ELSE name END ORDER BY length(name), entity_id) AS keeper FROM entity)"""


@query(f", {MERGES} SELECT dupe, keeper FROM merges WHERE dupe <> keeper")
def er01_exact_merges(g):
    return resolve.exact_merges(g.entity)


@query(f", {MERGES} SELECT m.keeper, count(*) AS n FROM merges m GROUP BY 1 HAVING count(*) > 1")
def agg14_duplicate_groups(g):
    return resolve.exact_merges(g.entity).groupBy("keeper").agg((F.count("*") + 1).alias("n"))


@query(f", {PAIRS} SELECT count(*) AS pairs, count(DISTINCT id_a) AS left_ids FROM pairs")
def agg16_pair_counts(g):
    return V.similar_pairs(g.vec, 0.2, 10, same="doc_kind").agg(F.count("*").alias("pairs"), F.countDistinct("id_a").alias("left_ids"))


def er02_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the citation links."""
    g = graph_of(spark, sf_dir)
    return resolve.connected(g.cites.select(c("citing").alias("a"), c("cited").alias("b")))


QUERIES["er02_components"] = er02_components
# the orders of one customer form a chain, so its first order is the component
ORACLES["er02_components"] = "SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) x WHERE n > 1"


@query(", x AS (SELECT n_regionkey AS component, n_nationkey AS node, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS place, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation) SELECT component, CAST(k AS INTEGER) AS chunk, node FROM x, unnest(range(0, 10)) t(k) WHERE place >= k * 2 AND place < k * 2 + 3 AND least(n - k * 2, 3) >= 2")
def er03_cluster_chunks(g):
    members = g.section.where("node_id between 100 and 999").select(c("parent_id").cast("int").alias("component"), (c("node_id") - 100).cast("int").alias("node"))
    return resolve.cluster_chunks(members, 3, 2)


@query("SELECT entity_id AS dupe, min(entity_id) OVER w AS keeper, first_value(name) OVER (PARTITION BY entity_type, n ORDER BY length(name), entity_id) AS canonical FROM (SELECT *, CASE WHEN length(name) > 3 AND right(name, 1) = 's' AND right(name, 2) <> 'ss' THEN left(name, length(name) - 1) ELSE name END AS n FROM entity) x WINDOW w AS (PARTITION BY entity_type, n) QUALIFY entity_id <> min(entity_id) OVER w")
def er04_grouping(g):
    return resolve.group_by_name(g.entity)


@query(f", {MERGES} SELECT src, rel, keeper AS dst, max(confidence) AS confidence, min(source_rule) AS source_rule FROM paper_entity JOIN merges ON dupe = dst WHERE src + 1000000000 <> keeper GROUP BY 1, 2, 3")
def er05_edge_rewrite(g):
    shift = 1_000_000_000  # papers and entities share a number space here
    edges = g.paper_entity.withColumn("src", c("src") + shift)
    return resolve.rewrite_edges(edges, resolve.exact_merges(g.entity)).withColumn("src", c("src") - shift)


@query("SELECT src AS paper_id, lower(name) AS key, min(dst) AS entity_id, count(*) AS n FROM paper_entity JOIN entity ON entity_id = dst GROUP BY 1, 2")
def er06_within_paper(g):
    rows = g.paper_entity.join(g.entity, c("entity_id") == c("dst")).select(c("src").alias("paper_id"), "name", "entity_id", "description", c("dst").alias("seq"))
    return resolve.within_paper(rows).select("paper_id", "key", "entity_id", "n")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM vec WHERE doc_kind = 'citation'")
def er07_across_papers(g):
    named = g.vec.withColumn("name", F.concat(F.lit("point "), c("vec_id").cast("string")))
    new, known = named.where("doc_kind = 'citation'"), named
    return resolve.across_papers(new.withColumn("name", F.concat("name", F.lit(" "))), known).agg(F.count("*").alias("n"))


@query(f", {MERGES} SELECT count(*) AS n, count(DISTINCT keeper) AS keepers FROM merges WHERE dupe <> keeper")
def er08_resolution_job(g):
    none = g.entity.select(c("entity_id").alias("id_a"), c("entity_id").alias("id_b")).limit(0)
    merges, _ = resolve.resolve(g.entity, g.paper_entity, none, dry_run=True)
    return merges.agg(F.count("*").alias("n"), F.countDistinct("keeper").alias("keepers"))


def _store(g) -> ST.Store:
    spark = g.paper.sparkSession
    return ST.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


@query("SELECT paper_id, CASE WHEN venue = '1-URGENT' THEN concat(title, '!') ELSE title END AS title, year FROM paper WHERE venue <> '5-LOW'")
def snk03_paper_upsert(g):
    s = _store(g)
    rows = g.paper.select("paper_id", "title", "year", "venue")
    s.upsert("paper", rows)
    s.upsert("paper", rows.where("venue = '1-URGENT'").withColumn("title", F.concat("title", F.lit("!"))))
    s.delete_where("paper", c("venue") == "5-LOW")
    s.compact("paper")
    return s.read("paper").select("paper_id", "title", "year")


@query("SELECT src, rel, dst, confidence, source_rule, 'unknown.source' AS confidence_source FROM paper_entity WHERE confidence IS NOT NULL AND rel <> 'USES'")
def snk04_paper_entity_links(g):
    edges = g.paper_entity.withColumn("rel", F.when(c("rel") == "USES", "OTHER").otherwise(c("rel")))
    return ST.link_paper_entities(edges, g.paper, g.entity).select("src", "rel", "dst", "confidence", "source_rule", "confidence_source")


@query("SELECT citing AS paper_id, concat('cited by ', citing) AS title FROM cites WHERE citing % 7 = 0 UNION SELECT DISTINCT cited, CAST(cited AS VARCHAR) FROM cites WHERE cited % 7 = 0 AND cited NOT IN (SELECT citing FROM cites)")
def snk05_citation_stubs(g):
    titles = g.cites.select(c("citing").alias("paper_id"), F.concat(F.lit("cited by "), c("citing").cast("string")).alias("title")).distinct()
    return ST.citation_stubs(g.cites, g.paper.where("paper_id % 7 <> 0"), titles)


@query("SELECT cur, prev, CASE WHEN cur % 2 = 0 THEN 'new' ELSE delta END AS delta, CAST(CASE WHEN cur % 3 = 0 THEN 1999 ELSE 2000 END AS INTEGER) AS year FROM evolves")
def snk06_evolution_upsert(g):
    old = g.evolves.withColumn("year", F.lit(2000))
    new = g.evolves.select("cur", "prev", F.when(c("cur") % 2 == 0, "new").otherwise(" ").alias("delta"), F.when(c("cur") % 3 == 0, 1999).alias("year"))
    return ST.merge_evolution(old, new)


@query("SELECT claim_id AS dst, paper_id AS src, CAST(0.7 AS DOUBLE) AS confidence FROM claim WHERE claim_id IN (SELECT claim_id FROM idea_claim)")
def snk07_claim_links(g):
    edges = g.claim.select(c("paper_id").alias("src"), c("claim_id").alias("dst"), F.lit(0.7).alias("confidence"))
    return ST.valid_edges(edges, g.paper.select("paper_id"), g.idea_claim.select("claim_id"))


@query("SELECT vec_id, CAST(concat('0x', substr(sha256(CAST(vec_id AS VARCHAR)), 1, 15)) AS BIGINT) AS point_id, doc_kind FROM vec WHERE paper_id <> 5")
def snk13_vector_upsert(g):
    s = _store(g)
    rows = ST.vector_points(g.vec, "claims", "claim", "L3", "vec_id", ["doc_kind", "paper_id"])
    s.upsert("vector", rows.select("collection", "point_id", F.map_entries("payload").alias("payload")))
    s.delete_where("vector", F.map_from_entries("payload")["paper_id"] == "5")
    out = s.read("vector").withColumn("p", F.map_from_entries("payload"))
    return out.select(c("p")["_original_id"].cast("long").alias("vec_id"), "point_id", c("p")["doc_kind"].alias("doc_kind"))


ORACLES["snk13_vector_upsert"] = ORACLES["snk13_vector_upsert"].replace("doc_kind FROM vec WHERE", "'claim' AS doc_kind FROM vec WHERE")


@query("SELECT paper_id FROM paper WHERE venue NOT IN ('1-URGENT', '2-HIGH')")
def snk16_checkpoint(g):
    s = _store(g)
    ST.save_checkpoint(s, g.paper.where("venue = '1-URGENT'"))
    ST.save_checkpoint(s, g.paper.where("venue = '2-HIGH'"))
    return ST.unprocessed(s, g.paper).select("paper_id")


def _uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(c("l_orderkey").alias("src"), c("l_returnflag").alias("rel"), c("l_partkey").alias("dst"))
    return ST.Store(spark, shared_dir(spark)).duplicates("paper_entity", rows)


QUERIES["snk17_uniqueness"] = _uniqueness
ORACLES["snk17_uniqueness"] = "SELECT src, rel, dst, count(*) AS n FROM (SELECT l_orderkey AS src, l_returnflag AS rel, l_partkey AS dst FROM lineitem) x GROUP BY 1, 2, 3 HAVING count(*) > 1"


@query("SELECT name, count(*) AS n FROM entity GROUP BY 1")
def mod02_embeddings(g):
    rows = M.embedded(g.entity.select("entity_id", "name"), "name", M.HashEmbedder())
    return rows.where("embedding is not null and size(embedding) = 64").groupBy("name").agg(F.count("*").alias("n"))


class _Identity:
    """A completer that answers with its prompt."""

    def complete(self, prompts: list[str]) -> list[str]:
        return prompts


@query("SELECT paper_id, concat('METHOD') AS entity_type, title AS name FROM paper")
def mod03_entity_answers(g):
    answer = F.concat(F.lit('```json\n{"entities": [{"name": "'), "title", F.lit('", "type": "method", "extra": 1}], "relations": []\n```'))
    rows = g.paper.select("paper_id", answer.alias("prompt"))
    out = M.completed(rows, "prompt", _Identity(), M.ENTITIES)
    return M.entities(out).select("paper_id", "entity_type", "name")


@query("SELECT cur, prev, delta FROM evolves")
def mod05_evolution_links(g):
    methods = g.method.select(c("method_id"), F.concat(F.lit("M"), c("method_id").cast("string")).alias("method_name"))
    named = lambda x: F.concat(F.lit("m"), c(x).cast("string"))
    links = g.evolves.select(c("cur").alias("seq"), named("prev").alias("from_method"), named("cur").alias("to_method"), "delta")
    back = g.evolves.select((c("cur") + 10**9).alias("seq"), named("cur").alias("from_method"), named("prev").alias("to_method"), F.lit("back").alias("delta"))
    loops = g.evolves.select((c("cur") + 2 * 10**9).alias("seq"), named("cur").alias("from_method"), named("cur").alias("to_method"), F.lit("self").alias("delta"))
    return M.evolution_links(links.unionByName(back).unionByName(loops), methods)


def _tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat(F.lit("<think>{</think>Sure: "), "props", F.lit(" and more")).alias("answer"))
    return loose_json.parsed(rows, "answer").select("event_id", F.from_json("json", "k long")["k"].alias("k"))


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat(F.lit('{"a": '), "props", F.lit(', "items": [{"x": 1}, {"y": "cut of')).alias("answer"))
    return loose_json.parsed(rows, "answer").select("event_id", F.from_json("json", "a struct<k:long>")["a"]["k"].alias("k"))


QUERIES["jsn01_tolerant_json"] = _tolerant
QUERIES["jsn02_repaired_json"] = _repaired
ORACLES["jsn01_tolerant_json"] = ORACLES["jsn02_repaired_json"] = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"


@query("SELECT paper_id, title, CAST(year AS INTEGER) AS year FROM paper WHERE title <> ''")
def src11_citation_source(g):
    """Every paper, its answers read from a written table file by file."""
    spark = g.paper.sparkSession
    citations.register(spark)
    answer = F.to_json(F.array(F.struct("title", "year"), F.struct(F.lit("").alias("title"), F.lit(None).cast("int").alias("year"))))
    path = fresh_path(spark, "citations")
    g.paper.select(c("paper_id").cast("string").alias("id"), answer.alias("answer")).write.parquet(path)
    out = spark.read.format("paper_citations").option("path", path).load()
    return out.select(c("citing").cast("long").alias("paper_id"), "title", "year")


REVIEW = """SELECT o_orderkey AS paper_id, CAST(left(o_orderpriority, 1) AS INTEGER) AS rating, 'Good point one' AS strength, concat('Weak ', o_orderpriority) AS weakness FROM orders"""


def txt15_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined review texts of every order, split into strengths and weaknesses."""
    both = F.concat(F.lit("Good point one\nWeaknesses:\nWeak "), "o_orderpriority")
    content = F.create_map(F.lit("rating"), c("o_orderpriority"), F.lit("strength_and_weaknesses"), both)
    notes = spark.read.parquet(f"{sf_dir}/orders.parquet").select(c("o_orderkey").alias("paper_id"), F.lit("n").alias("note_id"), content.alias("content"))
    return parse.reviews(notes).select("paper_id", "rating", c("strengths")[0].alias("strength"), c("weaknesses")[0].alias("weakness"))


def txt16_review_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.create_map(F.lit("decision"), F.lit("Accept"), F.lit("metareview"), F.concat(F.lit("sum "), "o_orderpriority"), F.lit("weaknesses"), F.concat(F.lit("weak point "), "o_orderstatus"))
    notes = spark.read.parquet(f"{sf_dir}/orders.parquet").select(c("o_orderkey").alias("paper_id"), F.lit("n").alias("note_id"), content.alias("content"))
    return parse.review_claims(parse.reviews(notes))


QUERIES["txt15_reviews"], ORACLES["txt15_reviews"] = txt15_reviews, REVIEW
QUERIES["txt16_review_claims"] = txt16_review_claims
ORACLES["txt16_review_claims"] = """SELECT o_orderkey AS paper_id, concat('[Meta-review] sum ', o_orderpriority) AS text, 'PERFORMANCE' AS claim_type, 'P1' AS severity FROM orders
UNION ALL SELECT o_orderkey, concat('weak point ', o_orderstatus), 'ROBUSTNESS', 'P2' FROM orders"""
