"""The remaining operators as queries of their own: filters, projections, rankings, links, sinks, sources, model answers, ingest."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import loose_json, text as X
from ..operators import models as M
from ..operators import parse, patterns as P, store as ST, vectors as V
from ..plans import retrieval as RT
from ..projection import SQL, graph_of, tables
from ..runtime import shared_dir
from ..sources import records as R
from ..streaming import ingest as S
from .graph import METHODS, _list
from .search import SCORED, _Identity, query_vector

QUERIES: dict = {}
ORACLES: dict = {}
c = F.col


def query(sql: str | None = None, over=graph_of, plain: bool = False):
    """Register a function of the graph (or the raw tables) under its name, with its SQL if there is one."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(over(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql if plain else f"WITH {SQL}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return f

    return add


def raw(sql: str | None = None):
    return query(sql, tables, True)


# filters and projections


@query("SELECT claim_id, text FROM claim WHERE severity = 'P0'")
def flt01_equality(g):
    return g.claim.where("severity = 'P0'").select("claim_id", "text")


@query("SELECT citing, cited FROM cites WHERE citing <> cited AND confidence <> 0.5")
def flt05_inequality(g):
    return g.cites.where("citing <> cited and confidence <> 0.5").select("citing", "cited")


@query("SELECT vec_id FROM vec WHERE doc_kind = 'claim' AND entity_type = 'DATASET'")
def flt08_payload_conjunction(g):
    conditions = {"doc_kind": "claim", "entity_type": "DATASET"}
    out = g.vec
    for name, value in conditions.items():
        out = out.where(c(name) == value)
    return out.select("vec_id")


@raw("SELECT c_custkey, length(trim(split_part(c_name, '#', 1))) >= 5 AND regexp_matches(c_name, '[A-Za-z]') AS ok FROM customer")
def flt10_valid_cited(t):
    return t["customer"].select("c_custkey", X.valid_cited("c_name").alias("ok"))


@query("SELECT citing, cited, confidence FROM cites WHERE confidence >= 0.8")
def flt12_threshold(g):
    return g.cites.where("confidence >= 0.8").select("citing", "cited", "confidence")


@raw("SELECT conv_id, turn FROM conversations WHERE length(trim(text, ' ' || chr(10) || chr(9) || chr(13))) >= 50")
def flt14_length_gate(t):
    return t["conversations"].where(F.length(X.utrim("text")) >= 50).select("conv_id", "turn")


@query("SELECT paper_id AS id, title AS name, year AS published FROM paper")
def prj01_aliases(g):
    return g.paper.select(c("paper_id").alias("id"), c("title").alias("name"), c("year").alias("published"))


@query("SELECT CAST(paper_id AS VARCHAR) AS id, 'paper' AS label FROM paper UNION ALL SELECT CAST(claim_id AS VARCHAR), 'claim' FROM claim UNION ALL SELECT '', 'problem' FROM problem")
def prj02_first_id(g):
    nodes = g.paper.select("paper_id", F.lit("paper").alias("label")).unionByName(g.claim.select("claim_id", F.lit("claim").alias("label")), allowMissingColumns=True)
    nodes = nodes.unionByName(g.problem.select(F.lit("problem").alias("label")), allowMissingColumns=True)
    return nodes.select(F.coalesce(c("paper_id").cast("string"), c("claim_id").cast("string"), F.lit("")).alias("id"), "label")


@query("SELECT claim_id, concat(severity, '/', claim_type) AS kind FROM claim")
def prj04_structs(g):
    return g.claim.withColumn("m", F.struct("severity", "claim_type")).select("claim_id", F.concat_ws("/", "m.severity", "m.claim_type").alias("kind"))


@query("SELECT DISTINCT 'paper' AS label, rel AS type FROM paper_entity UNION ALL SELECT 'paper', 'CITES' FROM (SELECT 1) x")
def prj05_labels(g):
    return g.paper_entity.select(F.lit("paper").alias("label"), c("rel").alias("type")).distinct().unionByName(g.cites.select(F.lit("paper").alias("label"), F.lit("CITES").alias("type")).distinct())


@query("SELECT src AS paper_id, unnest(list_sort(list(DISTINCT rel))) AS rel FROM paper_entity GROUP BY 1")
def prj06_unwind(g):
    return g.paper_entity.groupBy(c("src").alias("paper_id")).agg(F.array_sort(F.collect_set("rel")).alias("r")).select("paper_id", F.explode("r").alias("rel"))


@query("SELECT src AS paper_id, array_to_string(list_sort(list(DISTINCT dst))[1:3], ',') AS first_three FROM paper_entity GROUP BY 1")
def prj07_slices(g):
    own = g.paper_entity.groupBy(c("src").alias("paper_id")).agg(F.array_sort(F.collect_set("dst")).alias("d"))
    return own.select("paper_id", F.array_join(F.transform(F.slice("d", 1, 3), lambda x: x.cast("string")), ",").alias("first_three"))


@query("SELECT c.claim_id, count(evidence_id) AS n FROM claim c LEFT JOIN supported_by s ON s.claim_id = c.claim_id GROUP BY 1")
def prj08_null_free_lists(g):
    own = g.claim.select("claim_id").join(g.supported_by, "claim_id", "left").groupBy("claim_id").agg(F.collect_list(F.struct("evidence_id")).alias("l"))
    return own.select("claim_id", F.size(F.filter("l", lambda x: x["evidence_id"].isNotNull())).cast("long").alias("n"))


@raw("SELECT conv_id, turn, left(text, 40) AS shown FROM conversations")
def prj12_display(t):
    return t["conversations"].select("conv_id", "turn", X.truncated("text", 40).alias("shown"))


# links by similarity


@query("""SELECT c.paper_id, e.entity_id, c.claim_id, CAST(0.95 AS DOUBLE) AS confidence FROM claim c JOIN (SELECT DISTINCT src, dst FROM paper_entity) p ON p.src = c.paper_id JOIN entity e ON e.entity_id = p.dst WHERE contains(c.text, e.name)""")
def jn16_method_claim_links(g):
    pairs = g.paper_entity.select(c("src").alias("paper_id"), c("dst").alias("entity_id")).distinct().join(g.entity, "entity_id").join(g.claim, "paper_id")
    return pairs.withColumn("confidence", X.method_claim_confidence("name", "text")).where("confidence > 0.9").select("paper_id", "entity_id", "claim_id", "confidence")


@query("""SELECT e.evidence_id, n.entity_id, CAST(0.95 AS DOUBLE) AS confidence FROM evidence e JOIN (SELECT DISTINCT src, dst FROM paper_entity) p ON p.src = e.paper_id JOIN entity n ON n.entity_id = p.dst WHERE n.name = e.dataset""")
def jn16_dataset_evidence_links(g):
    pairs = g.paper_entity.select(c("src").alias("paper_id"), c("dst").alias("entity_id")).distinct().join(g.entity, "entity_id").join(g.evidence, "paper_id")
    return pairs.withColumn("confidence", X.dataset_evidence_confidence("name", F.array("dataset"))).where("confidence > 0.9").select("evidence_id", "entity_id", "confidence")


@query("""SELECT gap_vec, vec_id, score FROM (SELECT a.vec_id AS gap_vec, b.vec_id, s AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) AS rn FROM vec a JOIN vec b ON a.paper_id = b.paper_id AND a.vec_id <> b.vec_id,
LATERAL (SELECT round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s) z WHERE a.doc_kind = 'claim' AND b.doc_kind <> 'claim' AND s >= 0.0) x WHERE rn <= 5""")
def jn17_gap_citations(g):
    found = V.nearest(g.vec.where("doc_kind = 'claim'"), g.vec.where("doc_kind <> 'claim'"), 5, 0.0, same="paper_id")
    return found.select(c("query_id").alias("gap_vec"), "vec_id", "score")


@query("SELECT node_id AS claim_id, node_id FROM section WHERE parent_id IS NOT NULL")
def jn18_claim_sections(g):
    # names of suppliers may repeat, so a section's name ends with its id
    name = F.concat_ws(" ", X.utrim("title"), c("node_id").cast("string"))
    tree = g.section.where("parent_id is not null").select(c("parent_id").alias("paper_id"), "node_id", c("node_id").alias("seq"), "title", F.lower(name).alias("section_key"), F.upper(name).alias("source_section"))
    claims = tree.select("paper_id", c("node_id").alias("claim_id"), "source_section")
    return parse.link_claims(claims, tree).select("claim_id", "node_id")


@query("SELECT name, max(entity_id) AS entity_id, count(*) AS papers FROM entity JOIN paper_entity ON dst = entity_id GROUP BY 1")
def jn19_lookup_by_name(g):
    last = g.entity.groupBy(F.lower("name").alias("low")).agg(F.max_by("entity_id", "entity_id").alias("entity_id"), F.max("name").alias("name"))
    uses = g.paper_entity.join(g.entity.select(c("entity_id").alias("dst"), F.lower("name").alias("low")), "dst").groupBy("low").agg(F.count("*").alias("papers"))
    return last.join(uses, "low").select("name", "entity_id", "papers")


@query("SELECT DISTINCT o.dst AS src, 'USES' AS rel, s.dst FROM (SELECT src, min(dst) AS dst FROM paper_entity GROUP BY 1) o JOIN (SELECT src, max(dst) AS dst FROM paper_entity GROUP BY 1) s ON s.src = o.src JOIN entity a ON a.entity_id = o.dst JOIN entity b ON b.entity_id = s.dst WHERE a.name <> b.name")
def jn20_relation_endpoints(g):
    ends = g.paper_entity.groupBy(c("src").alias("paper_id")).agg(F.min("dst").alias("a"), F.max("dst").alias("b"))
    name = lambda x, out: g.entity.select(c("entity_id").alias(x), c("name").alias(out))
    named = ends.join(name("a", "source"), "a").join(name("b", "target"), "b").where("source <> target")
    answers = named.select("paper_id", F.struct(F.array(F.struct("source", "target", F.lit("uses").alias("type"))).alias("relations")).alias("answer"))
    resolved = named.select("paper_id", c("source").alias("name"), c("a").alias("entity_id")).unionByName(named.select("paper_id", c("target").alias("name"), c("b").alias("entity_id")))
    return M.relations(answers, resolved)


# aggregates, windows, sets


@query("SELECT src AS paper_id, len(list(DISTINCT dst)) AS n FROM paper_entity GROUP BY 1")
def agg06_list_size(g):
    return g.paper_entity.groupBy(c("src").alias("paper_id")).agg(F.size(F.collect_set("dst")).cast("long").alias("n"))


@query(f", {SCORED} SELECT paper_id, count(DISTINCT doc_kind) AS n_paths, max(greatest(score, 0)) AS best, string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS matched FROM sc WHERE doc_kind IN ('entity', 'claim', 'section') GROUP BY 1")
def agg13_nested_max(g):
    q = query_vector(g)
    paths = None
    for kind in ("entity", "claim", "section"):
        one = RT.hits(g, q, kind, 2_000_000_000, kind)
        paths = one if paths is None else paths.unionByName(one)
    return RT.fused(paths).select("paper_id", "n_paths", "best", "matched")


@raw("SELECT conv_id, text AS decision FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'assistant') x WHERE rn = 1")
def agg18_first_decision(t):
    rows = t["conversations"].select(c("conv_id").alias("paper_id"), c("turn").alias("note_id"), F.when(c("role") == "assistant", c("text")).otherwise("").alias("decision"))
    return parse.first_decision(rows).select(c("paper_id").alias("conv_id"), "decision")


@query("SELECT name, arg_min(entity_id, entity_id) AS keeper, count(*) AS members FROM entity GROUP BY 1")
def win03_keeper(g):
    order = Window.partitionBy("name").orderBy(F.length("name"), "entity_id")
    return g.entity.withColumn("rn", F.row_number().over(order)).withColumn("members", F.count("*").over(Window.partitionBy("name"))).where("rn = 1").select("name", c("entity_id").alias("keeper"), "members")


@query("SELECT name, max(length(description)) AS longest FROM entity GROUP BY 1")
def win04_longest_description(g):
    return P.top_per(g.entity, ["name"], [F.desc(F.length("description")), "entity_id"], 1).select("name", F.length("description").cast("long").alias("longest"))


@raw("SELECT conv_id, turn, CAST(coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), -1) AS BIGINT) AS level FROM conversations")
def win05_fill(t):
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return t["conversations"].select("conv_id", "turn", F.coalesce(F.last(F.when(c("role") == "user", c("turn")), ignorenulls=True).over(order), F.lit(-1)).alias("level"))


TURNS = "(SELECT conv_id, turn, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS lv FROM conversations)"


def _turn_levels(t):
    level = F.when(c("role") == "system", 1).when(c("role") == "user", 2).otherwise(3)
    return t["conversations"].select(c("conv_id").alias("doc_id"), c("turn").alias("seq"), c("role").alias("title"), level.alias("heading_level"))


@raw(f"SELECT a.conv_id AS doc_id, a.turn AS seq, max(b.turn) AS parent_seq FROM {TURNS} a LEFT JOIN {TURNS} b ON b.conv_id = a.conv_id AND b.turn < a.turn AND b.lv < a.lv GROUP BY 1, 2")
def win06_parents(t):
    return parse.heading_tree(_turn_levels(t)).select("doc_id", "seq", "parent_seq")


@raw(f"SELECT a.conv_id AS doc_id, a.turn AS seq, min(b.turn) AS end_seq FROM {TURNS} a LEFT JOIN {TURNS} b ON b.conv_id = a.conv_id AND b.turn > a.turn AND b.lv <= a.lv GROUP BY 1, 2")
def win07_content_ends(t):
    return parse.content_ends(_turn_levels(t)).select("doc_id", "seq", "end_seq")


@raw("SELECT conv_id, concat('cite_', conv_id, '_', row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS id FROM conversations")
def win10_ordinals(t):
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return t["conversations"].select("conv_id", F.concat_ws("_", F.lit("cite"), c("conv_id").cast("string"), place.cast("string")).alias("id"))


@query("SELECT dst AS entity_id, count(*) AS n FROM paper_entity GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def srt02_count_order(g):
    return g.paper_entity.groupBy(c("dst").alias("entity_id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_id").limit(30)


@query("SELECT paper_id, title, year FROM paper ORDER BY year DESC NULLS FIRST, paper_id LIMIT 20")
def srt06_newest_first(g):
    return g.paper.orderBy(F.desc_nulls_first("year"), "paper_id").limit(20).select("paper_id", "title", "year")


@query(f", {SCORED} SELECT vec_id, score FROM sc ORDER BY score DESC, vec_id LIMIT 25")
def srt01_cosine_top_k(g):
    return V.top_k(g.vec, query_vector(g), 25).select("vec_id", "score")


@query("SELECT c.claim_id, len(list_intersect(string_split(c.text, ' '), string_split(coalesce(e.summary, ''), ' '))) AS shared FROM claim c JOIN supported_by s ON s.claim_id = c.claim_id JOIN evidence e ON e.evidence_id = s.evidence_id")
def set03_token_overlap(g):
    rows = g.claim.join(g.supported_by, "claim_id").join(g.evidence.select("evidence_id", "summary"), "evidence_id")
    return rows.select("claim_id", F.size(F.array_intersect(F.split("text", " "), F.split(F.coalesce("summary", F.lit("")), " "))).cast("long").alias("shared"))


@query("SELECT entity_id FROM entity EXCEPT SELECT dst FROM paper_entity WHERE confidence = 0.9")
def set07_difference(g):
    return g.entity.join(g.paper_entity.where("confidence = 0.9"), c("entity_id") == c("dst"), "left_anti").select("entity_id")


@query("SELECT paper_id FROM paper WHERE paper_id NOT IN (SELECT citing FROM cites)")
def set08_exclude_processed(g):
    return g.paper.join(g.cites, c("paper_id") == c("citing"), "left_anti").select("paper_id")


@raw("SELECT o_orderkey, 'good' AS strengths, concat('bad ', o_orderstatus) AS weaknesses FROM orders")
def str15_split_review(t):
    good, bad = parse.split_review(F.concat(F.lit("good\nCons:\nbad "), "o_orderstatus"))
    return t["orders"].select("o_orderkey", good.alias("strengths"), bad.alias("weaknesses"))


# JSON, structure


@raw("SELECT event_id, CAST(1 AS BIGINT) AS n FROM events")
def jsn03_node_ids(t):
    rows = t["events"].select("event_id", F.concat(F.lit('[{"node_id": "'), c("event_id").cast("string"), F.lit('"}, {"x": 1}, 5]')).alias("a"))
    ids = F.filter(F.from_json("json", "items array<struct<node_id:string>>")["items"], lambda x: x["node_id"].isNotNull())
    return loose_json.parsed(rows.withColumn("a", F.regexp_replace("a", r", 5\]", "]")), "a").select("event_id", F.size(ids).cast("long").alias("n"))


@raw("SELECT conv_id, turn, text FROM conversations")
def jsn04_without_thoughts(t):
    noisy = F.concat(F.lit("<think>a\nb</think>"), "text")
    return t["conversations"].select("conv_id", "turn", F.regexp_replace(noisy, r"(?s)<think>.*?</think>", "").alias("text"))


@raw("SELECT n_nationkey AS doc_id, CAST(2 AS BIGINT) AS level FROM nation")
def txt04_enriched_levels(t):
    entries = t["nation"].select(c("n_nationkey").alias("doc_id"), F.lit(0).alias("seq"), F.upper("n_name").alias("title"), F.lit(None).cast("int").alias("heading_level"))
    heads = t["nation"].select(c("n_nationkey").alias("doc_id"), F.lit(0).alias("seq"), F.lower("n_name").alias("title"), F.lit(2).alias("heading_level"))
    return parse.enrich_levels(entries, heads).select("doc_id", c("heading_level").cast("long").alias("level"))


@raw(r"""WITH own AS (SELECT doc_id, regexp_replace(text, '\A[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+\z', '', 'g') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN length(t) > 10000 THEN concat(left(t, 10000), '...') ELSE t END AS content FROM own""")
def txt05_attached_content(t):
    docs = t["documents"].where("text is not null").select("doc_id", F.concat(F.lit("# Head\n"), "text").alias("text"))
    return parse.attach_content(parse.heading_tree(parse.markdown_headings(docs)), docs).where("content is not null").select("doc_id", "content")


@raw("SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'introduction' WHEN '2' THEN 'method' WHEN '3' THEN 'experiments' ELSE NULL END AS key FROM orders")
def txt06_section_keys(t):
    title = F.when(c("o_orderpriority") == "1-URGENT", "## 1 Introduction").when(c("o_orderpriority") == "2-HIGH", "3. Our Approach").when(c("o_orderpriority") == "3-MEDIUM", "Experimental Results").otherwise("Thanks")
    return t["orders"].select("o_orderkey", parse.section_key(title).alias("key"))


@query("SELECT parent_id AS paper_id, string_agg(concat('[', node_id, '] ', title), chr(10) ORDER BY node_id) AS tree FROM section WHERE parent_id IS NOT NULL GROUP BY 1")
def txt14_tree_text(g):
    nodes = g.section.where("parent_id is not null").select(c("parent_id").alias("paper_id"), "node_id", c("node_id").alias("seq"), "title", F.lit(None).cast("string").alias("section_key"), F.lit(1).alias("heading_level"))
    return parse.tree_text(nodes)


@raw("SELECT doc_id, CAST(1 AS BIGINT) AS n_sections, false AS has_tables FROM documents")
def txt17_parsed_documents(t):
    docs = t["documents"].select("doc_id", F.regexp_replace("text", r"\|", "/").alias("text"))
    n = parse.sections(docs).groupBy("doc_id").agg(F.count("*").alias("n_sections"))
    return n.join(parse.tables(docs).select("doc_id", F.lit(True).alias("t")).distinct(), "doc_id", "left").select("doc_id", "n_sections", F.coalesce("t", F.lit(False)).alias("has_tables"))


# sources


def _jsonl(t) -> str:
    """The orders as JSON Lines records in the shared folder, with blank and broken lines between."""
    spark = t["orders"].sparkSession
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    record = F.to_json(F.struct(c("o_orderkey").cast("string").alias("id"), F.concat(F.lit("Paper "), c("o_orderkey").cast("string")).alias("title"), F.lit("Ann Lee, Bo Ray").alias("authors"), F.lit("# H\n## Abstract\nshort\n").alias("content"), F.year("o_orderdate").cast("string").alias("year")))
    lines = t["orders"].select(F.explode(F.array(record, F.lit(""), F.lit('{"id": '))).alias("value"))
    lines.write.text(path)
    return path


RECORDS = "SELECT CAST(o_orderkey AS VARCHAR) AS id, concat('Paper ', o_orderkey) AS title, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(2 AS BIGINT) AS n_authors FROM orders WHERE o_orderstatus <> 'P'"


@raw(RECORDS)
def src01_jsonl_scan(t):
    skip = t["orders"].where("o_orderstatus = 'P'").select(c("o_orderkey").cast("string").alias("id"))
    rows = R.normalised(R.records(t["orders"].sparkSession, _jsonl(t), skip=skip))
    return rows.select("id", "title", "year", F.size("authors").cast("long").alias("n_authors"))


@raw("SELECT CAST(o_orderkey AS VARCHAR) AS paper_id, concat('# H', chr(10), '## Abstract', chr(10), 'short', chr(10)) AS text FROM orders")
def src04_paper_sources(t):
    return R.paper_sources(R.normalised(R.records(t["orders"].sparkSession, _jsonl(t)))).select("paper_id", "text")


@raw("SELECT CAST(o_orderkey AS VARCHAR) AS paper_id, 'n1' AS note_id, o_orderpriority AS rating FROM orders")
def src05_review_notes(t):
    literal = F.concat(F.lit("[{'id': 'n1', 'content': {'rating': '"), "o_orderpriority", F.lit("', 'x': None}}, 5]"))
    return R.notes(t["orders"].select(c("o_orderkey").cast("string").alias("paper_id"), literal.alias("related_notes"))).select("paper_id", "note_id", c("content")["rating"].alias("rating"))


def _files(t, extension: str) -> str:
    spark = t["nation"].sparkSession
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    t["nation"].select("n_name").coalesce(1).write.option("lineSep", "\n").text(f"{path}")
    return path


@raw("SELECT CAST(count(*) AS BIGINT) AS n_lines FROM nation")
def src07_text_files(t):
    rows = R.text_files(t["nation"].sparkSession, _files(t, "txt"), "txt")
    return rows.select((F.size(F.split("text", "\n")) - 1).cast("long").alias("n_lines"))


@raw("SELECT CAST(count(*) AS BIGINT) AS n_lines FROM nation")
def src06_binary_documents(t):
    rows = R.converted(t["nation"].sparkSession, _files(t, "txt"), _decode, "txt")
    return rows.where("error is null").select((F.size(F.split("text", "\n")) - 1).cast("long").alias("n_lines"))


def _decode(content: bytes) -> str:
    return bytes(content).decode("utf-8")


@query("SELECT paper_id, title FROM paper WHERE paper_id IN (1, 2, 3, 5, 8, 13)")
def src12_paper_lookup(g):
    return R.lookup(g.paper, [1, 2, 3, 5, 8, 13]).select("paper_id", "title")


# sinks


def _store(spark: SparkSession) -> ST.Store:
    return ST.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


@query("SELECT entity_id, concat(upper(left(entity_type, 1)), lower(substr(entity_type, 2))) AS label, CAST(1 AS BIGINT) AS n_attributes FROM entity")
def snk01_entity_upsert(g):
    s = _store(g.entity.sparkSession)
    rows = g.entity.withColumn("attributes", F.create_map(F.lit("good_key"), c("description"), F.lit("bad key"), c("name")))
    for _ in range(2):
        s.upsert("entity", ST.entity_rows(rows).withColumn("attributes", F.map_entries("attributes")))
    return s.read("entity").select("entity_id", "label", F.size("attributes").cast("long").alias("n_attributes"))


@query("SELECT src, rel, dst FROM paper_entity WHERE confidence IS NOT NULL AND dst IN (SELECT entity_id FROM entity WHERE entity_type = 'PROMO')")
def snk02_relation_upsert(g):
    s = _store(g.entity.sparkSession)
    s.upsert("relation", ST.valid_edges(g.paper_entity, g.paper, g.entity.where("entity_type = 'PROMO'")))
    return s.read("relation").select("src", "rel", "dst")


@query("SELECT evidence_id AS dst, paper_id AS src, 'unknown' AS evidence_span FROM evidence")
def snk08_evidence_links(g):
    s = _store(g.evidence.sparkSession)
    edges = g.evidence.select(c("paper_id").alias("src"), c("evidence_id").alias("dst"), F.lit(0.9).alias("confidence"))
    s.upsert("dataset_evidence", ST.with_metadata(ST.valid_edges(edges, g.paper, g.evidence)))
    return s.read("dataset_evidence").select("src", "dst", "evidence_span")


@query("SELECT node_id, parent_id, title FROM section")
def snk10_section_upsert(g):
    s = _store(g.section.sparkSession)
    s.upsert("section", g.section)
    return s.read("section").select("node_id", "parent_id", "title")


@query("SELECT claim_id, paper_id % 25 + 100 AS node_id FROM claim")
def snk11_claim_sections(g):
    s = _store(g.claim.sparkSession)
    s.upsert("section_claim", g.claim.select((c("paper_id") % 25 + 100).alias("node_id"), "claim_id"))
    return s.read("section_claim").select("claim_id", "node_id")


@query("SELECT citing, cited, intent, citing % 10 AS gap_id, CAST(0.8 AS DOUBLE) AS confidence FROM cites")
def snk12_citation_gaps(g):
    s = _store(g.cites.sparkSession)
    s.upsert("citation_gap", g.cites.select("citing", "cited", "intent", (c("citing") % 10).alias("gap_id"), F.lit(0.8).alias("confidence")))
    return s.read("citation_gap").select("citing", "cited", "intent", "gap_id", "confidence")


@query("SELECT vec_id FROM vec WHERE vec_id NOT IN (SELECT vec_id FROM vec WHERE doc_kind = 'claim')")
def snk15_delete_vectors(g):
    s = _store(g.vec.sparkSession)
    rows = g.vec.select(F.lit("claims").alias("collection"), c("vec_id").alias("point_id"), "doc_kind")
    s.upsert("vector", rows)
    s.delete("vector", rows.where("doc_kind = 'claim'"))
    return s.read("vector").select(c("point_id").alias("vec_id"))


@query("SELECT entity_type, count(*) AS n FROM entity GROUP BY 1")
def snk18_embedding_writer(g):
    text = F.concat(F.upper("entity_type"), F.lit(": "), "name", F.lit(". "), "description")
    rows = M.embedded(g.entity.withColumn("t", text), "t", M.HashEmbedder())
    points = ST.vector_points(rows.where("embedding is not null"), "entities", "entity", "L1", "entity_id", ["entity_type", "name"])
    return points.groupBy(c("payload")["entity_type"].alias("entity_type")).agg(F.count("*").alias("n"))


@query("SELECT claim_id, 'claim' AS doc_kind, 'L3' AS kg_layer, severity FROM claim")
def snk19_payloads(g):
    points = ST.vector_points(g.claim.withColumn("embedding", F.array(F.lit(1.0))), "claims", "claim", "L3", "claim_id", ["severity"])
    p = c("payload")
    return points.select(p["_original_id"].cast("long").alias("claim_id"), p["doc_kind"].alias("doc_kind"), p["kg_layer"].alias("kg_layer"), p["severity"].alias("severity"))


# vectors, retrieval, models


@query("SELECT name, CAST(64 AS BIGINT) AS size FROM (SELECT DISTINCT name FROM entity) x")
def vec03_embedded_names(g):
    rows = M.embedded(g.entity.select("name").distinct(), "name", M.HashEmbedder(64), batch=64)
    return rows.select("name", F.size("embedding").cast("long").alias("size"))


@query(f", {SCORED} SELECT vec_id AS method_vec FROM sc WHERE doc_kind = 'entity' AND entity_type = 'METHOD' ORDER BY score DESC, vec_id LIMIT 1")
def vec05_method_lookup(g):
    return V.top_k(g.vec, query_vector(g), 1, (c("doc_kind") == "entity") & (c("entity_type") == "METHOD")).select(c("vec_id").alias("method_vec"))


@query("SELECT paper_id, claim_id, CAST(0.67 AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY claim_id) AS rn FROM claim) x WHERE rn <= 5")
def ret05_tree_claim_coupling(g):
    found = g.paper.select("paper_id", X.tree_score(F.lit(None).cast("double")).alias("tree"))
    return P.first_claims(g, 5).join(found, "paper_id").select("paper_id", "claim_id", F.round(X.coupled_score("tree"), 6).alias("score"))


@query("SELECT paper_id, 'tree_search' AS path, CAST(0.65 AS DOUBLE) AS score FROM paper")
def ret03_tree_search(g):
    found, _ = RT.tree_path(g, g.paper)
    return found.select("paper_id", "path", F.round("score", 6).alias("score"))


@query(f"""SELECT count(*) AS gaps FROM (SELECT DISTINCT hg.gap_id FROM entity e JOIN paper_entity pe ON pe.dst = e.entity_id AND rel IN ('PROPOSES', 'INTRODUCES') JOIN has_problem hp ON hp.paper_id = pe.src JOIN has_gap hg ON hg.problem_id = hp.problem_id WHERE lower(trim(e.name)) IN {_list(METHODS)} AND hg.gap_id NOT IN (SELECT gap_id FROM addressed_by)) x""")
def ret08_open_gap_count(g):
    return P.unaddressed_gaps(g, METHODS).agg(F.countDistinct("gap_id").alias("gaps"))


@query("SELECT paper_id, title AS statement FROM paper")
def ret09_gap_statements(g):
    answer = F.to_json(F.struct(c("title").alias("statement")))
    out = M.completed(g.paper.select("paper_id", answer.alias("prompt")), "prompt", _Identity(), "statement string")
    return out.select("paper_id", "answer.statement")


@query("SELECT paper_id, 'ok' AS word FROM paper")
def mod01_completions(g):
    out = M.completed(g.paper.select("paper_id", F.concat(F.lit("say ok to "), "title").alias("prompt")), "prompt", M.EchoCompleter((("say ok", '{"word": "ok"}'),)), "word string")
    return out.select("paper_id", "answer.word")


@query("SELECT citing, cited, intent FROM cites")
def mod04_citation_answers(g):
    answer = F.to_json(F.struct(F.array(F.struct("cited", "intent")).alias("citations")))
    out = M.completed(g.cites.select("citing", answer.alias("prompt")), "prompt", _Identity(), "citations array<struct<cited:bigint,intent:string>>")
    return out.select("citing", F.inline("answer.citations"))


@query("SELECT paper_id, CAST(1 AS BIGINT) AS n_valid FROM paper")
def mod06_schema_answers(g):
    answer = F.lit('{"problems": [{"description": "d", "gap_ids": [0, 99, -1]}], "gaps": [{"failure_mode": "f", "other": 1}], "claims": [{"text": "t"}]}')
    out = M.completed(g.paper.select("paper_id", answer.alias("prompt")), "prompt", _Identity(), M.ARGUMENT)
    valid = M.in_range(c("answer.problems")[0]["gap_ids"], c("answer.gaps"))
    return out.select("paper_id", F.size(valid).cast("long").alias("n_valid"))


@query("SELECT claim_id, evidence_id, strength FROM supported_by")
def mod07_evidence_answers(g):
    rows = g.supported_by.groupBy("claim_id").agg(F.to_json(F.struct(F.collect_list(F.struct("evidence_id", "strength")).alias("evidence_links"))).alias("prompt"))
    out = M.completed(rows, "prompt", _Identity(), "evidence_links array<struct<evidence_id:bigint,strength:string>>")
    return out.select("claim_id", F.inline("answer.evidence_links"))


@query("SELECT cur // 1000 AS paper_id, cur, prev FROM evolves")
def mod09_persisted_links(g):
    """Each conversation's methods are a paper's; links come with that paper, the one after, and with both ends the same."""
    own = g.method.select(F.floor(c("method_id") / 1000).cast("long").alias("paper_id"), "method_id")
    link = g.evolves.select(F.floor(c("cur") / 1000).cast("long").alias("paper_id"), "cur", "prev")
    given = link.unionByName(link.withColumn("paper_id", c("paper_id") + 1)).unionByName(link.withColumn("prev", c("cur")))
    return M.persisted_links(given, own)


# ingest


@raw("SELECT count(*) AS success, CAST(0 AS BIGINT) AS failed, count(*) AS sections FROM orders")
def stm03_batch_ingest(t):
    spark = t["orders"].sparkSession
    totals = S.ingest(_store(spark), R.records(spark, _jsonl(t)))
    return totals.select("success", "failed", "sections")


@raw("SELECT CAST(o_orderkey AS VARCHAR) AS paper_id, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def stm05_stream_ingest(t):
    spark = t["orders"].sparkSession
    s = _store(spark)
    S.ingest_stream(s, _jsonl(t), f"{s.root}/checkpoint").awaitTermination()
    return s.read("paper").select("paper_id", "year")


@raw("SELECT name, value FROM (VALUES ('files_per_batch', 5), ('min_section', 50)) v(name, value)")
def stm09_settings(t):
    spark = t["orders"].sparkSession
    own = S.Settings.of(spark)
    return spark.createDataFrame([("files_per_batch", own.files_per_batch), ("min_section", own.min_section)], "name string, value int")
