"""Composed operators and the orders and scores inside them as queries of their own, each with the same query in SQL where SQL has one."""
from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as X
from ..operators import models as M, parse, patterns as P, resolve, store as ST, vectors as V
from ..plans import retrieval as RT
from ..projection import SQL, graph_of, tables
from ..runtime import shared_dir
from ..sources import records as R
from ..streaming import ingest as S
from .search import PAIRS, SCORED, _hits, query_vector

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


# recall and reranking, whole

ORDER = ", ".join(f"'{p}'" for p in RT.PATHS)
RECALL = f"""{SCORED}, f1 AS ({_hits('entity', 20, 'entity')} UNION ALL {_hits('claim', 20, 'claim')}),
seeds AS (SELECT paper_id FROM f1 GROUP BY 1 ORDER BY max(score) DESC, paper_id LIMIT 10),
rel AS (SELECT cited AS paper_id, max(coalesce(confidence, 0.5)) AS rc, count(*) AS lc FROM cites WHERE intent IN ('EVOLVES_FROM', 'CITES_FOR_FOUNDATION') AND citing <> cited AND citing IN (SELECT paper_id FROM seeds) GROUP BY 1 ORDER BY lc DESC, rc DESC, paper_id LIMIT 20),
f4 AS (SELECT * FROM f1 UNION ALL SELECT paper_id, 'evolution', least(0.95, 0.35 + 0.12 * CASE WHEN rc = 0 THEN 0.5 ELSE rc END + 0.08 * lc), 'evolution' FROM rel UNION ALL {_hits('section', 20, 'section')}),
cand AS (SELECT paper_id FROM f4 GROUP BY 1 ORDER BY max(score) DESC, paper_id LIMIT 5),
ap AS (SELECT paper_id, path, CAST(score AS DOUBLE) AS score, payload FROM f4 UNION ALL SELECT paper_id, 'tree_search', 0.65, 'section' FROM cand
UNION ALL SELECT paper_id, 'tree_claim_coupling', 0.67, 'claim' FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY claim_id) AS rn FROM claim WHERE paper_id IN (SELECT paper_id FROM cand)) x WHERE rn <= 5),
fu AS (SELECT paper_id, max(score) AS best, count(DISTINCT path) AS n_paths, arg_min(path, list_position([{ORDER}], path)) AS recall_path, string_agg(DISTINCT nullif(payload, ''), ',' ORDER BY nullif(payload, '')) AS matched FROM ap GROUP BY 1),
rc AS (SELECT *, round(least(1.0, best + 0.05 * (n_paths - 1)), 6) AS score FROM fu ORDER BY score DESC, paper_id LIMIT 20)"""


def _shown(df: DataFrame) -> DataFrame:
    return df.select("paper_id", F.round("best", 6).alias("best"), "n_paths", "recall_path", "matched", F.round("score", 6).alias("score"), c("rerank_position").cast("long").alias("rerank_position"))


@query(f", {RECALL} SELECT paper_id, round(best, 6) AS best, n_paths, recall_path, matched, round(score, 6) AS score, row_number() OVER (ORDER BY rc.score DESC, paper_id) - 1 AS rerank_position FROM rc")
def ret02_enhanced_recall(g):
    return _shown(RT.enhanced_recall(g, query_vector(g)))


@query(f""", {RECALL}, pl AS (SELECT *, row_number() OVER (ORDER BY rc.score DESC, paper_id) - 1 AS place, row_number() OVER (ORDER BY paper_id) AS wish, count(*) OVER () AS n FROM rc),
rr AS (SELECT *, CASE WHEN n >= 3 THEN row_number() OVER (ORDER BY CASE WHEN place < 15 THEN wish END NULLS LAST, place) - 1 ELSE place END AS rp FROM pl)
SELECT paper_id, round(best, 6) AS best, n_paths, recall_path, matched, round(CASE WHEN n >= 3 THEN least(1.0, score + 0.05 * (1 - rp / n)) ELSE score END, 6) AS score, rp AS rerank_position FROM rr""")
def ret04_rerank(g):
    """A ranker that wants the papers by id."""
    base = RT.enhanced_recall(g, query_vector(g))
    rank = base.select("paper_id", F.row_number().over(Window.orderBy("paper_id")).alias("position"))
    return _shown(RT.reranked(base.drop("rerank_position"), rank))


# orders with ties


@query("""SELECT row_number() OVER (ORDER BY link_count DESC, relation_confidence DESC, paper_id) AS place, * FROM (SELECT cited AS paper_id, max(coalesce(confidence, 0.5)) AS relation_confidence, count(*) AS link_count FROM cites
WHERE intent IN ('EVOLVES_FROM', 'CITES_FOR_FOUNDATION') AND citing <> cited GROUP BY 1 ORDER BY 3 DESC, 2 DESC, 1 LIMIT 50) x""")
def srt03_links_then_confidence(g):
    order = Window.orderBy(F.desc("link_count"), F.desc("relation_confidence"), "paper_id")  # over the k rows of a limit
    return P.evolution_related(g, g.paper, 50).withColumn("place", F.row_number().over(order).cast("long"))


@query(", n AS (SELECT src, count(*) AS a, count(DISTINCT rel) AS b FROM paper_entity GROUP BY 1) SELECT src AS paper_id, a + b AS weight, row_number() OVER (ORDER BY a + b DESC, src) AS place FROM n ORDER BY 2 DESC, 1 LIMIT 30")
def srt05_sum_order(g):
    own = g.paper_entity.groupBy(c("src").alias("paper_id")).agg((F.count("*") + F.countDistinct("rel")).alias("weight")).orderBy(F.desc("weight"), "paper_id").limit(30)
    return own.withColumn("place", F.row_number().over(Window.orderBy(F.desc("weight"), "paper_id")).cast("long"))


@query(f", {SCORED}, ap AS (SELECT paper_id, round(greatest(score, 0), 1) AS score, list_position(['entity', 'claim', 'section'], doc_kind) AS o FROM sc WHERE doc_kind IN ('entity', 'claim', 'section')) SELECT paper_id, max(score) AS score, arg_min(o, -score * 10 + o / 100) AS first FROM ap GROUP BY 1 ORDER BY 2 DESC, 3, 1 LIMIT 40")
def srt08_score_then_first_path(g):
    """Papers by score; ties go to the path that came first."""
    q = query_vector(g)
    paths = None
    for n, kind in enumerate(("entity", "claim", "section"), 1):
        one = RT.hits(g, q, kind, 2_000_000_000, kind).withColumns({"score": F.round("score", 1), "o": F.lit(n).cast("long")})
        paths = one if paths is None else paths.unionByName(one)
    best = paths.groupBy("paper_id").agg(F.max("score").alias("score"), F.min_by("o", F.struct(-c("score"), c("o"))).alias("first"))
    return best.orderBy(F.desc("score"), "first", "paper_id").limit(40)


@query(f", {PAIRS} SELECT id_a, id_b, score, row_number() OVER (ORDER BY score DESC, id_a, id_b) AS place FROM pairs ORDER BY 4 LIMIT 100")
def srt09_pairs_by_score(g):
    pairs = V.similar_pairs(g.vec, 0.2, 10, same="doc_kind").orderBy(F.desc("score"), "id_a", "id_b").limit(100)
    return pairs.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id_a", "id_b")).cast("long"))


@raw("SELECT min(o_orderkey) AS component, count(*) AS members, row_number() OVER (ORDER BY count(*) DESC, min(o_orderkey)) AS place FROM orders GROUP BY o_custkey HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 100")
def srt09_clusters_by_size(t):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    chain = t["orders"].select(c("o_orderkey").alias("a"), F.lag("o_orderkey").over(order).alias("b")).where("b is not null")
    sizes = resolve.connected(chain).groupBy("component").agg(F.count("*").alias("members")).orderBy(F.desc("members"), "component").limit(100)
    return sizes.withColumn("place", F.row_number().over(Window.orderBy(F.desc("members"), "component")).cast("long"))


# scores


@raw("SELECT l_orderkey, l_linenumber, round(least(0.95, 0.8 * (l_discount * 10) + 0.15), 6) AS score FROM lineitem")
def mth04_coupled_score(t):
    return t["lineitem"].select("l_orderkey", "l_linenumber", F.round(X.coupled_score(c("l_discount") * 10), 6).alias("score"))


@raw("SELECT l_orderkey, l_linenumber, round(least(1.0, l_discount * 10 + 0.05 * (l_linenumber - 1)), 6) AS score FROM lineitem")
def mth05_fused_score(t):
    return t["lineitem"].select("l_orderkey", "l_linenumber", F.round(X.fused_score(c("l_discount") * 10, "l_linenumber"), 6).alias("score"))


@query(f", {SCORED} SELECT vec_id, greatest(score, 0) AS score FROM sc WHERE doc_kind = 'evidence'")
def mth06_clipped_score(g):
    score = F.round(X.cosine("embedding", F.array(*(F.lit(float(x)) for x in query_vector(g)))), 6)
    return g.vec.where("doc_kind = 'evidence'").select("vec_id", X.clipped(score).alias("score"))


# texts

BLANK = "[\\t-\\r ]"


@raw(f"SELECT doc_id, CASE WHEN text IS NULL THEN -1 ELSE len(regexp_extract_all(text, '[.!?]{BLANK}+[A-Z]')) + 1 END AS n_sentences FROM documents")
def str16_sentences(t):
    return t["documents"].select("doc_id", F.size(X.sentences("text")).cast("long").alias("n_sentences"))


TRIM = r"regexp_replace(regexp_replace(coalesce(text, ''), '^[\s\x0B\x{85}\p{Z}]+', ''), '[\s\x0B\x{85}\p{Z}]+$', '')"


@raw(rf"""WITH own AS (SELECT doc_id, {TRIM} AS t FROM documents),
p AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '\n[\t-\r ]*\n'), lambda x: regexp_matches(x, '[^\s\x0B\x{{85}}\p{{Z}}]')) AS parts,
len(regexp_extract_all(t, '(?m)^[\t-\r ]*\d+[.)][\t-\r ]+')) AS numbered, len(regexp_extract_all(t, '(?m)^[\t-\r ]*[-*•][\t-\r ]+')) AS bulleted FROM own)
SELECT doc_id, CAST(CASE WHEN t = '' THEN 0 WHEN len(parts) > 1 THEN len(parts) ELSE 1 END AS BIGINT) AS n_points FROM p WHERE numbered < 2 AND bulleted < 2
UNION ALL SELECT doc_id, -1 FROM p WHERE numbered >= 2 OR bulleted >= 2""")
def str14_points(t):
    """Paragraphs as points; where a text is numbered or has bullets, -1."""
    marks = [F.size(F.split(X.utrim("text"), pattern)) > 2 for pattern in X.POINT_MARKS[:2]]
    n = F.when(F.coalesce(marks[0] | marks[1], F.lit(False)), -1).otherwise(F.size(X.points("text")))
    return t["documents"].select("doc_id", n.cast("long").alias("n_points"))


@raw("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS n_points, CASE o_orderkey % 3 WHEN 0 THEN concat('first ', o_orderstatus) WHEN 1 THEN 'one' ELSE concat('plain ', o_orderpriority) END AS first_point FROM orders""")
def str14_marked_points(t):
    """Numbered and bulleted texts."""
    text = F.when(c("o_orderkey") % 3 == 0, F.concat(F.lit("1. first "), "o_orderstatus", F.lit("\n2) second\nline")))
    text = text.when(c("o_orderkey") % 3 == 1, F.lit("- one\n* two\n\n• three")).otherwise(F.concat(F.lit(" plain "), "o_orderpriority", F.lit("\n- lone mark is no list")))
    points = X.points(text)
    first = F.when(c("o_orderkey") % 3 == 2, F.split(points[0], "\n")[0]).otherwise(points[0])
    return t["orders"].select("o_orderkey", F.size(points).alias("n_points"), first.alias("first_point"))


# whole records, groups, files


def _records(t) -> DataFrame:
    """Orders as records: with headings enough, with a table of contents, and with neither."""
    kind, nl = c("o_orderkey") % 3, "\n"
    own = F.concat(F.lit("body "), "o_orderpriority")
    text = F.when(kind == 0, F.concat(F.lit(f"# Title{nl}## Introduction{nl}"), own, F.lit(f"{nl}## Method{nl}steps{nl}### Detail{nl}more"))).when(kind == 1, F.concat(F.lit(f"## Introduction{nl}"), own)).otherwise(own)
    toc = F.when(kind == 1, F.array(*(F.struct(F.lit(x).alias("title"), F.lit(None).cast("int").alias("heading_level"), F.lit(0).alias("page_id")) for x in ("Introduction", "Summary"))))
    return t["orders"].select(c("o_orderkey").alias("paper_id"), text.alias("text"), F.concat(F.lit("about "), "o_orderstatus").alias("abstract"), toc.alias("toc"))


@raw("""SELECT o_orderkey AS paper_id, 'abstract' AS section, concat('about ', o_orderstatus) AS content FROM orders
UNION ALL SELECT o_orderkey, 'introduction', concat('body ', o_orderpriority) FROM orders WHERE o_orderkey % 3 < 2
UNION ALL SELECT o_orderkey, 'method', concat('steps', chr(10), '### Detail', chr(10), 'more') FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 'full_text', concat('body ', o_orderpriority) FROM orders WHERE o_orderkey % 3 = 2""")
def txt11_record_sections(t):
    return parse.parsed_records(_records(t))[0]


@raw("""WITH n(k, place, title, lv, src, parent, key) AS (VALUES (0, 0, 'Title', 1, 'headings', NULL, NULL), (0, 1, 'Introduction', 2, 'headings', 0, 'introduction'), (0, 2, 'Method', 2, 'headings', 0, 'method'), (0, 3, 'Detail', 3, 'headings', 2, NULL),
(1, 0, 'Introduction', 2, 'contents', NULL, 'introduction'), (1, 1, 'Summary', 2, 'contents', NULL, 'conclusion'))
SELECT o_orderkey AS paper_id, place, title, lv AS heading_level, src AS source, key AS section_key, parent AS parent_place FROM orders JOIN n ON k = o_orderkey % 3""")
def txt11_record_tree(t):
    nodes = parse.parsed_records(_records(t))[1]
    order = Window.partitionBy("paper_id").orderBy("seq")
    placed = nodes.withColumn("place", F.row_number().over(order) - 1)
    parents = placed.select("paper_id", c("seq").alias("parent_seq"), c("place").alias("parent_place"))
    return placed.join(parents, ["paper_id", "parent_seq"], "left").select("paper_id", "place", "title", "heading_level", "source", "section_key", "parent_place")


def _lines(t) -> tuple[str, DataFrame]:
    """The orders as JSON Lines records in the shared folder."""
    spark = t["orders"].sparkSession
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    content = F.when(c("o_orderstatus") != "P", F.lit("# H\n## Abstract\nshort\n")).otherwise("")
    record = F.to_json(F.struct(c("o_orderkey").cast("string").alias("id"), F.concat(F.lit("Paper "), c("o_orderkey").cast("string")).alias("title"), content.alias("content"), F.year("o_orderdate").cast("string").alias("year")))
    t["orders"].select(record.alias("value")).write.text(path)
    return path, R.records(spark, path)


@raw("""SELECT 'first' AS run, count(*) FILTER (o_orderstatus <> 'P') AS success, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT 'second', count(*) FILTER (o_orderstatus <> 'P'), count(*) FILTER (o_orderstatus = 'P') FROM orders WHERE o_orderkey % 2 <> 0""")
def stm08_grouped_ingest(t):
    """A job that stops after the even orders, and its second run, which skips what checkpoints name."""
    spark = t["orders"].sparkSession
    s = ST.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    _, rows = _lines(t)
    size = max(1, -(-t["orders"].count() // 2))
    first = S.ingest_groups(s, rows.where(c("id").cast("long") % 2 == 0), size)
    second = S.ingest_groups(s, rows, size)
    total = lambda df, name: df.groupBy(F.lit(name).alias("run")).agg(F.sum("success").alias("success"), F.sum("failed").alias("failed"))
    return total(first, "first").unionByName(total(second, "second"))


@raw("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 0 AND l_linenumber > 0 THEN round(l_linenumber / l_quantity * 60, 4) END AS per_minute, CASE WHEN l_quantity > 0 AND l_linenumber > 0 THEN round((10 - l_linenumber) / (l_linenumber / l_quantity * 60), 4) END AS minutes_left FROM lineitem""")
def stm06_pace(t):
    rate, left = S.pace(c("l_linenumber"), F.lit(10), c("l_quantity"))
    return t["lineitem"].select("l_orderkey", "l_linenumber", rate.alias("per_minute"), left.alias("minutes_left"))


@raw("SELECT 'p1' AS paper_id, 'One file' AS title, 1999 AS year, 'venue' AS venue, count(*) AS n_lines FROM orders")
def src08_one_file(t):
    """All orders' priorities as the lines of one file, read as one record."""
    spark = t["orders"].sparkSession
    path = f"{shared_dir(spark)}/file-{uuid.uuid4().hex}"
    t["orders"].select("o_orderpriority").coalesce(1).write.option("lineSep", "\n").text(path)
    rows = R.one_file(spark, path, "p1", "One file", 1999, "venue")
    return rows.select("paper_id", "title", "year", "venue", (F.size(F.split("text", "\n")) - 1).cast("long").alias("n_lines"))


@query("SELECT vec_id FROM (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN NULL ELSE paper_id END AS p FROM vec) x WHERE p IS DISTINCT FROM 5 AND p IS NOT NULL")
def snk14_delete_by_equality(g):
    """Points of one paper deleted, then those of none; other points without a paper stay until then."""
    spark = g.vec.sparkSession
    s = ST.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    s.upsert("vector", g.vec.select(F.lit("claims").alias("collection"), c("vec_id").alias("point_id"), F.when(c("vec_id") % 10 != 0, c("paper_id")).alias("paper_id")))
    s.delete_equal("vector", "paper_id", 5)
    s.delete_equal("vector", "paper_id", None)
    return s.read("vector").select(c("point_id").alias("vec_id"))


# a model's three passes


@dataclass(frozen=True)
class _Fixed:
    """A completer with one answer."""

    answer: str

    def complete(self, prompts: list[str]) -> list[str]:
        return [self.answer] * len(prompts)


ZONES = json.dumps({"roles": ["PROBLEM", "METHOD"]})
NODES = json.dumps(
    {"problems": [{"description": "p", "gap_ids": [0, 7]}], "gaps": [{"failure_mode": "f", "core_idea_ids": [0, -1]}], "core_ideas": [{"mechanism": "m", "claim_ids": [1, 0, 1]}], "claims": [{"text": "a"}, {"text": "b"}]}
)
LINKS = json.dumps({"evidences": [{"type": "ANALYSIS", "result_summary": "r"}], "evidence_links": [{"claim_id": 1, "evidence_id": 0, "strength": "full"}, {"claim_id": 2, "evidence_id": 0, "strength": "FULL"}, {"claim_id": 0, "evidence_id": 0, "strength": "odd"}]})


@query("""SELECT paper_id, x.kind, x.n FROM paper, (VALUES ('paragraphs', 3), ('METHOD', 1), ('BACKGROUND', 1), ('problems', 1), ('gaps', 1), ('ideas', 1), ('claims', 2), ('evidences', 1), ('problem_gaps', 1), ('gap_ideas', 1), ('idea_claims', 2), ('claim_evidences', 1)) x(kind, n)""")
def mod08_argumentation(g):
    papers = g.paper.select("paper_id", F.concat(c("title"), F.lit("\n\nmiddle\n\nlast")).alias("text"))
    a = M.argumentation(papers, _Fixed(ZONES), _Fixed(NODES), _Fixed(LINKS))
    count = lambda df, kind: df.groupBy("paper_id").agg(F.count("*").cast("int").alias("n")).select("paper_id", F.lit(kind).alias("kind"), "n")
    out = count(a.paragraphs, "paragraphs").unionByName(count(a.paragraphs.where("role = 'METHOD'"), "METHOD")).unionByName(count(a.paragraphs.where("role = 'BACKGROUND'"), "BACKGROUND"))
    for name in ("problems", "gaps", "ideas", "claims", "evidences", "problem_gaps", "gap_ideas", "idea_claims", "claim_evidences"):
        out = out.unionByName(count(getattr(a, name), name))
    return out


@query()
def vec02_indexed_pairs(g):
    """Similar pairs by the index of cells; the test measures its recall against the exact pairs."""
    hits = V.nearest_indexed(g.vec, g.vec, 10, 0.2, same="doc_kind")
    pairs = hits.select(F.least("query_id", "vec_id").alias("id_a"), F.greatest("query_id", "vec_id").alias("id_b"), "score")
    return pairs.groupBy("id_a", "id_b").agg(F.max("score").alias("score"))
