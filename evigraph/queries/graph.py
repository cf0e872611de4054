"""Graph-pattern queries over the projected graph, each with the same query in SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as X
from ..operators import patterns as P
from ..projection import SQL, graph_of

METHODS, SIDE_A, SIDE_B = ["Red Plate", " small widget "], ["hot ring", "large rod"], ["cold plate", "red plate"]
QUERIES: dict = {}
ORACLES: dict = {}
c = F.col


def query(sql: str, recursive: bool = False):
    """Register a function (graph) -> DataFrame under its name, with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(graph_of(spark, sf_dir))

        QUERIES[f.__name__] = run
        ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{SQL}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return f

    return add


def _list(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in P.names_of(names)) + ")"


OWN = "rel IN ('PROPOSES', 'INTRODUCES')"


@query(f""", own AS (SELECT DISTINCT src, dst FROM paper_entity WHERE {OWN}),
cnt AS (SELECT a.src AS seed, b.src AS paper_id, count(*) AS shared_entities FROM own a JOIN own b ON a.dst = b.dst WHERE a.src <> b.src GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY shared_entities DESC, paper_id) AS rn FROM cnt)
SELECT seed, r.paper_id, shared_entities, title, year FROM r JOIN paper p ON p.paper_id = r.paper_id WHERE rn <= 10""")
def jn01_competitors(g):
    return P.competitors(g)


@query("""SELECT cited AS paper_id, max(coalesce(confidence, 0.5)) AS relation_confidence, count(*) AS link_count FROM cites
WHERE intent IN ('EVOLVES_FROM', 'CITES_FOR_FOUNDATION') AND citing <> cited GROUP BY 1 ORDER BY 3 DESC, 2 DESC, 1 LIMIT 20""")
def jn02_evolution_related(g):
    return P.evolution_related(g, g.paper)


@query("""SELECT cited AS paper_id, max(coalesce(confidence, 0.5)) AS relation_confidence, count(*) AS link_count FROM cites
JOIN paper s ON s.paper_id = citing WHERE s.venue = '1-URGENT' AND intent IN ('EVOLVES_FROM', 'CITES_FOR_FOUNDATION') AND citing <> cited GROUP BY 1 ORDER BY 3 DESC, 2 DESC, 1 LIMIT 50""")
def flt06_intent_filter(g):
    return P.evolution_related(g, g.paper.where("venue = '1-URGENT'"), 50)


@query(""", own AS (SELECT dst AS method_id FROM paper_entity WHERE rel = 'PROPOSES' AND src = 1),
hist AS (SELECT dst AS method_id, max(p.year) AS y FROM paper_entity JOIN paper p ON p.paper_id = src WHERE rel = 'PROPOSES' AND src <> 1
  AND (p.year IS NULL OR p.year <= coalesce((SELECT year FROM paper WHERE paper_id = 1), p.year)) GROUP BY 1 ORDER BY y DESC NULLS LAST, method_id LIMIT 40),
u AS (SELECT method_id FROM own UNION SELECT method_id FROM hist),
pp AS (SELECT dst AS method_id, p.paper_id, p.year FROM paper_entity JOIN paper p ON p.paper_id = src WHERE rel = 'PROPOSES')
SELECT u.method_id, name, pp.paper_id, pp.year FROM u JOIN entity ON entity_id = u.method_id LEFT JOIN pp ON pp.method_id = u.method_id""")
def jn03_related_methods(g):
    return P.related_methods(g, 1)


GAPS = f"""gm AS (SELECT DISTINCT e.name AS method, pe.src AS paper_id, hp.problem_id, pr.description AS problem, hg.gap_id, failure_mode, constraint_text FROM entity e JOIN paper_entity pe ON pe.dst = e.entity_id AND {OWN}
JOIN has_problem hp ON hp.paper_id = pe.src JOIN problem pr ON pr.problem_id = hp.problem_id JOIN has_gap hg ON hg.problem_id = hp.problem_id JOIN gap ON gap.gap_id = hg.gap_id WHERE lower(trim(e.name)) IN {_list(METHODS)})"""


@query(f", {GAPS} SELECT * FROM gm")
def jn04_gaps_for_methods(g):
    return P.gaps_for_methods(g, METHODS)


@query(f", {GAPS} SELECT a.gap_id, i.idea_id, mechanism, novelty_type, (SELECT count(DISTINCT claim_id) FROM idea_claim x WHERE x.idea_id = i.idea_id) AS claim_count FROM (SELECT DISTINCT gap_id FROM gm) g JOIN addressed_by a ON a.gap_id = g.gap_id JOIN idea i ON i.idea_id = a.idea_id")
def jn05_addressing_ideas(g):
    return P.addressing_ideas(g, P.gaps_for_methods(g, METHODS))


@query(f", {GAPS} SELECT DISTINCT problem_id, problem, gap_id, failure_mode, constraint_text FROM gm WHERE gap_id NOT IN (SELECT gap_id FROM addressed_by)")
def jn06_unaddressed_gaps(g):
    return P.unaddressed_gaps(g, METHODS)


def _side(names) -> str:
    return f"""(SELECT DISTINCT o.dst AS entity_id, o.src AS paper_id FROM entity e JOIN paper_entity w ON w.dst = e.entity_id AND w.{OWN} JOIN paper_entity o ON o.src = w.src AND NOT (o.dst = w.dst AND o.rel = w.rel) WHERE lower(trim(e.name)) IN {_list(names)})"""


BRIDGES = f"""sa AS (SELECT entity_id, count(*) AS papers_a_count FROM {_side(SIDE_A)} x GROUP BY 1),
br AS (SELECT entity_type, name, papers_a_count, count(DISTINCT b.paper_id) AS papers_b_count FROM sa JOIN {_side(SIDE_B)} b ON b.entity_id = sa.entity_id JOIN entity e ON e.entity_id = sa.entity_id GROUP BY 1, 2, 3)"""


@query(f", {BRIDGES} SELECT * FROM br ORDER BY papers_a_count + papers_b_count DESC, entity_type, name, papers_a_count LIMIT 30")
def jn07_cross_domain_bridges(g):
    return P.cross_domain_bridges(g, SIDE_A, SIDE_B)


def _family(names, out) -> str:
    return f"(SELECT src AS paper_id, string_agg(DISTINCT name, ',' ORDER BY name) AS {out} FROM entity JOIN paper_entity ON dst = entity_id WHERE lower(trim(name)) IN {_list(names)} GROUP BY 1)"


@query(f"SELECT p.paper_id, title, year, venue, methods_a, methods_b FROM {_family(SIDE_A, 'methods_a')} a JOIN {_family(SIDE_B, 'methods_b')} b ON a.paper_id = b.paper_id JOIN paper p ON p.paper_id = a.paper_id ORDER BY year DESC NULLS FIRST, p.paper_id LIMIT 20")
def jn08_bridge_papers(g):
    return P.bridge_papers(g, SIDE_A, SIDE_B)


COMPONENTS = f"""base AS (SELECT DISTINCT e.name AS method, pe.src AS paper_id FROM entity e JOIN paper_entity pe ON pe.dst = e.entity_id AND {OWN} WHERE lower(trim(e.name)) IN {_list(METHODS)}),
ch AS (SELECT paper_id, claim_id, text, severity FROM claim WHERE claim_id IN (SELECT claim_id FROM idea_claim)),
comp AS (SELECT method, base.paper_id, ch.claim_id, text, severity, evidence_id, strength FROM base LEFT JOIN ch ON ch.paper_id = base.paper_id LEFT JOIN supported_by s ON s.claim_id = ch.claim_id),
cc AS (SELECT method, paper_id, count(DISTINCT claim_id) AS claim_count, count(DISTINCT evidence_id) AS evidence_count, coalesce(string_agg(DISTINCT strength, ',' ORDER BY strength), '') AS strengths FROM comp GROUP BY 1, 2)"""


@query(f", {COMPONENTS} SELECT * FROM cc")
def jn09_component_evidence(g):
    return P.component_evidence_counts(g, METHODS)


LEDGER = """led AS (SELECT c.claim_id, c.paper_id, c.text, c.claim_type, c.severity, count(DISTINCT s.evidence_id) AS evidence_count,
CASE max(CASE strength WHEN 'FULL' THEN 3 WHEN 'REFUTED' THEN 2 WHEN 'PARTIAL' THEN 1 ELSE 0 END) WHEN 3 THEN 'FULL' WHEN 2 THEN 'REFUTED' WHEN 1 THEN 'PARTIAL' ELSE 'UNVERIFIABLE' END AS support_status,
coalesce(string_agg(DISTINCT CASE WHEN e.evidence_id IS NOT NULL THEN coalesce(summary, '') END, '|' ORDER BY CASE WHEN e.evidence_id IS NOT NULL THEN coalesce(summary, '') END), '') AS actual_evidence
FROM claim c LEFT JOIN supported_by s ON s.claim_id = c.claim_id LEFT JOIN evidence e ON e.evidence_id = s.evidence_id GROUP BY 1, 2, 3, 4, 5)"""


@query(f", {LEDGER} SELECT * FROM led")
def jn10_claim_ledger(g):
    return P.ledger(g)


@query(f", {LEDGER} SELECT support_status, severity, count(*) AS n FROM led GROUP BY 1, 2")
def agg07_ledger_status(g):
    return P.ledger(g).groupBy("support_status", "severity").agg(F.count("*").alias("n"))


@query(f", {LEDGER} SELECT claim_id, paper_id, text FROM led WHERE severity = 'P0' AND support_status <> 'FULL'")
def flt11_red_flags(g):
    return P.ledger(g).where("severity = 'P0' AND support_status <> 'FULL'").select("claim_id", "paper_id", "text")


@query("""SELECT p.problem_id, description, coalesce(array_to_string(list_sort(list(DISTINCT hg.gap_id) FILTER (hg.gap_id IS NOT NULL)), ','), '') AS gaps,
coalesce(array_to_string(list_sort(list(DISTINCT a.idea_id) FILTER (a.idea_id IS NOT NULL)), ','), '') AS ideas
FROM problem p LEFT JOIN has_gap hg ON hg.problem_id = p.problem_id LEFT JOIN addressed_by a ON a.gap_id = hg.gap_id GROUP BY 1, 2""")
def jn11_gap_context(g):
    return P.gap_context(g)


@query("""SELECT DISTINCT c.claim_id, ic.idea_id, ab.gap_id, hg.problem_id, (SELECT count(*) FROM supported_by s WHERE s.claim_id = c.claim_id) AS evidence_count
FROM claim c LEFT JOIN idea_claim ic ON ic.claim_id = c.claim_id LEFT JOIN addressed_by ab ON ab.idea_id = ic.idea_id LEFT JOIN has_gap hg ON hg.gap_id = ab.gap_id""")
def jn12_evidence_chain(g):
    return P.evidence_chain(g)


CHAIN = """chain(start, method, step) AS (SELECT method_id, method_id, CAST(0 AS BIGINT) FROM method UNION ALL SELECT start, prev, step + 1 FROM chain JOIN evolves ON cur = method)"""


@query(f", {CHAIN} SELECT start, method, step FROM chain", recursive=True)
def jn13_evolution_chain(g):
    return P.evolution_chain(g)


@query(f", {CHAIN} SELECT start, method, step, name, year, prev AS next, delta FROM chain JOIN method m ON m.method_id = method LEFT JOIN evolves ON cur = method", recursive=True)
def srt07_chain_by_year(g):
    return P.evolution_steps(g).orderBy(F.asc_nulls_last("year"), "start", "step").select("start", "method", "step", "name", F.col("year").cast("long"), "next", "delta")


@query(""", tree(node_id, root_id, depth, title) AS (SELECT node_id, node_id, CAST(0 AS BIGINT), title FROM section WHERE parent_id IS NULL
UNION ALL SELECT s.node_id, root_id, depth + 1, s.title FROM tree t JOIN section s ON s.parent_id = t.node_id) SELECT * FROM tree""", recursive=True)
def jn14_section_tree(g):
    return P.section_tree(g)


@query("SELECT paper_id, claim_id, text FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY claim_id) AS rn FROM claim) x WHERE rn <= 5")
def jn15_section_claims(g):
    return P.first_claims(g)


@query("SELECT a.cited AS a, b.cited AS b, count(DISTINCT a.citing) AS citing_papers FROM cites a JOIN cites b ON a.citing = b.citing WHERE a.cited < b.cited GROUP BY 1, 2 UNION ALL SELECT -1, -1, count(*) FROM cites")
def ext_cocitation(g):
    total = g.cites.agg(F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), F.count("*").alias("citing_papers"))
    return P.chained_citations(g).unionByName(total)


LABELS = ("paper", "entity", "problem", "gap", "idea", "claim", "evidence", "method", "section")


@query(" UNION ALL ".join(f"SELECT '{t}' AS label, count(*) AS n FROM {t}" for t in LABELS) + " UNION ALL SELECT 'limitation', 0")
def agg01_label_counts(g):
    counts = None
    for t in LABELS:
        one = getattr(g, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("label"), "n")
        counts = one if counts is None else counts.unionByName(one)
    spark = g.paper.sparkSession
    return spark.createDataFrame([(t,) for t in (*LABELS, "limitation")], "label string").join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT rel, count(DISTINCT dst) AS entities, count(DISTINCT src) AS papers, count(*) AS edges FROM paper_entity GROUP BY 1")
def agg02_distinct_counts(g):
    return g.paper_entity.groupBy("rel").agg(F.countDistinct("dst").alias("entities"), F.countDistinct("src").alias("papers"), F.count("*").alias("edges"))


@query("SELECT intent, count(*) AS n, round(max(coalesce(confidence, 0.5)), 6) AS best FROM cites GROUP BY 1")
def agg03_count_and_max(g):
    return g.cites.groupBy("intent").agg(F.count("*").alias("n"), F.round(F.max(F.coalesce("confidence", F.lit(0.5))), 6).alias("best"))


@query("SELECT src AS paper_id, string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS kinds, count(DISTINCT entity_type) AS n_kinds FROM paper_entity JOIN entity ON entity_id = dst GROUP BY 1")
def agg04_collect_distinct(g):
    own = g.paper_entity.join(g.entity, c("entity_id") == c("dst")).groupBy(c("src").alias("paper_id")).agg(F.array_sort(F.collect_set("entity_type")).alias("k"))
    return own.select("paper_id", F.array_join("k", ",").alias("kinds"), F.size("k").cast("long").alias("n_kinds"))


@query("""SELECT c.claim_id, count(DISTINCT CASE WHEN s.evidence_id IS NULL THEN '' ELSE concat(s.evidence_id, ':', strength) END) AS n_maps, count(DISTINCT s.evidence_id) AS n_evidence
FROM claim c LEFT JOIN supported_by s ON s.claim_id = c.claim_id GROUP BY 1""")
def agg05_collect_maps(g):
    rows = g.claim.select("claim_id").join(g.supported_by, "claim_id", "left").groupBy("claim_id").agg(F.collect_set(F.struct("evidence_id", "strength")).alias("m"))
    return rows.select("claim_id", F.size("m").cast("long").alias("n_maps"), F.size(F.filter("m", lambda x: x["evidence_id"].isNotNull())).cast("long").alias("n_evidence"))


@query("SELECT c.claim_id, coalesce(string_agg(coalesce(summary, ''), '|' ORDER BY e.evidence_id), '') AS summaries, count(e.evidence_id) AS n FROM claim c LEFT JOIN supported_by s ON s.claim_id = c.claim_id LEFT JOIN evidence e ON e.evidence_id = s.evidence_id GROUP BY 1")
def agg08_evidence_lists(g):
    rows = g.claim.select("claim_id").join(g.supported_by, "claim_id", "left").join(g.evidence.select("evidence_id", "summary"), "evidence_id", "left")
    own = rows.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.when(c("evidence_id").isNotNull(), F.struct("evidence_id", F.coalesce("summary", F.lit("")).alias("s"))))).alias("l"))
    return own.select("claim_id", F.array_join(F.transform("l", lambda x: x["s"]), "|").alias("summaries"), F.size("l").cast("long").alias("n"))


RULE = "rule.F"
EDGES = f"edges AS (SELECT * FROM paper_entity WHERE source_rule = '{RULE}' ORDER BY coalesce(confidence, 0) DESC, src, rel, dst LIMIT 50)"


def edges_by_rule(g, rule: str, limit: int):
    """The edges of one source rule, most confident first."""
    return g.paper_entity.where(c("source_rule") == rule).orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "src", "rel", "dst").limit(max(1, limit))


@query(f", {EDGES} SELECT src, rel, dst, confidence, source_rule FROM edges")
def srt04_edges_by_rule(g):
    return edges_by_rule(g, RULE, 50)


@query("SELECT src, rel, dst, confidence FROM paper_entity WHERE source_rule = 'rule.O'")
def src10_edge_scan(g):
    return g.paper_entity.where("source_rule = 'rule.O'").select("src", "rel", "dst", "confidence")


@query(f", {EDGES} SELECT rel AS relation, count(*) AS n, round(coalesce(avg(confidence), 0), 6) AS average_confidence, (SELECT count(*) FROM edges) AS edge_count FROM edges GROUP BY 1")
def agg10_edge_audit(g):
    edges = edges_by_rule(g, RULE, 50)
    total = edges.agg(F.count("*").alias("edge_count"))
    return edges.groupBy(c("rel").alias("relation")).agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("average_confidence")).join(F.broadcast(total), F.lit(True))


@query(f""", {COMPONENTS},
st AS (SELECT method, avg(CASE strength WHEN 'FULL' THEN 1.0 WHEN 'PARTIAL' THEN 0.5 WHEN 'WEAK' THEN 0.25 ELSE 0.0 END) AS a FROM (SELECT DISTINCT method, paper_id, strength FROM comp WHERE strength IS NOT NULL) x GROUP BY 1),
un AS (SELECT method, count(DISTINCT claim_id) AS n FROM comp WHERE severity IN ('P0', 'P1') AND evidence_id IS NULL GROUP BY 1)
SELECT cc.method, count(DISTINCT paper_id) AS papers, CAST(sum(claim_count) AS BIGINT) AS claims, CAST(sum(evidence_count) AS BIGINT) AS evidence, round_even(coalesce(any_value(a), 0), 3) AS average_strength, coalesce(any_value(n), 0) AS unsupported
FROM cc LEFT JOIN st ON st.method = cc.method LEFT JOIN un ON un.method = cc.method GROUP BY 1""")
def agg11_component_rollup(g):
    rows = P.component_evidence(g, METHODS)
    counts = P.component_evidence_counts(g, METHODS).groupBy("method").agg(F.countDistinct("paper_id").alias("papers"), F.sum("claim_count").alias("claims"), F.sum("evidence_count").alias("evidence"))
    strength = rows.where("strength is not null").select("method", "paper_id", "strength").distinct().groupBy("method").agg(F.avg(X.strength_value("strength")).alias("a"))
    open_ = rows.where("severity IN ('P0', 'P1') AND evidence_id IS NULL").groupBy("method").agg(F.countDistinct("claim_id").alias("n"))
    return counts.join(strength, "method", "left").join(open_, "method", "left").select(
        "method", "papers", "claims", "evidence", F.bround(F.coalesce("a", F.lit(0.0)), 3).alias("average_strength"), F.coalesce("n", F.lit(0)).alias("unsupported")
    )


@query(f", {BRIDGES} SELECT entity_type, name, papers_a_count, papers_b_count FROM br WHERE papers_a_count >= 2")
def agg19_convergence_bridges(g):
    return P.cross_domain_bridges(g, SIDE_A, SIDE_B, 2_000_000_000).where("papers_a_count >= 2")


@query("SELECT paper_id, title, year, venue FROM paper WHERE year BETWEEN 1995 AND 1997")
def flt03_year_range(g):
    return g.paper.where(c("year").between(1995, 1997))


@query("SELECT paper_id, year FROM paper WHERE year IS NULL OR year <= coalesce(1996, year)")
def flt04_year_or_null(g):
    return g.paper.where(c("year").isNull() | (c("year") <= F.coalesce(F.lit(1996), "year"))).select("paper_id", "year")


@query(f"SELECT entity_id, name, entity_type FROM entity WHERE lower(trim(name)) IN {_list(METHODS)}")
def flt02_name_list(g):
    return P.methods_named(g, METHODS).select("entity_id", "name", "entity_type")


@query("SELECT gap_id, failure_mode FROM gap WHERE gap_id NOT IN (SELECT gap_id FROM addressed_by)")
def flt07_anti_pattern(g):
    return g.gap.join(g.addressed_by, "gap_id", "left_anti").select("gap_id", "failure_mode")


@query("SELECT p.paper_id, EXISTS (SELECT 1 FROM cites WHERE citing = p.paper_id) AS cites_any FROM paper p")
def flt09_existence(g):
    return g.paper.join(g.cites.select(c("citing").alias("paper_id"), F.lit(True).alias("x")).distinct(), "paper_id", "left").select("paper_id", F.coalesce("x", F.lit(False)).alias("cites_any"))


@query("SELECT src, dst, rel FROM paper_entity WHERE rel IN ('PROPOSES', 'INTRODUCES', 'USES') AND confidence BETWEEN 0.3 AND 1")
def flt13_validators(g):
    return g.paper_entity.where(c("rel").isin("PROPOSES", "INTRODUCES", "USES") & c("confidence").between(0.3, 1)).select("src", "dst", "rel")


@query("SELECT c.claim_id, s.evidence_id IS NOT NULL AS has_evidence, coalesce(s.strength, 'NONE') AS strength FROM claim c LEFT JOIN supported_by s ON s.claim_id = c.claim_id")
def prj03_flags(g):
    return g.claim.select("claim_id").join(g.supported_by, "claim_id", "left").select("claim_id", c("evidence_id").isNotNull().alias("has_evidence"), F.coalesce("strength", F.lit("NONE")).alias("strength"))


@query("SELECT DISTINCT entity_type, CASE entity_type WHEN 'STANDARD' THEN 'PROPOSES' WHEN 'ECONOMY' THEN 'INTRODUCES' ELSE 'USES' END AS relation FROM entity")
def prj09_relation_of_type(g):
    return g.entity.select("entity_type", F.when(c("entity_type") == "STANDARD", "PROPOSES").when(c("entity_type") == "ECONOMY", "INTRODUCES").otherwise("USES").alias("relation")).distinct()


@query("SELECT claim_id, CASE WHEN upper(trim(claim_type)) IN ('PERFORMANCE', 'ROBUSTNESS') THEN upper(trim(claim_type)) ELSE 'PERFORMANCE' END AS claim_type, CASE WHEN severity IN ('P0', 'P2') THEN severity ELSE 'P1' END AS severity FROM claim")
def prj10_enum_coercion(g):
    return g.claim.select("claim_id", X.one_of("claim_type", ("PERFORMANCE", "ROBUSTNESS"), "PERFORMANCE").alias("claim_type"), X.one_of("severity", ("P0", "P2"), "P1").alias("severity"))


@query("SELECT src, rel, dst, CASE WHEN trim(source_rule) = 'rule.O' THEN 'unknown.rule' ELSE trim(source_rule) END AS source_rule, 'unknown.source' AS confidence_source FROM paper_entity")
def prj11_edge_metadata(g):
    rule = F.when(c("source_rule") != "rule.O", F.concat(F.lit("  "), "source_rule")).otherwise(" \t")
    return g.paper_entity.select("src", "rel", "dst", X.blank_to(rule, "unknown.rule").alias("source_rule"), X.blank_to(F.lit(None).cast("string"), "unknown.source").alias("confidence_source"))


@query("SELECT name, min(entity_id) AS entity_id FROM entity GROUP BY name")
def win02_first_by_name(g):
    return P.top_per(g.entity.withColumn("low", F.lower("name")), ["low"], ["entity_id"], 1).select("name", "entity_id")


@query("SELECT paper_id, rerank_position, score FROM (SELECT paper_id, row_number() OVER (ORDER BY n DESC, paper_id) - 1 AS rerank_position, least(1.0, round(n / 10.0 + 0.05 * (1 - (row_number() OVER (ORDER BY n DESC, paper_id) - 1) / 15.0), 6)) AS score FROM (SELECT src AS paper_id, count(*) AS n FROM paper_entity GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15) x) y")
def win01_rerank_position(g):
    top = g.paper_entity.groupBy(c("src").alias("paper_id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "paper_id").limit(15)
    position = F.row_number().over(Window.orderBy(F.desc("n"), "paper_id")) - 1
    return top.withColumn("rerank_position", position.cast("long")).select("paper_id", "rerank_position", F.least(F.lit(1.0), F.round(c("n") / 10.0 + 0.05 * (1 - c("rerank_position") / 15.0), 6)).alias("score"))


@query("SELECT citing AS id FROM cites UNION ALL SELECT cited FROM cites")
def set01_union_all(g):
    return g.cites.select(c("citing").alias("id")).unionByName(g.cites.select(c("cited").alias("id")))


@query("SELECT citing AS id FROM cites UNION SELECT cited FROM cites")
def set02_union_distinct(g):
    return g.cites.select(c("citing").alias("id")).unionByName(g.cites.select(c("cited").alias("id"))).distinct()


@query("SELECT paper_id, CAST(0.3 AS DOUBLE) AS score FROM paper WHERE paper_id NOT IN (SELECT src FROM paper_entity)")
def set04_except_neighbours(g):
    return g.paper.join(g.paper_entity, c("paper_id") == c("src"), "left_anti").select("paper_id", F.lit(0.3).alias("score"))


@query(f"SELECT paper_id FROM {_family(SIDE_A, 'm')} a INTERSECT SELECT paper_id FROM {_family(SIDE_B, 'm')} b")
def set05_intersect(g):
    side = lambda names: P.methods_named(g, names).join(g.paper_entity, c("entity_id") == c("dst")).select(c("src").alias("paper_id"))
    return side(SIDE_A).intersect(side(SIDE_B))


@query("SELECT DISTINCT entity_type, name FROM entity")
def set06_distinct(g):
    return g.entity.select("entity_type", "name").distinct()
