"""Graph-pattern queries as joins over the node and edge tables.

Every LIMIT has a total order; null years sort as the largest value. Pattern
queries for one paper or name list take it as a parameter; batch forms rank per
key with a window, which the planner limits before the shuffle.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import utrim
from ..projection import Graph

OWNING = ("PROPOSES", "INTRODUCES")
c = F.col


def names_of(names: Sequence[str]) -> list[str]:
    return sorted({n.strip().lower() for n in names})


def methods_named(g: Graph, names: Sequence[str]) -> DataFrame:
    """Entities whose trimmed, lower-cased name is in the list."""
    return g.entity.where(F.lower(utrim("name")).isin(*names_of(names)) if names else F.lit(False))


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence, k: int) -> DataFrame:
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(c("rank_") <= k).drop("rank_")


def competitors(g: Graph, k: int = 10, seeds: DataFrame | None = None) -> DataFrame:
    """Per paper the k papers that propose or introduce most of the same entities."""
    own = g.paper_entity.where(c("rel").isin(*OWNING)).select("src", "dst").distinct()
    left = own if seeds is None else own.join(seeds.select(c("paper_id").alias("src")), "src", "left_semi")
    pairs = left.select(c("src").alias("seed"), "dst").join(own.select(c("src").alias("paper_id"), "dst"), "dst").where("seed <> paper_id")
    counts = pairs.groupBy("seed", "paper_id").agg(F.count("*").alias("shared_entities"))
    return top_per(counts, ["seed"], [F.desc("shared_entities"), "paper_id"], k).join(g.paper.select("paper_id", "title", "year"), "paper_id")


def evolution_related(g: Graph, seeds: DataFrame, k: int = 20) -> DataFrame:
    """Papers that the seeds evolve from or build on, by number of links and confidence."""
    links = g.cites.where(c("intent").isin("EVOLVES_FROM", "CITES_FOR_FOUNDATION") & (c("citing") != c("cited")))
    found = links.join(seeds.select(c("paper_id").alias("citing")).distinct(), "citing", "left_semi")
    best = F.max(F.coalesce("confidence", F.lit(0.5)))
    return found.groupBy(c("cited").alias("paper_id")).agg(best.alias("relation_confidence"), F.count("*").alias("link_count")).orderBy(F.desc("link_count"), F.desc("relation_confidence"), "paper_id").limit(k)


def related_methods(g: Graph, paper_id: int, limit: int = 40) -> DataFrame:
    """The paper's own methods and up to limit historical ones, with every paper that proposes them."""
    owned = g.paper_entity.where("rel = 'PROPOSES'")
    own = owned.where(c("src") == paper_id).select(c("dst").alias("method_id"))
    year = g.paper.where(c("paper_id") == paper_id).select(c("year").alias("own_year"))
    others = owned.where(c("src") != paper_id).join(g.paper, c("src") == c("paper_id")).join(F.broadcast(year.limit(1)), F.lit(True), "left")
    others = others.where("year is null or year <= coalesce(own_year, year)").groupBy(c("dst").alias("method_id")).agg(F.max("year").alias("year_"))
    history = others.orderBy(F.desc_nulls_last("year_"), "method_id").limit(limit).select("method_id")
    both = own.unionByName(history).distinct()
    named = both.join(g.entity.select(c("entity_id").alias("method_id"), "name"), "method_id")
    papers = owned.select(c("src").alias("paper_id"), c("dst").alias("method_id")).join(g.paper.select("paper_id", "year"), "paper_id")
    return named.join(papers, "method_id", "left").select("method_id", "name", "paper_id", "year")


def gaps_for_methods(g: Graph, names: Sequence[str]) -> DataFrame:
    """Distinct method, problem and gap along method <- paper -> problem -> gap.

    Both sides of the last join are made distinct before it: a row names its
    problem and all columns of both sides, so their product repeats no row and
    is neither shuffled nor held.
    """
    papers = methods_named(g, names).join(g.paper_entity.where(c("rel").isin(*OWNING)), c("entity_id") == c("dst")).select(c("name").alias("method"), c("src").alias("paper_id")).distinct()
    problems = papers.join(g.has_problem, "paper_id").select("method", "paper_id", "problem_id").distinct()
    gaps = g.problem.join(g.has_gap, "problem_id").join(g.gap, "gap_id").select("problem_id", c("description").alias("problem"), "gap_id", "failure_mode", "constraint_text").distinct()
    return problems.join(gaps, "problem_id").select("method", "paper_id", "problem_id", "problem", "gap_id", "failure_mode", "constraint_text")


def addressing_ideas(g: Graph, gaps: DataFrame) -> DataFrame:
    """Ideas that address the gaps, with the number of their claims."""
    pairs = gaps.select("gap_id").distinct().join(g.addressed_by, "gap_id").join(g.idea, "idea_id")
    counts = g.idea_claim.groupBy("idea_id").agg(F.countDistinct("claim_id").alias("n"))
    return pairs.join(counts, "idea_id", "left").select("gap_id", "idea_id", "mechanism", "novelty_type", F.coalesce("n", F.lit(0)).alias("claim_count"))


def unaddressed_gaps(g: Graph, names: Sequence[str]) -> DataFrame:
    """Gaps along the methods' problems that no idea addresses."""
    found = gaps_for_methods(g, names).select("problem_id", "problem", "gap_id", "failure_mode", "constraint_text").distinct()
    return found.join(g.addressed_by, "gap_id", "left_anti")


def _side(g: Graph, names: Sequence[str]) -> DataFrame:
    """(entity, paper): entities that papers owning one of the methods link by another edge."""
    linked = g.paper_entity.select(c("src").alias("paper_id"), c("dst").alias("entity_id"), "rel")
    own = methods_named(g, names).select("entity_id").join(linked.where(c("rel").isin(*OWNING)), "entity_id").select("paper_id", c("entity_id").alias("via"), c("rel").alias("via_rel"))
    other = own.join(linked, "paper_id").where((c("via") != c("entity_id")) | (c("via_rel") != c("rel")))
    return other.select("entity_id", "paper_id").distinct()


def cross_domain_bridges(g: Graph, a: Sequence[str], b: Sequence[str], k: int = 30) -> DataFrame:
    """Nodes that papers of both method families link, grouped by type, name and A's count."""
    left = _side(g, a).groupBy("entity_id").agg(F.count("*").alias("papers_a_count"))
    both = left.join(_side(g, b), "entity_id").join(g.entity.select("entity_id", "entity_type", "name"), "entity_id")
    out = both.groupBy("entity_type", "name", "papers_a_count").agg(F.countDistinct("paper_id").alias("papers_b_count"))
    return out.orderBy(F.desc(c("papers_a_count") + c("papers_b_count")), "entity_type", "name", "papers_a_count").limit(k)


def bridge_papers(g: Graph, a: Sequence[str], b: Sequence[str], k: int = 20) -> DataFrame:
    """Papers linked to methods of both families, newest (and undated) first."""
    side = lambda names, out: methods_named(g, names).join(g.paper_entity, c("entity_id") == c("dst")).groupBy(c("src").alias("paper_id")).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias(out))
    both = side(a, "methods_a").join(side(b, "methods_b"), "paper_id").join(g.paper, "paper_id")
    return both.orderBy(F.desc_nulls_first("year"), "paper_id").limit(k).select("paper_id", "title", "year", "venue", "methods_a", "methods_b")


def component_evidence(g: Graph, names: Sequence[str]) -> DataFrame:
    """One row per method, paper, claim and evidence; a missing optional chain is null as a whole."""
    base = methods_named(g, names).join(g.paper_entity.where(c("rel").isin(*OWNING)), c("entity_id") == c("dst")).select(c("name").alias("method"), c("src").alias("paper_id")).distinct()
    claims = g.claim.join(g.idea_claim.select("claim_id").distinct(), "claim_id").select("paper_id", "claim_id", "text", "severity")
    return base.join(claims, "paper_id", "left").join(g.supported_by, "claim_id", "left")


def component_evidence_counts(g: Graph, names: Sequence[str]) -> DataFrame:
    rows = component_evidence(g, names)
    return rows.groupBy("method", "paper_id").agg(
        F.countDistinct("claim_id").alias("claim_count"), F.countDistinct("evidence_id").alias("evidence_count"), F.array_join(F.array_sort(F.collect_set("strength")), ",").alias("strengths")
    )


def ledger(g: Graph) -> DataFrame:
    """Every claim with the status of its evidence: FULL over REFUTED over PARTIAL over UNVERIFIABLE."""
    rank = F.max(F.when(c("strength") == "FULL", 3).when(c("strength") == "REFUTED", 2).when(c("strength") == "PARTIAL", 1).otherwise(0))
    status = F.when(rank == 3, "FULL").when(rank == 2, "REFUTED").when(rank == 1, "PARTIAL").otherwise("UNVERIFIABLE")
    rows = g.claim.join(g.supported_by, "claim_id", "left").join(g.evidence.select("evidence_id", "summary"), "evidence_id", "left")
    return rows.groupBy("claim_id", "paper_id", "text", "claim_type", "severity").agg(
        F.countDistinct("evidence_id").alias("evidence_count"), status.alias("support_status"), F.array_join(F.array_sort(F.collect_set(F.when(c("evidence_id").isNotNull(), F.coalesce("summary", F.lit(""))))), "|").alias("actual_evidence")
    )


def gap_context(g: Graph) -> DataFrame:
    """Every problem with its optional gaps and their optional ideas."""
    rows = g.problem.join(g.has_gap, "problem_id", "left").join(g.gap, "gap_id", "left").join(g.addressed_by, "gap_id", "left").join(g.idea, "idea_id", "left")
    ids = lambda x: F.array_join(F.transform(F.array_sort(F.collect_set(x)), lambda v: v.cast("string")), ",")
    return rows.groupBy("problem_id", "description").agg(ids("gap_id").alias("gaps"), ids("idea_id").alias("ideas"))


def evidence_chain(g: Graph) -> DataFrame:
    """Every claim of an idea with its optional evidence and, backwards, idea, gap and problem."""
    back = g.idea_claim.join(g.addressed_by, "idea_id", "left").join(g.has_gap, "gap_id", "left")
    rows = g.claim.select("claim_id").join(back, "claim_id", "left")
    evidence = g.supported_by.groupBy("claim_id").agg(F.count("*").alias("evidence_count"))
    return rows.join(evidence, "claim_id", "left").select("claim_id", "idea_id", "gap_id", "problem_id", F.coalesce("evidence_count", F.lit(0)).alias("evidence_count")).distinct()


def evolution_chain(g: Graph, most: int = 64) -> DataFrame:
    """(start, step, method): every method on the paths of prev links from every start, whatever their length.

    Path doubling: after the i-th round jumps of up to 2**i links are known, so
    the number of joins is the logarithm of the longest path. ``most`` bounds the
    length; a cycle would exceed it and is reported.
    """
    hops = g.evolves.select(c("cur").alias("start"), c("prev").alias("method"), F.lit(1).cast("long").alias("step"))
    known, length = hops, 1
    while length < most:
        far = known.where(c("step") == length)
        if far.isEmpty():
            break
        more = far.select("start", c("method").alias("mid")).join(known.select(c("start").alias("mid"), "method", (c("step") + length).alias("step")), "mid").select("start", "method", "step")
        known, length = known.unionByName(more).distinct(), length * 2
    else:
        raise ValueError("evolution paths exceed the bound; the edges may hold a cycle")
    return g.method.select(c("method_id").alias("start"), c("method_id").alias("method"), F.lit(0).cast("long").alias("step")).unionByName(known.select("start", "method", "step"))


def evolution_steps(g: Graph) -> DataFrame:
    """Chain rows with the method's name and year and its own outgoing link."""
    out = g.evolves.select(c("cur").alias("method"), c("prev").alias("next"), "delta")
    return evolution_chain(g).join(g.method.select(c("method_id").alias("method"), "name", "year"), "method").join(out, "method", "left")


def section_tree(g: Graph, most: int = 32) -> DataFrame:
    """Every section with its depth and root, from the roots down, level by level."""
    level = g.section.where("parent_id is null").select("node_id", c("node_id").alias("root_id"), F.lit(0).cast("long").alias("depth"), "title")
    out = level
    for _ in range(most):
        level = g.section.join(level.select(c("node_id").alias("parent_id"), "root_id", "depth"), "parent_id").select("node_id", "root_id", (c("depth") + 1).alias("depth"), "title")
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError("section tree exceeds the bound; the edges may hold a cycle")


def first_claims(g: Graph, k: int = 5) -> DataFrame:
    """At most k claims of each paper, by id."""
    return top_per(g.claim.select("paper_id", "claim_id", "text"), ["paper_id"], ["claim_id"], k)


def chained_citations(g: Graph) -> DataFrame:
    """Papers cited together by one paper (co-citation), with the number of citing papers."""
    pairs = g.cites.select("citing", c("cited").alias("a")).join(g.cites.select("citing", c("cited").alias("b")), "citing").where("a < b")
    return pairs.groupBy("a", "b").agg(F.countDistinct("citing").alias("citing_papers"))
