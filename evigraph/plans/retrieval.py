"""Composite retrieval: several search paths, fused by score.

A path is a frame (paper_id, path, ordinal, score, payload). Paths that start
from earlier results join on a limited subquery, so nothing is collected but a
query vector.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import clipped, coupled_score, evolution_score, fused_score, tree_score
from ..operators import patterns as P
from ..operators.vectors import top_k
from ..projection import Graph

c = F.col
#: Order of the paths; ties between papers go to the earlier path.
PATHS = ("entity", "claim", "evolution", "section", "tree_search", "tree_claim_coupling")


def hits(g: Graph, query: list[float], kind: str, k: int, path: str) -> DataFrame:
    """Filtered vector hits as path rows; hits without a paper are dropped, negative scores count as 0."""
    found = top_k(g.vec, query, k, c("doc_kind") == kind)
    return found.where("paper_id is not null").select("paper_id", F.lit(path).alias("path"), clipped("score").alias("score"), c("entity_type").alias("payload"))


def fused(paths: DataFrame) -> DataFrame:
    """Per paper its best score, number of paths, fused score, first path, and distinct payloads."""
    order = F.array_position(F.array(*(F.lit(p) for p in PATHS)), c("path"))
    per = paths.groupBy("paper_id", "path").agg(F.max("score").alias("score"), F.collect_set(F.nullif("payload", F.lit(""))).alias("payloads"))
    out = per.groupBy("paper_id").agg(
        F.max("score").alias("best"), F.count("*").alias("n_paths"), F.min_by("path", order).alias("recall_path"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("payloads")))), ",").alias("matched")
    )
    return out.withColumn("score", F.round(fused_score("best", "n_paths"), 6))


def best_papers(paths: DataFrame, k: int) -> DataFrame:
    return paths.groupBy("paper_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "paper_id").limit(k)


def competition_space(g: Graph, query: list[float], k: int = 20) -> DataFrame:
    """Papers near an idea by entity, claim and section, and the competitors of the first ten at a fixed low score."""
    paths = hits(g, query, "entity", 2 * k, "entity").unionByName(hits(g, query, "claim", k, "claim")).unionByName(hits(g, query, "section", k, "section"))
    scored = paths.groupBy("paper_id").agg(F.max("score").alias("score"))
    near = P.competitors(g, 5, best_papers(paths, 10)).select("paper_id").distinct()
    extra = near.join(scored, "paper_id", "left_anti").withColumn("score", F.lit(0.3))
    return scored.unionByName(extra).orderBy(F.desc("score"), "paper_id").limit(k)


def tree_path(g: Graph, candidates: DataFrame, relevance: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Path rows of the sections that a ranker finds in the candidates' trees, and of the claims coupled to them.

    Without a ranker every candidate's own claims stand for the sections found,
    at the default relevance.
    """
    score = tree_score(relevance if relevance is not None else F.lit(None).cast("double"))
    found = candidates.select("paper_id", F.lit("tree_search").alias("path"), score.alias("score"), F.lit("section").alias("payload"))
    claims = P.first_claims(g, 5).join(found.select("paper_id", c("score").alias("tree")), "paper_id")
    coupled = claims.select("paper_id", F.lit("tree_claim_coupling").alias("path"), coupled_score("tree").alias("score"), F.lit("claim").alias("payload"))
    return found, coupled


def enhanced_recall(g: Graph, query: list[float], k: int = 20, rank: DataFrame | None = None) -> DataFrame:
    """Five paths and the coupling, fused; ``rank`` (paper_id, position) reorders the first fifteen of three or more."""
    first = hits(g, query, "entity", k, "entity").unionByName(hits(g, query, "claim", k, "claim"))
    related = P.evolution_related(g, best_papers(first, max(5, k // 2)), max(k, 10))
    evolution = related.select("paper_id", F.lit("evolution").alias("path"), evolution_score("relation_confidence", "link_count").alias("score"), F.lit("evolution").alias("payload"))
    four = first.unionByName(evolution).unionByName(hits(g, query, "section", k, "section"))
    tree, coupled = tree_path(g, best_papers(four, min(5, max(1, k // 4))))
    out = fused(four.unionByName(tree).unionByName(coupled)).orderBy(F.desc("score"), "paper_id").limit(k)
    return reranked(out, rank)


def reranked(results: DataFrame, rank: DataFrame | None, head: int = 15, bonus: float = 0.05) -> DataFrame:
    """Results with position and adjusted score: ranked ones first, the others in their order; fewer than three stay as they are.

    The windows have no partition, as results are the k rows of one limit.
    """
    order = Window.orderBy(F.desc("score"), "paper_id")
    rows = results.withColumn("place", F.row_number().over(order) - 1)
    if rank is None:
        return rows.withColumn("rerank_position", c("place")).drop("place")
    valid = rank.groupBy("paper_id").agg(F.min("position").alias("position"))
    rows = rows.join(valid, "paper_id", "left").withColumn("position", F.when(c("place") < head, c("position")))
    rows = rows.withColumn("n_", F.count("*").over(Window.partitionBy()))
    position = F.row_number().over(Window.orderBy(F.asc_nulls_last("position"), "place")) - 1
    rows = rows.withColumn("rerank_position", F.when(c("n_") >= 3, position).otherwise(c("place")))
    raised = F.round(F.least(F.lit(1.0), c("score") + bonus * (1 - c("rerank_position") / c("n_"))), 6)
    return rows.withColumn("score", F.when(c("n_") >= 3, raised).otherwise(c("score"))).drop("place", "position", "n_")


def research_trends(g: Graph, query: list[float], years: tuple[int, int] | None = None, k: int = 50) -> DataFrame:
    """Histogram of entity types among the nearest entities, with the number of papers; years may come in any order."""
    found = top_k(g.vec, query, k, c("doc_kind") == "entity")
    if years:
        found = found.join(g.paper.where(c("year").between(min(years), max(years))).select("paper_id"), "paper_id", "left_semi")
    return found.groupBy(F.coalesce("entity_type", F.lit("UNKNOWN")).alias("entity_type")).agg(F.count("*").alias("n"), F.countDistinct("paper_id").alias("papers"))


def verified_claims(claims: DataFrame, g: Graph, k: int = 5) -> DataFrame:
    """For each claim vector the k nearest claims and the k nearest pieces of evidence."""
    from ..operators.vectors import nearest

    out = None
    for kind in ("claim", "evidence"):
        one = nearest(claims, g.vec.where(c("doc_kind") == kind), k).select(c("query_id").alias("claim_vec"), F.lit(kind).alias("kind"), "vec_id", "score")
        out = one if out is None else out.unionByName(one)
    return out


def innovation_paths(g: Graph, names: list[str]) -> DataFrame:
    """Gaps of the methods with the ideas that address them, or none."""
    gaps = P.gaps_for_methods(g, names).select("gap_id", "problem_id", "failure_mode").distinct()
    ideas = P.addressing_ideas(g, gaps)
    return gaps.join(ideas, "gap_id", "left").select("problem_id", "gap_id", "failure_mode", "idea_id", "mechanism", F.coalesce("claim_count", F.lit(0)).alias("claim_count"))


def bridge_report(g: Graph, a: list[str], b: list[str]) -> DataFrame:
    """Shared nodes and bridge papers of two method families in one frame."""
    shared = P.cross_domain_bridges(g, a, b).select(F.lit("concept").alias("kind"), F.concat_ws(":", "entity_type", "name").alias("item"), (c("papers_a_count") + c("papers_b_count")).alias("weight"))
    papers = P.bridge_papers(g, a, b).select(F.lit("paper").alias("kind"), c("title").alias("item"), c("year").alias("weight"))
    return shared.unionByName(papers)


def aligned_ledgers(g: Graph, papers: DataFrame, most: int = 5) -> DataFrame:
    """The first claims of each paper with their support, for comparison across papers."""
    own = P.ledger(g).join(papers.select("paper_id"), "paper_id", "left_semi")
    return P.top_per(own, ["paper_id"], ["claim_id"], most).select("paper_id", "claim_id", "severity", "support_status", "evidence_count")


def verified_citations(queries: DataFrame, g: Graph) -> DataFrame:
    """For each query vector the paper of its nearest entity or claim, with its metadata; null where none is found."""
    from ..operators.vectors import nearest

    near = nearest(queries, g.vec.where(c("doc_kind").isin("entity", "claim")), 1)
    best = near.join(g.vec.select("vec_id", "paper_id"), "vec_id").select(c("query_id").alias("vec_id"), "paper_id", "score")
    return queries.select("vec_id").join(best, "vec_id", "left").join(g.paper.select("paper_id", "title", "year"), "paper_id", "left").select("vec_id", "paper_id", "title", "year", "score")
