"""Entity resolution: normalised-name merges, components of similar pairs, and edge rewrite."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import entity_name, plain
from .components import components as connected
from .vectors import nearest

c = F.col


def exact_merges(entities: DataFrame, kind: str = "entity_type", name: str = "name", key: str = "entity_id") -> DataFrame:
    """(dupe, keeper) of entities of one type whose normalised names agree; the shortest name is kept."""
    norm = entities.withColumn("norm_", entity_name(name)).where("norm_ <> ''")
    keeper = norm.groupBy(kind, "norm_").agg(F.min(F.struct(F.length(name).alias("n"), c(key).alias("keeper"))).alias("k"))
    return norm.join(keeper, [kind, "norm_"]).select(c(key).alias("dupe"), c("k.keeper").alias("keeper")).where("dupe <> keeper")


def cluster_chunks(clusters: DataFrame, size: int = 30, stride: int = 28) -> DataFrame:
    """Members of (component, node) in overlapping chunks of a bounded size; chunks of one member are dropped."""
    place = F.row_number().over(Window.partitionBy("component").orderBy("node")) - 1
    n = F.count("*").over(Window.partitionBy("component"))
    rows = clusters.withColumns({"place": place, "n": n})
    first = F.greatest(F.ceil((c("place") - (size - 1)) / stride), F.lit(0)).cast("int")
    last = F.floor(c("place") / stride).cast("int")
    out = rows.withColumn("chunk", F.explode(F.sequence(first, last)))
    kept = F.least(c("n") - c("chunk") * stride, F.lit(size)) >= 2
    return out.where(kept).select("component", "chunk", "node")


def acronym(name: Column | str) -> Column:
    """First letters of the words of a name."""
    return F.array_join(F.transform(F.split(plain(name), " "), lambda w: w.substr(1, 1)), "")


def group_by_name(entities: DataFrame, kind: str = "entity_type", name: str = "name", key: str = "entity_id") -> DataFrame:
    """The offline stand-in for grouping by a language model: (dupe, keeper, canonical) by normalised name."""
    norm = entities.withColumn("norm_", entity_name(name))
    own = norm.groupBy(kind, "norm_").agg(F.min(key).alias("keeper"), F.min_by(name, F.struct(F.length(name), c(key))).alias("canonical"))
    return norm.join(own, [kind, "norm_"]).where(c(key) != c("keeper")).select(c(key).alias("dupe"), "keeper", "canonical")


def rewrite_edges(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges (src, rel, dst, confidence, source_rule) with merged nodes replaced by their keepers.

    Merges are closed over chains; self-edges vanish; parallel edges become one
    with the highest confidence and the first source rule.
    """
    closed = connected(merges.select(c("dupe").alias("a"), c("keeper").alias("b")))
    to = lambda col: closed.select(c("node").alias(col), c("component").alias(f"{col}_to"))
    moved = edges.join(to("src"), "src", "left").join(to("dst"), "dst", "left")
    moved = moved.withColumns({"src": F.coalesce("src_to", "src"), "dst": F.coalesce("dst_to", "dst")}).where("src <> dst")
    return moved.groupBy("src", "rel", "dst").agg(F.max("confidence").alias("confidence"), F.min("source_rule").alias("source_rule"))


def within_paper(entities: DataFrame) -> DataFrame:
    """One row for each name of a paper: the id of the first seen, the longest description."""
    key = F.lower(F.trim("name"))
    return entities.groupBy("paper_id", key.alias("key")).agg(
        F.min_by("entity_id", "seq").alias("entity_id"), F.max_by("description", F.struct(F.length("description"), -c("seq"))).alias("description"), F.count("*").alias("n")
    )


def across_papers(new: DataFrame, known: DataFrame, least: float = 0.95, k: int = 3) -> DataFrame:
    """(vec_id, match): the known entity of the same type that a new one is, by name, else by nearest vector."""
    key = ["entity_type", "low"]
    low = lambda df: df.withColumn("low", F.lower(F.trim("name")))
    exact = low(new).join(low(known).groupBy(*key).agg(F.min("vec_id").alias("match")), key).select("vec_id", "match")
    rest = new.join(exact, "vec_id", "left_anti")
    near = nearest(rest, known, k, least, same="entity_type").groupBy("query_id").agg(F.min_by("vec_id", F.struct(-c("score"), c("vec_id"))).alias("match"))
    return exact.unionByName(near.select(c("query_id").alias("vec_id"), "match"))


def resolve(entities: DataFrame, edges: DataFrame, pairs: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """The offline job: exact merges and components of similar pairs give (dupe, keeper); edges are rewritten unless dry."""
    exact = exact_merges(entities)
    near = connected(pairs.select(c("id_a").alias("a"), c("id_b").alias("b"))).where("node <> component").select(c("node").alias("dupe"), c("component").alias("keeper"))
    merges = connected(exact.unionByName(near).select(c("dupe").alias("a"), c("keeper").alias("b"))).where("node <> component").select(c("node").alias("dupe"), c("component").alias("keeper"))
    return merges, edges if dry_run else rewrite_edges(edges, merges)
