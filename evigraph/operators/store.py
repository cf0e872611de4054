"""Keyed, idempotent tables on Parquet.

A table is a log of batches, each a folder with a sequence number; a batch
counts once Spark's commit marker is there, so a broken write is never seen. A
read takes the latest row of each key, and tombstones hide deleted keys.
Compaction rewrites the log as one batch under a later number.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import blank_to, int_id, safe_key
from ..runtime import listing, remove

#: Keys of the tables.
KEYS = {
    "paper": ("paper_id",), "entity": ("entity_id",), "problem": ("problem_id",), "gap": ("gap_id",), "idea": ("idea_id",), "claim": ("claim_id",), "evidence": ("evidence_id",),
    "baseline": ("baseline_id",), "limitation": ("limitation_id",), "section": ("node_id",), "paper_entity": ("src", "rel", "dst"), "relation": ("src", "rel", "dst"),
    "cites": ("citing", "intent", "cited"), "evolves": ("cur", "prev"), "method_claim": ("src", "dst"), "dataset_evidence": ("src", "dst"), "supported_by": ("claim_id", "evidence_id"),
    "has_problem": ("paper_id", "problem_id"), "has_gap": ("problem_id", "gap_id"), "addressed_by": ("gap_id", "idea_id"), "idea_claim": ("idea_id", "claim_id"), "section_claim": ("node_id", "claim_id"),
    "citation_gap": ("citing", "cited", "intent", "gap_id"), "vector": ("collection", "point_id"), "processed": ("paper_id",),
}
#: Name of a batch's folder, before its number.
BATCH = "seq="
PAPER_RELATIONS = ("PROPOSES", "INTRODUCES", "USES")
c = F.col


class Store:
    """Tables of one root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def batches(self, table: str) -> list[str]:
        """Folders of the finished batches, in order."""
        at = f"{self.root}/{table}"
        return [f"{at}/{d}" for d in listing(self.spark, at) if d.startswith(BATCH) and "_SUCCESS" in listing(self.spark, f"{at}/{d}")]

    def upsert(self, table: str, rows: DataFrame, deleted: bool = False) -> None:
        """Insert or overwrite by key; of equal keys in one batch the greatest row stays."""
        keys = KEYS[table]
        if unknown := [k for k in keys if k not in rows.columns]:
            raise ValueError(f"{table} lacks its keys {unknown}")
        others = [x for x in rows.columns if x not in keys]
        one = rows.groupBy(*keys).agg(F.max(F.struct(*others)).alias("r_")).select(*keys, "r_.*") if others else rows.distinct()
        last = max((int(d.partition("=")[2]) for d in listing(self.spark, f"{self.root}/{table}") if d.startswith(BATCH)), default=0)
        # a writer that was beaten to the number fails here, as the folder exists
        one.withColumn("deleted_", F.lit(deleted)).write.mode("error").parquet(f"{self.root}/{table}/{BATCH}{last + 1:09d}")

    def read(self, table: str) -> DataFrame | None:
        """The latest row of each key that is not deleted; None before the first batch."""
        if not (paths := self.batches(table)):
            return None
        # one scan of all batches; a column that an older batch lacks is null there
        log = self.spark.read.option("mergeSchema", "true").parquet(*paths)
        log = log.select("*", F.regexp_extract("_metadata.file_path", rf"{BATCH}(\d+)/[^/]*$", 1).cast("int").alias("seq_"))
        others = [x for x in log.columns if x not in KEYS[table] and x != "seq_"]
        latest = log.groupBy(*KEYS[table]).agg(F.max_by(F.struct(*others), "seq_").alias("r_"))
        return latest.select(*KEYS[table], "r_.*").where(~c("deleted_")).drop("deleted_")

    def compact(self, table: str) -> None:
        """One batch in place of all; the old ones go only after the new one counts."""
        old = self.batches(table)
        if (rows := self.read(table)) is not None:
            self.upsert(table, rows)
            for path in old:
                remove(self.spark, path)

    def delete(self, table: str, keys: DataFrame) -> None:
        """Hide the given keys."""
        current = self.read(table)
        if current is not None:
            self.upsert(table, current.join(keys.select(*KEYS[table]).distinct(), list(KEYS[table]), "left_semi"), deleted=True)

    def delete_where(self, table: str, condition: Column) -> None:
        """Hide all rows that meet the condition (a null condition does not)."""
        current = self.read(table)
        if current is not None:
            self.upsert(table, current.where(F.coalesce(condition, F.lit(False))), deleted=True)

    def delete_equal(self, table: str, column: str, value) -> None:
        """Hide all rows whose column equals the value; a null equals only a null."""
        self.delete_where(table, c(column).eqNullSafe(F.lit(value)))

    def duplicates(self, table: str, rows: DataFrame) -> DataFrame:
        """Keys that occur more than once."""
        return rows.groupBy(*KEYS[table]).agg(F.count("*").alias("n")).where("n > 1")


def safe_attributes(attributes: Column | str) -> Column:
    """Entries of a map whose keys may be property names."""
    return F.map_filter(attributes, lambda k, v: safe_key(k) & v.isNotNull())


def entity_rows(entities: DataFrame) -> DataFrame:
    """Entities as stored: label from the type, attributes with safe keys only."""
    return entities.withColumn("label", F.initcap("entity_type")).withColumn("attributes", safe_attributes("attributes"))


def with_metadata(edges: DataFrame) -> DataFrame:
    """Blank or missing edge metadata gets its defaults; a missing column counts as null."""
    out = edges
    for name, default in (("source_rule", "unknown.rule"), ("confidence_source", "unknown.source"), ("evidence_span", "unknown")):
        out = out.withColumn(name, blank_to(c(name) if name in edges.columns else F.lit(None).cast("string"), default))
    return out


def valid_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges with both end points present and a confidence from 0 to 1."""
    ok = edges.where(c("confidence").between(0, 1))
    return ok.join(sources.select(c(sources.columns[0]).alias(src)).distinct(), src, "left_semi").join(targets.select(c(targets.columns[0]).alias(dst)).distinct(), dst, "left_semi").select(*edges.columns)


def link_paper_entities(edges: DataFrame, papers: DataFrame, entities: DataFrame) -> DataFrame:
    """Paper-entity edges of an allowed type, with metadata."""
    return with_metadata(valid_edges(edges.where(c("rel").isin(*PAPER_RELATIONS)), papers, entities))


def citation_stubs(cites: DataFrame, papers: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Papers that citations name but the table lacks, titled by the given title or the id."""
    ends = cites.select(c("citing").alias("paper_id")).unionByName(cites.select(c("cited").alias("paper_id"))).distinct()
    new = ends.join(papers.select("paper_id"), "paper_id", "left_anti")
    if titles is not None:
        new = new.join(titles.select("paper_id", c("title").alias("t_")), "paper_id", "left")
        return new.select("paper_id", F.coalesce("t_", c("paper_id").cast("string")).alias("title"))
    return new.select("paper_id", c("paper_id").cast("string").alias("title"))


def merge_evolution(old: DataFrame, new: DataFrame) -> DataFrame:
    """Evolution edges after an upsert: a blank description or a null year keeps the old value."""
    both = new.select("cur", "prev", F.nullif(F.trim("delta"), F.lit("")).alias("delta"), "year").join(old.select("cur", "prev", c("delta").alias("d_"), c("year").alias("y_")), ["cur", "prev"], "full")
    return both.select("cur", "prev", F.coalesce("delta", "d_").alias("delta"), F.coalesce("year", "y_").alias("year"))


def index_links(left: DataFrame, right: DataFrame, ids: str) -> DataFrame:
    """(paper_id, left_id, right_id) within a paper.

    Where any left item of the paper carries indices, links follow them (out of
    range ones are dropped); else every left item links every right one.
    """
    mapped = left.groupBy("paper_id").agg(F.max(F.size(ids) > 0).alias("mapped_"))
    rows = left.join(mapped, "paper_id")
    by_index = rows.where("mapped_").select("paper_id", c("item_id").alias("left_id"), F.explode(ids).alias("seq")).join(right.select("paper_id", "seq", c("item_id").alias("right_id")), ["paper_id", "seq"])
    whole = rows.where("not mapped_").select("paper_id", c("item_id").alias("left_id")).join(right.select("paper_id", c("item_id").alias("right_id")), "paper_id")
    return by_index.select("paper_id", "left_id", "right_id").unionByName(whole.select("paper_id", "left_id", "right_id")).distinct()


def vector_points(rows: DataFrame, collection: str, kind: str, layer: str, key: str, payload: Sequence[str]) -> DataFrame:
    """Points with integer ids, the original id, and the payload with kind and layer."""
    own = ("doc_kind", "kg_layer", "_original_id")
    fields = [x for n in payload if n not in own for x in (F.lit(n), c(n).cast("string"))]
    extra = [F.lit("doc_kind"), F.lit(kind), F.lit("kg_layer"), F.lit(layer), F.lit("_original_id"), c(key).cast("string")]
    return rows.select(F.lit(collection).alias("collection"), int_id(c(key).cast("string")).alias("point_id"), F.create_map(*fields, *extra).alias("payload"), "embedding")


def save_checkpoint(store: Store, ids: DataFrame) -> None:
    store.upsert("processed", ids.select("paper_id").distinct())


def unprocessed(store: Store, records: DataFrame) -> DataFrame:
    """Records whose paper_id no checkpoint names."""
    done = store.read("processed")
    return records if done is None else records.join(done, "paper_id", "left_anti")
