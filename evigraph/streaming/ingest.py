"""Incremental ingest in batch and as a stream, and event-time windows over event streams.

One function ingests a batch; the stream calls it for every micro-batch, so both
give the same tables. Records already in the paper table are skipped; a record
that cannot be used is counted as failed with its reason and marked processed.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import hash_text
from ..operators import parse
from ..operators.store import Store
from ..sources import records as R

c = F.col


@dataclass(frozen=True)
class Settings:
    """Ingest settings, from session properties with defaults."""

    files_per_batch: int = 5
    min_section: int = 50

    @staticmethod
    def of(spark: SparkSession) -> Settings:
        return Settings(int(spark.conf.get("spark.evigraph.files_per_batch", "5")), int(spark.conf.get("spark.evigraph.min_section", "50")))


def ingest(store: Store, rows: DataFrame) -> DataFrame:
    """Ingest records; the totals come back as one row (success, failed, skipped, sections)."""
    papers = R.paper_sources(R.normalised(rows)).withColumn("paper_id", F.coalesce("paper_id", hash_text("title")))
    known = store.read("paper")
    fresh = papers if known is None else papers.join(known.select("paper_id"), "paper_id", "left_anti")
    problem = F.when(c("paper_id").isNull(), "no id or title").when(F.length(F.trim("text")) == 0, "no text")
    fresh = fresh.withColumn("error", problem).persist()
    try:
        good = fresh.where("error is null")
        sections = parse.sections(good, "paper_id", "text")
        notes = R.notes(good)
        found = parse.reviews(notes)
        claims = parse.review_claims(found).withColumn("claim_id", F.concat(F.lit("claim_"), hash_text(F.concat_ws("|", "paper_id", "text"))))
        headings = parse.heading_tree(parse.markdown_headings(good, "paper_id", "text"), "paper_id")
        nodes = headings.select(
            F.concat_ws(":", "paper_id", c("seq").cast("string")).alias("node_id"), "paper_id", "seq", "title", "heading_level", F.concat_ws(":", "paper_id", c("parent_seq").cast("string")).alias("parent"),
            c("parent_seq").isNotNull().alias("has_parent"), parse.section_key("title").alias("section_key"),
        )
        # one aggregate over the source gives all counts
        whole = rows.agg(F.count("*").alias("rows"))
        totals = fresh.agg(F.count(F.when(c("error").isNull(), 1)).alias("success"), F.count("error").alias("failed")).join(whole, F.lit(True))
        totals = totals.select("success", "failed", (c("rows") - c("success") - c("failed")).alias("skipped"))
        totals = totals.join(sections.agg(F.count("*").alias("sections")), F.lit(True))
        out = rows.sparkSession.createDataFrame(totals.collect(), totals.schema)  # one row, before the tables change
        store.upsert("section", nodes.select("node_id", "paper_id", "seq", "title", "heading_level", F.when(c("has_parent"), c("parent")).alias("parent"), "section_key"))
        store.upsert("claim", claims.select("claim_id", "paper_id", "text", "claim_type", "severity"))
        store.upsert("processed", fresh.where("paper_id is not null").select("paper_id", F.coalesce("error", F.lit("")).alias("error")))
        # the paper row comes last: only then does the record count as known
        store.upsert("paper", good.select("paper_id", "title", "year", "venue", F.array_join("authors", "; ").alias("authors")))
        return out
    finally:
        fresh.unpersist()


def ingest_groups(store: Store, rows: DataFrame, size: int, skip_existing: bool = True) -> DataFrame:
    """Ingest records in groups of about ``size``, each with its own checkpoint; a row of totals for each group.

    With skip_existing records whose ids a checkpoint names are left out, so a job
    that was stopped goes on with the groups that it lacks. Groups are dealt by a
    hash of the id, so they are the same in every run.
    """
    id = F.coalesce("id", hash_text("title"))
    if skip_existing and (done := store.read("processed")) is not None:
        rows = rows.withColumn("own_id", id).join(done.select(c("paper_id").alias("own_id")), "own_id", "left_anti").drop("own_id")
    groups = max(1, -(-rows.count() // size))
    out = None
    for n in range(groups):
        own = ingest(store, rows.where(F.pmod(F.xxhash64(id), F.lit(groups)) == n)).withColumn("group", F.lit(n))
        out = own if out is None else out.unionByName(own)
    return out


def pace(done: Column, total: Column, seconds: Column) -> tuple[Column, Column]:
    """Records a minute, and the minutes that the rest takes at that rate; null before the first record."""
    rate = F.when((seconds > 0) & (done > 0), done / seconds * 60)
    return F.round(rate, 4), F.round((total - done) / rate, 4)


def progress(query, total: int | None = None) -> list[dict]:
    """For each finished batch of a streaming query: its number, records so far, records a minute, and minutes left of total."""
    out, done, seconds = [], 0, 0.0
    for p in query.recentProgress:
        done += p["numInputRows"]
        seconds += p["durationMs"].get("triggerExecution", 0) / 1000
        rate = done / seconds * 60 if seconds and done else None
        out.append({"batch": p["batchId"], "records": done, "per_minute": rate, "minutes_left": (total - done) / rate if total is not None and rate else None})
    return out


def ingest_stream(store: Store, folder: str, checkpoint: str, on_batch: Callable[[int, DataFrame], None] | None = None):
    """Ingest what is new in a folder of JSON Lines files and stop; progress is kept in the checkpoint folder."""
    spark = store.spark
    rows = R.records(spark, folder, stream=True)

    def each(batch: DataFrame, number: int) -> None:
        totals = ingest(store, batch)
        if on_batch:
            on_batch(number, totals)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, size: str = "10 minutes", slide: str | None = None, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Counts and sums by event-time window and type, with a watermark when the input is a stream."""
    rows = events.withColumn(time, c(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    own = F.window(time, size, slide) if slide else F.window(time, size)
    return rows.groupBy(own.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(c("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Sessions of each user that end after a gap."""
    rows = events.withColumn(time, c(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    return rows.groupBy("user_id", F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", c("w.start").alias("start"), "n")


def batch_totals(results: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Totals of batch results: successes, failures, and the sum of each count column."""
    return results.agg(F.count(F.when(c("ok"), 1)).alias("success"), F.count(F.when(~c("ok"), 1)).alias("failed"), *(F.sum(x).alias(x) for x in columns))
