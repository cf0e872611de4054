"""Model adapters: embeddings and completions behind small interfaces, with deterministic offline stand-ins."""
from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import loose_json
from ..functions.text import cache_key
from . import parse

c = F.col


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Completer(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Unit vectors from hashed words: texts that share words are near."""

    size: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = hashlib.blake2b(word.encode(), digest_size=8).digest()
                out[i, int.from_bytes(h[:4], "little") % self.size] += 1 if h[4] & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).tolist()


@dataclass(frozen=True)
class EchoCompleter:
    """Answers from a table by the first key that the prompt holds, else an empty object."""

    answers: tuple[tuple[str, str], ...] = ()

    def complete(self, prompts: list[str]) -> list[str]:
        return [next((a for k, a in self.answers if k in p), "{}") for p in prompts]


def retried(call: Callable, attempts: int = 3, first: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep):
    """The result of a call, repeated on errors with growing pauses."""
    for n in range(attempts):
        try:
            return call()
        except Exception:
            if n + 1 == attempts:
                raise
            sleep(min(most, first * 2**n))


def embedded(df: DataFrame, column: str, model: Embedder, batch: int = 32, out: str = "embedding", error: str | None = None) -> DataFrame:
    """df with the embedding of a text column; each distinct text is embedded once.

    A batch that fails for good leaves nulls, which later steps skip; ``error`` names a column for what went wrong there.
    """
    key = cache_key(column)
    texts = df.where(c(column).isNotNull()).select(key.alias("key_"), c(column).alias("t_")).dropDuplicates(["key_"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                wrong = None
                try:
                    values = retried(lambda: model.embed(part.column(1).to_pylist()))
                except Exception as e:
                    values, wrong = [None] * part.num_rows, f"{type(e).__name__}: {e}"[:500]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.list_(pa.float32())), pa.array([wrong] * part.num_rows, pa.string())], ["key_", out, error or "error_"])

    made = texts.mapInArrow(run, f"key_ string, {out} array<float>, {error or 'error_'} string")
    return df.withColumn("key_", key).join(made if error else made.drop("error_"), "key_", "left").drop("key_")


def completed(df: DataFrame, prompt: str, model: Completer, schema: str, out: str = "answer", batch: int = 16, error: str | None = None) -> DataFrame:
    """df with the model's answer to a prompt column, read tolerantly and typed by a schema; unknown fields are ignored.

    A batch that fails for good leaves empty answers; ``error`` names a column for what went wrong there.
    """
    names = [*df.columns, out, *([error] if error else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                wrong = None
                try:
                    answers = retried(lambda: model.complete(part.column(prompt).to_pylist()))
                except Exception as e:
                    answers, wrong = [""] * part.num_rows, f"{type(e).__name__}: {e}"[:500]
                own = [json.dumps(loose_json.read(a), ensure_ascii=False) for a in answers]
                more = [pa.array([wrong] * part.num_rows, pa.string())] if error else []
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.string()), *more], names)

    shape = df.withColumn(out, F.lit(""))
    shape = shape.withColumn(error, F.lit(None).cast("string")) if error else shape
    return df.mapInArrow(run, shape.schema).withColumn(out, F.from_json(out, schema))


ENTITIES = "entities array<struct<name:string,type:string,description:string>>, relations array<struct<source:string,target:string,type:string>>"
ARGUMENT = """problems array<struct<description:string,scope:string,gap_ids:array<int>>>, gaps array<struct<failure_mode:string,constraint:string,core_idea_ids:array<int>>>,
core_ideas array<struct<mechanism:string,novelty_type:string,claim_ids:array<int>>>, claims array<struct<text:string,type:string,severity:string>>"""


def in_range(ids, items):
    """Indices that point into a list."""
    return F.filter(F.coalesce(ids, F.array().cast("array<int>")), lambda i: i.between(0, F.size(items) - 1))


EVIDENCE = "evidences array<struct<type:string,result_summary:string>>, evidence_links array<struct<claim_id:int,evidence_id:int,strength:string>>"
ROLES = "roles array<string>"


@dataclass(frozen=True)
class Argument:
    """Rows of papers' arguments: nodes by (paper_id, seq), and links by the seqs of their ends."""

    paragraphs: DataFrame
    problems: DataFrame
    gaps: DataFrame
    ideas: DataFrame
    claims: DataFrame
    evidences: DataFrame
    problem_gaps: DataFrame
    gap_ideas: DataFrame
    idea_claims: DataFrame
    claim_evidences: DataFrame


def argumentation(papers: DataFrame, zoner: Completer, extractor: Completer, linker: Completer) -> Argument:
    """The argument of every paper (paper_id, text) in three passes: roles of paragraphs, nodes by schema, evidence of claims.

    Links by index that point outside their list are dropped, as are unknown strengths.
    """
    roles = completed(papers.withColumn("prompt", c("text")), "prompt", zoner, ROLES)
    zoned = parse.zoned(roles, c("answer.roles"), "paper_id")
    body = zoned.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("paragraph_idx", F.concat(F.lit("["), "role", F.lit("] "), "paragraph").alias("p")))).alias("l"))
    prompts = body.select("paper_id", F.array_join(F.transform("l", lambda x: x["p"]), "\n\n").alias("prompt"))
    nodes = completed(prompts, "prompt", extractor, ARGUMENT)
    each = lambda name: nodes.select("paper_id", F.posexplode(f"answer.{name}").alias("seq", "n")).select("paper_id", "seq", "n.*")
    claims = each("claims")
    listed = claims.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("l"))
    evidence = completed(listed.select("paper_id", F.to_json("l").alias("prompt")), "prompt", linker, EVIDENCE)
    found = evidence.select("paper_id", F.posexplode("answer.evidences").alias("seq", "n")).select("paper_id", "seq", "n.*")

    def links(name: str, ids: str, to: str, other: str) -> DataFrame:
        rows = nodes.select("paper_id", c(f"answer.{to}").alias("to"), F.posexplode(f"answer.{name}").alias("seq", "n"))
        return rows.select("paper_id", "seq", F.explode(in_range(c(f"n.{ids}"), c("to"))).alias(other)).distinct()

    pairs = evidence.select("paper_id", c("answer.evidences").alias("to"), F.inline("answer.evidence_links")).join(listed, "paper_id")
    pairs = pairs.where(c("claim_id").between(0, F.size("l") - 1) & c("evidence_id").between(0, F.size("to") - 1))
    pairs = pairs.where(F.upper("strength").isin("FULL", "PARTIAL", "REFUTED", "UNVERIFIABLE")).select("paper_id", c("claim_id").alias("seq"), c("evidence_id").alias("evidence_seq"), F.upper("strength").alias("strength")).distinct()
    return Argument(
        zoned, each("problems").drop("gap_ids"), each("gaps").drop("core_idea_ids"), each("core_ideas").drop("claim_ids"), claims, found,
        links("problems", "gap_ids", "gaps", "gap_seq"), links("gaps", "core_idea_ids", "core_ideas", "idea_seq"), links("core_ideas", "claim_ids", "claims", "claim_seq"), pairs,
    )


def persisted_links(links: DataFrame, methods: DataFrame) -> DataFrame:
    """(paper_id, cur, prev): links found with a paper of which an end, at least, is a method of that paper; ends differ."""
    own = methods.select("paper_id", "method_id").distinct()
    ends = links.where("cur <> prev").select("paper_id", "cur", "prev", F.explode(F.array("cur", "prev")).alias("method_id"))
    return ends.join(own, ["paper_id", "method_id"], "left_semi").select("paper_id", "cur", "prev").distinct()


def entities(answers: DataFrame) -> DataFrame:
    """(paper_id, seq, entity_type, name, description) of entity answers."""
    rows = answers.select("paper_id", F.posexplode("answer.entities").alias("seq", "e"))
    return rows.select("paper_id", "seq", F.upper(F.trim("e.type")).alias("entity_type"), F.trim("e.name").alias("name"), F.coalesce("e.description", F.lit("")).alias("description")).where("name <> ''")


def relations(answers: DataFrame, resolved: DataFrame) -> DataFrame:
    """(src, rel, dst) of relation answers, names resolved within the paper; unresolved ones are dropped."""
    rows = answers.select("paper_id", F.explode("answer.relations").alias("r")).select("paper_id", F.lower(F.trim("r.source")).alias("s"), F.lower(F.trim("r.target")).alias("t"), F.upper("r.type").alias("rel"))
    ids = resolved.groupBy("paper_id", F.lower(F.trim("name")).alias("n")).agg(F.min("entity_id").alias("id"))
    side = lambda col, out: ids.select("paper_id", c("n").alias(col), c("id").alias(out))
    return rows.join(side("s", "src"), ["paper_id", "s"]).join(side("t", "dst"), ["paper_id", "t"]).select("src", "rel", "dst").distinct()


def evolution_links(links: DataFrame, methods: DataFrame) -> DataFrame:
    """(cur, prev, delta): links whose names are known methods; self links and the later one of a pair of opposites are dropped."""
    ids = methods.groupBy(F.lower("method_name").alias("n")).agg(F.max("method_id").alias("id"))
    side = lambda col, out: ids.select(c("n").alias(col), c("id").alias(out))
    rows = links.select("seq", F.lower("from_method").alias("f"), F.lower("to_method").alias("t"), "delta").join(side("f", "prev"), "f").join(side("t", "cur"), "t").where("cur <> prev")
    first = rows.groupBy("cur", "prev").agg(F.min("seq").alias("seq"), F.min_by("delta", "seq").alias("delta"))
    other = first.select(c("cur").alias("prev"), c("prev").alias("cur"), c("seq").alias("other"))
    return first.join(other, ["cur", "prev"], "left").where("other is null or seq < other").select("cur", "prev", "delta")
