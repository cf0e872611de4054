"""Sources: JSON Lines paper records, plain texts in folders, review notes, binary documents."""
from __future__ import annotations

import ast
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import clean_markdown, utrim

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "title", "authors", "abstract", "content", "context", "content_meta", "conference", "year", "pdf_url", "source_url", "related_notes")])
TOC = "struct<table_of_contents:array<struct<title:string,heading_level:int,page_id:int>>>"
c = F.col


def records(spark: SparkSession, path: str, limit: int | None = None, skip: DataFrame | None = None, stream: bool = False) -> DataFrame:
    """Rows of a JSON Lines file or folder, blank and malformed lines left out, ids in ``skip`` left out, at most ``limit``."""
    schema = T.StructType([*RECORD.fields, T.StructField("_corrupt", T.StringType())])
    reader = (spark.readStream if stream else spark.read).schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    rows = reader.json(path)
    # the corrupt column alone cannot be read from the file, so another one goes along
    rows = rows.where(c("_corrupt").isNull() & (c("id").isNotNull() | c("title").isNotNull() | c("content").isNotNull())).drop("_corrupt")
    if skip is not None:
        rows = rows.join(skip.select(skip.columns[0]).withColumnRenamed(skip.columns[0], "id"), "id", "left_anti")
    return rows if limit is None else rows.limit(limit)


def author_list(authors: Column | str) -> Column:
    """A JSON array or a comma list of names as an array of trimmed names."""
    text = c(authors) if isinstance(authors, str) else authors
    parts = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.split(text, ","))
    return F.coalesce(F.filter(F.transform(parts, utrim), lambda a: a != ""), F.array().cast("array<string>"))


def normalised(rows: DataFrame) -> DataFrame:
    """Records with typed fields: authors array, integer year, table of contents, cleaned content."""
    content = F.coalesce(F.nullif("content", F.lit("")), "context", F.lit(""))
    return rows.select(
        "id", "title", author_list("authors").alias("authors"), "abstract", clean_markdown(content).alias("content"), F.from_json("content_meta", TOC)["table_of_contents"].alias("toc"),
        c("conference").alias("venue"), utrim("year").try_cast("int").alias("year"), "pdf_url", "source_url", "related_notes",
    )


def paper_sources(rows: DataFrame) -> DataFrame:
    """Records as ingest input."""
    return rows.select(c("id").alias("paper_id"), "title", "authors", "year", "venue", "abstract", c("content").alias("text"), "toc", "related_notes")


def decode_notes(raw: str | None) -> list[dict]:
    """Review notes from JSON or a Python literal; only dicts are kept."""
    if not raw or not raw.strip():
        return []
    for read in (json.loads, ast.literal_eval):
        try:
            value = read(raw)
            break
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
    else:
        return []
    return [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]


def notes(rows: DataFrame) -> DataFrame:
    """(paper_id, note_id, content) of the related notes of records; values that are no strings are JSON text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for paper, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for x in decode_notes(raw):
                    body = x.get("content") if isinstance(x.get("content"), dict) else {}
                    out.append((paper, str(x.get("id", "")), [(str(k), v if isinstance(v, str) else json.dumps(v)) for k, v in body.items() if v is not None]))
            if out:
                types = (pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], ["paper_id", "note_id", "content"])

    return rows.select("paper_id", "related_notes").mapInArrow(run, "paper_id string, note_id string, content map<string,string>")


def text_files(spark: SparkSession, path: str, extension: str = "txt") -> DataFrame:
    """(path, title, text) of the files of a folder with an extension, or of one file; the title is the file's stem."""
    rows = spark.read.option("pathGlobFilter", f"*.{extension}").text(path, wholetext=True).select(F.input_file_name().alias("path"), c("value").alias("text"))
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select("path", F.regexp_replace(F.url_decode(name), r"\.[^.]+\z", "").alias("title"), "text").orderBy("path")


def one_file(spark: SparkSession, path: str, paper_id: str | None = None, title: str | None = None, year: int | None = None, venue: str | None = None) -> DataFrame:
    """One file as a record (paper_id, title, year, venue, text); without an id or title the file's stem stands for them."""
    stem = F.regexp_replace(F.element_at(F.split(F.url_decode(F.input_file_name()), "/"), -1), r"\.[^.]+\z", "")
    given = lambda x, other: F.coalesce(F.lit(x).cast("string"), other)
    return spark.read.text(path, wholetext=True).select(
        given(paper_id, stem).alias("paper_id"), given(title, stem).alias("title"), F.lit(year).cast("int").alias("year"), F.lit(venue).cast("string").alias("venue"), c("value").alias("text")
    )


def converted(spark: SparkSession, path: str, convert: Callable[[bytes], str], extension: str = "pdf") -> DataFrame:
    """(path, text) of binary documents by a converter; a document on which it fails has an empty text and its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for raw in batch.column("content"):
                try:
                    texts.append(convert(raw.as_py()))
                    errors.append(None)
                except Exception as e:  # one bad document does not end the scan
                    texts.append("")
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "text", "error"])

    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").load(path)
    return rows.select("path", "content").mapInArrow(run, "path string, text string, error string")


def render(template: str, **values: str) -> str:
    """A template with {{ name }} places filled; unknown places stay."""
    import re

    return re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: str(values.get(m[1], m[0])), template)


def rendered(df: DataFrame, template: str, columns: tuple[str, ...], out: str = "prompt") -> DataFrame:
    """df with the template filled from columns, row by row, in the engine."""
    text = F.lit(template)
    for name in columns:
        place = F.regexp_extract(F.lit(template), rf"(\{{\{{\s*{name}\s*\}}\}})", 1)
        text = F.when(place != "", F.replace(text, place, c(name).cast("string"))).otherwise(text)
    return df.withColumn(out, text)


def lookup(papers: DataFrame, ids: list) -> DataFrame:
    """Papers by id."""
    return papers.where(c("paper_id").isin(ids) if ids else F.lit(False))


def first_names(nodes: DataFrame, key: str = "entity_id", name: str = "name") -> DataFrame:
    """Nodes with names of two or more characters, the first by id of each lower-cased name."""
    return nodes.where(F.length(name) >= 2).groupBy(F.lower(name).alias("low")).agg(F.min_by(F.struct(*nodes.columns), key).alias("n")).select("n.*")
