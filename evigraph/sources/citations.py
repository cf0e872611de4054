"""A data source of cited papers behind a replaceable fetcher."""
from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class CitationsReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.ids = [x for x in options.get("ids", "").split(",") if x]
        self.answers = json.loads(options.get("answers", "{}"))
        self.path = options.get("path")

    def partitions(self) -> list[InputPartition]:
        if self.path:
            fs, at = pf.FileSystem.from_uri(self.path)
            files = sorted(f.path for f in fs.get_file_info(pf.FileSelector(at)) if f.path.endswith(".parquet"))
            return [InputPartition(x) for x in files] or [InputPartition(None)]
        return [InputPartition(x) for x in self.ids] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """One row a cited paper with a title; a paper without an answer has none."""
        if partition.value is None:
            return
        for citing, answer in self._stored(partition.value) if self.path else [(partition.value, self.answers.get(partition.value, []))]:
            for x in answer:
                if x.get("title"):
                    yield citing, x["title"], x.get("year"), "COMPARISON", 0.6

    def _stored(self, file: str) -> Iterator[tuple[str, list]]:
        """Ids and answers of one file of the table."""
        fs, _ = pf.FileSystem.from_uri(self.path)
        with fs.open_input_file(file) as source:
            for batch in pq.ParquetFile(source).iter_batches(1000, columns=["id", "answer"]):
                for citing, answer in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    yield citing, json.loads(answer)


class Citations(DataSource):
    """The offline stand-in of a service. Options: ids (comma list) and answers (JSON: id to list of {title, year}),
    or path, a written Parquet table (id string, answer string: a JSON list) of which each file is a partition."""

    @classmethod
    def name(cls) -> str:
        return "paper_citations"

    def schema(self) -> str:
        return "citing string, title string, year int, intent string, confidence double"

    def reader(self, schema) -> CitationsReader:
        return CitationsReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Citations)
