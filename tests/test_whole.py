"""Queries that run over every row."""
from oracle import compare, views

from evigraph.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_paper_is_asked_for(spark):
    name = "src11_citation_source"
    rows, differences = compare(QUERIES[name](spark, SF), ORACLES[name], SF)
    assert rows > 20 and not differences, differences


def test_every_document_gets_content(spark):
    name = "txt05_attached_content"
    rows, differences = compare(QUERIES[name](spark, SF), ORACLES[name], SF)
    count, cut = views(SF).execute("SELECT count(text), count(*) FILTER (length(text) > 10003) FROM documents").fetchone()
    assert rows == count and cut and not differences, (rows, count, cut, differences)
