import math

import pytest
from pyspark.sql import functions as F

from evigraph.functions import loose_json as L, text as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def lit(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_hashes(spark):
    same = {lit(spark, X.hash_text(F.lit(t))) for t in ("Hello World", "hello world", "  hello world  ", " hello world\t")}
    assert len(same) == 1 and len(same.pop()) == 16
    for t in ("", "a", "entity-1", "é"):
        assert 0 <= lit(spark, X.int_id(F.lit(t))) < 2**60
    assert len(lit(spark, X.cache_key(F.lit("a")))) == 24


@pytest.mark.parametrize("raw,want", [("  BERT–Models ", "bert model"), ("boss", "boss"), ("its", "its"), ("Graph\tNets", "graph net"), ("O'Neil’s `x`", "oneils x"), ("a—b‒c", "a—b c".replace("—", " ")), ("", "")])
def test_entity_name(spark, raw, want):
    assert lit(spark, X.entity_name(F.lit(raw))) == want


def test_plain_and_keywords(spark):
    assert lit(spark, X.plain(F.lit("  Hello   World  \n FOO  "))) == "hello world foo"
    assert lit(spark, X.keywords(F.lit("The attention based method using our data data"))) == ["attention", "method", "data"]


def test_method_claim_confidence(spark):
    conf = lambda m, t: lit(spark, X.method_claim_confidence(F.lit(m), F.lit(t)))
    assert conf("SparseFlow", "SparseFlow achieves SOTA on LRA") == 0.95
    assert conf("Sparse Attention Flow", "flow with sparse layers") == 0.85
    assert conf("Sparse Attention Flow Nets", "attention of networks") == 0.62
    assert conf("SparseFlow", "unrelated text") < 0.5 and conf("", "x") == 0


def test_dataset_evidence_confidence(spark):
    conf = lambda d, names: lit(spark, X.dataset_evidence_confidence(F.lit(d), F.array(*map(F.lit, names))))
    assert conf("ImageNet", ["imagenet"]) == 0.95 and conf("ImageNet", ["ImageNet 21k"]) == 0.88 and conf("ImageNet", ["cifar"]) == 0
    assert lit(spark, X.dataset_evidence_confidence(F.lit("x"), F.array().cast("array<string>"))) == 0


def test_points(spark):
    split = lambda t: lit(spark, X.points(F.lit(t)))
    assert split("1. one\n2. two\n3. three") == ["one", "two", "three"]
    assert split("- one\n- two\n* three") == ["one", "two", "three"]
    assert split("one\n\ntwo\n\nthree") == ["one", "two", "three"]
    assert split(" single ") == ["single"] and split("") == [] and lit(spark, X.points(F.lit(None).cast("string"))) == []


def test_small_parsers(spark):
    assert lit(spark, X.leading_int(F.lit("6: Marginally above"))) == 6 and lit(spark, X.leading_int(F.lit("none"))) is None
    assert lit(spark, F.array(*X.line_range(F.lit("line 5-20")))) == [5, 20] and lit(spark, F.array(*X.line_range(F.lit("7")))) == [7, 7]
    assert lit(spark, F.array(*X.line_range(F.lit("lines 3 to 6")))) == [3, 6]
    keys = {"name": True, "_x": True, "x123": True, "": False, " a": False, "a.b": False, "a-b": False, "1a": False, "a`b": False, "a\n": False}
    assert {k: lit(spark, X.safe_key(F.lit(k))) for k in keys} == keys
    assert [lit(spark, X.valid_cited(F.lit(t))) for t in ("abc", "12345", "abcdefgh", "abcdefg", "a b c d")] == [False, False, True, False, True]
    assert lit(spark, X.clean_markdown(F.lit('## <span id="a">T</SPAN>'))) == "# T" and lit(spark, X.clean_markdown(F.lit("### x"))) == "### x"
    assert lit(spark, X.year_of(F.lit("In 1899, 2019 and 2020"))) == 2019


def test_scores(spark):
    vec = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert math.isclose(lit(spark, X.cosine(vec(1, 1), vec(1, 0))), 2**-0.5) and lit(spark, X.cosine(vec(0, 0), vec(1, 0))) == 0
    assert math.isclose(lit(spark, X.evolution_score(F.lit(0.9), F.lit(2))), 0.618)
    assert math.isclose(lit(spark, X.tree_score(F.lit(None).cast("double"))), 0.65) and math.isclose(lit(spark, X.coupled_score(F.lit(0.65))), 0.67)
    assert math.isclose(lit(spark, X.fused_score(F.lit(0.9), F.lit(4))), 1.0)


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"a": 1}', {"a": 1}), ('x ```json\n{"a": 1}\n``` y', {"a": 1}), ('Sure: {"a": {"b": "}"}} done', {"a": {"b": "}"}}), ("[1, 2]", {"items": [1, 2]}), ("", {}), (None, {}), ("no json", {}), ("5", {}),
        ('{"a": 1, "b": [1, {"c": "cut', {"a": 1, "b": [1, {}]}), ('<think>{"x": 1}</think>{"a": 2}', {"a": 2}), ('{"a": [1, 2', {"a": [1, 2]}),
    ],
)
def test_loose_json(text, want):
    assert L.read(text) == want


def test_node_ids():
    assert L.node_ids('[{"node_id": "s1"}, {"x": 1}, 3]') == [{"node_id": "s1"}]
