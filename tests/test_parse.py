from pyspark.sql import functions as F

from evigraph.operators import parse as P

PAPER = """# A Study of Sparse Flows
## Abstract
Short summary here.
## 1 Introduction
Intro text.
## 2. Related Work
Others.
# 3 Method
We do it.
## Experiments
Table 1: Scores
| Model | LRA Score | Time (ms) |
|---|---|---|
| A | 1 | 2 |
| B | 3 | 4 |
| C | 5 | 6 |
Figure 2: The curve
## Conclusion
Done.
References
[1] Ann Lee, Bo Ray. "First title". Venue, 2019.
[2] Cy Doe. Second title. Journal, 2020.
[3] Di Eve. *Third title* Book 1999."""


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_sections(spark):
    got = {r.section: r.content for r in P.sections(docs(spark, PAPER)).collect()}
    assert list(sorted(got)) == ["abstract", "conclusion", "experiments", "introduction", "method", "related_work"]
    assert got["abstract"] == "Short summary here." and got["method"] == "We do it."
    plain = P.sections(docs(spark, "just words\nand more", "Results\nfirst\nEvaluation\nsecond")).orderBy("doc_id").collect()
    assert [(r.section, r.content) for r in plain] == [("full_text", "just words\nand more"), ("experiments", "second")]


def test_tables_figures_references_title(spark):
    (t,) = P.tables(docs(spark, PAPER)).collect()
    assert t.caption == "Scores" and t.headers == ["Model", "LRA Score", "Time (ms)"] and t.rows == [["A", "1", "2"], ["B", "3", "4"], ["C", "5", "6"]]
    row = docs(spark, PAPER).select(P.figures("text").alias("f"), P.references("text").alias("r"), P.title("text").alias("t")).first()
    assert [tuple(f) for f in row.f] == [("Figure 2", "The curve")]
    assert [(r.title, r.year) for r in row.r] == [("First title", 2019), ("Second title", 2020), ("Third title", 1999)]
    assert row.r[0].authors[-2:] == ["[1] Ann Lee", "Bo Ray"] and row.t == "A Study of Sparse Flows"
    assert docs(spark, "", None).select(F.size(P.references("text")).alias("n"), P.title("text").alias("t")).collect()[0] == (0, "")


def tree(spark, *entries):
    rows = [(0, i, t, lv) for i, (t, lv) in enumerate(entries)]
    return [(r.title, r.heading_level, r.parent_seq) for r in P.heading_tree(spark.createDataFrame(rows, "doc_id long, seq int, title string, heading_level int")).orderBy("seq").collect()]


def test_heading_trees(spark):
    assert [p for _, _, p in tree(spark, ("Title", 1), ("Introduction", 2), ("Background", 3), ("Method", 2), ("Conclusion", 2))] == [None, 0, 1, 0, 0]
    numbered = tree(spark, *((t, None) for t in ("1 Introduction", "1.1 Background", "1.2 Motivation", "2 Method", "3 Conclusion")))
    assert [p for _, _, p in numbered] == [None, 0, 0, None, None]
    caps = tree(spark, ("ABSTRACT", None), ("INTRODUCTION", None), ("1.1 Subsection", None))
    assert [(lv, p) for _, lv, p in caps] == [(1, None), (1, None), (2, 1)]
    assert tree(spark, ("a", None), ("  ", 2), ("b", None)) == [("a", 1, None), ("b", 1, None)]


def test_tree_equals_a_stack(spark):
    import random

    rng = random.Random(4)
    levels = [rng.randint(1, 6) for _ in range(80)]
    stack, want = [], []
    for i, lv in enumerate(levels):
        while stack and levels[stack[-1]] >= lv:
            stack.pop()
        want.append(stack[-1] if stack else None)
        stack.append(i)
    assert [p for _, _, p in tree(spark, *((f"t{i}", lv) for i, lv in enumerate(levels)))] == want


def test_levels_from_markdown_and_content(spark):
    heads = P.markdown_headings(docs(spark, PAPER))
    toc = spark.createDataFrame([(0, 0, "Abstract", None), (0, 1, "3 Method", 3), (0, 2, "Nowhere", None)], "doc_id long, seq int, title string, heading_level int")
    got = {r.title: r.heading_level for r in P.enrich_levels(toc, heads).collect()}
    assert got == {"Abstract": 2, "3 Method": 3, "Nowhere": None}
    own = P.heading_tree(heads)
    content = {r.title: r.content for r in P.attach_content(own, docs(spark, PAPER)).collect()}
    assert content["1 Introduction"] == "Intro text." and content["Conclusion"].startswith("Done.")
    short = P.attach_content(own, docs(spark, PAPER), most=5)
    assert {r.title: r.content for r in short.collect()}["Abstract"] == "Short..."


def test_claims_to_sections_and_tree_text(spark):
    nodes = spark.createDataFrame(
        [("p", "s1", 0, "Abstract", "abstract", 1), ("p", "s2", 1, "1 Introduction", "introduction", 1), ("p", "s3", 2, "Background", "", 2), ("p", "s4", 3, "4.2 Experimental Results", None, 2)],
        "paper_id string, node_id string, seq int, title string, section_key string, heading_level int",
    )
    claims = spark.createDataFrame([("p", "c1", "abstract"), ("p", "c2", "Introduction"), ("p", "c3", "Experimental Results"), ("p", "c4", "unknown_section")], "paper_id string, claim_id string, source_section string")
    assert {r.claim_id: r.node_id for r in P.link_claims(claims, nodes).collect()} == {"c1": "s1", "c2": "s2", "c3": "s4"}
    assert P.tree_text(nodes).first().tree.split("\n")[:3] == ["[s1] Abstract [abstract]", "[s2] 1 Introduction [introduction]", "  - [s3] Background"]


def test_line_ranges(spark):
    text = "\n".join(f"l{i}" for i in range(1, 12))
    ranges = F.array(*(F.struct(F.lit(s).alias("section"), F.lit(a).alias("first"), F.lit(b).alias("last")) for s, a, b in (("a", 3, 4), ("b", 7, 6), ("c", 9, 99), ("d", 50, 60))))
    got = docs(spark, text).select(P.split_by_ranges("text", ranges).alias("r")).first().r
    assert [(r.section, r.content) for r in got] == [("a", "l3\nl4"), ("b", "l6\nl7"), ("c", "l9\nl10\nl11")]


def test_reviews(spark):
    notes = [
        ("p", "1", {"rating": "6: Marginally above", "confidence": "4", "summary": "A sum", "strengths": "1. one strong point\n2. two strong points\n3. three", "weaknesses": "- weak one is long\n- weak two is long", "questions": "q"}),
        ("p", "2", {"decision": "Accept: poster", "metareview:_summary,_strengths_and_weaknesses": "Meta text"}), ("p", "3", {"title": "re", "comment": "thanks"}), ("p", "4", {"paperhash": "x", "summary": "s"}),
        ("p", "5", {"strength_and_weaknesses": "Strengths:\n- good\nWeaknesses:\n- bad thing here"}), ("p", "6", {"rating": "3"}),
    ]
    found = P.reviews(spark.createDataFrame(notes, "paper_id string, note_id string, content map<string,string>"))
    rows = {r.note_id: r for r in found.collect()}
    assert sorted(rows) == ["1", "2", "5"] and rows["1"].rating == 6 and len(rows["1"].strengths) == 3 and rows["2"].is_meta_review
    assert rows["5"].weaknesses == ["- bad thing here"]
    claims = {(r.claim_type, r.text) for r in P.review_claims(found).collect()}
    assert ("PERFORMANCE", "[Meta-review] Meta text") in claims and ("ROBUSTNESS", "weak one is long") in claims
    assert P.review_evidence(found).count() == 3 and P.first_decision(found).first().decision == "Accept: poster"
