"""Document structure: sections, headings and their tree, tables, figures, references, titles, reviews.

Line-based operators explode a text into its lines and use windows within one
document, so a task never needs more than one document's lines at a time.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import collapsed, first_filled, leading_int, points, title_similarity, utrim, year_of

#: Section keys and the headings that stand for them, in order of priority (fixed values).
SECTION_HEADINGS = {
    "abstract": r"abstract",
    "introduction": r"introduction",
    "related_work": r"related\s*work|background|literature\s*review|prior\s*work",
    "method": r"method(?:ology)?|approach|proposed\s*method|our\s*(?:method|approach)|model|framework",
    "experiments": r"experiment(?:s|al)?(?:\s*(?:results|setup|and\s*results))?|evaluation|results|empirical\s*(?:study|evaluation|results)",
    "limitation": r"limitations?|discussion|broader\s*impact|ethics",
    "conclusion": r"conclusions?(?:\s*(?:and\s*future\s*work)?)?|summary|future\s*work",
}
#: A word that every such heading holds, to pass over other lines quickly.
HEADING_WORD = r"(?i)abstract|introduction|related|background|literature|prior|method|approach|model|framework|experiment|evaluation|results|empirical|limitation|discussion|impact|ethics|conclusion|summary|future"
MAX_LEVEL = 6
c = F.col


def section_key(heading: Column | str) -> Column:
    """The key that a heading stands for, without marks and numbering; null for none."""
    text = c(heading) if isinstance(heading, str) else heading
    clean = utrim(F.regexp_replace(F.regexp_replace(utrim(text), r"^#+\s*", ""), r"^\d+\.?\s*", ""))
    out = F.lit(None).cast("string")
    for key, pattern in reversed(SECTION_HEADINGS.items()):
        out = F.when(clean.rlike(rf"(?i)\A(?:{pattern})\z"), F.lit(key)).otherwise(out)
    return F.when(text.rlike(HEADING_WORD), out)


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no from 0, start offset in code points, line)."""
    rows = docs.select(key, F.posexplode(F.split(F.coalesce(c(text), F.lit("")), "\n")).alias("line_no", "line"))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long"))


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section, content): text between recognised headings, the last of equal keys; a text without any is full_text."""
    order = Window.partitionBy(key).orderBy("line_no")
    marked = lines(docs, key, text).withColumn("head", section_key("line"))
    marked = marked.withColumn("part", F.count("head").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = marked.groupBy(key, "part").agg(F.max("head").alias("section"), F.array_sort(F.collect_list(F.when(c("head").isNull(), F.struct("line_no", "line")))).alias("l"))
    own = own.where("part > 0").select(key, "section", "part", utrim(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("content")).where("content <> ''")
    last = own.groupBy(key, "section").agg(F.max_by("content", "part").alias("content"))
    whole = docs.join(last.select(key).distinct(), key, "left_anti").select(key, F.lit("full_text").alias("section"), c(text).alias("content"))
    return last.unionByName(whole)


def markdown_headings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, seq, title, heading_level) of lines that begin with one to six number signs."""
    pattern = r"^(#{1,6})\s+(.+)"
    rows = lines(docs, key, text).where(c("line").rlike(pattern))
    return rows.select(key, c("line_no").alias("seq"), utrim(F.regexp_extract("line", pattern, 2)).alias("title"), F.length(F.regexp_extract("line", pattern, 1)).alias("heading_level"))


def enrich_levels(entries: DataFrame, headings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Entries whose missing level is taken from the last heading of equal title; a level that is there stays."""
    known = headings.groupBy(key, collapsed("title").alias("t_")).agg(F.max_by("heading_level", "seq").alias("l_"))
    joined = entries.withColumn("t_", collapsed("title")).join(known, [key, "t_"], "left")
    return joined.withColumn("heading_level", F.coalesce("heading_level", "l_")).drop("t_", "l_")


def heading_levels(entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """Entries with a level each: given, by numbering, 1 for capitals, else that of the entry before."""
    title = utrim(F.replace(c("title"), F.lit("\n"), F.lit(" ")))
    number = F.regexp_extract(title, r"^(\d+(?:\.\d+)*)\s", 1)
    letters = F.regexp_replace(title, r"[^a-zA-Z\s]", "")
    capitals = (F.length(letters) > 3) & (letters == F.upper(letters))
    level = F.coalesce(c("heading_level"), F.when(number != "", F.size(F.split(number, r"\."))), F.when(capitals, 1))
    rows = entries.withColumn("title", title).where("title <> ''").withColumn("level_", level)
    so_far = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("heading_level", F.coalesce(F.last("level_", ignorenulls=True).over(so_far), F.lit(1))).drop("level_")


def heading_tree(entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """Entries with the seq of their parent: the nearest one before of a smaller level."""
    rows = heading_levels(entries, key)
    before = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last_of = [F.max(F.when(c("heading_level") == lv, c("seq"))).over(before) for lv in range(1, MAX_LEVEL)]
    rows = rows.withColumns({f"l{lv}_": x for lv, x in enumerate(last_of, 1)})
    smaller = [F.when(c("heading_level") > lv, c(f"l{lv}_")) for lv in range(1, MAX_LEVEL)]
    return rows.withColumn("parent_seq", F.greatest(*smaller)).drop(*(f"l{lv}_" for lv in range(1, MAX_LEVEL)))


def content_ends(entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """Entries with the seq at which their content ends: the next of the same or a smaller level."""
    after = Window.partitionBy(key).orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    rows = entries.withColumns({f"n{lv}_": F.min(F.when(c("heading_level") <= lv, c("seq"))).over(after) for lv in range(1, MAX_LEVEL + 1)})
    end = F.coalesce(*(F.when(c("heading_level") == lv, c(f"n{lv}_")) for lv in range(1, MAX_LEVEL + 1)))
    return rows.withColumn("end_seq", end).drop(*(f"n{lv}_" for lv in range(1, MAX_LEVEL + 1)))


def attach_content(tree: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 10_000) -> DataFrame:
    """Tree nodes with the text under the first heading whose title is similar enough, at most ``most`` characters and "..."."""
    heads = content_ends(markdown_headings(docs, key, text), key)
    pairs = tree.select(key, "seq", c("title").alias("node_title")).join(heads.select(key, c("seq").alias("at"), "title", "end_seq"), key)
    pairs = pairs.withColumn("sim", title_similarity("node_title", "title")).where("sim > 0.5")
    best = pairs.groupBy(key, "seq").agg(F.max_by(F.struct("at", "end_seq"), F.struct("sim", -c("at"))).alias("b")).select(key, "seq", "b.*")
    own = best.join(lines(docs, key, text), key).where("line_no > at and (end_seq is null or line_no < end_seq)")
    content = own.groupBy(key, "seq").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    joined = content.select(key, "seq", utrim(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("content"))
    cut = F.when(F.length("content") > most, F.concat(c("content").substr(1, most), F.lit("..."))).otherwise(c("content"))
    return tree.join(joined.select(key, "seq", cut.alias("content")), [key, "seq"], "left")


def parsed_records(rows: DataFrame, key: str = "paper_id") -> tuple[DataFrame, DataFrame]:
    """Sections and section tree of records (key, text, abstract, toc), each parsed whole.

    Sections: (key, section, content), the record's own abstract where the text has
    none. Tree: (key, seq, title, heading_level, source, parent_seq, section_key, content)
    from the text's headings where there are more than two, else from the table of
    contents with levels from equal headings, else none.
    """
    found = sections(rows, key)
    abstract = utrim("abstract")
    lacking = rows.where(F.coalesce(abstract, F.lit("")) != "").join(found.where("section = 'abstract'").select(key), key, "left_anti")
    own = found.unionByName(lacking.select(key, F.lit("abstract").alias("section"), c("abstract").alias("content")))
    heads = markdown_headings(rows, key)
    many = heads.groupBy(key).agg(F.count("*").alias("n")).where("n > 2").select(key)
    marked = heads.join(many, key, "left_semi").withColumn("source", F.lit("headings"))
    listed = rows.join(many, key, "left_anti").select(key, F.posexplode("toc").alias("seq", "e")).select(key, "seq", c("e.title").alias("title"), c("e.heading_level").alias("heading_level"))
    listed = enrich_levels(listed, heads, key).withColumn("source", F.lit("contents"))
    nodes = heading_tree(marked.unionByName(listed.select(*marked.columns)), key)
    return own, attach_content(nodes.withColumn("section_key", section_key("title")), rows, key)


def link_claims(claims: DataFrame, tree: DataFrame, key: str = "paper_id") -> DataFrame:
    """(claim_id, node_id): the first node whose key equals the claim's section, else the most similar title above 0.4.

    Names of sections are looked up by equality first; only names without such a
    node are compared with titles, each name with each title of its paper once.
    Among nodes of equal seq the largest id counts.
    """
    claims = claims.select(key, "claim_id", F.lower(utrim("source_section")).alias("s")).where(c("s").isNotNull())
    nodes = tree.where(c(key).isNotNull())
    first = F.max(F.struct((-c("seq")).alias("order"), "node_id"))
    equal = nodes.where(c("section_key").isNotNull()).groupBy(key, c("section_key").alias("s")).agg(first.alias("node"))
    exact = claims.join(equal, [key, "s"]).select(key, "claim_id", F.lit(2.0).alias("sim"), "node")
    names = claims.select(key, "s").distinct().join(equal, [key, "s"], "left_anti")
    pairs = names.join(nodes.groupBy(key, "title").agg(first.alias("node")), key).withColumn("sim", title_similarity("s", "title")).where("sim > 0.4")
    similar = pairs.groupBy(key, "s").agg(F.max(F.struct("sim", "node")).alias("b")).select(key, "s", "b.*")
    found = exact.unionByName(claims.join(similar, [key, "s"]).select(key, "claim_id", "sim", "node"))
    return found.groupBy(key, "claim_id").agg(F.max(F.struct("sim", "node")).alias("b")).select(key, "claim_id", c("b.node.node_id").alias("node_id"))


def tree_text(tree: DataFrame, key: str = "paper_id") -> DataFrame:
    """Each tree as lines "- [id] title [key]", two spaces a level."""
    indent = F.when(c("heading_level") > 1, F.concat(F.repeat(F.lit("  "), c("heading_level") - 1), F.lit("- "))).otherwise(F.lit(""))
    label = F.when(F.coalesce("section_key", F.lit("")) != "", F.concat(F.lit(" ["), c("section_key"), F.lit("]"))).otherwise(F.lit(""))
    line = F.concat(indent, F.lit("["), c("node_id").cast("string"), F.lit("] "), c("title"), label)
    return tree.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("l")).select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("tree"))


def figures(text: Column | str) -> Column:
    """Array of (ref_id, caption) of figure captions."""
    pattern = r"(?i)(?:Figure|Fig\.?)\s+(\d+)[.:]\s*([^\n]+)"
    numbers, captions = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.zip_with(numbers, captions, lambda n, t: F.struct(F.concat(F.lit("Figure "), n).alias("ref_id"), utrim(t).alias("caption")))


def references(text: Column | str) -> Column:
    """Array of (ref_key, title, year, authors) of the bibliography at the end of a text."""
    block = F.regexp_extract(text, r"(?is)(?:\A|\n)(?:#+\s*)?(?:References|Bibliography)\s*\n(.*)", 1)
    entries = F.split(block, r"\n(?:\[\d+\]|\d+\.|-)\s+")

    def one(entry: Column, i: Column) -> Column:
        e = utrim(F.regexp_replace(entry, r"<span[^>]*>|</span>", ""))
        parts = F.split(e, r"\. ", 3)
        quoted, starred = F.regexp_extract(e, r'["“”](.+?)["“”]', 1), F.regexp_extract(e, r"\*(.+?)\*", 1)
        second = F.regexp_replace(utrim(F.get(parts, 1)), r"\.+\z", "")
        title = F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(starred, F.lit("")), second, F.lit(""))
        names = F.filter(F.transform(F.split(F.split(e, r"\.")[0], ","), utrim), lambda a: a != "")
        return F.struct(F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]")).alias("ref_key"), title.alias("title"), year_of(e).alias("year"), names.alias("authors"), F.length(e).alias("n"))

    return F.when(block != "", F.filter(F.transform(entries, one), lambda r: r["n"] >= 10)).otherwise(F.filter(F.transform(F.array(F.lit("")), one), lambda r: F.lit(False)))


def title(text: Column | str) -> Column:
    """The first of the first ten lines that is long enough and no abstract heading."""
    heads = F.transform(F.slice(F.split(utrim(text), "\n"), 1, 10), lambda x: utrim(F.regexp_replace(utrim(x), r"^#+", "")))
    return F.coalesce(F.get(F.filter(heads, lambda x: (F.length(x) > 10) & ~x.startswith("Abstract")), F.lit(0)), F.lit(""))


def paragraphs(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\n"), utrim), lambda p: p != "")


def zoned(docs: DataFrame, roles: Column, key: str = "doc_id", text: str = "text", default: str = "BACKGROUND") -> DataFrame:
    """(key, paragraph_idx, paragraph, role): roles by index, the default where one is missing."""
    rows = docs.select(key, roles.alias("roles_"), F.posexplode(paragraphs(text)).alias("paragraph_idx", "paragraph"))
    return rows.select(key, "paragraph_idx", "paragraph", F.coalesce(F.get("roles_", c("paragraph_idx")), F.lit(default)).alias("role"))


def split_by_ranges(text: Column | str, ranges: Column) -> Column:
    """Parts of a text by arrays of (section, first, last) line numbers from 1; reversed ranges are swapped, others clamped."""
    rows = F.split(text, "\n")

    def one(r: Column) -> Column:
        a, b = F.least(r["first"], r["last"]), F.greatest(r["first"], r["last"])
        first, last = F.greatest(a, F.lit(1)), F.least(b, F.size(rows))
        return F.struct(r["section"].alias("section"), F.when(last >= first, utrim(F.array_join(F.slice(rows, first, F.greatest(last - first + 1, F.lit(0))), "\n"))).otherwise("").alias("content"))

    return F.filter(F.transform(ranges, one), lambda r: r["content"] != "")


def tables_in(text: str | None) -> list[dict]:
    """Pipe tables of a text: caption of the line before, header row, other rows without the ruler."""
    out: list[dict] = []
    own: list[str] = []
    caption = pending = ""
    for line in [*(text or "").split("\n"), ""]:
        if line.startswith("|") and line.rstrip().endswith("|") and len(line.strip()) > 2:
            if not own:
                caption = pending
            own.append(line)
            continue
        if own:
            cells = [[x.strip() for x in r.strip().strip("|").split("|")] for r in own]
            out.append({"caption": caption, "headers": cells[0], "rows": [x for x, r in zip(cells[1:], own[1:]) if not re.fullmatch(r"[-:| ]+", r.strip())]})
            own = []
        found = re.match(r"\s*Table\s+\d+[.:]\s*(.+)", line)
        pending = found[1] if found else pending if not line.strip() else ""
    return out


def tables(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, table_no, caption, headers, rows) of every pipe table."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k.as_py(), i, t["caption"], t["headers"], t["rows"]) for k, x in zip(batch.column(0), batch.column(1)) for i, t in enumerate(tables_in(x.as_py()))]
            if rows:
                types = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], ["key", "table_no", "caption", "headers", "rows"])

    return docs.select(key, text).mapInArrow(run, f"key {kind}, table_no int, caption string, headers array<string>, rows array<array<string>>").withColumnRenamed("key", key)


#: Where weaknesses begin in a combined field, by priority (fixed values).
WEAKNESS_MARKS = (r"(?i)\n\s*weakness(?:es)?[\s:]*\n", r"(?i)\n\s*limitations?[\s:]*\n", r"(?i)\n\s*cons?[\s:]*\n", r"(?i)\bweakness(?:es)?\s*:", r"(?i)\blimitations?\s*:")
#: Field names of review notes by meaning, in order (fixed values).
SUMMARY = ("metareview:_summary,_strengths_and_weaknesses", "metareview", "summary_of_the_review", "summary_of_the_paper", "main_review", "review", "summary")
COMBINED = ("strength_and_weaknesses", "strengths_and_weaknesses", "strength_and_weakness")


def split_review(text: Column | str) -> tuple[Column, Column]:
    """Strengths and weaknesses of a combined text, cut at the first mark of highest priority."""
    text = c(text) if isinstance(text, str) else text
    good, bad = text, F.lit("")
    for pattern in reversed(WEAKNESS_MARKS):
        parts = F.split(text, pattern, 2)
        hit = F.size(parts) == 2
        good, bad = F.when(hit, utrim(parts[0])).otherwise(good), F.when(hit, utrim(parts[1])).otherwise(bad)
    return good, bad


def reviews(notes: DataFrame) -> DataFrame:
    """Structured reviews from notes (paper_id, note_id, content map<string,string>): comments, submissions and empty notes are left out."""
    get = lambda *keys: F.coalesce(first_filled(*(F.try_element_at("content", F.lit(k)) for k in keys)), F.lit(""))
    both = get(*COMBINED)
    good, bad = get("strengths", "strength"), get("weaknesses", "weakness", "limitations")
    use = (both != "") & (good == "") & (bad == "")
    split_good, split_bad = split_review(both)
    keys = F.map_keys("content")
    rows = notes.where((F.size(F.array_except(keys, F.array(F.lit("comment"), F.lit("title")))) > 0) & ~F.array_contains(keys, "paperhash") & ~F.array_contains(keys, "authorids"))
    rows = rows.select(
        "paper_id", "note_id", leading_int(get("rating", "recommendation")).alias("rating"), leading_int(get("confidence")).alias("confidence"), get("decision").alias("decision"), get(*SUMMARY).alias("summary"),
        points(F.when(use, split_good).otherwise(good)).alias("strengths"), points(F.when(use, split_bad).otherwise(bad)).alias("weaknesses"), points(get("questions", "questions_for_authors")).alias("questions"),
    ).withColumn("is_meta_review", c("decision") != "")
    return rows.where((c("summary") != "") | (F.size("strengths") > 0) | (F.size("weaknesses") > 0) | (c("decision") != ""))


def review_claims(found: DataFrame, least: int = 10) -> DataFrame:
    """Claims of reviews: a meta summary is a P1 performance claim, weaknesses are P2 robustness claims."""
    meta = found.where("is_meta_review and summary <> ''").select("paper_id", F.concat(F.lit("[Meta-review] "), c("summary")).alias("text"), F.lit("PERFORMANCE").alias("claim_type"), F.lit("P1").alias("severity"))
    weak = found.select("paper_id", F.explode("weaknesses").alias("text")).where(F.length("text") >= least)
    return meta.unionByName(weak.select("paper_id", "text", F.lit("ROBUSTNESS").alias("claim_type"), F.lit("P2").alias("severity")))


def review_evidence(found: DataFrame, least: int = 10) -> DataFrame:
    """Evidence of reviews: strengths are analyses."""
    return found.select("paper_id", F.explode("strengths").alias("result_summary")).where(F.length("result_summary") >= least).withColumn("evidence_type", F.lit("ANALYSIS"))


def first_decision(found: DataFrame) -> DataFrame:
    """The first non-empty decision of each paper, by note order."""
    return found.where("decision <> ''").groupBy("paper_id").agg(F.min_by("decision", "note_id").alias("decision"))
