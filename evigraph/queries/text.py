"""Text, id, score, parsing and source operators over the test tables, each with the same query in SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as X
from ..operators import parse, store
from ..projection import tables
from ..sources import records as R
from ..streaming import ingest as S

QUERIES: dict = {}
ORACLES: dict = {}
c = F.col


def query(sql: str | None = None):
    """Register a function (tables) -> DataFrame under its name, with its SQL if there is one."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


STOP = "(" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + ")"
PLAIN = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
KEYS = f"list_distinct(list_filter(string_split({PLAIN}, ' '), lambda t: length(t) > 3 AND t NOT IN {STOP}))"


@query("SELECT p_partkey, substr(sha256(lower(trim(concat('  ', p_name, ' ')))), 1, 16) AS h FROM part")
def str01_hash_text(t):
    return t["part"].select("p_partkey", X.hash_text(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("h"))


@query("SELECT p_partkey, CAST(concat('0x', substr(sha256(concat(p_name, p_partkey)), 1, 15)) AS BIGINT) AS id FROM part")
def str02_int_id(t):
    return t["part"].select("p_partkey", X.int_id(F.concat("p_name", c("p_partkey").cast("string"))).alias("id"))


@query("SELECT doc_id, substr(sha256(text), 1, 24) AS k FROM documents")
def str03_cache_key(t):
    return t["documents"].select("doc_id", X.cache_key("text").alias("k"))


NORM = "trim(regexp_replace(replace(translate(lower(trim({0})), '–—‒''’`', '---'), '-', ' '), '\\s+', ' ', 'g'))"
NAME = "concat(' The ', p_brand, '’s–', p_name, 's')"


@query(f"SELECT p_partkey, CASE WHEN length(n) > 3 AND right(n, 1) = 's' AND right(n, 2) <> 'ss' THEN left(n, length(n) - 1) ELSE n END AS norm FROM (SELECT p_partkey, {NORM.format(NAME)} AS n FROM part) x")
def str04_entity_name(t):
    return t["part"].select("p_partkey", X.entity_name(F.concat(F.lit(" The "), "p_brand", F.lit("’s–"), "p_name", F.lit("s"))).alias("norm"))


@query("SELECT p_partkey, concat(lower(p_type), '_', substr(sha256(concat(lower(p_type), ':', CASE WHEN right(p_name, 1) = 's' THEN left(p_name, length(p_name) - 1) ELSE p_name END)), 1, 16)) AS id FROM part")
def str05_entity_id(t):
    return t["part"].select("p_partkey", X.entity_id("p_type", "p_name").alias("id"))


@query(f"SELECT doc_id, {PLAIN.format('text')} AS plain FROM documents")
def str06_plain_text(t):
    return t["documents"].select("doc_id", X.plain("text").alias("plain"))


@query(f"SELECT doc_id, len(k) AS n, sha256(array_to_string(list_sort(k), ' ')) AS h FROM (SELECT doc_id, {KEYS.format('text')} AS k FROM documents) x")
def str07_keywords(t):
    own = t["documents"].select("doc_id", F.array_sort(X.keywords("text")).alias("k"))
    return own.select("doc_id", F.size("k").cast("long").alias("n"), F.sha2(F.array_join("k", " "), 256).alias("h"))


@query(f"""SELECT p_partkey, l_orderkey, l_linenumber, CASE WHEN contains({PLAIN.format("t")}, {PLAIN.format("p_name")}) THEN 0.95::DOUBLE WHEN len(k) = 0 THEN 0 WHEN n / len(k) >= 0.66 THEN 0.85 WHEN n / len(k) >= 0.4 THEN 0.72 WHEN long THEN 0.62 ELSE 0 END AS confidence
FROM (SELECT *, len(list_intersect(k, {KEYS.format("t")})) AS n, len(list_filter(list_intersect(k, {KEYS.format("t")}), lambda w: length(w) >= 6)) > 0 AS long FROM
(SELECT p.p_partkey, l_orderkey, l_linenumber, p.p_name, concat('our ', q.p_name, ' improves results') AS t, {KEYS.format("p.p_name")} AS k FROM lineitem JOIN part p ON p.p_partkey = l_partkey JOIN part q ON q.p_partkey = (l_partkey * 7) % 100) x) y""")
def str08_method_claim(t):
    other = t["part"].select(c("p_partkey").alias("q"), F.concat(F.lit("our "), "p_name", F.lit(" improves results")).alias("t"))
    rows = t["lineitem"].join(t["part"], c("p_partkey") == c("l_partkey")).join(other, c("q") == (c("l_partkey") * 7) % 100)
    return rows.select("p_partkey", "l_orderkey", "l_linenumber", X.method_claim_confidence("p_name", "t").alias("confidence"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0.95::DOUBLE WHEN p_size % 3 = 1 THEN 0.88 ELSE 0.0 END AS confidence FROM part")
def str09_dataset_evidence(t):
    names = F.when(c("p_size") % 3 == 0, F.array(F.lit("zz"), F.upper("p_name"))).when(c("p_size") % 3 == 1, F.array(F.concat(F.lit("the "), "p_name", F.lit(" benchmark")))).otherwise(F.array(F.lit("qqqq")))
    return t["part"].select("p_partkey", X.dataset_evidence_confidence("p_name", names).alias("confidence"))


@query("SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM conversations")
def str10_collapse(t):
    return t["conversations"].select("conv_id", "turn", X.collapsed("text").alias("t"))


@query("""SELECT p_partkey, round(CASE WHEN contains(a, b) OR contains(b, a) THEN 1.0 ELSE len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / greatest(len(string_split(a, ' ')), len(string_split(b, ' '))) END, 6) AS sim
FROM (SELECT p_partkey, lower(p_name) AS a, lower(concat(split_part(p_name, ' ', 1), ' ', p_type)) AS b FROM part) x""")
def str11_title_similarity(t):
    other = F.concat(F.split("p_name", " ")[0], F.lit(" "), "p_type")
    return t["part"].select("p_partkey", F.round(X.title_similarity("p_name", other), 6).alias("sim"))


@query("SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS INTEGER) AS rating FROM orders")
def str12_leading_int(t):
    return t["orders"].select("o_orderkey", X.leading_int("o_orderpriority").alias("rating"))


@query("SELECT n_nationkey, coalesce(nullif(trim(CASE WHEN n_nationkey % 2 = 0 THEN '  ' END), ''), n_name) AS f FROM nation")
def str13_first_filled(t):
    return t["nation"].select("n_nationkey", X.first_filled(F.when(c("n_nationkey") % 2 == 0, "  "), "n_name").alias("f"))


@query("SELECT doc_id, CAST(len(string_split_regex(text, '[.!?]\\s+')) AS BIGINT) AS n_upper_bound, length(left(text, 200)) AS n_cut FROM documents")
def str18_truncate(t):
    return t["documents"].select("doc_id", F.size(F.split("text", r"[.!?]\s+")).cast("long").alias("n_upper_bound"), F.length(X.truncated("text", 200)).cast("long").alias("n_cut"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber AS first, CAST(trunc(l_quantity) AS INTEGER) AS last FROM lineitem")
def str19_line_ranges(t):
    first, last = X.line_range(F.concat(F.lit("line "), c("l_linenumber").cast("string"), F.lit("-"), c("l_quantity").cast("int").cast("string")))
    return t["lineitem"].select("l_orderkey", "l_linenumber", first.alias("first"), last.alias("last"))


@query("SELECT p_partkey, regexp_matches(p_name, '^[A-Za-z_][A-Za-z0-9_]*$') AS name_ok, regexp_matches(lower(p_type), '^[A-Za-z_][A-Za-z0-9_]*$') AS type_ok FROM part")
def str20_safe_key(t):
    return t["part"].select("p_partkey", X.safe_key("p_name").alias("name_ok"), X.safe_key(F.lower("p_type")).alias("type_ok"))


@query("SELECT doc_id, CAST(nullif(regexp_extract(text, '\\b((?:19|20)\\d{2})\\b', 1), '') AS INTEGER) AS year FROM documents")
def dt01_year_of(t):
    return t["documents"].select("doc_id", X.year_of("text").alias("year"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 5) AS score FROM embeddings")
def mth01_cosine(t):
    first = t["embeddings"].where("vec_id = 0").select(c("embedding").alias("q")).limit(1)
    return t["embeddings"].join(F.broadcast(first), F.lit(True)).select("vec_id", F.round(X.cosine("embedding", "q"), 5).alias("score"))


@query("SELECT o_orderkey, round(least(0.95, 0.35 + 0.12 * (CASE WHEN o_orderkey % 10 = 0 THEN 0.5 ELSE o_orderkey % 10 / 10.0 END) + 0.08 * (CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE o_orderkey % 4 END)), 6)::DOUBLE AS score FROM orders")
def mth02_evolution_score(t):
    return t["orders"].select("o_orderkey", F.round(X.evolution_score(c("o_orderkey") % 10 / 10.0, (c("o_orderkey") % 4).cast("int")), 6).alias("score"))


@query("SELECT l_orderkey, l_linenumber, round(least(0.9, 0.4 + 0.5 * l_discount * 10), 6) AS tree, round(least(0.95, 0.8 * least(0.9, 0.4 + 0.5 * l_discount * 10) + 0.15), 6) AS coupled, round(least(1.0, l_discount + 0.05 * (l_linenumber - 1)), 6) AS fused, greatest(l_tax - 0.04, 0) AS clipped FROM lineitem")
def mth03_path_scores(t):
    tree = X.tree_score(c("l_discount") * 10)
    return t["lineitem"].select(
        "l_orderkey", "l_linenumber", F.round(tree, 6).alias("tree"), F.round(X.coupled_score(tree), 6).alias("coupled"), F.round(X.fused_score("l_discount", "l_linenumber"), 6).alias("fused"), F.greatest(c("l_tax") - 0.04, F.lit(0.0)).alias("clipped")
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def jsn05_json_fields(t):
    return t["events"].select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, CAST(length(text) - length(string_split(text, chr(10))[-1]) AS BIGINT) AS last_start FROM documents")
def txt18_line_starts(t):
    return parse.lines(t["documents"]).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max("start").alias("last_start"))


@query("SELECT doc_id, 'full_text' AS section, text AS content FROM documents")
def txt01_sections(t):
    return parse.sections(t["documents"])


@query("SELECT doc_id, title FROM (SELECT doc_id, coalesce(list_filter(list_transform(string_split(trim(text), chr(10))[1:10], lambda x: trim(regexp_replace(trim(x), '^#+', ''))), lambda x: length(x) > 10 AND NOT starts_with(x, 'Abstract'))[1], '') AS title FROM documents) x")
def txt10_title(t):
    return t["documents"].select("doc_id", parse.title("text").alias("title"))


@query("SELECT page_id, trim(regexp_extract(html, '<h1>(.*?)</h1>', 1)) AS title, CAST(1 AS BIGINT) AS level FROM pages")
def txt02_page_headings(t):
    md = t["pages"].select("page_id", F.concat(F.lit("# "), F.regexp_extract("html", "<h1>(.*?)</h1>", 1), F.lit("\ntext")).alias("text"))
    return parse.markdown_headings(md, "page_id").select("page_id", "title", c("heading_level").cast("long").alias("level"))


@query()
def txt03_heading_tree(t):
    titles = ["1 Introduction", "1.1 Background", "1.1.1 Detail", "ABSTRACT", "Notes", "2 Method", "2.1 Setup"]
    entries = t["orders"].join(t["orders"].sparkSession.createDataFrame(list(enumerate(titles)), "seq int, title string").hint("broadcast"), F.lit(True))
    tree = parse.heading_tree(entries.select(c("o_orderkey").alias("doc_id"), "seq", "title", F.lit(None).cast("int").alias("heading_level")))
    return tree.groupBy("title", "heading_level", "parent_seq").agg(F.count("*").alias("n"))


ORACLES["txt03_heading_tree"] = """SELECT title, heading_level, parent_seq, n FROM (VALUES ('1 Introduction', 1, NULL), ('1.1 Background', 2, 0), ('1.1.1 Detail', 3, 1), ('ABSTRACT', 1, NULL), ('Notes', 1, NULL), ('2 Method', 1, NULL), ('2.1 Setup', 2, 5)) v(title, heading_level, parent_seq), (SELECT count(*) AS n FROM orders) o"""


@query("SELECT o_orderkey, CAST(2 AS BIGINT) AS n, concat('Figure ', o_orderkey) AS first_ref, concat('caption of ', o_orderpriority) AS first_caption FROM orders")
def txt08_figures(t):
    text = F.concat(F.lit("see Figure "), c("o_orderkey").cast("string"), F.lit(": caption of "), "o_orderpriority", F.lit("\nfig. 2. other"))
    own = t["orders"].select("o_orderkey", parse.figures(text).alias("f"))
    return own.select("o_orderkey", F.size("f").cast("long").alias("n"), c("f")[0]["ref_id"].alias("first_ref"), c("f")[0]["caption"].alias("first_caption"))


@query("SELECT o_orderkey, concat('On ', o_orderpriority, ' things') AS title, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(2 AS BIGINT) AS n_authors FROM orders")
def txt09_references(t):
    entry = F.concat(F.lit("Intro\n# References\n[1] A. Tiny\n[2] Ann Lee, Bo Ray. \"On "), "o_orderpriority", F.lit(' things". Venue, '), F.year("o_orderdate").cast("string"), F.lit(".\n"))
    own = t["orders"].select("o_orderkey", F.filter(parse.references(entry), lambda r: r["title"].startswith("On ")).alias("r"))
    return own.select("o_orderkey", c("r")[0]["title"].alias("title"), c("r")[0]["year"].alias("year"), F.size(c("r")[0]["authors"]).cast("long").alias("n_authors"))


@query("SELECT o_orderkey AS doc_id, 'name, score' AS headers, CAST(1 AS BIGINT) AS n_rows, o_orderpriority AS cell FROM orders")
def txt07_tables(t):
    text = F.concat(F.lit("Table 1: results\n| name | score |\n|---|---|\n| "), "o_orderpriority", F.lit(" | 5 |\nend"))
    own = parse.tables(t["orders"].select(c("o_orderkey").alias("doc_id"), text.alias("text")))
    return own.select("doc_id", F.array_join("headers", ", ").alias("headers"), F.size("rows").cast("long").alias("n_rows"), c("rows")[0][0].alias("cell"))


@query("SELECT conv_id, turn, CAST(i - 1 AS BIGINT) AS paragraph_idx, trim(p) AS paragraph, CASE WHEN i = 1 THEN role ELSE 'BACKGROUND' END AS role FROM (SELECT *, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM (SELECT conv_id, turn, role, list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(x) <> '') AS ps FROM conversations) a) b")
def txt13_zoning(t):
    rows = t["conversations"].withColumn("key", F.struct("conv_id", "turn"))
    own = parse.zoned(rows, F.array("role"), "key")
    return own.select("key.conv_id", "key.turn", c("paragraph_idx").cast("long").alias("paragraph_idx"), "paragraph", "role")


@query("SELECT conv_id, turn, CASE WHEN contains(text, chr(10)) THEN string_split(text, chr(10))[1] ELSE text END AS first_line FROM conversations")
def txt12_line_ranges(t):
    ranges = F.array(F.struct(F.lit("head").alias("section"), F.lit(1).alias("first"), F.lit(1).alias("last")))
    own = t["conversations"].select("conv_id", "turn", parse.split_by_ranges("text", ranges).alias("r"))
    return own.select("conv_id", "turn", F.coalesce(F.get("r", F.lit(0))["content"], F.lit("")).alias("first_line"))


@query("SELECT c_custkey, c_name AS first_author, CAST(2 AS BIGINT) AS n_authors, CAST(CASE WHEN c_custkey % 2 = 0 THEN 2000 + c_custkey % 20 END AS INTEGER) AS year FROM customer")
def src02_records(t):
    authors = F.when(c("c_custkey") % 3 == 0, F.to_json(F.array("c_name", F.lit("Bo Ray")))).otherwise(F.concat("c_name", F.lit(" , Bo Ray, ")))
    year = F.when(c("c_custkey") % 2 == 0, (2000 + c("c_custkey") % 20).cast("string")).otherwise("n/a")
    raw = t["customer"].select(c("c_custkey").cast("string").alias("id"), c("c_name").alias("title"), authors.alias("authors"), F.lit("").alias("abstract"), F.lit("x").alias("content"), F.lit("").alias("context"), F.lit(None).cast("string").alias("content_meta"), F.lit("v").alias("conference"), year.alias("year"), F.lit("").alias("pdf_url"), F.lit("").alias("source_url"), F.lit("").alias("related_notes"))
    own = R.normalised(raw)
    return own.select(c("id").cast("long").alias("c_custkey"), c("authors")[0].alias("first_author"), F.size("authors").cast("long").alias("n_authors"), "year")


@query("SELECT n_nationkey, concat('# ', n_name) AS clean FROM nation")
def src03_clean_markdown(t):
    return t["nation"].select("n_nationkey", X.clean_markdown(F.concat(F.lit('## <span id="p">'), "n_name", F.lit("</SPAN>"))).alias("clean"))


@query("SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS rn FROM part) x WHERE rn = 1")
def src09_first_names(t):
    return R.first_names(t["part"], "p_partkey", "p_name").select("p_partkey", "p_name")


@query("SELECT p_partkey, concat('Find ', p_name, ' in {{ other }}') AS prompt FROM part")
def src13_prompts(t):
    return R.rendered(t["part"], "Find {{ p_name }} in {{ other }}", ("p_name",)).select("p_partkey", "prompt")


@query("SELECT o_custkey, min(o_orderkey) AS first_order, count(*) AS n FROM orders GROUP BY 1")
def str17_lookup(t):
    return t["orders"].groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, coalesce(nullif(trim(CASE WHEN l_linenumber % 2 = 0 THEN ' ' ELSE l_shipmode END), ''), 'unknown.rule') AS source_rule FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS l_shipmode FROM lineitem) x")
def snk04_metadata(t):
    rule = F.when(c("l_linenumber") % 2 == 0, " ").otherwise(c("l_returnflag"))
    return store.with_metadata(t["lineitem"].select("l_orderkey", "l_linenumber", rule.alias("source_rule"))).select("l_orderkey", "l_linenumber", "source_rule")


@query("""SELECT paper_id, left_id, right_id FROM (SELECT l_orderkey AS paper_id, max(l_linenumber) <= 2 AS small FROM lineitem GROUP BY 1) m JOIN (SELECT DISTINCT l_orderkey, l_linenumber AS left_id FROM lineitem WHERE l_linenumber <= 2) a ON a.l_orderkey = paper_id JOIN (SELECT DISTINCT l_orderkey, l_linenumber AS right_id FROM lineitem WHERE l_linenumber > 2) b ON b.l_orderkey = paper_id WHERE paper_id % 2 = 0 OR right_id = left_id + 2""")
def snk09_index_links(t):
    own = t["lineitem"].select(c("l_orderkey").alias("paper_id"), c("l_linenumber").alias("item_id")).distinct()
    ids = F.when(c("paper_id") % 2 == 1, F.array(c("item_id"), F.lit(99))).otherwise(F.array().cast("array<int>"))
    left = own.where("item_id <= 2").withColumn("ids", ids)
    right = own.where("item_id > 2").withColumn("seq", c("item_id") - 2)
    return store.index_links(left, right, "ids")


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stm01_event_windows(t):
    return S.windowed(t["events"]).select(c("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) a) b GROUP BY user_id, s""")
def stm02_sessions(t):
    return S.sessions(t["events"]).select("user_id", c("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT count(*) FILTER (o_orderstatus <> 'P') AS success, count(*) FILTER (o_orderstatus = 'P') AS failed, CAST(sum(o_custkey) AS BIGINT) AS o_custkey FROM orders")
def agg15_batch_totals(t):
    return S.batch_totals(t["orders"].withColumn("ok", c("o_orderstatus") != "P"), ["o_custkey"])


@query("SELECT conv_id, turn, role, CAST(turn - coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS BIGINT) AS step FROM conversations")
def win08_lead_lag(t):
    order = Window.partitionBy("conv_id").orderBy("turn")
    return t["conversations"].select("conv_id", "turn", "role", (c("turn") - F.coalesce(F.lag("turn").over(order), F.lit(-1))).alias("step"))
