r"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Texts are lower-cased (A-Z) and read as words. A window is ``n`` consecutive
words of a benchmark item; an item of fewer words is one window. Document words
inside any occurrence of a window are hit.

Scanning every window of a document is not needed: with grams of ``g`` words
looked up at every (n - g + 1)-th word, each window holds exactly one such gram.
The benchmark's grams at all positions are the hash set. A gram carries the few
words around it that a window could reach, never the text; the runs of equal
words to the left and right are measured word by word, and a run of n or more is
a verified occurrence. Texts are cut into chunks of ``chunk`` words before their
grams are taken, each with the words that reach into it, so time and memory grow
in proportion to a text's length.

The set is broadcast while the benchmark has at most ``BROADCAST_WORDS`` words;
beyond that the same join runs as a shuffle. Hits of a document are gathered by
(doc_id, hash of the text), so rows of equal id and text share their result and
rows of equal id but other text do not mix. Only DataFrame functions are used.

Defined results: a null text has no words; a very long text is scanned whole; an
empty benchmark hits nothing; items of equal words are all listed (a tie);
repeated rows get equal results; an empty table gives no rows; null item ids are
ignored in the list of items; other columns pass through, whatever they are
called.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .runtime import free_name

BROADCAST_WORDS = 2_000_000
#: What is no word, before lower-casing (a word: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after it).
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = NO_WORD.replace("[", "[^", 1)
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Params:
    n: int = 10
    gram: int = 6
    #: Words a chunk of a text: a multiple of the stride.
    chunk: int = 2000

    @property
    def stride(self) -> int:
        return self.n - self.gram + 1


def with_normal(df: DataFrame, text: str = "text", out: str = "normal_") -> DataFrame:
    """df with the words of a text, A-Z lower-cased, joined by single spaces.

    The steps are columns of their own, so that each is computed once a row.
    """
    spaced = F.trim(F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), NO_WORD, " "))
    # full lower-casing equals A-Z lower-casing where nothing but ASCII letters can change
    low = F.when(F.length("spaced_") == F.octet_length("spaced_"), F.lower("spaced_")).otherwise(F.translate("spaced_", UPPER, LOWERED))
    return df.withColumn("spaced_", spaced).withColumn(out, low).drop("spaced_")


def with_words(df: DataFrame, text: str = "text", out: str = "w") -> DataFrame:
    """df with the array of the words of a text."""
    words = F.when(F.col("normal_") == "", F.array().cast("array<string>")).otherwise(F.split("normal_", " "))
    return with_normal(df, text).withColumn(out, words).drop("normal_")


def _around(w: Column, p: Column, params: Params) -> tuple[Column, Column]:
    """The words left of position p (nearest first) and from p on, as far as one window can reach."""
    reach = params.stride - 1
    left = F.slice(w, F.greatest(p - reach, F.lit(0)) + 1, F.least(p, F.lit(reach)))
    return F.reverse(left), F.slice(w, p + 1, params.n)


def _chunks(texts: DataFrame, params: Params) -> DataFrame:
    """(doc_id, text_key, base, own, c): chunks of words with what reaches into them; base is the place of c's first word, own that of the chunk's."""
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(params.chunk))
    reach = params.stride - 1
    base = lambda s: F.greatest(s - reach, F.lit(0))
    cut = F.transform(starts, lambda s: F.struct(base(s).alias("base"), s.alias("own"), F.slice(F.col("w"), base(s) + 1, s - base(s) + params.chunk + params.n - 1).alias("c")))
    # an outer explode, as the filter that an inner one implies would compute the words once more
    rows = texts.select("doc_id", "text_key", F.explode_outer(F.when(F.size("w") > 0, cut)).alias("x"))
    return rows.select("doc_id", "text_key", "x.base", "x.own", "x.c")


def _run(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(equal, False)
    return F.when(first == 0, F.size(equal)).otherwise(first.cast("int") - 1)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))


def hits(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """Verified occurrences: doc_id, text_key, start and end (in words, end exclusive), item_id."""
    items = with_words(benchmark.select("item_id", "text")).select("item_id", "w").where("size(w) > 0")
    sizes = items.agg(F.sum(F.size("w")).alias("n"), F.collect_set(F.when(F.size("w") < params.n, F.size("w"))).alias("short")).first()
    fits = (sizes["n"] or 0) <= BROADCAST_WORDS
    chunks = _chunks(with_words(_keyed(docs)).select("doc_id", "text_key", "w"), params)

    def joined(grams: DataFrame, known: DataFrame) -> DataFrame:
        return grams.join(F.broadcast(known) if fits else known, "h")

    def taken(step: int, size: int, around) -> DataFrame:
        """(doc_id, text_key, at, h, left, right): at every step-th word of a text the hash of the next size words, and the words that around gives."""
        c = F.col("c")
        first, last = F.col("own") - F.col("base"), F.least(F.size("c") - size, F.col("own") - F.col("base") + params.chunk - 1)

        def one(p: Column) -> Column:
            left, right = around(c, p)
            return F.struct((p + F.col("base")).alias("at"), F.xxhash64(F.slice(c, p + 1, size)).alias("h"), left.alias("left"), right.alias("right"))

        rows = chunks.select("doc_id", "text_key", F.explode_outer(F.when(last >= first, F.transform(F.sequence(first, last, F.lit(step)), one))).alias("x"))
        return rows.select("doc_id", "text_key", "x.*")

    gram = lambda p: F.xxhash64(F.slice(F.col("w"), p + 1, params.gram))
    last = F.size("w") - params.gram
    known = items.where(F.size("w") >= params.n).select("item_id", "w", F.posexplode(F.transform(F.sequence(F.lit(0), last), gram)).alias("at", "h"))
    left, right = _around(F.col("w"), F.col("at"), params)
    known = known.select("h", "item_id", left.alias("item_left"), right.alias("item_right")).distinct()
    grams = taken(params.stride, params.gram, lambda c, p: _around(c, p, params))
    back, on = _run(F.col("left"), F.col("item_left")), _run(F.col("right"), F.col("item_right"))
    found = joined(grams, known).select("doc_id", "text_key", "item_id", "at", back.alias("back"), on.alias("on")).where(F.col("back") + F.col("on") >= params.n)
    found = found.select("doc_id", "text_key", (F.col("at") - F.col("back")).alias("start"), (F.col("at") + F.col("on")).alias("end"), "item_id")
    for size in sorted(sizes["short"]):  # at most n - 1 lengths
        whole = items.where(F.size("w") == size).select(F.xxhash64("w").alias("h"), "item_id", F.col("w").alias("item_w"))
        windows = taken(1, size, lambda c, p, size=size: (F.lit(0), F.slice(c, p + 1, size)))
        short = joined(windows, whole).where(F.col("right") == F.col("item_w"))
        found = found.unionByName(short.select("doc_id", "text_key", F.col("at").alias("start"), (F.col("at") + size).alias("end"), "item_id"))
    return found


def _union_size(spans: Column) -> Column:
    """How many positions the sorted spans cover together."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))

    def step(acc: Column, s: Column) -> Column:
        return F.struct((acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["to"]), F.lit(0))).alias("n"), F.greatest(acc["to"], s["end"]).alias("to"))

    return F.aggregate(F.array_sort(spans), start, step)["n"]


def _gathered(docs: DataFrame, benchmark: DataFrame, params: Params) -> DataFrame:
    """Per hit text: its spans, how many words they cover, and the items."""
    found = hits(docs, benchmark, params)
    # both lists are bounded by one text and by the benchmark
    return found.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("items"))


def _joined(docs: DataFrame, found: DataFrame, how: str) -> tuple[DataFrame, dict[str, str]]:
    """docs joined with (doc_id, text_key, ...) rows; the latter's columns go under free names, which come back as well."""
    names = {x: free_name(docs, f"{x}_") for x in ("row_key", *found.columns)}
    right = found.withColumnsRenamed({x: names[x] for x in found.columns})
    left = docs.withColumn(names["row_key"], F.xxhash64(F.col("text").cast("string")))
    # a null text has no hits, so its null key may stay unmatched
    on = left["doc_id"].eqNullSafe(right[names["doc_id"]]) & (left[names["row_key"]] == right[names["text_key"]])
    return left.join(right, on, how), names


def contamination(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    # the words that are scanned are counted, as regexp_count takes many times their time; the counts are all that goes through the join
    base = with_words(_keyed(docs)).select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"))
    found = _gathered(docs, benchmark, params).withColumnsRenamed({"doc_id": "doc_id_", "text_key": "text_key_"})
    both = base.join(found, F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("text_key") == F.col("text_key_")), "left")
    n_hit = F.coalesce(_union_size(F.col("spans")), F.lit(0).cast("long"))
    items = F.coalesce(F.array_sort("items"), F.array().cast("array<string>"))
    return both.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """docs, all columns, without the rows that hold an occurrence of a window."""
    bad = hits(docs, benchmark, params).select("doc_id", "text_key").distinct()
    return _joined(docs, bad, "left_anti")[0].select(*(F.col(f"`{x}`") for x in docs.columns))


def remove_spans(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """docs, all columns, with the hit words cut out of the texts; n_chars, where present, follows the text.

    A cut takes the hit words of a run and what stands between them; the rest of
    the text keeps its exact form.
    """
    out, names = _joined(docs, _gathered(docs, benchmark, params), "left")
    text, spans = F.col("text").cast("string"), F.col(names["spans"])
    own_name, between_name = free_name(out, "own"), free_name(out, "between")
    out = out.withColumns({own_name: F.when(spans.isNotNull(), F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), between_name: F.when(spans.isNotNull(), F.split(text, WORD, -1))})
    own, between = F.col(own_name), F.col(between_name)
    # sets of positions, so that the time does not grow with words times spans
    hit = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["end"] - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), hit)
    ends = F.array_except(hit, F.transform(hit, lambda i: i - 1))
    piece = lambda i, x: F.struct(i.alias("i"), x.alias("x"))
    pieces = F.concat(F.transform(kept, lambda i: piece(i, F.concat(F.get(own, i), F.get(between, i + 1)))), F.transform(ends, lambda i: piece(i, F.get(between, i + 1))))
    cut = F.concat(F.get(between, F.lit(0)), F.array_join(F.transform(F.array_sort(pieces), lambda p: p["x"]), ""))
    changed = {"text": F.when(spans.isNotNull(), cut).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(spans.isNotNull(), F.length(cut).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*(F.col(f"`{x}`") for x in docs.columns))


def contamination_sql(params: Params = Params()) -> str:
    """The same result in plain SQL: every window of every document against every window of every item."""
    own = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH it AS (SELECT item_id, {own} AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, least(len(w), {params.n}) AS n, array_to_string(w[i:i + least(len(w), {params.n}) - 1], ' ') AS g
            FROM it, unnest(range(1, greatest(len(w) - {params.n - 1}, 1) + 1)) t(i) WHERE len(w) > 0),
        d AS (SELECT row_number() OVER () AS rid, doc_id, {own} AS w FROM documents),
        dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM iw) ns, unnest(range(1, len(w) - n + 2)) t(i)),
        h AS (SELECT rid, i, n, item_id FROM dw JOIN iw USING (n, g)),
        hp AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT rid, i, n FROM h), unnest(range(n)) t(k) GROUP BY rid),
        hi AS (SELECT rid, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS s FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM h) GROUP BY rid)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            coalesce(s, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN hp USING (rid) LEFT JOIN hi USING (rid)"""
