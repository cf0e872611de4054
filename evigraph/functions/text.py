"""Scalar functions on text, ids and scores as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Words that never count as keywords (fixed values).
STOPWORDS = ("the", "a", "an", "and", "or", "to", "of", "for", "in", "on", "with", "from", "using", "based", "via", "our", "we", "is", "are")
SAFE_KEY = r"(?i)\A[a-z_][a-z0-9_]*\z"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def utrim(x: Column | str) -> Column:
    """Trim Unicode white space on both ends."""
    return F.regexp_replace(col(x), r"(?U)\A\s+|\s+\z", "")


def blank_to(x: Column | str, default: str) -> Column:
    """Trimmed text, or the default where it is null or blank."""
    return F.coalesce(F.nullif(utrim(x), F.lit("")), F.lit(default))


def hash_text(x: Column | str) -> Column:
    """16 hex digits of the SHA-256 of the trimmed, lower-cased text."""
    return F.substring(F.sha2(F.lower(utrim(x)), 256), 1, 16)


def int_id(x: Column | str) -> Column:
    """A 60-bit integer from the first 15 hex digits of the SHA-256."""
    return F.conv(F.substring(F.sha2(col(x), 256), 1, 15), 16, 10).cast("long")


def cache_key(x: Column | str) -> Column:
    return F.substring(F.sha2(col(x), 256), 1, 24)


def entity_name(x: Column | str) -> Column:
    """Normalised entity name: lower case, plain dashes as spaces, no apostrophes, single spaces, no plural s."""
    flat = F.translate(F.lower(utrim(x)), "–—‒'’`", "---")
    flat = utrim(F.regexp_replace(F.replace(flat, F.lit("-"), F.lit(" ")), r"(?U)\s+", " "))
    plural = (F.length(flat) > 3) & flat.endswith("s") & ~flat.endswith("ss")
    return F.when(plural, flat.substr(F.lit(1), F.length(flat) - 1)).otherwise(flat)


def entity_id(kind: Column | str, name: Column | str) -> Column:
    low = F.lower(col(kind))
    return F.concat(low, F.lit("_"), hash_text(F.concat(low, F.lit(":"), entity_name(name))))


def cited_id(title: Column | str) -> Column:
    return F.concat(F.lit("cited_"), hash_text(title))


def plain(x: Column | str) -> Column:
    """Lower case letters and digits, everything else as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), "[^a-z0-9]+", " "))


def keywords(x: Column | str) -> Column:
    """Distinct words of more than three characters that are no stop words."""
    return F.array_distinct(F.filter(F.split(plain(x), " "), lambda t: (F.length(t) > 3) & ~t.isin(*STOPWORDS)))


def method_claim_confidence(method: Column | str, claim: Column | str) -> Column:
    """How surely a claim speaks of a method: whole name, share of its keywords, or one long keyword."""
    name, text = plain(method), plain(claim)
    own = keywords(method)
    shared = F.array_intersect(own, keywords(claim))
    ratio = F.size(shared) / F.greatest(F.size(own), F.lit(1))
    return (
        F.when((name == "") | (text == ""), 0.0).when(text.contains(name), 0.95).when(F.size(own) == 0, 0.0).when(ratio >= 0.66, 0.85).when(ratio >= 0.40, 0.72)
        .when(F.exists(shared, lambda t: F.length(t) >= 6), 0.62).otherwise(0.0)
    )


def dataset_evidence_confidence(dataset: Column | str, names: Column | str) -> Column:
    """How surely one of the names is the dataset: equal, contained, or share of keywords; the best name counts."""
    name, own = plain(dataset), keywords(dataset)

    def one(x: Column) -> Column:
        other = plain(x)
        ratio = F.size(F.array_intersect(own, keywords(x))) / F.greatest(F.size(own), F.lit(1))
        return (
            F.when((name == "") | (other == ""), 0.0).when(other == name, 0.95).when(other.contains(name) | name.contains(other), 0.88)
            .when(F.size(own) == 0, 0.0).when(ratio >= 0.66, 0.78).when(ratio >= 0.40, 0.68).otherwise(0.0)
        )

    return F.coalesce(F.array_max(F.transform(col(names), one)), F.lit(0.0))


def collapsed(x: Column | str) -> Column:
    """Lower case with white space collapsed."""
    return F.lower(utrim(F.regexp_replace(col(x), r"(?U)\s+", " ")))


def title_similarity(a: Column | str, b: Column | str) -> Column:
    """1 where one title contains the other, else shared words over the longer title's words."""
    x, y = collapsed(a), collapsed(b)
    wx, wy = F.split(x, " "), F.split(y, " ")
    return F.when((x == "") | (y == ""), 0.0).when(x.contains(y) | y.contains(x), 1.0).otherwise(F.size(F.array_intersect(wx, wy)) / F.greatest(F.size(wx), F.size(wy), F.lit(1)))


def leading_int(x: Column | str) -> Column:
    return F.regexp_extract(utrim(x), r"^(\d+)", 1).try_cast("int")


def first_filled(*fields: Column | str) -> Column:
    """The first field that is not blank, trimmed."""
    return F.coalesce(*(F.nullif(utrim(f), F.lit("")) for f in fields))


#: Where points of a text begin: numbers, bullets, and between paragraphs.
POINT_MARKS = (r"(?m)^\s*\d+[.)]\s+", r"(?m)^\s*[-*•]\s+", r"\n\s*\n")


def points(x: Column | str) -> Column:
    """A text as its points: numbered, else bulleted, else paragraphs, else whole."""
    text = utrim(x)
    parts = lambda pattern: F.filter(F.transform(F.split(text, pattern), utrim), lambda p: p != "")
    numbered, bulleted, paragraphs = (parts(p) for p in POINT_MARKS)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).when(F.size(F.split(text, POINT_MARKS[0])) > 2, numbered)
        .when(F.size(F.split(text, POINT_MARKS[1])) > 2, bulleted).when(F.size(paragraphs) > 1, paragraphs).otherwise(F.array(text))
    )


def sentences(x: Column | str) -> Column:
    return F.split(col(x), r"(?<=[.!?])\s+(?=[A-Z])")


def truncated(x: Column | str, n: int, suffix: str = "") -> Column:
    text = col(x).cast("string")
    return F.when(F.length(text) > n, F.concat(text.substr(1, n), F.lit(suffix))).otherwise(text)


def line_range(x: Column | str) -> tuple[Column, Column]:
    """First and last line number from a text such as "line 5-20" or "7"."""
    number = lambda i: F.regexp_extract(col(x), r"(\d+)(?:\s*(?:-|\bto\b|~|–|—)\s*(?:line\s*)?(\d+))?", i)
    first, last = number(1).try_cast("int"), number(2).try_cast("int")
    return first, F.coalesce(last, first)


def safe_key(x: Column | str) -> Column:
    return col(x).rlike(SAFE_KEY)


def year_of(x: Column | str) -> Column:
    return F.regexp_extract(col(x), r"\b((?:19|20)\d{2})\b", 1).try_cast("int")


def valid_cited(x: Column | str) -> Column:
    """Long enough, with a letter, and without spaces only from eight characters on."""
    text = utrim(x)
    return (F.length(text) >= 5) & text.rlike(r"\p{L}") & (text.contains(" ") | (F.length(text) >= 8))


def clean_markdown(x: Column | str) -> Column:
    """Without span tags; a leading second-level heading becomes a first-level one."""
    text = F.regexp_replace(col(x), r"(?i)<span[^>]*>|</span>", "")
    return F.when(text.startswith("## "), text.substr(F.lit(2), F.length(text))).otherwise(text)


def one_of(x: Column | str, values: tuple[str, ...], default: str) -> Column:
    """An enumerated value, upper-cased and trimmed, or the default."""
    up = F.upper(utrim(x))
    return F.when(up.isin(*values), up).otherwise(F.lit(default))


# scores


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity in double precision; 0 where a norm is 0."""
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, t: s + t)
    a, b = col(a), col(b)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def evolution_score(confidence: Column | str, links: Column | str) -> Column:
    conf, n = F.coalesce(col(confidence), F.lit(0.0)), F.coalesce(col(links), F.lit(0))
    return F.least(F.lit(0.95), 0.35 + 0.12 * F.when(conf == 0, 0.5).otherwise(conf) + 0.08 * F.when(n == 0, 1).otherwise(n))


def tree_score(relevance: Column | str) -> Column:
    return F.least(F.lit(0.9), 0.4 + 0.5 * F.coalesce(col(relevance), F.lit(0.5)))


def coupled_score(tree: Column | str) -> Column:
    return F.least(F.lit(0.95), 0.8 * col(tree) + 0.15)


def fused_score(best: Column | str, paths: Column | str) -> Column:
    """The best path's score with a bonus for each further path."""
    return F.least(F.lit(1.0), col(best) + 0.05 * (col(paths) - 1))


def clipped(score: Column | str) -> Column:
    """A score, or 0 for a negative one."""
    return F.greatest(col(score), F.lit(0.0))


def strength_value(x: Column | str) -> Column:
    return F.when(col(x) == "FULL", 1.0).when(col(x) == "PARTIAL", 0.5).when(col(x) == "WEAK", 0.25).otherwise(0.0)
