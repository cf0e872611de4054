"""Personal data: format-preserving pseudonyms by keyed Feistel permutations.

Numbers and dates that pass their kind's validation are permuted inside their
own format: a payment card stays a valid card, a date stays a date of the same
notation, an address stays an address. The permutation is a keyed Feistel
network over the kind's domain (two residue classes whose sizes multiply to
it), so it is one to one, and equal values stay linked across documents. Mail
addresses get keyed names. Whatever fails validation is left as it is.

A text is cut into runs of words that may hold values. In a run every place
where a value can begin is tried, from left to right: of each kind the longest
match that passes validation, with ends inside a chain such as 2024-01-02 last.
A match that fails hides nothing inside or after it. Kinds of a fixed shape are
looked for first, loose runs of digits in what is left. A run is walked in
chunks that see past both their ends, so its time grows with its length.

Only DataFrame functions are used. There is no shuffle; a task needs memory for
one text at a time. No pattern repeats a group without bound unless the
repetition is possessive, so the depth of the matcher does not grow with a text.

Defined results: a null text stays null, an empty one empty; a very long text is
rewritten whole; repeated rows give equal results; of values that could begin at
one place the kind listed first stands (a tie); an empty table gives no rows;
other columns pass through, also those of the names used here.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from .runtime import free_name

ROUNDS = 8
KINDS = ("email", "iban", "date", "ip", "card", "ssn", "phone")
#: Patterns by kind, tried in this order at each position.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "date": r"(?<![\p{L}\p{N}./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![\p{N}/-]|\.[0-9]|(?!T[0-9])\p{L})",
    "ip": r"(?<![\p{L}\p{N}.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{L}\p{N}]|\.[0-9])",
    "card": r"(?<![\p{L}\p{N}])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\p{L}\p{N}])",
}
ANY = "|".join(PATTERNS.values())
#: Cards as they are printed, and phones without a country code.
SHAPED = {
    "phone": r"(?<!\+[0-9]{1,3}[ .-]?)(?<![\p{L}\p{N}+])(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\p{L}\p{N}]|[.-][0-9])",
    "card": r"(?<![\p{L}\p{N}+])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}(?: [0-9]{3})?|[0-9]{4}(?:-[0-9]{4}){3}(?:-[0-9]{3})?|[0-9]{4}(?: [0-9]{6} [0-9]{4,5}|-[0-9]{6}-[0-9]{4,5}))(?![\p{L}\p{N}])",
}
#: Two passes over a run, each the kinds and patterns in the order tried at a place.
PASSES = (
    [(k, PATTERNS[k]) for k in ("iban", "date", "ip", "ssn")] + [(k, SHAPED[k]) for k in ("phone", "card")],
    [(k, PATTERNS[k]) for k in ("phone", "card")],
)
#: Words with a digit or an at sign, each one space from the next, and words of capitals among them (parts of an iban).
RUN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: (?:[^\s0-9@]*+[0-9@]\S*+|[A-Z]++(?![\p{L}\p{N}])\S*+))*+"
#: A value begins where one of these does.
TOKEN = r"(?s)[\p{L}\p{N}]+|."
#: Characters seen before a place, and from it on: more than any pattern but that of mail takes.
BEFORE, AHEAD = 6, 64
#: A part of a run: about so many characters, up to the end of a token, of a run with BEFORE blanks in front.
CHUNK = r"(?s)(?<=(.{%d})).{1,500}+[\p{L}\p{N}]*+(?=(.{0,%d}))" % (BEFORE, AHEAD)


@dataclass(frozen=True)
class Params:
    key: str = "set-a-secret-key"
    #: Dates are permuted within blocks of this many days squared, counted from 1900-01-01.
    date_side: int = 270
    years: tuple[int, int] = (1800, 2199)


def _noise(key: str, kind: str, turn: Column, value: Column) -> Column:
    """A 60-bit keyed number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the pairs (left below a, right below b), as a struct of l and r."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(acc["l"] + F.pmod(_noise(key, kind, i, acc["r"]), a), a)).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + F.pmod(_noise(key, kind, i, acc["l"]), b), b)).alias("r"),
        )

    return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), start, turn)


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A digit string of 2 to 30 digits, permuted among those of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    a, b = F.rpad(F.lit("1"), half + 1, "0").cast("long"), F.rpad(F.lit("1"), n - half + 1, "0").cast("long")
    pair = feistel(digits.substr(F.lit(1), half).cast("long"), digits.substr(half + 1, n - half).cast("long"), a, b, key, kind)
    return F.concat(F.lpad(pair["l"].cast("string"), half, "0"), F.lpad(pair["r"].cast("string"), n - half, "0"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def refill(m: Column, digits: Column) -> Column:
    """m with its digits replaced by the given ones, in order."""
    def step(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(
            F.concat(acc["s"], F.when(is_digit, digits.substr(acc["k"], F.lit(1))).otherwise(c)).alias("s"),
            (acc["k"] + F.when(is_digit, 1).otherwise(0)).alias("k"),
        )

    return F.aggregate(F.regexp_extract_all(m, F.lit(r"(?s)."), F.lit(0)), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), step)["s"]


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string, modulo 10, the last digit counting once."""
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        d = digits.substr(n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10


def _card(m: Column, key: str) -> tuple[Column, Column]:
    d = _digits(m)
    n = F.length(d)
    body = F.concat(d.substr(F.lit(1), F.lit(1)), permute_digits(d.substr(F.lit(2), n - 2), key, "card"))
    valid = n.between(13, 19) & (_luhn(d) == 0) & (F.length(F.translate(d, "0", "")) > 0)
    return valid, F.transform(F.array(body), lambda x: refill(m, F.concat(x, F.pmod(-_luhn(F.concat(x, F.lit("0"))), F.lit(10)).cast("string"))))[0]


def _ip(m: Column, key: str) -> tuple[Column, Column]:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    pair = F.transform(
        F.array(feistel(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], F.lit(65536), F.lit(65536), key, "ip")),
        lambda p: F.concat_ws(".", *(x.cast("long").cast("string") for x in (F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256))),
    )
    return F.forall(parts, lambda x: x <= 255), pair[0]


def _phone(m: Column, key: str) -> tuple[Column, Column]:
    d = _digits(m)
    free = F.least(F.length(d) - 1, F.lit(9))
    fixed = F.length(d) - free
    return F.length(d).between(7, 15), refill(m, F.concat(d.substr(F.lit(1), fixed), permute_digits(d.substr(fixed + 1, free), key, "phone")))


def _ssn(m: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = m.substr(1, 3), m.substr(5, 2).cast("int"), m.substr(8, 4).cast("int")
    pair = feistel(group - 1, serial - 1, F.lit(99), F.lit(9999), key, "ssn")
    valid = ~area.isin("000", "666") & (area < "900") & (group > 0) & (serial > 0)
    return valid, F.transform(F.array(pair), lambda p: F.concat_ws("-", area, F.lpad((p["l"] + 1).cast("string"), 2, "0"), F.lpad((p["r"] + 1).cast("string"), 4, "0")))[0]


def _mod97(text: Column) -> Column:
    """The number that letters (A is 10) and digits spell, modulo 97."""
    def step(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.regexp_extract_all(text, F.lit("."), F.lit(0)), F.lit(0), step)


def _iban(m: Column, key: str) -> tuple[Column, Column]:
    whole = F.replace(m, F.lit(" "), F.lit(""))
    rest = whole.substr(F.lit(5), F.length(whole) - 4)
    d = _digits(rest)
    own = F.transform(F.array(refill(rest, permute_digits(d, key, "iban"))), lambda r: F.concat(F.lpad((98 - _mod97(F.concat(r, whole.substr(1, 2), F.lit("00")))).cast("string"), 2, "0"), r))[0]
    # the digits of the check number and of the account, put back into the spaced form
    valid = F.length(whole).between(15, 34) & (F.length(d) >= 2) & (_mod97(F.concat(rest, whole.substr(1, 4))) == 1)
    return valid, F.transform(F.array(own), lambda r: refill(m, _digits(r)))[0]


def _date(m: Column, params: Params) -> tuple[Column, Column]:
    iso, slash = m.contains("-"), m.contains("/")
    parts = F.transform(F.split(m, r"[-./]"), lambda x: x.cast("int"))
    year = F.when(iso, parts[0]).otherwise(parts[2])
    month_first = slash & (parts[0] <= 12)
    month = F.when(iso, parts[1]).when(month_first, parts[0]).otherwise(parts[1])
    day = F.when(iso, parts[2]).when(month_first, parts[1]).otherwise(parts[0])
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")
    side, base = F.lit(params.date_side), F.lit("1900-01-01").cast("date")
    n = F.datediff(date, base)
    block = F.floor(n / (side * side)).cast("int") * side * side
    inside = n - block
    pair = feistel(F.floor(inside / side), inside % side, side, side, params.key, "date")
    padded = ~m.rlike(r"(?<![0-9])[0-9](?![0-9])")

    def show(p: Column) -> Column:
        new = F.date_add(base, (block + p["l"] * side + p["r"]).cast("int"))
        y, mo, da = F.date_format(new, "yyyy"), F.date_format(new, "MM"), F.date_format(new, "dd")
        short = [F.when(padded, x).otherwise(F.regexp_replace(x, "^0", "")) for x in (mo, da)]
        return F.when(iso, F.concat_ws("-", y, mo, da)).when(month_first, F.concat_ws("/", short[0], short[1], y)).when(slash, F.concat_ws("/", short[1], short[0], y)).otherwise(F.concat_ws(".", short[1], short[0], y))

    return date.isNotNull() & year.between(*params.years), F.transform(F.array(pair), show)[0]


def _email(m: Column, key: str) -> tuple[Column, Column]:
    low = F.lower(m)
    name = F.concat(F.lit("user"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), low), 256), 1, 12))
    host = F.concat(F.lit("mail"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("host"), F.substring_index(low, "@", -1)), 256), 1, 8), F.lit(".example"))
    return F.lit(True), F.concat(name, F.lit("@"), host)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _makers(params: Params) -> dict[str, Callable[[Column], tuple[Column, Column]]]:
    """For each kind: whether a match is valid, and what stands in for it."""
    key = params.key
    return {"email": lambda m: _email(m, key), "iban": lambda m: _iban(m, key), "date": lambda m: _date(m, params), "ip": lambda m: _ip(m, key), "card": lambda m: _card(m, key), "ssn": lambda m: _ssn(m, key), "phone": lambda m: _phone(m, key)}


def _valid_start(near: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """The longest valid match at the place that near looks at, null if there is none; ends inside a chain come last."""
    def prefixes(longest: Column) -> Column:
        after = lambda e: near.substr(e + BEFORE + 1, F.lit(2))
        chained = lambda e: after(e).rlike("^[-./][0-9]")
        ends = F.filter(F.sequence(F.length(longest), F.lit(1), F.lit(-1)), lambda e: ~after(e).rlike(r"^[\p{L}\p{N}]") | (e == F.length(longest)))
        ordered = _let(ends, lambda own: F.concat(F.filter(own, lambda e: ~chained(e)), F.filter(own, chained)))
        own = F.transform(ordered, lambda e: longest.substr(F.lit(1), e))
        return F.get(F.filter(own, lambda x: x.rlike(f"^(?:{pattern})$") & F.coalesce(valid(x), F.lit(False))), F.lit(0))

    return _let(F.regexp_extract(near, f"(?s)^.{{{BEFORE}}}({pattern})", 1), lambda g: F.when(g != "", prefixes(g)))


HIT = "struct<at:int,kind:string,old:string>"
PIECE = "struct<kind:string,value:string>"


def _scanned(run: Column, patterns: list[tuple[str, str]], params: Params) -> Column:
    """The pieces of a run as (kind, value): values found, and the text between them, in one or more parts, with a null kind."""
    make = _makers(params)

    def tried(near: Column, at: Column) -> Column:
        def one(name: str, pattern: str) -> Column:
            own = _valid_start(near, pattern, lambda x: make[name](x)[0])
            return _let(own, lambda x: F.when(x.isNotNull(), F.struct(at.alias("at"), F.lit(name).alias("kind"), x.alias("old"))))

        return F.coalesce(*(one(*p) for p in patterns))

    def step(seen: Column, acc: Column, token: Column) -> Column:
        """Look at one token; places count from 1 at the chunk's own first character."""
        free = (acc["at"] >= acc["until"]) & token.rlike("^[0-9A-Z+(]")
        hit = F.when(free, _let(seen.substr(acc["at"], F.lit(BEFORE + AHEAD)), lambda near: tried(near, acc["at"])))
        return _let(hit, lambda h: F.struct(
            (acc["at"] + F.length(token)).alias("at"), F.when(h.isNull(), acc["until"]).otherwise(h["at"] + F.length(h["old"])).alias("until"),
            F.when(h.isNull(), acc["hits"]).otherwise(F.concat(acc["hits"], F.array(h))).alias("hits"),
        ))

    def chunk(acc: Column, part: Column) -> Column:
        start = F.struct(F.lit(1).alias("at"), acc["until"].alias("until"), F.array().cast(f"array<{HIT}>").alias("hits"))
        end = F.aggregate(F.regexp_extract_all(part["own"], F.lit(TOKEN), F.lit(0)), start, lambda a, t: step(part["seen"], a, t))
        return _let(end, lambda e: F.struct(
            F.greatest(e["until"] - F.length(part["own"]), F.lit(1)).alias("until"), F.concat(acc["out"], F.array(pieces(part["own"], e["hits"], acc["until"]))).alias("out")
        ))

    def pieces(own: Column, found: Column, first: Column) -> Column:
        end = lambda h: h["at"] + F.length(h["old"])
        before = lambda i: F.when(i == 0, first).otherwise(end(F.get(found, i - 1)))
        each = F.transform(found, lambda h, i: F.array(_piece(None, own.substr(before(i), h["at"] - before(i))), _piece(h["kind"], h["old"])))
        return F.concat(F.flatten(each), F.array(_piece(None, own.substr(before(F.size(found)), F.length(own)))))

    padded = F.concat(F.lit(" " * BEFORE), run)
    parts = lambda group: F.regexp_extract_all(padded, F.lit(CHUNK), F.lit(group))
    both = F.zip_with(F.zip_with(parts(1), parts(0), lambda b, o: F.struct(o.alias("own"), F.concat(b, o).alias("seen"))), parts(2), lambda p, a: F.struct(p["own"].alias("own"), F.concat(p["seen"], a).alias("seen")))
    return F.flatten(F.aggregate(both, F.struct(F.lit(1).alias("until"), F.array().cast(f"array<array<{PIECE}>>").alias("out")), chunk)["out"])


def _joined(pieces: Column) -> Column:
    """Pieces with the parts of text between two values made one."""
    at = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.get(pieces, i)["kind"].isNotNull())

    def between(a: Column, b: Column) -> Column:
        return _piece(None, F.array_join(F.transform(F.slice(pieces, a + 1, b - a), lambda x: x["value"]), ""))

    def made(own: Column) -> Column:
        each = F.transform(own, lambda p, i: F.array(between(F.coalesce(F.get(own, i - 1) + 1, F.lit(0)), p), F.get(pieces, p)))
        return F.concat(F.flatten(each), F.array(between(F.coalesce(F.get(own, F.size(own) - 1) + 1, F.lit(0)), F.size(pieces))))

    return F.when(F.size(pieces) > 1, _let(at, made)).otherwise(pieces)


def _piece(kind: Column | None, value: Column) -> Column:
    return F.struct((F.lit(None).cast("string") if kind is None else kind).alias("kind"), value.alias("value"))


def _deeper(cut: Callable[[Column], Column], pattern: str, pieces: Column) -> Column:
    """Pieces of text that the pattern matches somewhere cut further; the others, and values, as they are."""
    return F.flatten(F.transform(pieces, lambda x: F.when(x["kind"].isNull() & x["value"].rlike(pattern), cut(x["value"])).otherwise(F.array(x))))


def _replaced(piece: Column, params: Params) -> Column:
    """What stands in for a value; text stays."""
    out = piece["value"]
    for name, make in _makers(params).items():
        out = F.when(piece["kind"] == name, make(piece["value"])[1]).otherwise(out)
    return out


def _each_run(found: str, cut: Callable[[Column], Column], pattern: str) -> Column:
    return F.transform(found, lambda pieces: _deeper(cut, pattern, pieces))


def _mails(m: Column) -> Column:
    """The pieces of a text between and at mail addresses, which need no validation."""
    mail = PATTERNS["email"]
    own = F.transform(F.regexp_extract_all(m, F.lit(mail), F.lit(0)), lambda x: _piece(F.lit("email"), x))
    return F.filter(F.flatten(F.zip_with(F.transform(F.split(m, mail, -1), lambda t: _piece(None, t)), own, lambda t, x: F.array(t, x))), lambda x: x.isNotNull())


def pseudonymise(docs: DataFrame, params: Params = Params(), column: str = "text", found: str | None = None) -> DataFrame:
    """docs with the text rewritten; with ``found`` also an array column of (kind, value) for what was found.

    Where docs has a column of that name, the array goes under ``free_name(docs, found)``.
    """
    text = F.col(column).cast("string")
    own = free_name(docs, found or "found_")
    # a text without a digit or an at sign has no match of any kind
    runs = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    step = docs.withColumn(own, F.coalesce(F.transform(runs, lambda m: F.array(_piece(None, m))), F.array().cast(f"array<array<{PIECE}>>")))
    # mail, then values of a fixed shape, then loose ones; steps of their own, as the analyser follows lambdas only so deep
    cuts = [(PATTERNS["email"], _mails)]
    cuts += [("|".join(p for _, p in patterns), partial(_scanned, patterns=patterns, params=params)) for patterns in PASSES]
    for pattern, cut in cuts:
        step = step.withColumn(own, _each_run(own, cut, pattern))
        step = step.withColumn(own, F.transform(own, _joined))
    step = step.withColumn(own, F.transform(own, lambda pieces: F.transform(pieces, lambda x: _piece(x["kind"], _replaced(x, params)))))
    values = F.filter(F.flatten(own), lambda f: f["kind"].isNotNull())
    whole = F.zip_with(F.split(text, RUN, -1), F.col(own), lambda t, f: F.concat(t, F.coalesce(F.array_join(F.transform(f, lambda x: x["value"]), ""), F.lit(""))))
    out = step.withColumns({column: F.when(F.size(values) > 0, F.array_join(whole, "")).otherwise(F.col(column)), own: values})
    return out if found else out.drop(own)


def report(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, rewritten text, and the number of values of each kind."""
    out = pseudonymise(docs.select("doc_id", "text"), params, found="found")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return out.select("doc_id", "text", *counts)
