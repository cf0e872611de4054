"""Secret scan with corpus-wide ownership frequency.

One pass over the bytes of every whole text finds candidates: the base kinds
(assignments, access key ids, hex runs) and further shapes (tokens with known
prefixes, web tokens, private key blocks, and long mixed runs). Candidates are
hashed, and the hashes are aggregated over the corpus by distinct repositories
and distinct owners. A value that several owners hold is a widely copied
example, and so is one that two owners hold in several repositories each; one
that stays with one owner, in however many of its repositories, or that two
owners share in few places, and that is no placeholder looks live. The further
shapes are reported where they look live; the base spans always stay.

Columns: an owner is a value of ``source``; a repository is a (source, lang).

Distinct counts go through one grouping by (hash, owner, repository), then by
(hash, owner), then by hash, each with map-side partial sums, so a value that
sits in a third of all documents costs a task one row a map task. The counts are
joined back over salted keys. Every pattern passes a text once, so time grows
with its length.

Defined results: a null text is empty and has no spans; a very long text is
scanned whole; spans that start together are ordered by kind (a tie); repeated
rows and rows of equal doc_id are kept apart; a null source or lang is a value
of its own, and so is a missing column; an empty table gives no rows; extra
columns are ignored, whatever they are called.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .kernels import runs, slices
from .runtime import texts, written

#: Base kinds in order, and the shapes that the method adds.
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
MORE = {
    "jwt": re.compile(rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "prefixed": re.compile(rb"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,})"),
    "mixed": re.compile(rb"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])"),
}
#: Key blocks, from a header to the next end.
PEM = (re.compile(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"), re.compile(rb"(?=(-----END [A-Z ]*PRIVATE KEY-----))"))
KINDS = (*BASE, "pem", *MORE)
PLACEHOLDER = re.compile(rb"example|sample|dummy|placeholder|changeme|your|xxxx|0123456789|123456789|abcdef0123|test", re.I)


@dataclass(frozen=True)
class Params:
    min_assign: int = 12
    min_access: int = 18
    min_hex: int = 16
    #: A value that this many owners hold is taken for a copied example, or that two hold in this many repositories.
    copied_owners: int = 3
    copied_repositories: int = 4
    #: Parts into which the rows of a value are dealt when its counts are joined back.
    salts: int = 16
    min_entropy: float = 3.0


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_HEX = _table(b"0123456789abcdef")
_SOLID = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
#: Shorter shapes of MORE begin so; the others hold a solid run of 32 characters.
_STARTS = (b"-----BEGIN", b"eyJ", b"xox", b"sk_live_", b"sk-", b"AIza", b"glpat-")


def entropy(value: bytes) -> float:
    """Bits a character of a value."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_matches(raw: bytes, params: Params = Params()) -> list[tuple[int, int, int, bytes]]:
    """(kind, start, end, value) of the base kinds, in bytes."""
    found = [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(raw) if len(m[2]) >= params.min_assign]
    found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(raw) if m.end() - m.start() >= params.min_access]
    found += [(2, m.start(), m.end(), m[0]) for m in re.finditer(rb"[0-9a-f]+", raw) if m.end() - m.start() >= params.min_hex]
    return found


def more_matches(raw: bytes) -> list[tuple[int, int, int, bytes]]:
    """(kind, start, end, value) of the further shapes, in bytes."""
    found = [(len(BASE), a, b, raw[a:b]) for a, b in key_blocks(raw)]
    return found + [(len(BASE) + 1 + k, m.start(), m.end(), m[0]) for k, p in enumerate(MORE.values()) for m in p.finditer(raw)]


def key_blocks(raw: bytes) -> list[tuple[int, int]]:
    """Places of key blocks, which do not overlap."""
    ends = [m.span(1) for m in PEM[1].finditer(raw)]
    out, done, k = [], 0, 0
    for m in PEM[0].finditer(raw):
        while k < len(ends) and ends[k][0] < m.end():
            k += 1
        if k == len(ends):
            break
        if m.start() >= done:
            done = ends[k][1]
            out.append((m.start(), done))
    return out


def _candidates(part, params: Params) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Matches of each row of a slice. Rows that cannot match are passed over by cheap exact tests."""
    data, offsets = part.data, part.offsets
    starts, ends = runs(_HEX[data], offsets)
    long = ends - starts >= params.min_hex
    hex_row = np.searchsorted(offsets, starts[long], "right") - 1
    hexes: dict[int, list] = {}
    for r, s, e in zip(hex_row.tolist(), starts[long].tolist(), ends[long].tolist()):
        hexes.setdefault(r, []).append((s, e))
    starts, ends = runs(_SOLID[data], offsets)
    wide = set((np.searchsorted(offsets, starts[ends - starts >= 32], "right") - 1).tolist())
    raw = data.tobytes()
    low = raw.lower()
    has_word = any(w in low for w in _WORDS)
    at = offsets.tolist()
    for r in range(part.last - part.first):
        a, b = at[r], at[r + 1]
        found: list[tuple[int, int, int, bytes]] = []
        own = None
        if has_word and any(low.find(w, a, b) >= 0 for w in _WORDS):
            own = raw[a:b]
            found += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(own) if len(m[2]) >= params.min_assign]
        if raw.find(b"AKIA", a, b) >= 0:
            own = own or raw[a:b]
            found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(own) if m.end() - m.start() >= params.min_access]
        found += [(2, s - a, e - a, raw[s:e]) for s, e in hexes.get(r, ())]
        if r in wide or any(raw.find(s, a, b) >= 0 for s in _STARTS):
            found += more_matches(own or raw[a:b])
        yield found


def _points(raw: bytes, spots: set[int]) -> dict[int, int]:
    """Byte positions as code point positions."""
    out, done, count = {}, 0, 0
    for p in sorted(spots):
        count += len(raw[done:p].decode("utf-8"))
        out[p], done = count, p
    return out


_FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType()), T.StructField("plain", T.BooleanType())]))


def scanned(docs: DataFrame, params: Params) -> DataFrame:
    """Per row: counts and digest of the base spans, and all candidates with hashed values."""
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()), docs.schema["doc_id"], T.StructField("owner", T.StringType()), T.StructField("repository", T.StringType()),
            *(T.StructField(f"n_{k}", T.LongType()) for k in BASE), T.StructField("base_sha256", T.StringType()), T.StructField("found", _FOUND),
        ]
    )
    found_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("plain", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch.column("text")):
                n = part.last - part.first
                counts, digests, found = [[], [], []], [], []
                for r, own in enumerate(_candidates(part, params)):
                    if own:
                        raw = part.data[part.offsets[r] : part.offsets[r + 1]].tobytes()
                        point = _points(raw, {x for c in own for x in c[1:3]})
                        own = sorted((point[s], k, point[e], v) for k, s, e, v in own)
                    base = [(s, k, e) for s, k, e, _ in own if k < len(BASE)]
                    for k in range(len(BASE)):
                        counts[k].append(sum(b[1] == k for b in base))
                    digests.append(hashlib.sha256(",".join(f"{BASE[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
                    found.append([{"kind": k, "start": s, "end": e, "value": hashlib.sha256(v).hexdigest()[:32], "plain": bool(PLACEHOLDER.search(v)) or entropy(v) < params.min_entropy} for s, k, e, v in own])
                own_rows = batch.slice(part.first, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)), own_rows.column("doc_id"), own_rows.column("owner"), own_rows.column("repository"),
                        *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(found, found_type),
                    ],
                    schema.names,
                )
                row += n

    given = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("")) if x in docs.columns else F.lit("")
    owner = given("source")
    repository = F.concat_ws("/", owner, given("lang"))
    return texts(docs).select("doc_id", F.col("text").cast("string").alias("text"), owner.alias("owner"), repository.alias("repository")).mapInArrow(run, schema)


def ownership(found: DataFrame) -> DataFrame:
    """For each hashed value of (value, owner, repository) rows: distinct repositories, distinct owners, occurrences."""
    per_repository = found.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    per_owner = per_repository.groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return per_owner.groupBy("value").agg(F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners"), F.sum("n").alias("n_found"))


def scan(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """Per document: base counts and digest, all spans, and how many candidates look live or copied."""
    rows = written(scanned(docs, params), "secret-candidates")
    found = rows.select("row", "owner", "repository", F.explode("found").alias("f")).select("row", "owner", "repository", "f.*")
    counts = ownership(found.select("value", "owner", "repository")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(params.salts - 1))))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(params.salts)).cast("int"))
    copied = (F.col("n_owners") >= params.copied_owners) | (F.col("n_owners") >= 2) & (F.col("n_repositories") >= params.copied_repositories)
    judged = salted.join(counts.hint("merge"), ["value", "salt"]).withColumn("copied", copied)
    live = ~F.col("copied") & ~F.col("plain")
    names = F.array(*(F.lit(k) for k in KINDS))
    # the candidates of one document lie in its own text, so this list is bounded by that
    spans = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when((F.col("kind") < len(BASE)) | live, F.struct("start", "kind", "end")))).alias("spans"),
        F.sum(live.cast("long")).alias("n_live"), F.sum(F.col("copied").cast("long")).alias("n_copied"),
    )
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.join(spans, "row", "left").select(
        "doc_id", *(f"n_{k}" for k in BASE), "base_sha256", F.coalesce(text, F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )
