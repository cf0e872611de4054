"""Exact subword ids of whole texts, each distinct piece encoded once.

A text is cut where white space begins, and between an ASCII letter and an ASCII
mark other than the apostrophe. The public vocabularies' splitting patterns
never join characters across such a cut, so the ids of the pieces, joined, are
the ids of the text. The distinct pieces of a slice go to the
tokenizers library; their ids are spread back by numpy. Texts with white space
beyond ASCII, where the cut is not safe, are encoded whole, and so are texts
that may hold a special token's string.
"""
from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .kernels import LOWER, SPACE, Slice, ragged, runs, slices, span_hashes

#: White space outside ASCII that the patterns' \s takes (fixed values, Unicode White_Space), the separator below, and how special tokens begin.
WIDE_SPACE = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{E000}]|<\|"
SEPARATOR = "\ue000"
_BLANK = frozenset(b" \t\n\v\f\r")
MEMO, SLICE, JOINED = 250_000, 3 << 20, 4000


def _kinds() -> np.ndarray:
    """1: ASCII letter, 2: ASCII mark but the apostrophe, 0: any other byte."""
    out = np.zeros(256, np.uint8)
    out[33:127] = 2
    out[48:58] = out[39] = 0
    out[65:91] = out[97:123] = 1
    return out


_KIND = _kinds()


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """One per Python worker. keep_space: white space before a word belongs to its piece (byte-level vocabularies)."""

    def __init__(self, path: str, keep_space: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep_space = keep_space
        self.memo: dict[int, bytes] = {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        if keep_space:  # bytes that each id stands for: a byte-level token has one character a byte
            self.widths = np.zeros(max(vocab.values()) + 1, np.int64)
            self.widths[list(vocab.values())] = [len(x) for x in vocab]
        else:
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for x, i in vocab.items() if x.endswith("</w>")]] = True
            self.mark = self._plain([SEPARATOR])[0]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, found by encoding many pieces as one text and cutting the ids again."""
        if self.keep_space:  # white space first, none at the end: joined, such pieces stay apart
            easy = [p[0] in _BLANK and p[-1] not in _BLANK for p in pieces]
            join = (self._by_width, lambda own: [x.tobytes() for x in self._plain([y.decode("utf-8") for y in own])])
        else:  # letters alone are one word, and its last id says so
            easy = [p.isalpha() or (t := p.decode("utf-8")).isalpha() and t.lower().isalpha() for p in pieces]
            join = (self._by_word, self._by_mark)
        out: list = [None] * len(pieces)
        for flag, encode in ((True, join[0]), (False, join[1])):
            where = [i for i, x in enumerate(easy) if x == flag]
            for k in range(0, len(where), JOINED):
                for i, ids in zip(where[k : k + JOINED], encode([pieces[i] for i in where[k : k + JOINED]]), strict=True):
                    out[i] = ids
        return out

    def _by_width(self, group: list[bytes]) -> list[bytes]:
        (ids,) = self._plain([b"".join(group).decode("utf-8")])
        ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)))
        cuts = np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1
        return self._cut(ids, np.concatenate([[0], cuts[:-1]]), cuts)

    def _by_word(self, group: list[bytes]) -> list[bytes]:
        (ids,) = self._plain([b" ".join(group).decode("utf-8")])
        cuts = np.flatnonzero(self.last[ids]) + 1
        return self._cut(ids, np.concatenate([[0], cuts[:-1]]), cuts)

    def _by_mark(self, group: list[bytes]) -> list[bytes]:
        (ids,) = self._plain([f" {SEPARATOR} ".encode().join([*group, b""]).decode("utf-8")])
        n = len(self.mark)
        hit = ids[: len(ids) - n + 1] == self.mark[0]
        for j in range(1, n):
            hit &= ids[j : len(ids) - n + 1 + j] == self.mark[j]
        at = np.flatnonzero(hit)
        return self._cut(ids, np.concatenate([[0], at[:-1] + n]), at)

    @staticmethod
    def _cut(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip((starts * 4).tolist(), (ends * 4).tolist())]

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = _KIND[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = kind[1:] + kind[:-1] == 3
        edge[1:-1] &= kind[1:] != 0
        edge[1:-1] &= kind[:-1] != 0
        starts, ends = runs(~SPACE[data], offsets)
        edge[ends] = edge[offsets] = True
        if not self.keep_space:
            edge[starts] = True
        edges = np.flatnonzero(edge)
        starts, ends = edges[:-1], edges[1:]
        if not self.keep_space:
            solid = ~SPACE[data[starts]]
            starts, ends = starts[solid], ends[solid]
        return starts, ends

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of the slice, joined, and each row's number of ids."""
        data = part.data if self.keep_space else LOWER[part.data]
        starts, ends = self._pieces(data, part.offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(part.last - part.first, np.int64)
        hashes = span_hashes(data, starts, ends)
        order = np.argsort(hashes)
        run = hashes[order]
        fresh = np.ones(len(run), bool)
        fresh[1:] = run[1:] != run[:-1]
        back = np.empty(len(run), np.int64)
        back[order] = np.cumsum(fresh) - 1
        own, at = run[fresh].tolist(), order[fresh]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        packed = [memo.get(k) for k in own]
        new = [i for i, x in enumerate(packed) if x is None]
        if new:
            s, e = starts[at[new]], ends[at[new]]
            raw = data.tobytes()
            pieces = [raw[a:b] for a, b in zip(s.tolist(), e.tolist())]
            for i, ids in zip(new, self._encoded(pieces)):
                packed[i] = memo[own[i]] = ids
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) >> 2
        flat = np.frombuffer(b"".join(packed), np.uint32)
        begin = np.cumsum(sizes) - sizes
        lengths = sizes[back]
        ids = flat[ragged(begin[back], lengths)]
        total = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=total[1:])
        return ids, np.diff(total[np.searchsorted(starts, part.offsets)])

    def rows(self, column: pa.Array):
        """For each row of a string column (null: empty) in turn: its index and its ids as uint32."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column, "")
        odd = pc.match_substring_regex(column, WIDE_SPACE)
        wide = odd.to_numpy(zero_copy_only=False)
        for part in slices(pc.if_else(odd, "", column), SLICE):
            ids, counts = self.encode(part)
            ends = np.cumsum(counts)
            for k in range(part.last - part.first):
                i = part.first + k
                yield i, self._plain([column[i].as_py()])[0] if wide[i] else ids[ends[k] - counts[k] : ends[k]]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, keep_space: bool) -> Encoder:
    """The worker's own encoder, kept from task to task."""
    if (path, keep_space) not in _ENCODERS:
        _ENCODERS[path, keep_space] = Encoder(path, keep_space)
    return _ENCODERS[path, keep_space]
