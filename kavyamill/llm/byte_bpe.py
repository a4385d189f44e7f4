"""Byte-level BPE encoding and decoding with a given rank file.

A piece of text is covered by the longest tokens from left to right; where two neighbours could not stand
side by side in the result of the merges, the last one is shortened, or taken back. A bit for each position
keeps dead ends from being entered twice, so that the work is linear. Bytes stand for the characters of the
same number (Latin-1) in an Aho-Corasick automaton that gives the longest token at each place.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kavyamill.llm.common import in_arrow

#: White_Space as the tokenizers' own regex engine has it for \s.
_WHITE = "\\t-\\r\\x20\\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces that are kept at once, and the longest that is; both bound a worker's memory, not the result.
KEPT_PIECES, KEPT_CHARS = 150_000, 32
KEPT_PAIRS = 300_000

_RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, file))}


def _members(category: str) -> str:
    """The Latin-1 characters of a Unicode category, for a set of Python's own re."""
    return "".join(f"\\x{i:02x}" for i in range(256) if unicodedata.category(chr(i))[0] == category)


def compiled(pattern: str, latin: bool = False) -> regex.Pattern | re.Pattern:
    """The split pattern, with \\s and \\S written out, as Python's \\s has other members.

    latin: for texts of Latin-1 characters alone, in Python's own re, which is several times faster.
    """
    named = {r"\p{L}": _members("L"), r"\p{N}": _members("N")} if latin else {}
    white = _WHITE.partition("\u1680")[0] if latin else _WHITE
    out, in_set = [], False
    for part in regex.findall(r"\\p\{\w+\}|\\.|.", pattern, regex.S):
        if part == r"\s" or part in named:
            members = named.get(part, white)
            out.append(members if in_set else f"[{members}]")
        elif part == r"\S":
            out.append(f"[^{white}]")
        else:
            in_set = (in_set or part == "[") and part != "]"
            out.append(part)
    return (re if latin else regex).compile("".join(out))


class BytePairs:
    """Encoder and decoder for one vocabulary; ranks are ids, and lower ranks merge first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.token: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.token[rank] = token
        self.spelled = np.frombuffer(b"".join(self.token), np.uint8)
        self.length = np.array([len(x) for x in self.token], np.int64)
        self.begins = np.cumsum(self.length) - self.length
        self.find, self.find_latin = compiled(pattern).findall, compiled(pattern, latin=True).findall
        self.trie = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.trie.add_word(token.decode("latin-1"), (rank, len(token) - 1))
        self.trie.make_automaton()
        self.shorter = [-1] * self.size
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(self.size)]
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.kept: dict[str, bytes] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.shorter[rank] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1)
            if len(token) > 1:
                halves = self._halves(token, rank)
                if halves:
                    self.halves[rank] = halves
                    self.merged[halves] = rank

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one, found with the lower ranks alone."""
        parts = [self.ranks[token[i : i + 1]] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                found = self.merged.get((parts[i], parts[i + 1]), rank)
                if found < best:
                    best, at = found, i
            if at < 0:
                return None
            parts[at : at + 2] = [best]
        return tuple(parts)

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the merges would leave left and right side by side, each by itself."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= KEPT_PAIRS:
                self.fits.clear()
            known = self.fits[key] = self._may_follow(left, right)
        return known

    def _may_follow(self, left: int, right: int) -> bool:
        # Undo the merges on both sides of the border from the latest to the first. A pair across the border that
        # would merge before the step just undone would have prevented it.
        limit = self.size + 1
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, left = left, self.halves[left][1]
                if left != limit:
                    continue
                limit, right = right + 1, self.halves[right][0]
                if right + 1 == limit:
                    return True
            else:
                limit, right = right + 1, self.halves[right][0]
                if right + 1 != limit:
                    continue
                limit, left = left, self.halves[left][1]
                if left == limit:
                    return True

    def longest(self, text: str) -> list[int]:
        """The longest token that begins at each character of a Latin-1 string."""
        out = [-1] * len(text)
        for end, (rank, before) in self.trie.iter(text):  # by rising ends: the last at a place is the longest
            out[end - before] = rank
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest = self.longest(piece.decode("latin-1"))
        open_at, out, at, end = bytearray(b"\1") * (len(piece) + 1), [], 0, len(piece)
        token = longest[0] if piece else -1
        while token >= 0:
            last = out[-1] if out else -1
            while True:
                to = at + len(self.token[token])
                if open_at[to] and (last < 0 or self.may_follow(last, token)):
                    out.append(token)
                    at, token = to, longest[to] if to < end else -1
                    break
                if self.shorter[token] >= 0:
                    token = self.shorter[token]
                    continue
                open_at[at] = 0
                out.pop()
                at, token = at - len(self.token[last]), last
                break
        return out

    def _piece_ids(self, piece: str) -> bytes:
        ids = np.asarray(self.encode_piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= KEPT_CHARS:
            if len(self.kept) >= KEPT_PIECES:
                self.kept.clear()
            self.kept[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known = self.kept.get
        try:
            text.encode("latin-1")
            pieces = self.find_latin(text)
        except UnicodeEncodeError:
            pieces = self.find(text)
        return b"".join([known(piece) or self._piece_ids(piece) for piece in pieces])

    def decode(self, ids: bytes) -> bytes:
        ids = np.frombuffer(ids, "<u4")
        length = self.length[ids]
        ends = np.cumsum(length)
        return self.spelled[np.repeat(self.begins[ids] - (ends - length), length) + np.arange(ends[-1] if len(ids) else 0)].tobytes()


_READY: dict[tuple[str, str], BytePairs] = {}


def _ready(path: str, pattern: str) -> BytePairs:
    if (path, pattern) not in _READY:
        _READY[path, pattern] = BytePairs(read_ranks(path), pattern)
    return _READY[path, pattern]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    pairs = _ready(path, pattern)
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            ids = [pairs.encode(x or "") for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(pairs.decode, ids), pa.binary())], schema=_RESULT)
    _READY.clear()  # a worker that waits for other tasks holds no tables


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hexed = [pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column(i)], pa.string()) for i in (2, 3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *hexed], schema=_DIGEST)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): each whole text's ids (little-endian uint32) and the bytes they decode to.

    The rank file must lie at `path` on every executor. Null texts count as empty (no token); each row gives a row,
    so repeated rows repeat; texts are encoded whole, however long, in time that grows with their length; other columns
    are ignored; an empty table gives no rows.
    """
    return in_arrow(docs.select("doc_id", "text"), lambda batches: _encoded(batches, path, pattern), "doc_id long, n_tokens long, ids binary, decoded binary")


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """What encode() gives, with its ids and decoded bytes as SHA-256 in lowercase hex, all in one Python worker."""
    return in_arrow(docs.select("doc_id", "text"), lambda batches: _digested(_encoded(batches, path, pattern)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
