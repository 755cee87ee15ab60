"""Byte-level BPE encoding in linear time, and decoding.

Text is split by the tokenizer's pattern, and each piece is encoded over its bytes mapped to Latin-1 characters: an
Aho-Corasick automaton of all tokens (pyahocorasick) gives the longest token at every position, and the encoder goes
from longest matches to shorter ones, backtracking where a token cannot stand after the one before it. Two tokens
can stand side by side if merging would not have joined across their border; that test undoes their merges from the
latest to the earliest, and its results are remembered. The ids are exactly those of the merges by rank.

Pieces and words recur, so each worker process remembers the ids of the first PIECES and WORDS of them that it meets;
others are encoded each time. The vocabulary file is read on the driver and sent to the workers.

Results in odd cases: null text counts as empty, and an empty text has no ids; special-token strings are ordinary
text; a byte without a token of its own cannot occur, since the vocabulary is checked to hold all 256; rows repeated
with one id are encoded alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sosrank.llm.common import id_text, ship

#: Pieces and words whose ids a worker process remembers.
PIECES, WORDS = 800_000, 400_000
#: White space other than single spaces and newlines, or a space beside white space: then words are not split apart
#: at spaces before the pattern is applied.
_ODD_SPACE = re.compile(r"[^\S \n]|  | \n|\n |\A | \Z")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines ``<base64 token> <rank>``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Remembered(dict):
    """Results of ``make`` by key; the first ``limit`` are kept."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key: str) -> bytes:
        out = self.make(key)
        if len(self) < self.limit:
            self[key] = out
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a token: {missing}")
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.tokens = {r: t for t, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces = _Remembered(lambda p: np.array(self.piece(p), "<u4").tobytes(), PIECES)
        self.words = _Remembered(lambda w: self._packed(self.find(f" {w}")), WORDS)

    def next_shorter(self, token: int) -> int:
        """The longest other token that this one starts with; -1 for a single byte."""
        found = self.shorter.get(token)
        if found is None:
            t = self.tokens[token]
            found = next((self.ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ranks), -1)
            self.shorter[token] = found
        return found

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        if token not in self.parts:
            ids = self.merge(self.tokens[token], token)
            self.parts[token] = (ids[0], ids[1]) if len(ids) == 2 else None
        return self.parts[token]

    def merge(self, data: bytes, below: int) -> list[int]:
        """Merge by rank with the tokens before ``below``; only for single tokens, to learn their halves."""
        parts = [bytes([b]) for b in data]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave a border between the two tokens."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # While both tokens grow, the pair at the border would merge if its rank comes before the next merge that
        # made either side; walk back through those merges, the later one first.
        before = len(self.ranks)
        while True:
            joined = self.ranks.get(self.tokens[a] + self.tokens[b], before)
            if joined < before and self.halves(joined) == (a, b):
                return False
            left, right = self.halves(a), self.halves(b)
            if left is None and right is None:
                return True
            # at equal ranks the left occurrence was merged first, so the right one is undone first
            if right is None or left is not None and a > b:
                before, a = a, left[1]
            else:
                before, b = b + 1, right[0]

    def piece(self, text: str) -> list[int]:
        """The ids of one piece of the pattern."""
        data = text.encode()
        whole = self.ranks.get(data)
        if whole is not None and (len(data) == 1 or self.halves(whole)):
            return [whole]
        n = len(data)
        longest = [-1] * n
        for end, (rank, length) in self.automaton.iter(data.decode("latin-1")):
            start = end - length + 1
            # matches of one start come in ascending length
            longest[start] = rank
        size, fits = self.tokens, self.fits
        dead = bytearray(n + 1)  # positions from which every continuation has failed
        ids: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + len(size[token])
            if not dead[end] and (not ids or fits.get((ids[-1], token)) or self.compatible(ids[-1], token)):
                ids.append(token)
                at = end
                if at < n:
                    token = longest[at]
                continue
            token = self.next_shorter(token)
            while token < 0:  # nothing fits here: take back the token before and shorten it
                dead[at] = 1
                last = ids.pop()
                at -= len(size[last])
                token = self.next_shorter(last)
        return ids

    def _packed(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if _ODD_SPACE.search(text):
            return self._packed(self.find(text))
        # Every space stands between two others, so that no piece of the pattern runs over it but as its first sign.
        first, *rest = text.split(" ")
        return self._packed(self.find(first)) + b"".join(map(self.words.__getitem__, rest))

    @cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' bytes in a row, and where each starts and how long it is."""
        tokens = [self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        flat, starts, sizes = self._table
        n = sizes[ids]
        before = np.cumsum(n) - n
        return flat[np.repeat(starts[ids] - before, n) + np.arange(n.sum())].tobytes()


_made: dict[tuple, Encoder] = {}


def _encoder(key: tuple, ranks: dict[bytes, int], pattern: str) -> Encoder:
    """One encoder a worker process."""
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(ranks, pattern)
    return _made[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``, if asked for).

    Ids are hashed as little-endian unsigned 32-bit integers; the decoded bytes come from decoding those ids.
    """
    ship(docs.sparkSession)
    ranks = read_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    key = (ranks_path, len(ranks), pattern)
    rows = id_text(docs, id_col, text_col)
    out = rows.drop("text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        out = out.add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared.value, pattern)
        sha = hashlib.sha256
        for batch in batches:
            n, a, b, packed = [], [], [], []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py())
                n.append(len(ids) // 4)
                a.append(sha(ids).hexdigest())
                b.append(sha(encoder.decode(ids)).hexdigest())
                if with_ids:
                    packed.append(ids)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if with_ids:
                arrays.append(pa.array(packed, pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, out.names)

    return rows.mapInArrow(run, out)
