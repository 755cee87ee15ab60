"""Token ids of whole texts by the ``tokenizers`` library, for the operators that store or pack them.

The vocabulary drops white space and never joins across it, so a text's ids are those of its words in turn. Words
recur: each worker process numbers the first WORDS words that it meets and keeps their ids; a batch's other words are
encoded once a batch. The ids of a batch are then gathered by word number. A text with white space on which Python and
the library might differ is encoded whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a worker process remembers, and the longest that it remembers.
WORDS, WORD_CHARS = 450_000, 64
#: Runs that are encoded in one text, and texts in one call.
JOINED, CALL = 256, 32
#: Words that are told apart and encoded at a time, which bounds the memory that a batch of new words takes.
LEARN = 1 << 14
_RARE_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]")
#: Words of these signs are split here: lower case and composition treat them sign by sign.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: The two simplest forms: ASCII letters, and such letters before signs.
_SIMPLE = r"^(?P<letters>[A-Za-z]+)(?P<signs>[!-/:-@\[-`{-~]*)$"
#: Fixed value: how the vocabulary's file splits lower-case text, over those signs.
_RUN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")


def stretches(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places ``first``, ``first + 1``, ... of each stretch, one stretch after the other."""
    if not size.all():
        first, size = first[size > 0], size[size > 0]
    if not len(size):
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    steps = np.ones(int(ends[-1]), np.int64)  # from each place to the next
    steps[0] = first[0]
    steps[ends[:-1]] = first[1:] - first[:-1] - size[:-1] + 1
    return np.cumsum(steps)


def _cut(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    data, cuts = ids.tobytes(), (4 * ends).tolist()
    return [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


class WordEncoder:
    """Encodes batches of texts; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary_json: str):
        # a task has one core; threads of its own would only each keep memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(vocabulary_json)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        # runs need no normalising and no splitting but at the blanks between them; the model is shared
        self.run_tokenizer = Tokenizer(self.tokenizer.model)
        self.run_tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # the remembered words, their ids one after the other, and where each word's begin and how many there are
        self.words = pa.array([], pa.string())
        self.ids, self.first, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs one after the other, and how many each has: a run ends with its first word-end token."""
        texts = [" ".join(runs[i:i + JOINED]) for i in range(0, len(runs), JOINED)]
        ids = [np.zeros(0, "<u4")]
        for at in range(0, len(texts), CALL):
            found = self.run_tokenizer.encode_batch_fast(texts[at:at + CALL], add_special_tokens=False)
            ids.append(np.fromiter(chain.from_iterable(e.ids for e in found), "<u4"))
        ids = np.concatenate(ids)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(runs):
            raise ValueError("the vocabulary does not mark word ends as expected")
        return ids, np.diff(ends, prepend=0)

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: a table of ids, and where each word's begin and how many there are."""
        tables, firsts, sizes, at = [], [], [], 0
        for i in range(0, max(len(words), 1), LEARN):
            table, first, size = self._learn_some(words.slice(i, LEARN))
            tables.append(table)
            firsts.append(first + at)
            sizes.append(size)
            at += len(table)
        return np.concatenate(tables), np.concatenate(firsts), np.concatenate(sizes)

    def _learn_some(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # letters, and letters before signs, are taken apart by Arrow; words of another form one by one
        found = pc.extract_regex(words, _SIMPLE)
        simple = np.asarray(found.is_valid())
        at = np.flatnonzero(simple)
        found = found.filter(pa.array(simple))
        parts, places = [pc.ascii_lower(found.field("letters"))], [at]
        signs = found.field("signs")
        signed = np.asarray(pc.not_equal(signs, ""))
        parts.append(signs.filter(pa.array(signed)))
        places.append(at[signed])
        rest, others, other_at = words.filter(pa.array(~simple)).to_pylist(), [], []
        runs, run_at = [], []
        for i, word in zip(np.flatnonzero(~simple).tolist(), rest, strict=True):
            if _PLAIN.fullmatch(word):
                own = _RUN.findall(word.lower())
                runs += own
                run_at += [i] * len(own)
            elif word:  # empty before and after white space at the ends of a text
                others.append(word)
                other_at.append(i)
        runs = pa.concat_arrays([*parts, pa.array(runs, pa.string())]).dictionary_encode()
        run_at = np.concatenate([*places, np.array(run_at, np.int64)])
        order = np.argsort(run_at, kind="stable")  # a word's runs in their order
        ids, size = self._encode_runs(runs.dictionary.to_pylist())
        number = np.asarray(runs.indices)[order]
        table = ids[stretches((np.cumsum(size) - size)[number], size[number])]
        n = np.bincount(run_at, size[np.asarray(runs.indices)], len(words)).astype(np.int64)
        first = np.cumsum(n) - n
        whole = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        lengths = np.fromiter(map(len, whole), np.int64, len(whole))
        n[other_at], first[other_at] = lengths, len(table) + np.cumsum(lengths) - lengths
        return np.concatenate([table, np.fromiter(chain.from_iterable(whole), "<u4")]), first, n

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's end."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        odd = np.asarray(pc.match_substring_regex(texts, _RARE_SPACE.pattern))
        split = pc.utf8_split_whitespace(pc.if_else(pa.array(odd), "", texts))
        words = split.flatten().dictionary_encode()  # a batch's distinct words are looked up
        known = pc.index_in(words.dictionary, self.words)
        fresh = words.dictionary.filter(known.is_null())
        number = np.array(known.fill_null(-1), np.int64)
        number[number < 0] = len(self.words) + np.arange(len(fresh))
        new_ids, new_first, new_size = self._learn(fresh)
        ids = np.concatenate([self.ids, new_ids])
        first, size = (np.concatenate(c) for c in ((self.first, new_first + len(self.ids)), (self.size, new_size)))
        at = number[np.asarray(words.indices)]
        out = ids[stretches(first[at], size[at])]
        ends = np.concatenate([[0], np.cumsum(size[at])])[np.cumsum(np.asarray(pc.list_value_length(split)))]
        if odd.any():
            odd_ids, odd_first, odd_size = self._learn(texts.filter(pa.array(odd)))
            n, start = np.diff(ends, prepend=0), np.concatenate([[0], ends[:-1]])
            n[odd], start[odd] = odd_size, len(out) + odd_first
            out, ends = np.concatenate([out, odd_ids])[stretches(start, n)], np.cumsum(n)
        if len(self.words) < WORDS:
            self._remember(fresh, new_ids, new_first, new_size)
        return out, ends

    def _remember(self, words: pa.Array, ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        kept = np.flatnonzero(np.asarray(pc.utf8_length(words)) <= WORD_CHARS)[:WORDS - len(self.words)]
        size = size[kept]
        self.words = pa.concat_arrays([self.words, words.take(pa.array(kept))])
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.ids = np.concatenate([self.ids, ids[stretches(first[kept], size)]])
        self.size = np.concatenate([self.size, size])

    def encode_batch(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text."""
        return _cut(*self.encode(texts))


_made: dict[str, WordEncoder] = {}


def read_vocabulary(path: str) -> str:
    """The tokenizer's file, read on the driver: workers get its text by broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def word_encoder(path: str, vocabulary_json: str) -> WordEncoder:
    """One encoder a worker process."""
    if path not in _made:
        _made.clear()
        _made[path] = WordEncoder(vocabulary_json)
    return _made[path]
