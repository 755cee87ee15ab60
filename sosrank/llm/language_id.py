"""Language identification by compression with zstandard raw-content dictionaries.

Each language has a dictionary: raw text of its labelled documents, lower case, letters only. A text is encoded with
every dictionary, block by block, and the language with the smallest total wins. A win by a narrow margin is marked
as rejected (``reliable`` false); ``lang_pred`` still names the winner, as the contract of the query asks.

The dictionaries are fitted on a bounded sample: for each language the DOCS_PER_LANG labelled documents with the
lowest hash of their id (of those with a letter), CHARS_PER_DOC characters each, from a place of the text that a hash
chooses, so that openings which a source's texts share do not fill them. Prediction reads every character of every text.

Results in odd cases: a null text, or one without a letter, is ``und`` with score 0 and not reliable; ties go to the
language with more labelled rows; rows repeated with one id are predicted alike; without any labelled row every text is
``und``; a null lang is never learned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sosrank.llm.common import ship

DOCS_PER_LANG = 256
CHARS_PER_DOC = 1024
#: Bytes of a text that are encoded at a time. Each block starts from the dictionary again, so the end of a long text
#: weighs as much as its start, and a text that repeats itself gains little from its own words.
BLOCK = 512
#: zstandard's level.
LEVEL = 3
#: A win is reliable if the runner-up needs at least this much more, relative to the winner.
MARGIN = 0.02
#: Bytes of margin that change the odds of the winner by a factor of e.
SCALE = 3.0

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """The text's words of letters in lower case, one space around each; empty if it has no letter."""
    out = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {out} " if any(map(str.isalpha, out)) else ""


class Compressors:
    """For each language a zstandard compressor over its dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.langs, self.compress = list(dictionaries), []
        for lang in self.langs:
            d = z.ZstdCompressionDict(dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compress.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False,
                                                  write_content_size=False, write_dict_id=False).compress)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        data = letters(text).encode()
        if not data or not self.langs:
            return "und", 0.0, False
        blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = [sum(len(c(b)) for b in blocks) for c in self.compress]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        low = sizes[best]
        score = 1 / sum(math.exp(-min(50.0, (s - low) / SCALE)) for s in sizes)
        second = min((s for i, s in enumerate(sizes) if i != best), default=2 * low)
        return self.langs[best], score, second - low >= MARGIN * low


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        docs_per_lang: int = DOCS_PER_LANG, chars_per_doc: int = CHARS_PER_DOC) -> dict[str, bytes]:
    """Dictionaries by language, at most ``docs_per_lang * chars_per_doc`` characters each; commonest language first."""
    scale = 1 << 40
    order = F.pmod(F.xxhash64(F.lit("fit"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(scale))
    clean = F.trim(F.regexp_replace(F.lower(F.col(text_col)), r"[^\p{L}]+", " "))
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = rows.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return {}
    # about twice as many rows of a language as are wanted, whatever the number it has; the driver takes the first
    below = F.create_map(*[x for r in counts for x in (F.lit(r[0]), F.lit(scale * 2 * docs_per_lang // r.n))])
    spare = F.greatest(F.char_length(clean) - chars_per_doc, F.lit(0))
    start = F.pmod(F.xxhash64(F.lit("start"), F.col(text_col)), spare + 1).cast("int") + 1
    chosen = rows.select(F.col(lang_col).alias("lang"), order.alias("h"),
                         F.substr(clean, start, F.lit(chars_per_doc)).alias("text"))
    parts: dict[str, list[str]] = {}
    for r in sorted(chosen.filter(F.col("h") < below[F.col("lang")]).select("lang", "h", "text").collect()):
        if r.text and len(parts.setdefault(r.lang, [])) < docs_per_lang:
            parts[r.lang].append(r.text)
    common = sorted(counts, key=lambda r: (-r.n, r[0]))
    return {r[0]: " ".join(parts[r[0]]).encode() for r in common if parts.get(r[0])}


_made: dict[int, tuple[dict[str, bytes], Compressors]] = {}


def _compressors(key: int, dictionaries: dict[str, bytes]) -> Compressors:
    """One set a worker process, made anew for other dictionaries."""
    if key not in _made:
        _made.clear()
        _made[key] = (dictionaries, Compressors(dictionaries))
    return _made[key][1]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], keep: dict[str, Column] | None = None,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, <keep...>, lang_pred, score, reliable`` for each row; ``keep`` names columns to carry along."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in (keep or {}).items()],
                       F.col(text_col).alias("_text"))
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    key = hash(tuple(dictionaries.items()))
    out = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double").add("reliable", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _compressors(key, shared.value)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            cols = [list(c) for c in zip(*found, strict=True)] or [[], [], []]
            arrays = [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], out.names)

    return rows.mapInArrow(run, out)
