"""Token-id output as shards compressed by Re-Pair grammars.

Documents are dealt to range partitions in ascending order of their id, encoded, and gathered into shards of about
SHARD_TOKENS ids. In each shard frequent pairs of neighbouring symbols are replaced by nonterminals, round after
round, until no pair pays for its rule; pairs never cross the border of two documents. A shard's record holds the
symbols, the rules in order, the expansion length of each nonterminal, and for each document its id and where its
symbols and its ids start, so that one document can be decoded alone. Records are rows of a Parquet table in the
shared folder, which Spark writes and reads in any store.

Results in odd cases: null text counts as empty, and a document without ids holds its end id only; rows with one id
follow each other by a hash of their text (repeated rows hold the same ids one after the other); a null id comes
first; an empty table makes no shard and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sosrank.llm.common import give_back, id_text, scratch, ship
from sosrank.llm.word_tokens import read_vocabulary, stretches, word_encoder

END_ID = 1
SHARD_TOKENS = 1 << 20
#: Occurrences that a pair must have: its rule takes two symbols and a length, and each occurrence saves one symbol.
MIN_COUNT = 12
#: A round replaces the pairs that are at least this share as frequent as the most frequent one; the rest wait, as
#: their counts change by the replacements.
ROUND_SHARE = 1 / 64


@dataclass
class Grammar:
    """``symbols`` from ``base`` on are nonterminals: rule ``symbol - base``; ``rounds`` says how many rules each
    round had."""

    symbols: np.ndarray
    rules: np.ndarray
    rounds: np.ndarray
    base: int
    starts: np.ndarray  # of each document's symbols, and where the last ends

    def lengths(self) -> np.ndarray:
        """How many ids each nonterminal expands to; a rule only uses symbols of earlier rounds."""
        out = np.ones(len(self.rules), np.int64)
        at = 0
        for n in self.rounds.tolist():
            left, right = self.rules[at:at + n, 0], self.rules[at:at + n, 1]
            out[at:at + n] = sum(np.where(s >= self.base, out[np.maximum(s - self.base, 0)], 1)
                                 for s in (left.astype(np.int64), right.astype(np.int64)))
            at += n
        return out


def _chosen(at: np.ndarray, rank: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which of the pairs at places ``at`` (ascending) are replaced: of two that overlap the better rank, in a run of
    one pair every second. ``after`` is the place of each pair's second symbol."""
    n = len(at)
    touches = np.zeros(n + 1, bool)  # whether a pair overlaps the one before it
    touches[1:n] = at[1:] == after[:-1]
    same, better_before, better_after = (np.zeros(n, bool) for _ in range(3))
    same[1:] = touches[1:n] & (rank[1:] == rank[:-1])
    better_before[1:] = touches[1:n] & (rank[:-1] < rank[1:])
    better_after[:-1] = touches[1:n] & (rank[1:] < rank[:-1])
    place = np.arange(n)
    run = np.maximum.accumulate(np.where(same, 0, place))
    return ((place - run) % 2 == 0) & ~better_after & ~(better_before[run] & (place == run))


def _by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sorted by key, then value (neither negative): as one number where the two fit in it, which is far faster."""
    if not len(keys):
        return keys, values
    bits = int(values.max()).bit_length()
    if int(keys.max()).bit_length() + bits <= 63:
        both = np.sort((keys << bits) | values)
        return both >> bits, both & ((1 << bits) - 1)
    order = np.lexsort((values, keys))
    return keys[order], values[order]


class _Pairs:
    """The pairs that occur MIN_COUNT times or more: their symbols, counts and places.

    A pair's count only falls once it is known, so that rarer ones are never looked at again.
    """

    def __init__(self, n: int, base: int):
        self.symbol_bits = (base + n).bit_length()
        self.marked = np.zeros(n, bool)
        self.of = np.full(n, -1, np.int64)  # place -> number of the pair that begins there
        self.keys = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.places = np.zeros(0, np.int64)

    def distinct(self, *places: np.ndarray) -> np.ndarray:
        """Places, ascending, each once; below 0 is none."""
        for p in places:
            self.marked[p[p >= 0]] = True
        out = np.flatnonzero(self.marked)
        self.marked[out] = False
        return out

    def add(self, places: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """Pairs that were not there before, at ``places``."""
        ranked, places = _by_key((left << self.symbol_bits) | right, places)
        starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else ranked
        sizes = np.diff(np.concatenate([starts, [len(ranked)]]))
        often = sizes >= MIN_COUNT
        if not often.any():
            return
        held = places[np.repeat(often, sizes)]
        sizes, number = sizes[often], len(self.counts) + np.arange(int(often.sum()))
        self.of[held] = np.repeat(number, sizes)
        self.keys = np.concatenate([self.keys, ranked[starts[often]]])
        self.counts = np.concatenate([self.counts, sizes])
        self.first = np.concatenate([self.first, len(self.places) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.places = np.concatenate([self.places, held])

    def drop(self, places: np.ndarray) -> None:
        """The pairs at ``places`` (each once) are gone."""
        lost = self.of[places]
        self.of[places] = -1
        self.counts -= np.bincount(lost[lost >= 0], minlength=len(self.counts))

    def at(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs ``numbers``, ascending, and which of them each is."""
        sizes = self.size[numbers]
        which = np.repeat(np.arange(len(numbers)), sizes)
        index = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes - self.first[numbers], sizes)
        places = self.places[index]
        still = self.of[places] == numbers[which]
        return _by_key(places[still], which[still])

    def symbols(self, numbers: np.ndarray) -> np.ndarray:
        """The two symbols of each pair."""
        keys = self.keys[numbers]
        return np.stack([keys >> self.symbol_bits, keys & ((1 << self.symbol_bits) - 1)], axis=1)


def compress(ids: np.ndarray, starts: np.ndarray, base: int) -> Grammar:
    """Re-Pair over ``ids`` (each below ``base``); documents start at ``starts``, the last of which is ``len(ids)``.

    Symbols are a list linked by place. Pairs are counted once; a round only touches the places of the pairs that it
    replaces and their neighbours, where all new pairs hold a symbol of the round.
    """
    n = len(ids)
    seq = ids.astype(np.int64)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    edges = starts[(starts > 0) & (starts < n)]
    after[edges - 1], before[edges] = -1, -1  # documents are lists of their own
    if n:
        after[-1] = -1
    alive = np.ones(n, bool)
    pairs, rules, rounds, size = _Pairs(n, base), [], [], base
    whole = np.flatnonzero(after >= 0)
    pairs.add(whole, seq[whole], seq[after[whole]])
    while len(pairs.counts) and pairs.counts.max() >= MIN_COUNT:
        picked = np.flatnonzero(pairs.counts >= max(MIN_COUNT, int(pairs.counts.max() * ROUND_SHARE)))
        picked = picked[np.argsort(-pairs.counts[picked], kind="stable")]
        at, rank = pairs.at(picked)
        take = _chosen(at, rank, after[at])
        hit, rank = at[take], rank[take]
        second, previous = after[hit], before[hit]
        # pairs that end or begin with a replaced symbol are gone, each once
        pairs.drop(pairs.distinct(hit, second, previous))
        seq[hit] = size + rank
        alive[second] = False
        following = after[second]
        after[hit] = following
        before[following[following >= 0]] = hit[following >= 0]
        rules.append(pairs.symbols(picked))
        new = pairs.distinct(hit, before[hit])  # where the symbol before was replaced as well, its new one
        new = new[after[new] >= 0]
        pairs.add(new, seq[new], seq[after[new]])
        rounds.append(len(picked))
        size += len(picked)
    symbol_starts = np.concatenate([[0], np.cumsum(alive)])[starts]
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return Grammar(seq[alive].astype("<u4"), table.astype("<u4"), np.array(rounds, np.int64), base, symbol_starts)


def expand(g: Grammar, symbols: np.ndarray) -> np.ndarray:
    """The ids of a stretch of symbols; of a long one by a table of all rules' expansions."""
    if not 0 < len(g.rules) < len(symbols):
        return _opened(g, symbols)
    lengths, terminals = g.lengths(), np.arange(g.base)
    table = np.concatenate([terminals, _opened(g, g.base + np.arange(len(g.rules)))]).astype("<u4")
    first = np.concatenate([terminals, g.base + np.cumsum(lengths) - lengths])
    size = np.concatenate([np.ones(g.base, np.int64), lengths])
    return table[stretches(first[symbols], size[symbols])]


def _opened(g: Grammar, symbols: np.ndarray) -> np.ndarray:
    """All nonterminals are replaced by their rules until none is left."""
    out = symbols.astype(np.int64)
    while True:
        hit = out >= g.base
        if not hit.any():
            return out.astype("<u4")
        wide = np.repeat(out, 1 + hit)
        at = np.flatnonzero(hit) + np.arange(hit.sum())
        pair = g.rules[out[hit] - g.base].astype(np.int64)
        wide[at], wide[at + 1] = pair[:, 0], pair[:, 1]
        out = wide


def _pack(symbols: np.ndarray) -> bytes:
    """Low halves, then high halves, which are mostly alike."""
    return (symbols & 0xFFFF).astype("<u2").tobytes() + (symbols >> 16).astype("<u2").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    low, high = np.frombuffer(data, "<u2").reshape(2, -1).astype(np.uint32)
    return low | high << 16


_SHARD = ("part int, seq int, n_tokens long, base long, symbols binary, rules binary, rounds array<long>, "
          "rule_lengths binary, doc_id array<{id}>, symbol_start array<long>, token_start array<long>")


def _record(part: int, seq: int, doc_ids: list, packed: list[bytes], base: int) -> dict:
    sizes = np.fromiter((len(p) // 4 for p in packed), np.int64, len(packed))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    g = compress(np.frombuffer(b"".join(packed), "<u4"), starts, base)
    return {"part": part, "seq": seq, "n_tokens": int(starts[-1]), "base": base, "symbols": _pack(g.symbols),
            "rules": _pack(g.rules.reshape(-1)), "rounds": g.rounds.tolist(),
            "rule_lengths": g.lengths().astype("<u4").tobytes(), "doc_id": doc_ids,
            "symbol_start": g.starts.tolist(), "token_start": starts.tolist()}


def grammar_of(record: dict) -> Grammar:
    return Grammar(_unpack(record["symbols"]), _unpack(record["rules"]).reshape(-1, 2),
                   np.array(record["rounds"], np.int64), record["base"], np.array(record["symbol_start"], np.int64))


def decode_document(record: dict, i: int) -> np.ndarray:
    """The ids of the shard's ``i``-th document, from its own symbols only."""
    g = grammar_of(record)
    return expand(g, g.symbols[g.starts[i]:g.starts[i + 1]])


def decode_stretch(record: dict, i: int, start: int, stop: int) -> np.ndarray:
    """The ids ``start`` to ``stop`` (exclusive) of the shard's ``i``-th document.

    The stored expansion lengths tell which symbols the stretch lies in; a nonterminal at either end that reaches over
    it is opened until its parts do not, so that little more than the stretch itself is expanded.
    """
    g = grammar_of(record)
    lengths = np.frombuffer(record["rule_lengths"], "<u4").astype(np.int64)
    symbols = g.symbols[g.starts[i]:g.starts[i + 1]].astype(np.int64)
    size = lambda s: np.where(s >= g.base, lengths[np.maximum(s - g.base, 0)], 1) if len(lengths) else np.ones_like(s)
    while True:
        ends = np.cumsum(size(symbols))
        start, stop = max(0, start), min(stop, int(ends[-1]) if len(ends) else 0)
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
        skipped = int(ends[first - 1]) if first else 0
        symbols, ends = symbols[first:last + 1], ends[first:last + 1] - skipped
        start, stop = start - skipped, stop - skipped
        open_first = start > 0 and symbols[0] >= g.base
        open_last = stop < ends[-1] and symbols[-1] >= g.base
        if not open_first and not open_last:
            return expand(g, symbols)
        parts = [g.rules[symbols[0] - g.base].astype(np.int64)] if open_first else [symbols[:1]]
        if len(symbols) > 1:
            parts += [symbols[1:-1], g.rules[symbols[-1] - g.base].astype(np.int64) if open_last else symbols[-1:]]
        elif not open_first:
            parts = [g.rules[symbols[0] - g.base].astype(np.int64)]
        symbols = np.concatenate(parts)


def _plain_id(kind: str) -> str:
    return "long" if kind == "bigint" else kind


def write_shards(docs: DataFrame, path: str, tokenizer: str, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Encode all documents in ascending order of their id and write the shards to ``path`` as Parquet.

    Nonterminals are numbered from the vocabulary's size on.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer))
    rows = id_text(docs, id_col, text_col)
    ordered = (rows.withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h")
               .sortWithinPartitions("doc_id", "_h").select("doc_id", "text"))
    kind = _plain_id(rows.schema["doc_id"].dataType.simpleString())
    schema = _SHARD.format(id=kind)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = word_encoder(tokenizer, shared.value), TaskContext.get().partitionId(), 0
        base = max(len(encoder.ends), END_ID + 1)
        ids: list = []
        packed: list[bytes] = []
        held = 0
        for batch in batches:
            arrow = {f.name: f.type for f in batch.schema}
            found = encoder.encode_batch(batch.column(1))
            for doc_id, own in zip(batch.column(0).to_pylist(), found, strict=True):
                ids.append(doc_id)
                packed.append(own + end)
                held += len(own) // 4 + 1
                if held >= shard_tokens:
                    yield _batch(_record(part, seq, ids, packed, base), arrow["doc_id"])
                    ids, packed, held, seq = [], [], 0, seq + 1
        if ids:
            yield _batch(_record(part, seq, ids, packed, base), arrow["doc_id"])
        ids, packed = [], []
        give_back()

    ordered.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def _batch(record: dict, id_type: pa.DataType) -> pa.RecordBatch:
    i32, i64, b = pa.int32(), pa.int64(), pa.binary()
    types = {"part": i32, "seq": i32, "n_tokens": i64, "base": i64, "symbols": b, "rules": b,
             "rounds": pa.list_(i64), "rule_lengths": b, "doc_id": pa.list_(id_type), "symbol_start": pa.list_(i64),
             "token_start": pa.list_(i64)}
    return pa.RecordBatch.from_arrays([pa.array([record[k]], t) for k, t in types.items()], list(types))


def read_shards(docs_schema: StructType, spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row a document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    kind = _plain_id(docs_schema[id_col].dataType.simpleString())
    shards = spark.read.schema(_SHARD.format(id=kind)).parquet(path)
    # ids before a shard: those of earlier parts (one row a part), and of its part's earlier shards
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("_in_part"))
               .join(parts, "part").select("part", "seq", (F.col("_in_part") + F.col("_part_start")).alias("_before")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field("doc_id").type.value_type
            for i in range(batch.num_rows):
                r = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                g = grammar_of(r)
                data, starts = expand(g, g.symbols).tobytes(), r["token_start"]
                sums = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(starts, starts[1:], strict=False)]
                at = np.array(starts, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * len(sums), pa.int32()), pa.array([r["seq"]] * len(sums), pa.int32()),
                     pa.array(r["doc_id"], id_type), pa.array(at[:-1]), pa.array(np.diff(at)),
                     pa.array(sums, pa.int64())], ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = shards.mapInArrow(run, f"part int, seq int, doc_id {kind}, at long, n_tokens long, ids_crc32 long")
    return found.join(offsets, ["part", "seq"]).select(
        "doc_id", (F.col("_before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Write the shards (to ``path``, or a folder of their own in the shared one) and read them back."""
    spark = docs.sparkSession
    path = path or scratch(spark, "shards")
    write_shards(docs, path, tokenizer, id_col=id_col, text_col=text_col)
    return read_shards(docs.schema, spark, path, id_col)
