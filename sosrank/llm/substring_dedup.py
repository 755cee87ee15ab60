"""Removal of passages that repeat over documents: windows of words found by level-wise doubling.

Documents are gathered into blocks of about BLOCK_WORDS words, written once as a table bucketed by block, so that
later passes join their results to it without moving texts. A level hashes windows of one length; a block sends each
distinct hash once, packed by hash bucket, and a bucket answers each block with one bit a hash. At the shorter levels
the bit says that the window occurs elsewhere too, and only where both halves repeat is a window of twice the length
looked at; at the last level it says whether the block holds the window's first occurrence (smallest id, then
start). Levels go on until windows have their full length or no candidate survives: where no window of a level repeats,
nothing is removed and the longer levels are not run. A window that many documents share is one entry a block, so no bucket or task gathers its occurrences.

Hashes of the shorter levels are 32 bits within a bucket: a collision only adds a candidate. The last level compares
96 bits within a bucket.

Results in odd cases: null text has no words; a text shorter than a window keeps everything; rows repeated with one id
are ordered by block and place, so the later lose what the first holds; a null id comes before all others; an empty
table gives an empty result; other columns are ignored. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sosrank.llm.common import give_back, scratch, ship, written

WINDOW = 20
#: Window lengths: each twice the one before, the last is WINDOW.
LEVELS = 3
BLOCK_WORDS = 1 << 20
#: Distinct windows that a bucket holds, about, and the fewest buckets.
BUCKET_WINDOWS, LEAST_BUCKETS = 1 << 20, 64
_PRIMES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SEED = 7
NO_ID = -(1 << 63)


#: Shorter data stands as it is: its compression would take more time and room than it saves.
LEAST_SQUEEZED = 64


def _squeeze(data: bytes) -> bytes:
    import zstandard

    return b"z" + zstandard.ZstdCompressor(level=3).compress(data) if len(data) >= LEAST_SQUEEZED else b"-" + data


def _expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data[1:]) if data[:1] == b"z" else data[1:]


def _stretches(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(value, from, to)`` of each value that occurs: its cost grows with the values there, not with all possible."""
    cuts = np.flatnonzero(np.diff(sorted_values)) + 1
    starts = np.concatenate([[0], cuts]) if len(sorted_values) else cuts
    ends = np.append(cuts, len(sorted_values))
    yield from zip(sorted_values[starts].tolist(), starts.tolist(), ends.tolist(), strict=False)


def _pack_array(a: np.ndarray) -> bytes:
    """Bytes of equal significance stand together, which makes steps of sorted numbers and ids compress well."""
    width = a.dtype.itemsize
    return _squeeze(a.view(np.uint8).reshape(-1, width).T.tobytes())


def _unpack_array(data: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(_expand(data), np.uint8).reshape(width, -1).T).view(dtype).reshape(-1)


def _steps(sorted_values: np.ndarray) -> np.ndarray:
    out = sorted_values.copy()
    out[1:] -= sorted_values[:-1]
    return out


#: Bytes of a block that are taken apart at a time.
STRETCH = 1 << 16


class Block:
    """A block's words, one after the other with a blank between two, and hashes of its windows."""

    def __init__(self, words: bytes, sizes: list[int]):
        import xxhash

        self.data = _expand(words)
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.repeat(np.cumsum(self.sizes), self.sizes)
        n = len(self.ends)
        self.word_hashes, self.stops = np.empty(n, np.uint64), np.empty(n, np.int64)
        h, at, done = xxhash.xxh64_intdigest, 0, 0
        while done < n:  # a stretch at a time: words as objects of their own take many times their length
            cut = self.data.find(b" ", at + STRETCH)
            some = self.data[at:cut if cut >= 0 else None].split(b" ")
            here = slice(done, done + len(some))
            self.word_hashes[here] = np.fromiter((h(w, _SEED) for w in some), np.uint64, len(some))
            self.stops[here] = at + np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1
            done, at = done + len(some), cut + 1

    def __len__(self) -> int:
        return len(self.ends)

    def text(self, first: int, last: int, gone: np.ndarray) -> bytes:
        """The words from ``first`` to before ``last`` that are not ``gone``."""
        starts = np.flatnonzero(np.diff(gone[first:last].astype(np.int8), prepend=1, append=1))
        begin = lambda w: int(self.stops[w - 1]) + 1 if w else 0
        return b" ".join(self.data[begin(first + a):int(self.stops[first + b - 1])]
                         for a, b in zip(starts[::2].tolist(), starts[1::2].tolist(), strict=True))

    def starts(self, length: int) -> np.ndarray:
        """Where a window of so many words fits in its document."""
        return np.flatnonzero(np.arange(len(self)) + length <= self.ends)

    def hashes(self, length: int, prime: int = _PRIMES[0]) -> np.ndarray:
        """Hash of the window at each word (meaningful where it fits), by doubling shorter windows."""
        at, size, p = self.word_hashes, 1, prime
        for bit in bin(length)[3:]:
            at = at + np.uint64(pow(p, size, 1 << 64)) * np.concatenate([at[size:], np.zeros(min(size, len(at)),
                                                                                             np.uint64)])
            size *= 2
            if bit == "1":
                shifted = np.concatenate([self.word_hashes[size:], np.zeros(min(size, len(at)), np.uint64)])
                at = at + np.uint64(pow(p, size, 1 << 64)) * shifted
                size += 1
        return _mixed(at)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _entries(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, ascending; the first place of each; for each place the number of its hash."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(ranked), np.int64)
    number[order] = np.cumsum(new) - 1
    return ranked[new], order[new], number


def _coarse(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bucket (upper ``bits``) and the 32 bits after it: what the shorter levels compare."""
    return hashes >> np.uint64(32 - bits)


def _make_blocks(docs: DataFrame, id_col: str, text_col: str, block_words: int) -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"))
    schema = ("block long, doc_id array<long>, text_key array<long>, n_words array<long>, total long, words binary")

    def record(block: int, held: list) -> pa.RecordBatch:
        held.sort(key=lambda r: NO_ID if r[0] is None else r[0])
        sizes = [r[3] for r in held]
        cols = {"block": pa.array([block], pa.int64()),
                "doc_id": pa.array([[r[0] for r in held]], pa.list_(pa.int64())),
                "text_key": pa.array([[r[1] for r in held]], pa.list_(pa.int64())),
                "n_words": pa.array([sizes], pa.list_(pa.int64())), "total": pa.array([sum(sizes)], pa.int64()),
                "words": pa.array([_squeeze(b" ".join(r[2] for r in held if r[2]))], pa.binary())}
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seq, held, n = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            for doc_id, text, key in zip(*(c for c in batch.columns), strict=True):
                words = (text.as_py() or "").encode().split()
                held.append((doc_id.as_py(), key.as_py(), b" ".join(words), len(words)))
                n += len(words)
                if n >= block_words:
                    yield record(first + seq, held)
                    seq, held, n = seq + 1, [], 0
        if held:
            yield record(first + seq, held)
        held = None
        give_back()

    return rows.mapInArrow(run, schema)


def _send(buckets: int, keys: np.ndarray, extra: list[np.ndarray], block: int) -> Iterator[pa.RecordBatch]:
    """One row a bucket with entries: the block's ascending ``keys`` there and what belongs to them, packed."""
    bits = buckets.bit_length() - 1
    of = (keys >> np.uint64(64 - bits)).astype(np.int64)
    blobs, where = [], []
    for b, lo, hi in _stretches(of):
        where.append(b)
        blobs.append([_pack_array(_steps(keys[lo:hi])), *[_pack_array(x[lo:hi]) for x in extra]])
    yield pa.RecordBatch.from_arrays(
        [pa.array([block] * len(where), pa.int64()), pa.array(where, pa.int32()),
         pa.array(blobs, pa.list_(pa.binary()))], ["block", "bucket", "blobs"])


def _answer(group: pa.Table, last_level: bool) -> pa.Table:
    """One bucket: a bit for each block's entry (repeated elsewhere, or at the last level first of all)."""
    blocks = group.column("block").to_pylist()
    blobs = group.column("blobs").to_pylist()
    kind = "<u8" if last_level else "<u4"
    keys = [np.cumsum(_unpack_array(x[0], kind), dtype=kind) for x in blobs]
    sizes = np.array([len(k) for k in keys])
    key = np.concatenate(keys)
    keys = None
    if last_level:
        second = np.concatenate([_unpack_array(x[1], "<u4") for x in blobs])
        ids = np.concatenate([_unpack_array(x[2], "<i8") for x in blobs])
        order = np.lexsort((np.repeat(np.array(blocks), sizes), ids, second, key))
        ids = None
        k, s = key[order], second[order]
        bit = np.ones(len(k), bool)
        bit[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    else:
        many = np.concatenate([np.unpackbits(np.frombuffer(_expand(x[1]), np.uint8), count=n)
                               for x, n in zip(blobs, sizes.tolist(), strict=True)]).astype(bool)
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = k[1:] == k[:-1]
        bit = many[order]
        bit[1:] |= same
        bit[:-1] |= same
    bits = np.empty(len(key), bool)
    bits[order] = bit
    ends = np.cumsum(sizes)
    n_set = [int(bits[e - n:e].sum()) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    packed = [_squeeze(np.packbits(bits[e - n:e]).tobytes()) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": group.column("bucket"),
                     "n": pa.array(sizes, pa.int64()), "n_set": pa.array(n_set, pa.int64()),
                     "bits": pa.array(packed, pa.binary())})


def _bits_of(answers: list[dict] | None) -> np.ndarray:
    """A block's bits in the order of its ascending keys."""
    parts = [np.unpackbits(np.frombuffer(_expand(a["bits"]), np.uint8), count=a["n"])
             for a in sorted(answers or [], key=lambda a: a["bucket"])]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _candidates(block: Block, level: int, lengths: list[int], answers: list[list[dict]], bits: int) -> np.ndarray:
    """Places of the level's windows both halves of which repeat; all places at the first level."""
    at = block.starts(lengths[0])
    for i in range(level):
        coarse, _, number = _entries(_coarse(block.hashes(lengths[i])[at], bits))
        repeats = np.zeros(len(block) + lengths[i] + 1, bool)
        repeats[at] = _bits_of(answers[i])[number]
        at = block.starts(lengths[i + 1])
        at = at[repeats[at] & repeats[at + lengths[i]]]
    return at


def _level_rows(row: dict, level: int, lengths: list[int], buckets: int) -> Iterator[pa.RecordBatch]:
    """A block's entries at a level."""
    block = Block(row["words"], row["n_words"])
    bits = buckets.bit_length() - 1
    at = _candidates(block, level, lengths, row["answers"], bits)
    hashes = block.hashes(lengths[level])[at]
    if level + 1 < len(lengths):
        keys, _, number = _entries(_coarse(hashes, bits))
        # bucket and 32 bits, moved to the top of 64 bits; a second occurrence in the block is enough to repeat
        many = np.bincount(number, minlength=len(keys)) > 1
        yield from _send_coarse(keys, many, row["block"])
    else:
        keys, first, _ = _entries(hashes)
        second = (block.hashes(lengths[level], _PRIMES[1])[at[first]] >> np.uint64(32)).astype("<u4")
        ids = np.array([NO_ID if i is None else i for i in row["doc_id"]], "<i8")
        doc = np.searchsorted(np.cumsum(block.sizes), at[first], side="right")
        yield from _send(buckets, keys, [second, ids[doc]], row["block"])


def _send_coarse(keys: np.ndarray, many: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    of = (keys >> np.uint64(32)).astype(np.int64)
    low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
    where, blobs = [], []
    for b, lo, hi in _stretches(of):
        where.append(b)
        blobs.append([_pack_array(_steps(low[lo:hi])), _squeeze(np.packbits(many[lo:hi]).tobytes())])
    yield pa.RecordBatch.from_arrays(
        [pa.array([block] * len(where), pa.int64()), pa.array(where, pa.int32()),
         pa.array(blobs, pa.list_(pa.binary()))], ["block", "bucket", "blobs"])


def _removed(row: dict, lengths: list[int], buckets: int) -> tuple[Block, np.ndarray]:
    """Which words of a block are covered by a window that also starts earlier; none if a level found no candidate."""
    block = Block(row["words"], row["n_words"])
    last = len(lengths) - 1
    if len(row["answers"]) <= last:
        return block, np.zeros(len(block), bool)
    at = _candidates(block, last, lengths, row["answers"], buckets.bit_length() - 1)
    _, first, number = _entries(block.hashes(lengths[last])[at])
    is_first = np.zeros(len(at), bool)
    is_first[first] = _bits_of(row["answers"][last])
    later = at[~is_first]
    edge = np.zeros(len(block) + 1, np.int64)
    edge[later] += 1
    np.add.at(edge, later + lengths[last], -1)
    return block, np.cumsum(edge[:-1]) > 0


def _sender(level: int, lengths: list[int], buckets: int) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _level_rows(batch.slice(i, 1).to_pylist()[0], level, lengths, buckets)
        give_back()

    return send


def _answerer(last_level: bool) -> Callable:
    def answer(group: pa.Table) -> pa.Table:
        out = _answer(group, last_level)
        give_back()
        return out

    return answer


def _with_answers(blocks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """Blocks, each with its answers of all levels so far; the bucketed side is not shuffled."""
    out, names = blocks, []
    for i, a in enumerate(answers):
        of = a.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias(f"a{i}"))
        out = out.join(of.hint("merge"), "block", "left")
        names.append(f"a{i}")
    empty = F.array().cast("array<struct<bucket:int,n:bigint,bits:binary>>")
    made = F.array(*[F.coalesce(n, empty) for n in names]) if names else F.array(empty)
    return out.withColumn("answers", made).drop(*names)


def remove_repeats(docs: DataFrame, window: int = WINDOW, levels: int = LEVELS, with_text: bool = False,
                   id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row a document: ``doc_id, text_key, n_words, n_removed, kept_sha256`` (and ``text``, the kept words).

    ``text_key`` is xxhash64 of the text, to join the result to rows whose ids are not unique.
    """
    if window % (1 << (levels - 1)):
        raise ValueError("the window must be divisible down to the first level")
    spark = docs.sparkSession
    lengths = [window >> k for k in reversed(range(levels))]
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = _make_blocks(docs, id_col, text_col, block_words)
    path = scratch(spark, "blocks")
    name = "blocks_" + path.rpartition("-")[2]
    (made.repartition(files, "block").write.format("parquet").option("path", path).bucketBy(files, "block")
     .sortBy("block").saveAsTable(name))
    blocks = spark.table(name)
    words = blocks.agg(F.sum("total")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, 1 << max(0, (words // BUCKET_WINDOWS)).bit_length())
    answers: list[DataFrame] = []
    for level in range(levels):
        sent = _with_answers(blocks, answers).mapInArrow(_sender(level, lengths, buckets),
                                                         "block long, bucket int, blobs array<binary>")
        found = sent.groupBy("bucket").applyInArrow(_answerer(level + 1 == levels),
                                                    "block long, bucket int, n long, n_set long, bits binary")
        answers.append(written(found, f"level{level}"))
        if level + 1 < levels and not answers[-1].agg(F.sum("n_set")).first()[0]:
            break

    out = "doc_id long, text_key long, n_words long, n_removed long, kept_sha256 string"
    out = f"{out}, text string" if with_text else out

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block, gone = _removed(row, lengths, buckets)
                ends = np.cumsum(block.sizes)
                n_gone = np.diff(np.concatenate([[0], np.cumsum(gone)])[np.concatenate([[0], ends])])
                texts = []
                for end, size in zip(ends.tolist(), block.sizes.tolist(), strict=True):
                    texts.append(block.text(end - size, end, gone))
                cols = {"doc_id": pa.array(row["doc_id"], pa.int64()), "text_key": pa.array(row["text_key"], pa.int64()),
                        "n_words": pa.array(block.sizes), "n_removed": pa.array(n_gone.astype(np.int64)),
                        "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())}
                if with_text:
                    cols["text"] = pa.array([t.decode() for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return _with_answers(blocks, answers).mapInArrow(finish, out)


#: DuckDB, for the query's columns: a window's first start by (doc_id, start), and the words that later ones cover.
ORACLE = """
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20
), later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth
    FROM (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS s FROM starts)
  ) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM later, range(0, 20) AS r(k)
), words AS (
  SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM t)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, (len(t.w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id
"""
