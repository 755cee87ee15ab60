"""Packing of token pieces into few sequences: linear grouping, then best fit.

Large pieces are sorted and cut into GROUPS groups of equal cardinality; each group's lengths are rounded up to its
largest. Over these few sizes the driver solves the configuration problem (which combinations of sizes fill a
sequence, and how often each is used) by column generation, then Spark substitutes the actual pieces. Small pieces
go by best fit, largest first, into the space that is left, and into new sequences where none is.

The driver only sees histograms by length (at most ``capacity`` rows). Its plan consists of intervals: "pieces number
a to b of this length go into bins number c to d of that kind"; pieces and bins are numbered by Spark without
gathering a length in one task, and find their interval by a join on a table whose size depends on the capacity, not
on the number of documents.

Results in odd cases: null text counts as empty, and an empty document is one piece that holds its end id; rows
repeated with one id are packed each; pieces of equal length take their places in the order of a hash; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sosrank.llm.common import give_back, id_text, numbered, ship, written
from sosrank.llm.word_tokens import read_vocabulary, word_encoder

CAPACITY = 4096
END_ID = 1
#: Groups of equal cardinality that the large lengths are rounded in, and the share of the capacity from which a piece
#: is large.
GROUPS, LARGE_SHARE = 48, 1 / 8


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: ``doc_id, row_id, piece, start, length, ids_crc32`` (and ``ids``, if asked for)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer))
    rows = id_text(docs, id_col, text_col).select("doc_id", F.monotonically_increasing_id().alias("row_id"), "text")
    out = (rows.select("doc_id", "row_id").schema.add("piece", "integer").add("start", "long").add("length", "long")
           .add("ids_crc32", "long"))
    if with_ids:
        out = out.add("ids", "binary")
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer, shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, found in enumerate(encoder.encode_batch(batch.column(2))):
                    data = found + end
                    for k in range(0, len(data), 4 * capacity):
                        part = data[k:k + 4 * capacity]
                        row.append(i)
                        piece.append(k // (4 * capacity))
                        start.append(k // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        ids.append(part)
                arrays = [batch.column(0).take(pa.array(row, pa.int64())),
                          batch.column(1).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                          *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
                if with_ids:
                    arrays.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, out.names)
        give_back()

    return rows.mapInArrow(run, out)


def group_sizes(lengths: list[int], counts: list[int], groups: int) -> list[tuple[int, int]]:
    """Linear grouping of a histogram (ascending lengths): ``(size, cardinality)``, ascending; the groups' shares of the
    sorted pieces are equal but for rounding, and ``size`` is the largest length of the group."""
    total = sum(counts)
    ends = [total * (g + 1) // groups for g in range(groups)]
    out, seen, at = [], 0, 0
    for length, n in zip(lengths, counts, strict=True):
        seen += n
        while at < groups and ends[at] <= seen:
            before = ends[at - 1] if at else 0
            if ends[at] > before:
                out.append((length, ends[at] - before))
            at += 1
    merged: dict[int, int] = {}
    for size, n in out:
        merged[size] = merged.get(size, 0) + n
    return sorted(merged.items())


def _best_pattern(sizes: np.ndarray, values: np.ndarray, bounds: np.ndarray, capacity: int) -> np.ndarray:
    """The combination of sizes within the capacity with the highest value: a bounded knapsack over token counts."""
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(sizes), capacity + 1), np.int64)
    for i, (s, v) in enumerate(zip(sizes.tolist(), values.tolist(), strict=True)):
        base = best.copy()
        for k in range(1, min(int(bounds[i]), capacity // s) + 1):
            with_k = np.full(capacity + 1, -1.0)
            with_k[k * s:] = base[:capacity + 1 - k * s] + k * v
            better = with_k > best + 1e-12
            best[better], taken[i][better] = with_k[better], k
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    for i in range(len(sizes) - 1, -1, -1):
        pattern[i] = taken[i][room]
        room -= int(pattern[i] * sizes[i])
    return pattern


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 200) -> list[tuple[list[int], int]]:
    """``(pieces of each size, sequences)`` that together hold all counts: column generation for the linear programme,
    its basis rounded down, and the rest filled pattern by pattern. Sequences may have spare places."""
    if not sizes:
        return []
    s, need = np.array(sizes, np.int64), np.array(counts, np.int64)
    k = len(s)
    basis = np.diag(capacity // s).astype(float)
    x = need / np.diag(basis)
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(k))
        column = _best_pattern(s, np.maximum(duals, 0), np.full(k, capacity), capacity)
        if column @ duals <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column.astype(float))
        able = step > 1e-9
        ratio = np.where(able, x / np.where(able, step, 1), np.inf)
        out = int(np.argmin(ratio))
        x = x - ratio[out] * step
        x[out] = ratio[out]
        x = np.maximum(x, 0)
        basis[:, out] = column
    plan, left = [], need.copy()
    for j in np.argsort(-x, kind="stable"):
        pattern = np.rint(basis[:, j]).astype(np.int64)
        times = int(x[j] + 1e-6)
        used = pattern > 0
        if used.any():
            times = min([times, *(left[used] // pattern[used]).tolist()])
        if times > 0 and used.any():
            plan.append((pattern.tolist(), times))
            left -= pattern * times
    while left.any():  # a basis's worth of sequences at most: a few for each size
        pattern = _best_pattern(s, s.astype(float), left, capacity)
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        plan.append((pattern.tolist(), times))
        left -= pattern * times
    return plan


def best_fit(spaces: dict[int, int], pieces: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, largest first, by intervals.

    ``spaces``: how many bins have each amount of free space; ``pieces``: how many pieces have each length. Result:
    rows ``(length, first piece, n, kind, first bin, used)``: the n pieces of the length from the first on go one each
    into the bins from the first on of a kind (its free space at the start; ``-1``: new sequences), in which the pieces
    placed before take ``used`` tokens.
    """
    queues: dict[int, deque] = defaultdict(deque)
    free: list[int] = []

    def put(space: int, kind: int, first: int, n: int, used: int) -> None:
        if space > 0:
            if not queues[space]:
                insort(free, space)
            queues[space].append((kind, first, n, used))

    for space, n in sorted(spaces.items()):
        put(space, space, 0, n, 0)
    plan, opened = [], 0
    for length in sorted(pieces, reverse=True):
        done, n = 0, pieces[length]
        while done < n:
            at = bisect_left(free, length)
            if at < len(free):
                space = free[at]
                kind, first, bins, used = queues[space].popleft()
                take = min(bins, n - done)
                if take < bins:
                    queues[space].appendleft((kind, first + take, bins - take, used))
                if not queues[space]:
                    free.pop(at)
            else:
                # as many new sequences as hold the rest of this length
                space, kind, first, used = capacity, -1, opened, 0
                take = min(n - done, -(-(n - done) // (capacity // length)))
                opened += take
            plan.append((length, done, take, kind, first, used))
            put(space - length, kind, first, take, used + length)
            done += take
    return plan


def pack(pieces: DataFrame, keys: list[str], capacity: int = CAPACITY, length_col: str = "length",
         groups: int = GROUPS, large_share: float = LARGE_SHARE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of 1 to ``capacity`` tokens; ``keys`` identify a row."""
    spark = pieces.sparkSession
    large_from = max(1, int(capacity * large_share))
    rows = pieces.select("*", F.col(length_col).alias("_len"))
    histogram = {r["_len"]: r["n"] for r in rows.groupBy("_len").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not histogram:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if min(histogram) < 1 or max(histogram) > capacity:
        raise ValueError(f"pieces must have 1 to {capacity} tokens")
    large = sorted((n, c) for n, c in histogram.items() if n >= large_from)
    lengths, counts = [n for n, _ in large], [c for _, c in large]
    sized = group_sizes(lengths, counts, groups)
    plan = configurations([s for s, _ in sized], [c for _, c in sized], capacity)

    # pieces are numbered within their length; a group takes the numbers of its lengths one after the other
    by_length = written(numbered(rows, ["_len"], keys, "_no"), "numbered")
    seen: dict[int, int] = defaultdict(int)
    borders = iter(sized)
    ranks = []  # (length, numbers from, to, size, number within the size of the first)
    size, room = next(borders, (0, 0))
    for n, c in large:
        at = 0
        while at < c:
            if room == 0:
                size, room = next(borders)
            take = min(c - at, room)
            ranks.append((n, at, at + take, size, seen[size]))
            seen[size] += take
            at, room = at + take, room - take
    # the places of a size, pattern by pattern: place number -> sequence, and order within the sequence
    places, next_place, sequence = [], defaultdict(int), 0
    for pattern, times in plan:
        for (size, _), k in zip(sized, pattern, strict=True):
            if k:
                places.append((size, next_place[size], next_place[size] + k * times, sequence, k))
                next_place[size] += k * times
        sequence += times
    cuts = []  # the two tables above, joined: at most a row for each length and pattern
    by_size = defaultdict(list)
    for p in places:
        by_size[p[0]].append(p)
    for n, a, b, size, first in ranks:
        for _, lo, hi, seq, k in by_size[size]:
            x, y = max(first, lo), min(first + b - a, hi)
            if x < y:
                cuts.append((n, a + x - first, a + y - first, x - lo, seq, k))
    shift = "_len long, _from long, _to long, _place long, _seq long, _k long"
    within = by_length.join(F.broadcast(spark.createDataFrame(cuts, shift)),
                            "_len").filter("_no >= _from AND _no < _to") if cuts else None
    if within is not None:
        place = F.col("_place") + F.col("_no") - F.col("_from")
        big = within.select(*keys, "_len", (F.col("_seq") + F.floor(place / F.col("_k"))).cast("long").alias("_bin"),
                            F.lit(0).cast("long").alias("_used"))
        big = written(big, "large")
        filled = big.groupBy("_bin").agg((F.lit(capacity) - F.sum("_len")).alias("_space"))
        filled = written(numbered(filled, ["_space"], ["_bin"], "_bin_no"), "filled")
        spaces = {r["_space"]: r["n"]
                  for r in filled.groupBy("_space").agg(F.count(F.lit(1)).alias("n")).collect()}
    else:
        spaces = {}
    small = {n: c for n, c in histogram.items() if n < large_from}
    fits = best_fit(spaces, small, capacity)
    parts = []
    if fits:
        table = spark.createDataFrame([(n, a, a + c, kind, first) for n, a, c, kind, first, _ in fits],
                                      "_len long, _from long, _to long, _space long, _first long")
        little = (by_length.join(F.broadcast(table), "_len").filter("_no >= _from AND _no < _to")
                  .select(*keys, "_len", "_space", (F.col("_first") + F.col("_no") - F.col("_from")).alias("_bin_no")))
        fresh = little.filter("_space = -1").select(*keys, "_len", (F.col("_bin_no") + sequence).alias("_bin"))
        parts.append(fresh)
        if within is not None:
            parts.append(little.filter("_space >= 0").join(filled, ["_space", "_bin_no"])
                         .select(*keys, "_len", "_bin"))
    if within is not None:
        parts.append(big.select(*keys, "_len", "_bin"))
    placed = parts[0]
    for p in parts[1:]:
        placed = placed.unionByName(p)
    # offsets: a sequence holds at most ``capacity`` pieces
    order = Window.partitionBy("_bin").orderBy(F.col("_len").desc(), *keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select(*keys, F.col("_bin").alias("sequence_id"),
                           F.coalesce(F.sum("_len").over(order), F.lit(0)).cast("long").alias("offset"))
    return pieces.join(placed, keys)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    pieces = written(token_pieces(docs, tokenizer, capacity, id_col=id_col, text_col=text_col), "pieces")
    return pack(pieces, ["row_id", "piece"], capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
