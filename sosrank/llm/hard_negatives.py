"""Hard-negative mining by threshold joins over an inverted index with suffix-norm bounds.

Rows are whole-number vectors with a label. The anchors' positives are their best rows of the same label, their
negatives the best rows of other labels whose score lies in a window below the positive's. Both are threshold joins:
all rows whose inner product with an anchor reaches a threshold, which is lowered, for the anchors whose windows are not
full yet, until they are (or until nothing is left out).

- Rows of one label and vector are one class with its smallest ids, as many as any anchor can use: copies, however many,
  are scored once and lose no result.
- Classes are packed in blocks, dealt to groups and written as a table bucketed by group. The anchors of a round are
  packed as well and sent to every group, in chapters of a bounded number of anchors; what a task holds of them and of
  a block's scores is bounded. This is a stated query set against all rows, in blocks.
- In a block, dimensions stand in ascending order of their share in the block's squares, in stripes. A row's first
  stripes are left out of the posting lists as long as the norm over them, times the anchors', stays under the
  thresholds. Partial scores are accumulated from the last stripe on; rows whose partial score plus the product of the
  remaining norms reaches no anchor's threshold are dropped on the way; what is left is completed with the stripes that
  the lists omit, exactly.

Results in odd cases: rows with a null label, a null vector or a null or non-finite component take no part; an empty
vector is orthogonal to all; of vectors of different lengths the shorter counts as filled with zeros; rows alike in id,
label and vector count once; rows that share the anchor's id are never its positives; a null id comes after all others
and is no anchor; scores are exact, and saturate at a long's range; a positive with a negative score has no negatives;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sosrank.llm.common import salted_join, scratch, ship, written
from sosrank.llm.vectors import packed, unpack_rows, usable, whole

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these per cents of the positive's.
LOW, HIGH = 50, 95
#: Rows of a block, anchors of a block, and blocks of anchors that a task meets in one job.
ROW_BLOCK, QUERY_BLOCK, CHAPTER = 2048, 1024, 256
#: Dimensions of a stripe (one posting list).
STRIPE = 8
#: Thresholds by round: shares of the largest possible score, and of the window from its upper end; the last is all.
SHARES = (0.6, 0.42, 0.3, 0.2, 0.1, 0.0, None)
DEPTHS = (0.125, 0.5, 1.0)
#: Ends of the range of scores, and the id that stands for null.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
NO_ID = MOST
#: Pairs completed at a time.
PAIRS = 1 << 17


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


class L2Index:
    """Posting lists over a block of vectors; ``probe`` finds all pairs that reach a threshold."""

    def __init__(self, x: np.ndarray):
        self.whole = x
        squares = (x.astype(np.float64) ** 2).sum(axis=0)
        self.order = np.argsort(squares, kind="stable")
        self.stripes = -(-x.shape[1] // STRIPE)
        self.x, self.rest = self._laid_out(x)

    def _laid_out(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors in the index's order of dimensions, and their norms over the first 0, 1, ... stripes."""
        own = np.zeros((len(x), self.stripes * STRIPE))
        own[:, :len(self.order)] = x[:, self.order]
        squares = np.cumsum((own ** 2).reshape(len(x), self.stripes, STRIPE).sum(axis=2), axis=1)
        return own, np.sqrt(np.concatenate([np.zeros((len(x), 1)), squares], axis=1))

    def probe(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs ``(query, row, score)`` whose inner product is at least the query's ``least``."""
        none = np.zeros(0, np.int64)
        if not len(q) or not len(self.x):
            return none, none, none
        if self.x.shape[1] == 0 or q.shape[1] == 0:
            at, row = np.nonzero(np.broadcast_to((least <= 0)[:, None], (len(q), len(self.x))))
            return at, row, np.zeros(len(at), np.int64)
        if q.shape[1] < len(self.order):  # dimensions that only one side has add nothing
            q = np.pad(q, ((0, 0), (0, len(self.order) - q.shape[1])))
        own, qrest = self._laid_out(q)
        least_f = least.astype(np.float64)
        reach = qrest[:, -1].max() * self.rest[:, -1].max()
        # partial sums are whole numbers: exact in the type chosen, or else bounds get a margin
        kind = np.float32 if reach < 1 << 23 else np.float64
        exact = reach < 1 << 52
        slack = 1e-9 * reach + (0 if exact else 1e-6 * reach)

        # stripes that a row leaves out: its norm over them can't bring any query to its threshold
        with np.errstate(divide="ignore", invalid="ignore"):
            needed = np.where(least_f[:, None] > slack, (least_f[:, None] - slack) / qrest, -1.0).min(axis=0)
        skipped = (self.rest[:, 1:] < needed[1:]).sum(axis=1)
        rows = np.argsort(skipped, kind="stable")
        rows = rows[skipped[rows] < self.stripes]  # a row that could leave out all reaches nobody
        x, rest, skipped = self.x[rows].astype(kind), self.rest[rows], skipped[rows]
        own = own.astype(kind)
        partial = np.zeros((len(q), len(rows)), kind)
        for s in reversed(range(self.stripes)):
            n = int(np.searchsorted(skipped, s, side="right"))
            dims = slice(s * STRIPE, (s + 1) * STRIPE)
            partial[:, :n] += own[:, dims] @ x[:n, dims].T
            if s and s % 3 == 0 or s == 0:
                left = np.maximum(skipped, s)
                bound = partial + qrest[:, left] * rest[np.arange(len(left)), left]
                live = bound >= (least_f - slack)[:, None]
                if s == 0:
                    break
                some = live.any(axis=0)
                if some.mean() < 0.8:
                    rows, x, rest, skipped = rows[some], x[some], rest[some], skipped[some]
                    partial = partial[:, some]
        if not len(rows):
            return none, none, none
        at, col = np.nonzero(live)
        if exact:
            score = partial[at, col].astype(np.float64)
            for s in range(int(skipped.max(initial=0))):
                part = np.nonzero(skipped[col] > s)[0]
                for i in range(0, len(part), PAIRS):
                    p = part[i:i + PAIRS]
                    dims = slice(s * STRIPE, (s + 1) * STRIPE)
                    score[p] += np.einsum("ij,ij->i", own[at[p], dims].astype(np.float64),
                                          x[col[p], dims].astype(np.float64))
            score = score.astype(np.int64)
        else:
            a, b = q.astype(object), self.whole[rows].astype(object)
            score = np.array([min(MOST, max(LEAST, int(a[i, :b.shape[1]] @ b[j])))
                              for i, j in zip(at.tolist(), col.tolist(), strict=True)], np.int64)
        enough = score >= least[at]
        return at[enough], rows[col[enough]], score[enough]


def _best(at: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` entries of each ``at``, by falling score, then rising ``tie``."""
    order = np.lexsort((tie, ~score, at))
    group = at[order]
    starts = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
    nth = np.arange(len(group)) - np.maximum.accumulate(np.where(starts, np.arange(len(group)), 0))
    return order[nth < k]


BLOCK = "g int, n int, label array<long>, ids array<array<long>>, x array<binary>, top double"
QUERIES = "block int, cid array<long>, label array<long>, x array<binary>, window array<array<long>>"
HITS = "cid long, key long, id long, score long"


def _row_blocks(classes: DataFrame, groups: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, ROW_BLOCK):
                cut = batch.slice(i, ROW_BLOCK)
                label, ids, x = (c.to_pylist() for c in cut.columns)
                top = float(_norms(unpack_rows(x)).max())
                cols = [pa.array([(part * 31 + seq) % groups], pa.int32()), pa.array([len(x)], pa.int32()),
                        pa.array([label], pa.list_(pa.int64())), pa.array([ids], pa.list_(pa.list_(pa.int64()))),
                        pa.array([x], pa.list_(pa.binary())), pa.array([top])]
                yield pa.RecordBatch.from_arrays(cols, ["g", "n", "label", "ids", "x", "top"])
                seq += 1

    return classes.select("label", "ids", "x").mapInArrow(run, BLOCK)


def _query_blocks(pending: DataFrame, blocks: int, top: float, share: float | None, depth: float | None) -> DataFrame:
    """Anchors of a round in blocks; a window is ``(place of its anchor, key, threshold, upper end)``."""
    def record(held: list, number: int) -> pa.RecordBatch:
        x = [r[2] for r in held]
        norms, windows = _norms(unpack_rows(x)), []
        for i, (_, _, _, own) in enumerate(held):
            for w in own:
                if depth is not None:
                    least = max(w["lo"], w["hi"] - int(depth * (w["hi"] - w["lo"])))
                else:
                    least = LEAST if share is None else min(MOST, int(share * norms[i] * top))
                windows.append([i, w["key"], least, w["hi"]])
        cols = [pa.array([number], pa.int32()), pa.array([[r[0] for r in held]], pa.list_(pa.int64())),
                pa.array([[r[1] for r in held]], pa.list_(pa.int64())), pa.array([x], pa.list_(pa.binary())),
                pa.array([windows], pa.list_(pa.list_(pa.int64())))]
        return pa.RecordBatch.from_arrays(cols, ["block", "cid", "label", "x", "window"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], TaskContext.get().partitionId()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) == QUERY_BLOCK:
                    yield record(held, number)
                    held = []
        if held:
            yield record(held, number)

    windows = (pending.groupBy("cid", "label", "x")
               .agg(F.collect_list(F.struct("key", "lo", "hi")).alias("windows")))
    return windows.repartition(blocks, "cid").mapInArrow(run, QUERIES)


def _scorer(k: int, same_label: bool):
    """Per pair of a row block and an anchor block: the first ``k`` rows of each of the anchors' windows."""
    def hits(held, cid, label, x, window) -> tuple[np.ndarray, ...]:
        rows, rlabel, ids, index = held
        q, qlabel = unpack_rows(x), np.array(label, np.int64)
        window = np.array(window, np.int64).reshape(-1, 4)
        least = np.full(len(q), MOST, np.int64)
        np.minimum.at(least, window[:, 0], window[:, 2])
        if same_label:
            found = []
            for of in np.intersect1d(qlabel, rlabel).tolist():
                mine, theirs = np.nonzero(qlabel == of)[0], np.nonzero(rlabel == of)[0]
                if of not in index:
                    index[of] = L2Index(rows[theirs])
                a, r, s = index[of].probe(q[mine], least[mine])
                found.append((mine[a], theirs[r], s))
            at, row, score = (np.concatenate(c) if found else np.zeros(0, np.int64)
                              for c in (zip(*found) if found else [()] * 3))
        else:
            if None not in index:
                index[None] = L2Index(rows)
            at, row, score = index[None].probe(q, least)
            other = qlabel[at] != rlabel[row]
            at, row, score = at[other], row[other], score[other]
        first = np.array([i[0] for i in ids], np.int64)
        slot = np.arange(len(window)) - np.searchsorted(window[:, 0], window[:, 0])  # windows stand by anchor
        out = []
        for nth in range(int(slot.max(initial=-1)) + 1):
            own = window[slot == nth]
            low, high, key = (np.full(len(q), v, np.int64) for v in (MOST, LEAST, 0))
            key[own[:, 0]], low[own[:, 0]], high[own[:, 0]] = own[:, 1], own[:, 2], own[:, 3]
            inside = np.nonzero((score >= low[at]) & (score <= high[at]))[0]
            best = inside[_best(at[inside], score[inside], first[row[inside]], k)]
            sizes = np.array([len(ids[r]) for r in row[best].tolist()], np.int64)
            each = np.repeat(best, sizes)
            members = np.array([i for r in row[best].tolist() for i in ids[r]], np.int64)
            take = _best(at[each], score[each], members, k)
            out.append((at[each][take], key[at[each][take]], members[take], score[each][take]))
        at, key, members, score = (np.concatenate(c) for c in zip(*out)) if out else [np.zeros(0, np.int64)] * 4
        return np.array(cid, np.int64)[at], key, members, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("uid", "cid", "qlabel", "qx", "window")}
                if row["uid"] != last:
                    label, ids, x = (batch.column(n)[i].as_py() for n in ("label", "ids", "x"))
                    last, held = row["uid"], (unpack_rows(x), np.array(label, np.int64), ids, {})
                found = hits(held, row["cid"], row["qlabel"], row["qx"], row["window"])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["cid", "key", "id", "score"])

    return run


def _threshold_join(blocks: DataFrame, groups: int, top: float, queries: DataFrame, k: int, same_label: bool,
                    rounds: list[tuple[float | None, float | None]]) -> DataFrame:
    """The first ``k`` rows ``(cid, key, id, score, rank)`` of every window ``(cid, label, x, key, lo, hi)``."""
    best = Window.partitionBy("cid", "key").orderBy(F.col("score").desc(), "id")
    pending, out = queries, []
    for i, (share, depth) in enumerate(rounds):
        n = pending.select("cid").distinct().count()
        if not n:
            break
        parts = -(-n // QUERY_BLOCK)
        asked = written(_query_blocks(pending, parts, top, share, depth), "anchors")
        chapters, found = -(-parts // CHAPTER), []
        for c in range(chapters):
            sent = (asked.filter(F.pmod("block", F.lit(chapters)) == c)
                    .select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "cid",
                            F.col("label").alias("qlabel"), F.col("x").alias("qx"), "window"))
            pairs = blocks.hint("merge").join(sent, "g").select(
                "uid", "label", "ids", "x", "cid", "qlabel", "qx", "window")
            hits = pairs.mapInArrow(_scorer(k, same_label), HITS)
            found.append(written(hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "hits"))
        hits = reduce(DataFrame.unionByName, found)
        if i + 1 == len(rounds):
            out.append(hits)
            break
        full = hits.filter(F.col("rank") == k).select("cid", "key")
        out.append(hits.join(full, ["cid", "key"], "left_semi"))
        pending = written(pending.join(full, ["cid", "key"], "left_anti"), "pending")
    if not out:
        empty = queries.sparkSession.createDataFrame([], HITS)
        return empty.withColumn("rank", F.lit(0))
    return reduce(DataFrame.unionByName, out)


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
         high: int = HIGH, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of ``rows`` that
    satisfy ``anchors``."""
    spark = rows.sparkSession
    ship(spark)
    keep = max(positives + 1, negatives)
    fit = (rows.filter(F.col(label_col).isNotNull() & usable(F.col(vector_col)))
           .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                   whole(F.col(vector_col)).alias("x"),
                   F.coalesce(anchors & F.col(id_col).isNotNull(), F.lit(False)).alias("anchor")))
    fit = packed(fit)
    # copies are combined before they travel: of each label and vector the smallest ids go on
    nth = Window.partitionBy("label", "x").orderBy(F.col("id").asc_nulls_last())
    few = (fit.select("id", "label", "x").distinct().withColumn("_n", F.row_number().over(nth))
           .filter(F.col("_n") <= keep))
    ids = F.sort_array(F.collect_list(F.coalesce("id", F.lit(NO_ID))))
    classes = few.groupBy("label", "x").agg(ids.alias("ids"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    wanted = fit.filter("anchor").select("id", "label", "x").distinct()
    heads = written(classes.select("label", "x", "cid").hint("merge")
                    .join(wanted.select("label", "x").distinct(), ["label", "x"], "left_semi"), "heads")
    asking = written(salted_join(wanted, heads, ["label", "x"], "id").select("id", "cid"), "asking")

    groups = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = scratch(spark, "rows")
    table = "rows_" + uuid.uuid4().hex
    (_row_blocks(classes, groups).withColumn("uid", F.monotonically_increasing_id()).repartition(groups, "g")
     .write.format("parquet").option("path", path).bucketBy(groups, "g").sortBy("g").saveAsTable(table))
    blocks = spark.table(table)
    top = blocks.agg(F.max("top")).first()[0] or 0.0

    queries = heads.select("cid", "label", "x", F.lit(0).cast("long").alias("key"), F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi"))
    found = _threshold_join(blocks, groups, top, queries, positives + 1, True, [(s, None) for s in SHARES])
    own = found.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("own"))
    others = F.slice(F.filter("own", lambda t: t["id"] != F.col("id")), 1, positives)
    pairs = written(salted_join(asking, own, ["cid"], "id")
                    .select("id", "cid", F.explode(others).alias("p"))
                    .select(F.col("id").alias("anchor_id"), "cid", F.col("p.id").alias("positive_id"),
                            F.col("p.score").alias("key")), "positives")

    wide = F.col("key").cast("decimal(20,0)")
    windows = (pairs.filter("key >= 0").select("cid", "key").distinct()
               .select("*", F.ceil(wide * low / 100).cast("long").alias("lo"),
                       F.floor(wide * high / 100).cast("long").alias("hi")).filter("lo <= hi"))
    windows = written(windows.join(heads, "cid").select("cid", "label", "x", "key", "lo", "hi"), "windows")
    found = _threshold_join(blocks, groups, top, windows, negatives, False, [(None, d) for d in DEPTHS])
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    out = written(salted_join(pairs, found, ["cid", "key"], "anchor_id")
                  .select("anchor_id", known("positive_id"), F.col("rank").cast("int"),
                          F.col("id").alias("negative_id"), F.col("key").alias("positive_score"),
                          F.col("score").alias("negative_score"))
                  .select("anchor_id", "positive_id", "rank", known("negative_id"), "positive_score",
                          "negative_score"), "negatives")
    spark.sql(f"DROP TABLE {table}")
    return out


#: DuckDB, for the query's columns: every anchor against every row.
ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         list_inner_product(a.x, r.x)::BIGINT AS score
  FROM v a, v r WHERE a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
