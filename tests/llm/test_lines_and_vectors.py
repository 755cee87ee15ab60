import collections
import hashlib
import math
import random

import numpy as np
import pytest

from sosrank.llm import hard_negatives as hn, line_dedup as ld, whitening as wh
from sosrank.llm.common import scratch

#: Names that the operators use themselves, as columns of the input.
CLASHING = "x array<long>, cid long, uid long, g int, rank int, key long, score string, n int, id string"


def _vectors(spark, rows, parts=3):
    """Vectors of (vec_id, embedding, label), with further columns whose names the operators use."""
    more = ([1], 2, 3, 4, 5, 6, "s", 7, "i")
    return spark.createDataFrame([(*r, *more) for r in rows],
                                 f"vec_id long, embedding array<double>, label int, {CLASHING}").repartition(parts)


def _whole(v):
    return [min((1 << 63) - 1, max(-(1 << 63), math.floor(c * 256) if abs(c) < 1e300 else int(c) * 256)) for c in v]


def _fit(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def _dot(a, b):
    return max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b, strict=False))))


def _mined(rows, anchor, p=5, n=3, low=50, high=95):
    last = lambda i: (i is None, i)
    fit = {(i, tuple(_whole(v)), label) for i, v, label in rows if label is not None and _fit(v)}
    out = []
    for i, x, label in fit:
        if i is None or not anchor(i):
            continue
        scored = sorted(((-_dot(x, y), last(j), k) for j, y, k in fit if j != i or k != label), key=lambda t: t[:2])
        for s, j, _ in [t for t in scored if t[2] == label][:p]:
            inside = [t for t in scored if t[2] != label and low * -s <= 100 * -t[0] <= high * -s]
            out += [(i, j[1], r + 1, t[1][1], -s, -t[0]) for r, t in enumerate(inside[:n])]
    return sorted(out, key=str)


def _random_rows(rng, n, dims, labels):
    return [(i, [rng.gauss(0, 1) / math.sqrt(dims) for _ in range(dims)], rng.choice(labels)) for i in range(n)]


@pytest.mark.parametrize("scale, dims", [(200, 64), (200, 5), (10**5, 20), (10**9, 3), (2**58, 2)])
def test_probe_finds_all_pairs_at_any_threshold(scale, dims):
    rng = np.random.default_rng(dims)
    x = (rng.normal(size=(300, dims)) * scale * np.linspace(0.1, 1, dims)).astype(np.int64)
    x[:3] = 0
    q = np.concatenate([x[:20], (rng.normal(size=(20, dims)) * scale).astype(np.int64)])
    exact = [[_dot(a, b) for b in x.tolist()] for a in q.tolist()]
    index = hn.L2Index(x)
    for share in (0.9, 0.5, 0.1, 0.0, -0.2):
        least = np.array([int(min(2**62, max(-2**62, share * max(row)))) for row in exact], np.int64)
        want = {(i, j, s) for i, row in enumerate(exact) for j, s in enumerate(row) if s >= least[i]}
        assert set(zip(*(c.tolist() for c in index.probe(q, least)), strict=True)) == want


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = _random_rows(rng, 260, 12, [0, 0, 0, 1, 2])
    rows += [(300 + i, rows[10][1], 0) for i in range(60)]  # copies: one vector under many ids
    rows += [(400 + i, rows[10][1], 1) for i in range(5)] + rows[:8]  # also of another label; rows repeated
    rows += [(500, None, 1), (501, [0.1, None], 1), (502, [float("nan")] * 12, 1), (503, [float("inf")], 2),
             (504, rows[3][1], None), (None, rows[5][1], 0), (None, rows[6][1], 2), (510, [], 1),
             (520, [0.9, 0.3], 2), (530, [1.0], 7), (540, [0.5] * 15, 2), (550, [0.0] * 12, 1)]
    monkeypatch.setattr(hn, "CHAPTER", 1)
    monkeypatch.setattr(hn, "QUERY_BLOCK", 20)
    from pyspark.sql import functions as F

    got = hn.mine(_vectors(spark, rows), F.col("vec_id") % 5 == 0)
    want = _mined(rows, lambda i: i % 5 == 0)
    assert len(want) > 500
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert spark.catalog.listTables("default") == [] or not any(
        t.name.startswith("rows_") for t in spark.catalog.listTables("default"))
    assert hn.mine(_vectors(spark, rows).limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert hn.mine(_vectors(spark, rows), F.col("vec_id") == -1).count() == 0


def test_hard_negatives_of_large_numbers(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    for size in (1e4, 3e7, 1e30):
        rows = [(i, [c * size for c in v], k) for i, v, k in _random_rows(rng, 40, 3, [0, 1])]
        got = hn.mine(_vectors(spark, rows), F.col("vec_id") % 8 == 0, positives=3, negatives=2)
        assert sorted((tuple(r) for r in got.collect()), key=str) == _mined(rows, lambda i: i % 8 == 0, 3, 2)


def _key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))


def _without_common(rows, min_docs, min_chars=1):
    keys = [[_key(line) for line in (t or "").split("\n")] for _, t in rows]
    seen = collections.Counter(k for ks in keys for k in set(ks) if len(k) >= min_chars)
    out = []
    for (i, t), ks in zip(rows, keys, strict=True):
        lines = (t or "").split("\n")
        kept = [line for line, k in zip(lines, ks, strict=True) if seen[k] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def _texts(rng, n):
    pool = [f"line {i} {'x' * (i % 5)}" for i in range(60)] + ["é", "ÀB", "àb", "", "  ", "\x85", "a\x1c", "Z\r"]
    make = lambda: "\n".join(rng.choice((" ", "", "\t")) + rng.choice((str, str.upper))(rng.choice(pool))
                             for _ in range(rng.randrange(8)))
    return [make() for _ in range(n)]


@pytest.mark.parametrize("min_docs, min_chars", [(10, 1), (3, 4), (1, 2)])
def test_line_dedup_matches_brute_force(spark, make_docs, messy, min_docs, min_chars):
    rng = random.Random(min_docs)
    rows = [(i, t) for i, t in enumerate(_texts(rng, 150))]
    rows += [(None, "hot line"), (7, None), (None, None)] + [(1, "hot line\nown")] * 12
    rows += [(r.doc_id, r.text) for r in messy.collect()]
    docs = make_docs([(i, t, "en") for i, t in rows])
    got = ld.dedup_lines(docs, min_docs, min_chars)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _without_common(rows, min_docs, min_chars)
    digests = {(r.doc_id, r.kept_sha256) for r in ld.digests(got).collect()}
    assert digests == {(i, hashlib.sha256(t.encode()).hexdigest())
                       for i, _, _, t in _without_common(rows, min_docs, min_chars)}
    assert ld.dedup_lines(docs.limit(0)).count() == 0


def test_line_runs_over_batches_and_retries(spark, make_docs):
    rng = random.Random(2)
    runs = ld.LineRuns(spark, "lines_test", scratch(spark, "lines_test"), min_docs=4, fan=2, buckets=3)
    seen, levels = [], []
    for i in range(6):
        rows = [(100 * i + j, t) for j, t in enumerate(_texts(rng, 12))]
        seen += rows
        docs = make_docs([(k, t, "en") for k, t in rows])
        for _ in range(2):  # run again under its name, a batch adds nothing
            got = ld.dedup_lines(docs, 4, 1, runs, f"batch {i}")
            want = [r for r in _without_common(seen, 4) if r[0] >= 100 * i]
            assert sorted((tuple(r) for r in got.collect()), key=str) == want
        levels.append(sorted(level for _, level, _ in runs.runs()))
    assert levels == [[0], [1], [0, 1], [2], [0, 2], [1, 2]]
    assert sorted(b for _, _, names in runs.runs() for b in names) == [f"batch {i}" for i in range(6)]
    # settled lines are not written again
    assert sum(spark.table(r).count() for r, _, _ in runs.runs()) < sum(len(set(map(_key, t.split("\n")))) for _, t in seen)
    plan = runs._merged([r for r, _, _ in runs.runs()])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lines_test")]


@pytest.mark.parametrize("spectrum", [[9, 5, 4, 1], [5, 5, 5, 5, 5], [7, 3, 3, 3, 1e-3], [4, 4 - 1e-9, 2, 2, 0, 0], [3]])
def test_components_of_known_matrices(spectrum):
    rng = np.random.default_rng(len(spectrum))
    turn = np.linalg.qr(rng.normal(size=(len(spectrum),) * 2))[0]
    a = (turn * spectrum) @ turn.T
    a = (a + a.T) / 2
    values, vectors = wh.leading_components(a, 4)
    k = min(4, len(spectrum))
    assert np.allclose(values, sorted(spectrum, reverse=True)[:k], atol=1e-12)
    assert np.allclose(vectors @ vectors.T, np.eye(k), atol=1e-12)
    assert np.abs(a @ vectors.T - vectors.T * values).max() < 1e-12
    diagonal = np.diag([3.0, 8.0, 3.0, 1.0])  # nothing to reflect
    assert np.allclose(wh.leading_components(diagonal, 2)[0], [8, 3], atol=1e-13)


def _check_whitening(rows, got):
    fit = [(i, _whole(v)) for i, v, _ in rows if _fit(v)]
    wide = max(len(x) for _, x in fit)
    fit = [(i, [*x, *[0] * (wide - len(x))]) for i, x in fit]
    each = sorted({tuple(x) for _, x in fit})
    n, sums = len(each), [sum(c) for c in zip(*each, strict=True)]
    x = np.array(each, float)
    centred = x - np.array([s / n for s in sums])
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    k = min(4, int((values > wide * 1e-14 * values.sum()).sum()))
    assert len(got) == len(fit) * k
    found = collections.defaultdict(list)
    for r in got:
        found[r.component].append(r)
    assert sorted(found) == list(range(1, k + 1))
    exact = [(i, sum((n * a - s) ** 2 for a, s in zip(y, sums, strict=True))) for i, y in fit]
    deviations = collections.Counter((i, d if d < 1 << 63 else None) for i, d in exact)
    for c, rs in found.items():
        e, w = values[-c], vectors[:, -c]
        assert collections.Counter((r.vec_id, r.deviation) for r in rs) == deviations
        assert all(r.n == n and abs(r.explained - e / np.trace(v)) < 1e-9 and r.identity_error < 1e-8 for r in rs)
        want = sorted(((np.array([a - s / n for a, s in zip(y, sums, strict=True)]) @ w) / math.sqrt(e), str(i))
                      for i, y in fit)
        seen = sorted((r.whitened, str(r.vec_id)) for r in rs)
        flip = sorted((-r.whitened, str(r.vec_id)) for r in rs)
        close = lambda s: np.allclose([a for a, _ in s], [a for a, _ in want], atol=1e-6)
        assert close(seen) or close(flip)


def test_whitening_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [c * (d + 1) for d, c in enumerate(v)], k) for i, v, k in _random_rows(rng, 300, 9, [0])]
    rows += [(1000 + i, rows[0][1], 0) for i in range(200)] + rows[:5]  # copies weigh nothing
    rows += [(None, rows[7][1], None), (2000, None, 1), (2001, [None, 1.0], 1), (2002, [float("nan")], 1),
             (2003, [float("-inf")] * 9, 1), (2004, [-0.0] * 9, 1), (2005, [0.0], 1), (2006, [2.0, -3.5], 1)]
    _check_whitening(rows, wh.whiten(_vectors(spark, rows)).collect())
    assert wh.whiten(_vectors(spark, rows).limit(0)).count() == 0


def test_whitening_of_few_directions_and_large_numbers(spark):
    line = [(i, [float(i), 2.0 * i, -i / 2], 0) for i in range(20)]
    _check_whitening(line, wh.whiten(_vectors(spark, line)).collect())
    for rows in ([(1, [0.5, 0.25], 0)] * 3, [(1, [], 0), (2, [], 0)], [(5, [0.0], 0), (6, [0.0, 0.0], 0)]):
        assert wh.whiten(_vectors(spark, rows)).count() == 0
    rng = random.Random(3)
    large = [(i, [c * 2e5 for c in v], 0) for i, v, _ in _random_rows(rng, 60, 4, [0])]
    _check_whitening(large, wh.whiten(_vectors(spark, large)).collect())
    vast = [(i, [c * 1e13 for c in v], 0) for i, v, _ in _random_rows(rng, 60, 4, [0])]
    got = wh.whiten(_vectors(spark, vast)).collect()
    assert len(got) == 240 and all(r.deviation is None and math.isfinite(r.whitened) for r in got)
