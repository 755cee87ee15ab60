import hashlib
import random
import re
import struct

import pytest
import xxhash

from sosrank.llm import components, exact_dedup, simhash_fingerprints as sf, simhash_neardup as nd, substring_dedup as sd
from sosrank.llm.common import scratch


def _norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup_marks_one_row_a_text(messy):
    rows = exact_dedup.exact_dedup(messy).collect()
    source = messy.collect()
    assert len(rows) == len(source)
    sha = lambda t: hashlib.sha256(_norm(t).encode()).hexdigest()
    groups = {}
    for r in source:
        groups.setdefault(sha(r.text), []).append(r.doc_id)
    for r in rows:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == min((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in rows) == len(groups)
    assert exact_dedup.exact_dedup(messy.limit(0)).count() == 0


def test_index_holds_later_batches_against_earlier_ones(spark, make_docs):
    index = exact_dedup.DigestIndex(spark, "digest_index_test", buckets=4, location=scratch(spark, "index"))
    first = exact_dedup.exact_dedup(make_docs([(5, "a b", "en"), (6, "c", "en")]), index).collect()
    assert all(r.kept for r in first)
    again = {r.doc_id: r for r in exact_dedup.exact_dedup(
        make_docs([(1, "a  b", "en"), (2, "d", "en"), (3, "d", "en")]), index).collect()}
    assert (again[1].kept, again[1].keep_id) == (False, 5)
    assert again[2].kept and not again[3].kept and again[3].keep_id == 2
    assert index.read().count() == 3


def test_a_batch_added_twice_keeps_its_texts(spark, make_docs):
    index = exact_dedup.DigestIndex(spark, "digest_index_retry", buckets=3, location=scratch(spark, "index"))
    one, two = make_docs([(5, "a b", "en"), (6, "c", "en"), (6, "c", "en")]), make_docs([(1, "a  b", "en"), (2, "d", "en")])
    want = {}
    for _ in range(2):
        for name, docs in (("one", one), ("two", two)):
            rows = sorted(tuple(r) for r in exact_dedup.exact_dedup(docs, index, batch=name).collect())
            assert want.setdefault(name, rows) == rows
    assert [r[3] for r in want["two"]] == [False, True] and sum(r[3] for r in want["one"]) == 2
    assert index.read().count() == 3
    index.drop()


def test_batches_of_one_table_give_its_groups(spark, messy):
    once = sorted((tuple(r) for r in exact_dedup.exact_dedup(messy).collect()), key=str)
    for n in (2, 5):
        got = sorted((tuple(r) for r in exact_dedup.exact_dedup(messy, batches=n).collect()), key=str)
        assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in once]
        assert sum(r[3] for r in got) == sum(r[3] for r in once)
    assert exact_dedup.exact_dedup(messy.limit(0), batches=2).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index_") and t.name != "digest_index_test"]


def test_edited_texts_and_likeness(messy):
    rows = sf.edited_fingerprints(messy).collect()
    assert len(rows) == messy.count()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    by_id = {r.doc_id: r for r in rows if r.doc_id in (4, 8, 12)}
    assert by_id[8].fingerprint == by_id[12].fingerprint
    # the text after the last is the first: ids ascend with null first
    assert by_id[4].n_chars == 3
    assert by_id[4].edited_sha256 == hashlib.sha256(("on" + "o").encode()).hexdigest()
    one = messy.filter("doc_id = 5")
    assert sf.edited_fingerprints(one).first().near_next == 1.0
    assert sf.edited_fingerprints(messy.limit(0)).count() == 0


def _hash64(start, *words):
    """Spark's xxhash64 over a number and words: each is hashed with the hash before it as the seed."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", start), 42)
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h


def _simhash128(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    if len(words) < 2:
        return _hash64(1, *words) << 64 | _hash64(2, *words) if words else 0
    terms = [(_hash64(1, a, b) << 64 | _hash64(2, a, b), min(15, len(a) + len(b)))
             for a, b in zip(words, words[1:], strict=False)]
    total = sum(w for _, w in terms)
    return sum(1 << k for k in range(128) if 2 * sum(w for h, w in terms if h >> k & 1) > total)


def test_every_column_of_the_fingerprint_query_by_brute_force(make_docs):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["a", "Über", "日本", "x" * 40]
    texts = ["", "one", None, "  ", "two words"] + [
        " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    texts += texts[10:20]  # copies
    # ids close together, far apart, negative and beyond what a double tells apart
    ids = [*range(20), *[10**6 * i for i in range(1, 21)], *[-7 * i for i in range(1, 21)],
           *[2**62 + 2**33 * i + i for i in range(len(texts) - 60)]]
    rng.shuffle(ids)
    docs = sorted(zip(ids, [t or "" for t in texts], strict=True))
    want = {}
    for i, (doc_id, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        own, ed, nxt = (_simhash128(t) for t in (text, edited, after))
        want[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{own:032x}", f"{ed:032x}",
                        1 - (own ^ ed).bit_count() / 128, 1 - (own ^ nxt).bit_count() / 128)
    rows = sf.edited_fingerprints(make_docs([(i, t, "en") for i, t in zip(ids, texts, strict=True)])).collect()
    assert len(rows) == len(want)
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)
            for r in rows} == want


def test_votes_match_brute_force(spark, make_docs):
    from pyspark.sql import functions as F

    text = "alpha beta gamma alpha beta delta be to alpha beta"
    row = sf.fingerprint_columns(make_docs([(1, text, "en")]).select("doc_id", "text"), ["doc_id"]).first()
    words = text.split()
    pairs = list(zip(words, words[1:], strict=False))
    hashed = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", F.xxhash64(F.lit(1), "a", "b").alias("h")).collect()
    total = sum(min(15, len(r.a) + len(r.b)) for r in hashed)
    want = sum(1 << k for k in range(64)
               if 2 * sum(min(15, len(r.a) + len(r.b)) for r in hashed if (r.h >> k) & 1) > total)
    assert row.hi & (2**64 - 1) == want


@pytest.mark.parametrize("radius", [0, 2, 5])
def test_block_tables_find_all_within_radius(spark, radius):
    rng = random.Random(radius)
    prints = [rng.getrandbits(128) for _ in range(40)]
    for p in list(prints):
        for flips in (1, 2, 3, 5, 6):
            prints.append(p ^ sum(1 << b for b in rng.sample(range(128), flips)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    split = lambda p: (signed(p >> 64), signed(p & (2**64 - 1)))
    df = spark.createDataFrame([split(p) for p in prints], "hi long, lo long")
    got = {((r.query_hi, r.query_lo), (r.hi, r.lo)) for r in sf.within_radius(df, df, radius).collect()}
    want = {(split(a), split(b)) for a in prints for b in prints if (a ^ b).bit_count() <= radius}
    assert got == want


def test_simhash_fingerprint_is_the_contracts(messy):
    def plain(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
        hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)):016x}"

    texts = {(r.doc_id, plain(r.text)) for r in messy.collect()}
    rows = nd.near_duplicates(messy).collect()
    assert len(rows) == messy.count() and {(r.doc_id, r.fingerprint) for r in rows} == texts
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.component_id for r in zero} == {1} and len(zero) == 4
    assert nd.near_duplicates(messy.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_links_keep_every_component(spark, bits):
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = set(base)
    for b in base:  # a dense group about each, and a chain that leaves it
        for _ in range(60):
            prints.add(b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 3))))
        step = b
        for _ in range(5):
            step ^= sum(1 << i for i in rng.sample(range(64), bits))
            prints.add(step)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    links = nd.near_links(spark.createDataFrame([(p,) for p in prints], "fp long"), bits)
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert all(apart(r.a, r.b) <= bits for r in links.collect())
    root = {r.node: r.root for r in components.connected_components(links).collect()}
    want = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            low = min(want[b] for b in prints if apart(a, b) <= bits)
            if low < want[a]:
                want[a], changed = low, True
    assert {p: root.get(p, p) for p in prints} == want


@pytest.mark.parametrize("bits", range(5))
def test_one_segment_is_always_within_its_radius(bits):
    radii = nd.segment_radii(bits)
    assert all(a <= radii[0] or bits_apart - a <= radii[1] for bits_apart in range(bits + 1)
               for a in range(bits_apart + 1))


def test_candidates_are_those_that_meet_in_a_segment(spark):
    rng = random.Random(9)
    alone = {rng.getrandbits(64) for _ in range(300)}
    base = rng.getrandbits(64)
    near = {base, base ^ (1 << 40), base ^ 5, base ^ (1 << 63) ^ 2}
    signed = lambda ps: {p - (1 << 64) if p >> 63 else p for p in ps}
    df = spark.createDataFrame([(p,) for p in signed(alone | near)], "fp long")
    assert {r.fp for r in nd.candidates(df, 2).collect()} == signed(near)


@pytest.mark.parametrize("shift", [0, 32])
def test_a_segment_that_all_share_lists_no_pairs(spark, shift):
    rng = random.Random(shift)
    shared = 0x1234ABCD << (32 - shift)
    rest = {rng.getrandbits(32) for _ in range(1500)}
    base = rng.getrandbits(32)
    rest |= {base ^ sum(1 << b for b in rng.sample(range(32), rng.randint(1, 2))) for _ in range(200)}
    prints = [shared | (r << shift) for r in rest]
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    links = nd.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), 2).collect()
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert all(apart(r.a, r.b) <= 2 for r in links)
    pairs = [(a, b) for a in signed for b in signed if a < b and apart(a, b) <= 2]
    assert pairs and len(links) < len(signed) * 65
    root = {p: p for p in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        root[find(r.a)] = find(r.b)
    assert all(find(a) == find(b) for a, b in pairs)


def _brute_removed(rows, window=20):
    seen, out = set(), []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for a in range(len(words) - window + 1):
            key = tuple(words[a:a + window])
            if key in seen:
                gone[a:a + window] = [True] * window
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("block_words", [50, 1 << 20])
def test_substring_dedup_matches_brute_force(make_docs, block_words):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(40):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            a = rng.randint(0, 30)
            words[5:5] = passage[a:a + rng.randint(15, 30)]
        rows.append((i, " ".join(words), "en"))
    rows += [(50, "a " * 45, "en"), (51, None, None), (52, " ".join(passage), "en"), (53, " ".join(passage[:19]), "en")]
    out = sd.remove_repeats(make_docs(rows), block_words=block_words).collect()
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out)
    assert got == _brute_removed([(i, t) for i, t, _ in rows])


def test_levels_end_where_no_candidate_survives(make_docs, monkeypatch):
    words = [f"w{i}" for i in range(200)]
    none = [(i, " ".join(words[i * 25:i * 25 + 25]), "en") for i in range(8)]
    short = [(i, " ".join([*words[:7], f"x{i}", *words[i * 20 + 7:i * 20 + 27]]), "en") for i in range(8)]
    for rows, want in ((none, ["level0"]), (short, ["level0", "level1"])):
        run, inner = [], sd.written
        monkeypatch.setattr(sd, "written", lambda df, name, inner=inner, run=run: run.append(name) or inner(df, name))
        out = sd.remove_repeats(make_docs(rows)).collect()
        monkeypatch.setattr(sd, "written", inner)
        assert run == want
        got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out)
        assert got == _brute_removed([(i, t) for i, t, _ in rows])


@pytest.mark.parametrize("bits", [6, 12, 20])
def test_what_a_block_sends_grows_with_its_entries(bits):
    import numpy as np

    rng = np.random.default_rng(bits)
    keys = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2))
    coarse = np.unique(sd._coarse(keys, bits))
    many = np.arange(len(coarse)) % 3 == 0
    for batches, kind, all_keys in ((sd._send(1 << bits, keys, [], 1), "<u8", keys),
                                    (sd._send_coarse(coarse, many, 1), "<u4", coarse & np.uint64(0xFFFFFFFF))):
        rows = [r for b in batches for r in b.to_pylist()]
        assert len(rows) == len({r["bucket"] for r in rows}) <= min(1 << bits, len(keys))
        assert sum(sum(map(len, r["blobs"])) for r in rows) <= 14 * len(keys) + 40 * 64
        back = [np.cumsum(sd._unpack_array(r["blobs"][0], kind), dtype=kind) for r in rows]
        assert np.array_equal(np.concatenate(back), all_keys)
    assert list(sd._stretches(np.array([], np.int64))) == []


def test_substring_dedup_odd_rows(messy):
    rows = sd.remove_repeats(messy, with_text=True).collect()
    assert len(rows) == messy.count()
    assert {r.n_removed for r in rows if r.doc_id == 12} == {30_000}
    assert sd.remove_repeats(messy.limit(0)).count() == 0
