import random

import corpus_pipeline as cp


def _labels(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(
        f"{path}/labels.parquet")


def test_stages_keep_columns_and_decide(spark, make_docs, messy, tmp_path):
    _labels(spark, tmp_path, [(1, 0, 0)])
    passage = " ".join(f"p{i}" for i in range(30))
    docs = make_docs([(1, "alpha beta", "en"), (2, "alpha  beta", "en"), (3, f"x y {passage} z", "en"),
                      (4, f"q {passage} r", "en"), (4, f"q {passage} r", "en"), (5, None, None)])
    d = str(tmp_path)
    assert cp.toxicity_stage(spark, docs, d).count() == 6  # nothing to learn from: nobody goes
    exact = cp.exact_stage(spark, docs, d)
    assert exact.columns == docs.columns and sorted(r.doc_id for r in exact.collect()) == [1, 3, 4, 5]
    near = cp.near_stage(spark, exact, d)
    assert near.columns == docs.columns and near.count() <= 4
    cut = {r.doc_id: r for r in cp.substring_stage(spark, exact, d).collect()}
    assert cut[4].text == "q r" and cut[4].n_chars == 3 and cut[3].text.endswith(" z") and cut[5].text is None
    assert cp.packing_stage(spark, exact, d).count() == 4
    for name, stage in cp.STAGES:
        assert stage(spark, messy, d).count() > 0, name
        assert stage(spark, messy.limit(0), d).count() == 0, name


def test_near_stage_keeps_one_row_a_group_not_an_id(spark, make_docs, tmp_path):
    rng = random.Random(1)
    text = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=40)) for _ in range(6)]
    docs = make_docs([(None, text[0], "en"), (None, text[1], "en"), (7, text[2], "en"), (7, text[3], "en"),
                      (None, text[4], "en"), (9, text[4] + " ", "en"), (9, text[5], "en"), (8, text[5] + " ", "en")])
    near = cp.near_stage(spark, docs, str(tmp_path))
    assert sorted((r.doc_id or 0, r.text) for r in near.collect()) == sorted(
        [(0, text[0]), (0, text[1]), (7, text[2]), (7, text[3]), (9, text[4] + " "), (8, text[5] + " ")])


def test_a_hot_id_and_text_is_cut_before_it_travels(spark, make_docs):
    docs = make_docs([(1, "same text", "en")] * 300 + [(2, "other", "en")])
    kept = docs.select(cp._key(cp._text_key()).alias("_key")).distinct()
    out = cp._only(docs, cp._key(cp._text_key()), kept)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "same text"), (2, "other")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan.split("WindowGroupLimit", 1)[1]
    limits = [line for line in plan.splitlines() if "WindowGroupLimit" in line]
    assert any("Partial" in x for x in limits) and any("Final" in x for x in limits)


def _plain_run(rows, rejected):
    """The stages before packing in plain Python: rows ``(doc_id, text)`` -> those kept, texts cut."""
    import re

    import xxhash

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    last = lambda r: (r[0] is None, r[0] or 0)
    rows = [r for r in rows if (r[0], r[1]) not in rejected]
    exact = {}
    for r in sorted(rows, key=last):
        exact.setdefault(norm(r[1]), r)
    rows = list(exact.values())

    def bits(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [bits(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for r, g in sorted(zip(rows, group, strict=True), key=lambda x: last(x[0])):
        best.setdefault(g, r)
    rows = sorted(best.values(), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            window = tuple(words[k:k + 20])
            if window in seen:
                gone[k:k + 20] = [True] * 20
            seen.add(window)
        out.append((i, " ".join(w for w, g in zip(words, gone, strict=True) if not g) if any(gone) else t))
    return out


def test_run_matches_plain_python(spark, make_docs, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8))) for _ in range(400)]
    write = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage = write(60)
    # toxic ids 1000.. carry words that clean ones never use
    toxic = [(1000 + i, f"{write(12)} vilescum you vilescum {write(6)} nastyrot") for i in range(60)]
    clean = [(i, write(rng.randint(20, 60))) for i in range(1, 140)]
    copies = [(300 + i, clean[i][1] + (" " if i % 2 else "")) for i in range(12)]
    near = [(400 + i, write(300)) for i in range(4)]
    near += [(410 + i, t.upper()) for i, (_, t) in enumerate(near[:3])]
    shared = [(500 + i, f"{write(15)} {passage} {write(15)}") for i in range(5)]
    odd = [(None, None), (None, write(25)), (None, write(25)), (7, write(30)), (7, write(30)), (600, ""), (601, " \n ")]
    rows = toxic + clean + copies + near + shared + odd + [clean[5]] * 30
    _labels(spark, tmp_path, [(i, 1, int(i >= 1000)) for i in [*range(1, 140), *range(1000, 1060)]])
    make_docs([(i, t, "en") for i, t in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    kept = cp.toxicity_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    rejected = {(i, t) for i, t in rows} - {(r.doc_id, r.text) for r in kept}
    assert len(rejected & set(toxic)) > 50 and len(rejected - set(toxic)) < 3
    want = _plain_run(rows, rejected)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    sizes = sorted((str(i), len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in want)
    got = cp.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.length) for r in got) == sizes
