"""Each operator on odd documents, against its plain version."""

import hashlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from doctide.llm import bloom, license_scan, line_dedup, mixing, ngram_join, piece_codec, quality_model, quality_rules, sharding, suffix_dedup, topk
from doctide.llm.queries import tokenizer
from doctide.llm.work import Work

PIECES = tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return brute.documents(spark).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_license_scan(docs, empty):
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for i, t in brute.by_id().items():
        w, *want = brute.license_places(t)
        r = got[i]
        assert [r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels] == want
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert any("cc-by-nc" in r.labels for r in got.values()) and license_scan.scan(empty).count() == 0


def test_license_matches_are_those_of_all_pairs(docs):
    _, index = license_scan.template_index(docs, "text")
    got = {r.doc_id: {(m.template, m.block) for m in r.matches} for r in license_scan.scan(docs).collect()}
    for i, t in brute.by_id().items():
        w, n, *_ = brute.license_places(t)
        want = set()
        for k, (_, words, _, need) in enumerate(index):
            step = license_scan.stride(license_scan.TEMPLATES[k][1])
            for b in range(max(1, -(-(n - step) // step)) if n else 0):
                if len(set(w[b * step:b * step + 2 * step]) & set(words)) >= need:
                    want.add((k, b))
        assert got[i] == want


def test_license_templates_of_any_length(spark):
    """A long template lies whole in one of its blocks wherever it stands; only A-Z are lower-cased."""
    long = " ".join(f"clause{k}" for k in range(300))
    many = [(f"l{k}", " ".join(f"w{k}x{j}" for j in range(6 + k % 30))) for k in range(150)]
    texts = [("filler " * k + long.upper() + " filler" * 40) for k in (0, 1, 33, 300, 511)]
    texts += ["filler " * 7 + many[k][1] + " end" for k in (3, 77, 149)] + ["This wor\u212a is licensed under wor\u212a", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan(df, templates=(("long", long), ("work", "this work is licensed"), *many)).collect()}
    assert got == {**{k: "long" for k in range(5)}, 5: "l3", 6: "l77", 7: "l149", 8: "", 9: "", 10: ""}


def test_line_dedup(docs, empty):
    got = {r.doc_id: (r._n_lines, r._n_dropped, r._kept) for r in line_dedup.dedup(docs, keep=("doc_id", "_keep", "_text", "id")).collect()}
    assert got == brute.line_dedup(brute.by_id()) and sum(x[1] for x in got.values()) >= 6
    assert line_dedup.dedup(empty).count() == 0


def test_line_dedup_of_repeated_and_null_ids(spark):
    line = "x" * 45
    rows = [(k, line) for k in (1, 2, 3, 4, 4)] + [(None, line + "y")] * 6
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r._n_dropped for r in line_dedup.dedup(df).collect()] == [0] * 11
    more = df.union(spark.createDataFrame([(5, line)], df.schema))
    assert Counter((r.doc_id, r._n_dropped) for r in line_dedup.dedup(more).collect() if r.doc_id) == {(1, 1): 1, (2, 1): 1, (3, 1): 1, (4, 1): 2, (5, 0): 1}


def test_filters_merge_as_their_keys():
    rnd = np.random.default_rng(1)
    a, b = (rnd.integers(0, 4000, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
    parts = []
    for x in (a, b):
        f = bloom.Filters(1 << 16)
        f.add(x[:1000])
        f.add(x[1000:])
        parts.append((f.once, f.twice))
    _, twice = bloom.merge(parts)
    values, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    assert bloom.Filters.has(twice, values[counts > 1]).all()
    assert bloom.Filters.has(twice, values[counts == 1]).mean() < 0.5


def _suffix(df, **more):
    out = suffix_dedup.dedup(df, keep=("doc_id", "_keep") if "_keep" in df.columns else ("doc_id",), **more)
    return sorted((r.doc_id if r.doc_id is not None else -1, len(r._kept) + r._n_removed, r._n_removed, r._n_spans, hashlib.sha256(bytes(r._kept)).hexdigest()) for r in out.collect())


def test_suffix_dedup(docs, empty):
    want = sorted(brute.suffix_dedup([(i, t.encode()) for i, t in brute.by_id().items()]))
    assert _suffix(docs) == want and sum(x[2] for x in want) > 5000
    assert _suffix(docs, n_batches=1) == want and _suffix(docs, n_batches=7) == want
    assert suffix_dedup.dedup(empty).count() == 0


def test_suffix_dedup_of_random_and_repeated_rows(spark):
    rnd = np.random.default_rng(3)
    base = ["".join(rnd.choice(list("abc "), 700)) for _ in range(3)]
    rows = []
    for k in range(40):
        a, b = rnd.integers(0, 450, 2)
        x, y = base[rnd.integers(3)], base[rnd.integers(3)]
        rows.append((int(k), x[a:a + 150 + int(rnd.integers(120))] + "".join(rnd.choice(list("xyz"), int(rnd.integers(60)))) + y[b:b + 190 + int(rnd.integers(20))]))
    rows += [(7, "q" * 250), (7, "r" * 260), (8, "s" * 199), (9, "s" * 200), (None, "once more " * 30), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute.suffix_dedup([(i if i is not None else -1, t.encode()) for i, t in rows]))
    assert _suffix(df) == want


def test_suffix_dedup_of_later_batches(spark, docs):
    """A kept index: later documents lose what repeats in them or in those before; levels merge geometrically."""
    rows = [(i, t) for i, t in brute.by_id().items()]
    parts = [rows[k::3] for k in range(3)]
    frames = [spark.createDataFrame(p, "doc_id long, text string") for p in parts]
    index, known, before = suffix_dedup.IndexFamily(Work(spark, "kept-index")), None, []
    for part, frame in zip(parts, frames):
        before += part
        want = sorted(brute.suffix_dedup([(i, t.encode()) for i, t in before]))
        ids = {i for i, _ in part}
        index = suffix_dedup.IndexFamily(index.work, index.levels)
        assert _suffix(frame, n_batches=1, family=index, known=known) == [x for x in want if x[0] in ids]
        known = frame if known is None else known.union(frame)
    assert [size for size, _ in index.levels] == [2, 1]
    run = index.work.get(f"run-{index.levels[0][1]}", suffix_dedup.ENTRY)
    assert run.count() + index.work.get(f"run-{index.levels[1][1]}", suffix_dedup.ENTRY).count() == index.entries().count() > 50
    parts = run.withColumn("p", F.spark_partition_id()).collect()
    assert all(list(x) == sorted(x) for p in {r.p for r in parts} for x in [[(r.key, r.seg, r.d1, r.d2, r.s) for r in parts if r.p == p]])


def test_suffix_batches_are_read_and_dropped_one_by_one(spark):
    """The entries' folders, one a batch: the others stay whole when one is dropped; a batch may be empty, and all."""
    work = Work(spark, "by-batch")
    for n in (100, 0):
        made = spark.range(n).select((F.col("id") % 3 * 2).cast("int").alias("batch"), F.col("id").alias("key"))
        table = work.put(made, f"entries-{n}", partition_by="batch")
        left = sorted(made.collect())
        for k in range(5):
            got = table.filter(F.col("batch") == k).select("batch", "key").collect()
            assert sorted(got) == [r for r in left if r.batch == k]
            work.drop(f"entries-{n}/batch={k}")
            left = [r for r in left if r.batch != k]
            assert sorted(work.get(f"entries-{n}", made.schema).select("batch", "key").collect()) == left
    work.drop()


def test_suffix_scan_in_pieces_gives_the_same(docs, monkeypatch):
    want = _suffix(docs)
    text = np.frombuffer((brute.texts()[-3] * 3).encode(), np.uint8)
    whole = suffix_dedup.segments(text, np.array([0]), np.array([len(text)]))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    total, pieces = 0, []
    for rows, starts, ends, shift in suffix_dedup._pieces(np.array([0, len(text)])):
        for s, e, h in zip(starts, ends, shift):
            part = suffix_dedup.segments(text[s:e], np.array([0]), np.array([e - s]))
            total += int(part[2].sum())
            pieces += (part[1] + h).tolist()
    assert total == int(whole[2].sum()) and min(pieces) == 0 and len(want) == len(brute.by_id())


def test_ngram_classes(docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(docs).collect()}
    assert got == brute.ngram_classes(brute.by_id())
    assert ngram_join.classes(empty).count() == 0 and ngram_join.one_of_each(empty).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, c in got.values()}


@pytest.mark.parametrize("percent", [60, 75, 95])
def test_ngram_thresholds_on_many_near_copies(spark, percent):
    rnd = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    base = [list(rnd.choice(words, int(rnd.integers(5, 60)))) for _ in range(6)]
    rows = []
    for k in range(150):
        w = list(base[rnd.integers(6)])
        for _ in range(int(rnd.integers(0, 7))):
            w[int(rnd.integers(len(w)))] = f"e{rnd.integers(50)}"
        rows.append((k, " ".join(w[:len(w) - int(rnd.integers(0, 3))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(df, n=2, percent=percent).collect()}
    assert got == brute.ngram_classes(dict(rows), n=2, percent=percent)


def test_ngram_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e"), (1, "p q r s t"), (2, "a b c d e"), (3, "p q r s t"), (None, "a b c d e"), (4, None)]
    got = Counter((r.doc_id, r.component_id) for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(1, 1): 2, (2, 1): 1, (3, 1): 1, (None, None): 1, (4, 4): 1})


def test_codec(docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = piece_codec.encode(docs, PIECES, keep=("doc_id", "_keep", "_text"))
    got = {r.doc_id: list(r.ids) for r in ids.collect()}
    assert got == {i: [*model.encode(t), 2] for i, t in brute.by_id().items()}
    back = {r.doc_id: r.decoded for r in piece_codec.decode(ids, PIECES).collect()}
    assert back == {i: model.decode(x) for i, x in got.items()}
    for r in piece_codec.digests(docs, PIECES).collect():
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, got[r.doc_id])).encode()).hexdigest()
        assert (r.n_tokens, r.decoded_sha256) == (len(got[r.doc_id]), hashlib.sha256(back[r.doc_id].encode()).hexdigest())
    assert piece_codec.digests(empty, PIECES).count() == 0


def test_codec_on_random_texts_and_ids():
    import sentencepiece

    model, codec = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.Codec(PIECES)
    rnd = np.random.default_rng(2)
    some = list("ab  \n\t▁éñ日🙂\x00<s>012aa  ..--==ﬁ\r")
    texts = ["".join(rnd.choice(some, int(rnd.integers(0, 50)))) for _ in range(800)]
    texts += ["".join(rnd.choice(["ing", "er", "the", "an", " ", "e"], 60)) for _ in range(100)] + [c * n for c in "a= ▁-é" for n in (1, 2, 3, 16, 17, 33, 200)]
    flat, sizes = codec.encode(texts, end=False)
    at = 0
    for t, n in zip(texts, sizes.tolist()):
        assert flat[at:at + n].tolist() == model.encode(t), t
        at += n
    for _ in range(800):
        ids = [int(x) for x in rnd.choice([int(rnd.integers(32000)), int(rnd.integers(3, 259)), 0, 1, 2], 6)]
        assert codec.decode(ids) == model.decode(ids)
        assert codec.decode_all(np.array(ids), np.array([6])) == [model.decode(ids).encode()]


def test_quality_rules(docs, empty):
    got = {r.doc_id: r for r in quality_rules.judge(docs, keep=("doc_id", "_keep", "key")).collect()}
    for i, t in brute.by_id().items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality_signals(t)
        assert not (r.kept and r.base_failed)
    assert quality_rules.judge(empty).count() == 0
    junk = [i for i, t in brute.by_id().items() if t.startswith("###")]
    assert not any(got[i].kept for i in junk) and sum(r.kept for r in got.values()) > 20


def test_quality_rules_keep_whole_groups_without_spread(spark):
    df = spark.createDataFrame([(k, "plain words of one kind only " * 6 + f"and {k} " * 2 + " ".join(map(str, range(40))), "en", "s", 0) for k in range(60)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    assert all(r.kept or r.base_failed for r in quality_rules.judge(df).collect())


def test_quality_rules_differ_by_group(spark):
    """One text, two sources: odd where symbols are rare, ordinary where they are common."""
    prose = lambda k, extra: " ".join(f"word{(k * 7 + j) % 97}" for j in range(60)) + " " + extra
    same = prose(1, "# " * 12)
    rows = [(k, prose(k, ""), "en", "prose") for k in range(200)]
    rows += [(200 + k, prose(k, "# " * (6 + k % 9)), "en", "code") for k in range(200)]
    rows += [(900, same, "en", "prose"), (901, same, "en", "code"), (902, prose(1, "#"), "en", "prose")]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert (got[900], got[901], got[902]) == (False, True, True) and sum(got.values()) >= 395


@pytest.mark.parametrize("n", [0, 1, 7, 8, 23, 50])
def test_sharding(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(5).alias("_shard"), F.lit("x").alias("_row"), F.lit(1).alias("_keep"))
    out = sharding.shard(df.repartition(3)).collect()
    counts = Counter(r._shard for r in out)
    assert sorted(r.doc_id for r in out) == list(range(n)) and max(counts.values(), default=0) - min((counts.get(s, 0) for s in range(8)), default=0) <= 1
    for s, c in counts.items():
        assert sorted(r._slot for r in out if r._shard == s) == list(range(c))


def test_communication_matrix_and_draws():
    parts, shards = np.array([5, 0, 9, 2]), np.array([6, 5, 5])
    mean = np.zeros((4, 3))
    for seed in range(600):
        m = sharding.communication_matrix(parts, shards, seed)
        assert (m.sum(1) == parts).all() and (m.sum(0) == shards).all() and (m >= 0).all()
        mean += m / 600
    assert np.abs(mean - np.outer(parts, shards) / 16).max() < 0.2
    rng = np.random.default_rng(1)
    big = [sharding._draw(rng, 2_000_000_000, 6_000_000_000, 1000) for _ in range(400)]
    assert abs(np.mean(big) - 250) < 4 and 10 < np.std(big) < 18


def test_sharding_permutes_uniformly(spark):
    df = spark.range(16).coalesce(2)
    first = Counter()
    for seed in range(40):
        first.update(r.id for r in sharding.shard(df, 2, seed).filter("_shard = 0").collect())
    assert min(first.values()) >= 8 and max(first.values()) <= 32


def test_topk(spark):
    rnd = np.random.default_rng(4)
    vectors = np.round(rnd.normal(0, 0.3, (400, 12)), 2).astype(np.float32)
    vectors[100:110] = vectors[0]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(vectors)]
    odd = [(1000, None, 0), (1050, [float("nan")] * 12, 0), (1051, [None] * 12, 0), (1052, [float("inf")] * 12, 0), (1053, [], 0), (1100, [1.0, 2.0], 0), (5, rows[5][1], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int").repartition(3)
    whole = np.floor(256 * vectors.astype(np.float64)).astype(int)
    want = []
    for q in range(0, 400, 50):
        scores = sorted((-int(s), k) for k, s in enumerate(whole @ whole[q]) if k != q)[:5]
        want += [(q, j + 1, k, -s) for j, (s, k) in enumerate(scores)]
    assert sorted(tuple(r) for r in topk.search(df).collect()) == want
    assert sorted(tuple(r) for r in topk.search(df, query_block=3).collect()) == want
    assert topk.search(df.limit(0)).count() == 0
    assert [tuple(r) for r in topk.search(df.filter("vec_id = 50")).collect()] == []
    assert sorted(tuple(r) for r in topk.search(df, query_block=3, group_rows=50).collect()) == want
    twice = spark.createDataFrame([(50, [1.0, 0.0]), (7, [0.5, 0.0]), (7, [1.0, 1.0]), (None, [1.0, 1.0]), (50, [9.0, 9.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in topk.search(twice, k=3).orderBy("rank").collect()] == [(7, 18 * 65536), (7, 4.5 * 65536), (7, 65536)]


def test_topk_terms_split_by_bounds():
    """With a k-th best score, trailing terms are non-essential, and no better vector is lost."""
    rnd = np.random.default_rng(9)
    rows = np.floor(rnd.normal(0, 60, (3000, 24)) * np.linspace(3, 0.1, 24))
    shard = topk.Shard(np.arange(3000), rows)
    query = rows[17]
    scores = rows @ query
    best = sorted((-s, i) for i, s in enumerate(scores) if i != 17)[:5]
    _, essential, _ = shard.plan(query, -best[-1][0])
    assert 0 < essential < 24 and shard.plan(query, -np.inf)[1] == 24
    assert shard.search(query, 17, 5, best) == sorted([*best, *best])[:5]
    assert shard.search(query, 17, 5, []) == best


def test_mixing(docs, empty, spark):
    out = mixing.mix(docs, block_tokens=500).collect()
    tokens, seen = Counter(), Counter()
    for r in out:
        tokens[r.source] += r.n_tokens
        seen[r.doc_id] += 1
    assert set(seen) == set(brute.by_id()) and max(seen.values()) <= 2
    taken = mixing.take(docs)
    assert taken.columns == docs.columns and Counter(r.doc_id for r in taken.collect()) == seen
    assert mixing.mix(empty).count() == 0 and mixing.take(empty).count() == 0
    totals, longest = Counter(), Counter()
    for k, t, _, s, *_ in brute.rows():
        n = max(1, len((t or "").split()))
        totals[s] += n
        longest[s] = max(longest[s], n)
    chosen = mixing.decide(list(totals.values()), [1] * len(totals))
    for (s, n), (total, weight, take) in zip(totals.items(), chosen):
        assert total == n <= take <= 2 * n + 1 and take - longest[s] < tokens[s] <= take
        assert all(r.weight == pytest.approx(weight) for r in out if r.source == s)
    ordered = [r.doc_id for r in taken.coalesce(1).collect()]
    assert ordered == [r.doc_id for r in sorted(mixing.mix(docs).collect(), key=lambda r: (r.block, r.place))]


def test_mixing_weights():
    shares, one = np.array([0.7, 0.2, 0.1]), np.ones(3)
    for goal in (0.75, 0.8, 0.9, 0.99):
        a = mixing.fit_exponent(shares, goal, 100.0)
        assert mixing.entropy(mixing.weights_at(shares, one, a), one) == pytest.approx(goal * np.log(3), rel=1e-6)
    assert mixing.fit_exponent(shares, 0.5, 100.0) == 1.0 and mixing.fit_exponent([1.0]) == 1.0
    a = mixing.fit_exponent(shares, 1.0, 2.0)
    assert mixing.epochs_at(shares, mixing.weights_at(shares, one, a)) == pytest.approx(2.0, rel=1e-6)
    # equal sources stand together: the same as one by one
    assert mixing.fit_exponent([0.4, 0.1], 0.95, 9.0, [1, 6]) == pytest.approx(mixing.fit_exponent([0.4, *[0.1] * 6], 0.95, 9.0))


def test_mixing_budget(spark):
    rows = [(k, " ".join(["w"] * 10), "a" if k < 900 else "b") for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for budget, want in ((1000, 1000), (8000, 8000), (10 ** 9, 20000)):
        out = mixing.mix(df, budget=budget, block_tokens=500).collect()
        assert want - 20 <= sum(r.n_tokens for r in out) <= want
        assert max(Counter(r.doc_id for r in out).values()) <= 2 and len({(r.doc_id, r.copy) for r in out}) == len(out)


def test_mixing_blocks_hold_the_weights(spark):
    rows = [(k, " ".join(["w"] * 5), "a" if k % 4 else "b") for k in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, target_entropy=1.0, block_tokens=1000).collect()
    total = {s: sum(r.n_tokens for r in out if r.source == s) for s in "ab"}
    assert total["b"] == 2000 and total["a"] == 3000
    for block in range(3):
        share = sum(r.n_tokens for r in out if r.block == block and r.source == "a") / sum(r.n_tokens for r in out if r.block == block)
        assert share == pytest.approx(0.6, abs=0.02)
    assert mixing.fit_exponent([0.75, 0.25]) < 1  # the default's entropy is one that exponents above 0 reach


def test_quality_model(spark, docs, empty):
    rnd = np.random.default_rng(6)
    good = lambda: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "omega"], 40)) + "."
    bad = lambda: " ".join(x + "###" for x in rnd.choice(["alpha", "beta", "gamma"], 40))
    rows = [(k, good() if k % 3 else bad()) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(200)] + [(201, None), (None, 1), (5, 1)], "doc_id long, quality int")
    model = quality_model.train(df, labels)
    got = {r.doc_id: r.score for r in quality_model.score(df, model).collect()}
    assert all((got[k] >= 0.3) == (k % 3 > 0) for k in range(200, 300)) and all(0 <= s <= 1 for s in got.values())
    odd = quality_model.score(docs, model, keep=("doc_id", "score", "_keep")).collect()
    assert len(odd) == len(brute.by_id()) and quality_model.score(empty, model).count() == 0
    assert {r.score for r in quality_model.score(df, quality_model.train(df, labels.limit(0))).collect()} == {0.5}
    assert {r.score for r in quality_model.score(df, quality_model.train(df, labels.filter("quality = 1"))).collect()} == {1.0}


def test_dual_descent_reaches_the_optimum():
    rnd = np.random.default_rng(8)
    rows = [np.sort(rnd.choice(60, 9, replace=False)).astype(np.int32) for _ in range(80)]
    labels = np.array([int(r[0] < 5) for r in rows])
    ratio = quality_model.log_ratios(rows, labels, 64)
    weight, bias = quality_model.descend(rows, labels, ratio)
    x = np.zeros((80, 64))
    for k, r in enumerate(rows):
        v = ratio[r]
        x[k, r] = v / np.linalg.norm(v)
    x = np.hstack([x, np.ones((80, 1))])
    y = np.where(labels > 0, 1, -1)
    value = lambda w: 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w)).sum()
    w = np.append(weight, bias)
    dual = value(w)
    best = w.copy()
    for step in range(20000):
        g = best - ((y * (x @ best) < 1) * y) @ x
        best -= g * 0.02 / (1 + step / 200)
    assert dual <= value(best) * 1.02


def test_ngram_join_of_ids_with_unlike_rows(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(3, a), (3, b), (1, a), (2, b), (7, c), (8, c), (8, None), (9, None)]
    got = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 1), (3, 1), (7, 7), (8, 7), (8, 7), (9, 9)]
