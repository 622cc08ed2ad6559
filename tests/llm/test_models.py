"""Language model, search, quality rules and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from riskloom.llm import eliasfano, lm, quality, topk, queries

TABLES = "/root/testdata/sf0.001"


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, top in ((1, 1), (5, 3), (1000, 10), (1000, 10**6), (3000, 2**62)):
        v = np.sort(r.integers(0, top, n, dtype=np.uint64))
        s = eliasfano.Sequence(eliasfano.encode(v))
        assert (s.get(np.arange(n)) == v).all()
        q = np.concatenate([v, r.integers(0, top + 5, 500, dtype=np.uint64)])
        lo = r.integers(0, n + 1, len(q))
        hi = np.minimum(n, lo + r.integers(0, n + 1, len(q)))
        place, hit = s.successor(lo, hi, q)
        want = np.clip(np.searchsorted(v, q, "left"), lo, hi)
        assert (place == want).all() and (hit == ((want < hi) & (v[np.minimum(want, n - 1)] == q))).all()


def brute(train, texts, order):
    """Interpolated absolute discounting straight from counts."""
    seq = [(t or "").encode().lower().split() + [b""] for t in train]
    grams = [Counter(tuple(s[i : i + k]) for s in seq for i in range(len(s) - k + 1)) for k in range(1, order + 1)]
    after = [Counter(g[:-1] for g in c) for c in grams]
    n, v = sum(grams[0].values()), len(grams[0])
    disc = [0.5]
    for c in grams[1:]:
        n1, n2 = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
        disc.append(min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5)

    def p(ctx, w):
        if not ctx:
            return (grams[0][(w,)] + 0.5) / (n + 0.5 * (v + 1))
        low, k = p(ctx[1:], w), len(ctx)
        total, d = grams[k - 1][ctx], disc[k]
        if not total or not after[k][ctx]:
            return low
        c = grams[k][(*ctx, w)]
        return max(c - d, 0) / total + d * after[k][ctx] / total * low

    out = []
    for t in texts:
        s = (t or "").encode().lower().split() + [b""]
        out.append(sum(math.log10(p(tuple(s[max(0, i - order + 1) : i]), w)) for i, w in enumerate(s)))
    return out, n, v, grams[0]


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(spark, order):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)] + ["The", "the", "of"] * 10
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) for _ in range(120)] + [None, "", "zz unseen the", "the " * 400]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "the of")]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    got = {x.doc_id: x for x in lm.train_and_score(df, order).collect()}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    want, n, v, c = brute([t for i, t in rows if not held[i]], [t for _, t in rows], order)
    z = n + 0.5 * (v + 1)
    for (i, t), s in zip(rows, want):
        words = (t or "").encode().lower().split() + [b""]
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[i], len(words), sum(c[(w,)] > 0 for w in words), n)
        assert x.base_score == pytest.approx(sum(math.log10((c[(w,)] + 0.5) / z) for w in words))
        assert abs(x.score - s) <= (0.03 * order) * len(words)


def test_language_model_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.train_and_score(df).collect() == []


def test_hot_context_is_spread_over_shards():
    ctx, word = lm._splits([{"shard": 0, "split_at": [3, 3, 3], "split_part": [0.25, 0.5, 0.75]}], {0: 10}, 1000)
    assert list(zip(ctx.tolist(), word.tolist())) == [(0, 0), (10, 0), (13, 250), (13, 500), (13, 750)]
    at = lm.shard_of(np.array([0, 12, 13, 13, 13, 14]), np.array([5, 0, 100, 250, 900, 0]), ctx, word)
    assert at.tolist() == [0, 1, 1, 2, 4, 4]


def test_top_k_against_brute_force(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=8).tolist()) for i in range(300)] + [(1000 + i, [0.5] * 8) for i in range(200)]
    rows += [(2000, None), (2001, []), (2002, [1.0, None] + [0.0] * 6), (2003, [math.nan] * 8), (2004, [math.inf] + [0.0] * 7), (2005, [1.0] * 3), (None, [1.0] * 8), (50, rows[50][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.search(topk.scaled(df), 50, 5).collect())
    use = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in use if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(use[q], v)), i) for i, v in use.items() if i != q)[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_top_k_small_and_empty(spark):
    kind = "vec_id long, embedding array<float>"
    assert topk.search(topk.scaled(spark.createDataFrame([], kind)), 50, 5).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], kind)
    assert sorted((x.rank, x.vec_id, x.score) for x in topk.search(topk.scaled(few), 50, 5).collect()) == [(1, 2, 65536), (2, 1, 0)]


def test_topk_of_huge_vectors_and_other_lengths(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=4)]) for i in range(40)]
    rows += [(100 + i, [float(x) * 10.0 ** (4 + i) for x in r.normal(size=4)]) for i in range(10)]
    rows += [(200 + i, [float(x) for x in r.normal(size=3)]) for i in range(8)] + [(300, [1e300, -1e300, 1e300, 0.0]), (310, [1e307] * 4), (320, [1.0])]
    rows += [rows[0], (101, rows[3][1])]
    out = sorted(tuple(x) for x in topk.search(topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), 10, 5).collect())
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if all(math.isfinite(256 * x) for x in v)]
    want = []
    for q in {i for i, _ in whole if i % 10 == 0}:
        best = {}
        for _, x in (w for w in whole if w[0] == q):
            for i, y in whole:
                if i != q and len(x) == len(y):
                    s = max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y))))
                    best[i] = max(best.get(i, s), s)
        want += [(q, n, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda p: (-p[1], p[0]))[:5], 1)]
    assert out == sorted(want)
    only = spark.createDataFrame([(10, [1e200]), (11, [-1e200])], "vec_id long, embedding array<double>")
    assert [tuple(x) for x in topk.search(topk.scaled(only), 10, 5).collect()] == [(10, 1, 11, -(2**63))]


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality_counts_and_score(spark):
    r = random.Random(7)
    good = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "é"]) for _ in range(30)) for _ in range(20)]
    bad = [" ".join(r.choice("#*$%&|<>") + r.choice("xyz") for _ in range(30)) for _ in range(10)]
    line = "one two three four five six seven eight nine"
    odd = [None, "", " \n\t", "a b", f"{line}\n{line}\n{line} ten", "w " * 60, "a b " * 25 + "\n\n", "\n".join([line] * 2 + ["", " ", ""])]
    texts = good + bad + odd
    df = spark.createDataFrame([(i, t, 5, "k", True) for i, t in enumerate(texts)], "doc_id long, text string, n_words long, quality string, kept boolean")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(15)] + [(20, 0, None), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.judge(df, labels, "verdict", buckets=97).collect()}
    trusted = {x._ql_id for x in quality.trusted_ids(labels).collect()}
    assert trusted == set(range(15))

    def h(*parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p, seed)
        return seed

    def signed(x):
        return x - 2**64 if x >= 2**63 else x

    def bins(t):
        own = [h(w.encode()) for w in words_of(t)]
        pairs = [h(a.to_bytes(8, "little"), b.to_bytes(8, "little")) for a, b in zip(own, own[1:])]
        return [signed(x) % 97 for x in own + pairs]

    held = {i for i in trusted if signed(h(i.to_bytes(8, "little"))) % 10 < 4}
    raw, ok = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(bins(t))
        if i in trusted - held:
            ok.update(bins(t))
    ratio = [math.log(ok[b] + 1) - math.log(sum(ok.values()) + 97) - math.log(raw[b] + 1) + math.log(sum(raw.values()) + 97) for b in range(97)]
    for i, t in enumerate(texts):
        w, v = words_of(t), got[i].verdict
        at, covered, seen, repeated = defaultdict(list), set(), set(), 0
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        for places in at.values():
            if len(places) > 1:
                covered.update(x for k in places for x in range(k, k + 8))
        for x in (t or "").split("\n"):
            if words_of(x):
                repeated += x in seen
                seen.add(x)
        assert (v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), repeated, len(covered)), i
        assert v.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        b = bins(t)
        assert v.llr == pytest.approx(sum(ratio[x] for x in b) / len(b) if b else 0.0)
        assert not (v.kept and v.base_failed) and (got[i].n_words, got[i].kept) == (5, True)
    assert all(got[i].verdict.kept for i in held) and not any(got[i].verdict.kept for i in range(20, 30))
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and 0 < kept.count() < len(texts)


def test_quality_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t u")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [x.quality.kept for x in quality.judge(df, none).collect()] == [True]
    assert quality.judge(df.limit(0), none).collect() == []


def test_pipeline(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, TABLES)
        after = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
        assert after and after <= before
        if i < 3:
            assert docs.columns == columns
            docs = corpus_pipeline.stored(docs, "test-stage")
    assert after == before
    assert corpus_pipeline.run(spark, TABLES).count() == docs.count()


def test_registered_query_has_two_words_of_context(spark, monkeypatch):
    models, train = [], lm.train
    monkeypatch.setattr(lm, "train", lambda *args: models.append(train(*args)) or models[-1])
    rows = queries.op2_lm_scoring(spark, TABLES)
    assert models[0].order >= 3 and len(models[0].levels) >= 3 and models[0].levels[2].size > 0
    assert rows.count() == spark.read.parquet(f"{TABLES}/documents.parquet").count()
