"""Findings of round 2, third time."""

import random

import numpy as np
import pyarrow as pa

from riskloom.llm import lines, lm


def test_shards_go_by_tokens(spark):
    """op2_lm_scoring: a small table has few shards, whatever the number of partitions."""
    own = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 61)
    try:
        model = lm.train(spark.createDataFrame([(i, f"a b{i} c d{i % 7} e") for i in range(200)], "doc_id long, text string"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)
    assert [len(level.paths) for level in model.levels] == [61, 1, 1]
    assert [level.size for level in model.levels] == [3 + 200 + 7 + 1, 200 * 2 + 7 * 2 + 1, 200 * 2 + 7 * 2]


def test_cut_shards_and_whole_ones_score_the_same(spark, monkeypatch):
    """op2_lm_scoring: a context that is spread over shards gives its back-off weight in each of them."""
    r = np.random.default_rng(4)
    rows = [(i, " ".join(f"the w{x}" if x % 3 else f"w{x}" for x in r.zipf(1.3, 60) % 90)) for i in range(150)] + [(500, "the the never w1 the nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(lm.train_and_score(docs).collect())
    trained, train = [], lm.train
    monkeypatch.setattr(lm, "train", lambda *args: trained.append(train(*args)) or trained[-1])
    monkeypatch.setattr(lm, "PIECE", 150)
    monkeypatch.setattr(lm, "SHARD", 150)
    got = sorted(lm.train_and_score(docs).collect())
    assert trained[0].levels[1].home and len(trained[0].levels[1].paths) > 20
    assert got == want


def test_tokens_are_those_of_split():
    texts = ["", None, "  A b\n\x0bB\x1c\xa0c ", "".join(chr(i) + "Z" for i in range(300)), "É é"]
    at, hashes, n = lm.tokens(pa.array(texts))
    split = [[*(t or "").encode().lower().split(), b""] for t in texts]
    assert n.tolist() == list(map(len, split))
    assert hashes[at].tolist() == [lm.WordHasher().h(w) for s in split for w in s]
    assert len(set(hashes.tolist())) == len(hashes)


def unlike(r, n, letters="eeeetaoinshrdlu  é"):
    return "".join(r.choice(letters) for _ in range(n))


def test_few_distances_of_unlike_lines_are_taken_whole(monkeypatch):
    """op4_line_dedup, pipeline: nearly all pairs of unlike lines are ruled out by a part of their halves."""
    whole = []
    for name in ("_together", "_within"):
        monkeypatch.setattr(lines, name, lambda xs, ys, most, own=getattr(lines, name): whole.append(1 if isinstance(xs, str) else len(xs)) or own(xs, ys, most))
    r = random.Random(1)
    xs, ys = ([unlike(r, r.randint(60, 900)) for _ in range(1500)] for _ in "xy")
    ys = [unlike(r, len(x) + r.randint(0, len(x) // 6)) for x in xs]
    assert not lines.within(xs, ys, [max(len(x), len(y)) // 5 for x, y in zip(xs, ys)]).any()
    assert sum(whole) < 300


def test_halves_rule_out_no_link():
    """Edits up to the bound, and one more, anywhere: in one half, at an end, or spread."""
    r = random.Random(7)
    xs, ys = [], []
    for n in (40, 64, 65, 130, 250, 420) * 60:
        x, y = unlike(r, n), None
        lo, hi = r.choice([(0, n), (0, n // 2), (n // 2, n), (0, n // 5 + 1), (4 * n // 5, n)])
        y = list(x)
        for _ in range(n // 5 + r.randint(-3, 25)):
            i = min(r.randint(lo, hi), len(y) - 1)
            y[i : i + r.randint(0, 1)] = r.choice([[], ["q"], ["z"]])
        xs.append(x)
        ys.append("".join(y))
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(xs, ys)]
    most = [len(y) // 5 for _, y in pairs]
    near = [lines._within(*p, m) for p, m in zip(pairs, most)]
    assert 60 < sum(near) < 300
    assert lines.within(xs, ys, most).tolist() == near
    kept = set(lines._maybe_near(pairs, most, sorted(range(len(pairs)), key=lambda i: len(pairs[i][1]))))
    assert all(i in kept for i, linked in enumerate(near) if linked)
