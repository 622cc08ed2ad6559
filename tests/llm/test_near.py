"""Near-duplicates: links and components against brute force, with the awkward cases."""

import random

import numpy as np
import pytest

from riskloom.llm import blocks, jaccard, lines
from riskloom.llm.components import components

SCHEMA = "doc_id long, text string, n long, key string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", "c") for i, t in rows], SCHEMA)


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    base = [[word() for _ in range(n)] for n in (3, 4, 7, 9, 14, 30, 60, 120, 400)]
    rows, i = [], 100
    for b in base:
        for edits in (0, 0, 1, 1, 2, 3, 5, 9, 15):
            w = list(b)
            for _ in range(edits):
                w[r.randrange(len(w))] = word()
            rows.append((i, " ".join(w)))
            i -= 1 if r.random() < 0.5 else -7
    rows += [(900, None), (901, ""), (902, " \n\t "), (None, "a b c d e"), (903, "A B c D e"), (904, "a b c d e"), (905, "one"), (906, "ONE")]
    return list({k: (k, t) for k, t in rows}.values())


def groups(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, k, num):
    rows = corpus()
    sets = {i: jaccard.shingle_set(t or "", k) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    assert links
    want = groups(ids, links)
    got = jaccard.near_groups(frame(spark, rows), k, num).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) for r in got if r.doc_id is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    kept = {r.doc_id for r in jaccard.one_of_each(frame(spark, rows), k, num).collect()}
    assert kept == {*want.values(), None}


def test_jaccard_empty_table_and_repeated_rows(spark):
    assert jaccard.near_groups(frame(spark, []), 4, 85).collect() == []
    got = jaccard.near_groups(frame(spark, [(2, "a b c d e f")] * 3 + [(1, "a b c d e f")]), 4, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (2, 1), (2, 1)]


def test_large_groups_of_near_copies(spark):
    """Each copy differs from its original by one word, so two copies may not link, but all link to the original."""
    r = random.Random(1)
    base = [f"w{j}" for j in range(100)]
    rows = [(500, " ".join(base))]
    for i in range(300):
        w = list(base)
        w[r.randrange(3, 97)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = jaccard.near_groups(frame(spark, rows), 4, 85).collect()
    assert {x.component_id for x in got} == {0}


def test_pigeonhole_loses_no_pair():
    r = np.random.default_rng(3)
    for n in (6, 7, 8, 12, 20, 33, 50, 150, 700):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = a.copy()
        most = (15 * 2 * n // 185) // 2
        b[r.choice(n, most, replace=False)] = r.integers(0, 2**63, most, dtype=np.uint64)
        keys, owner = jaccard.sketch_keys([a, np.unique(b)], 85)
        if most:
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist()), n


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    want = groups(range(200), edges)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == c for i, c in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def similar(a, b):
    return 100 * edit(a, b) <= 20 * max(len(a), len(b))


def test_lines_against_brute_force(spark):
    """Edit similarity alone decides; whole documents are compared."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    base = [" ".join(word() for _ in range(n)) for n in (1, 3, 8, 20, 40, 60)]
    texts = []
    for i in range(24):
        own = []
        for b in r.sample(base, 3):
            w = b.split()
            if r.random() < 0.5 and len(w) > 1:
                w[r.randrange(len(w))] = word()
            own.append(r.choice([" ".join(w), " ".join(w).upper() + "!", "  " + " ".join(w)]))
        texts.append((i, "\n".join(own + [""] * (i % 3))))
    texts.append((80, "\n".join(base)))  # of which all others are one word away
    texts += [(90, None), (91, ""), (92, "\n\n"), (93, "x" * 5000), (94, "x" * 5000), (95, " ".join(f"w{i}" for i in range(30_000)))]
    texts += [(96, texts[-1][1].replace("w17 ", "v17 ")), (97, "\n".join(f"{word()} {word()} {word()} {i}" for i in range(3000)))]
    place = {}
    for i, t in texts:
        for k, w in enumerate(lines.normalised(t or "")):
            if w:
                place.setdefault(b" ".join(w).decode(), []).append((i, k))
    names = [x for x, v in place.items() if v[0][0] < 95]
    links = [(j, i) for i, a in enumerate(names) for j in range(i) if similar(a, names[j])]
    assert links
    group = groups(range(len(names)), links)
    at = {}
    for i, n in enumerate(names):
        at.setdefault(group[i], []).extend(place[n])
    gone = {x for v in at.values() for x in v if x != min(v)} | {(96, 0)}
    got = {x.doc_id: x for x in lines.dedup_lines(frame(spark, texts)).collect()}
    for i, t in texts[:-1]:
        want = t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        assert got[i].text == want, i
        assert (got[i].key, got[i].n) == ("k", 1)
    left = {x.doc_id for x in lines.dedup_lines(frame(spark, texts), drop_emptied=True).collect()}
    assert not {94, 96} & left and {90, 91, 92, 93, 95, 97} <= left


def test_lines_with_clashing_columns_and_one_id_for_two_texts(spark):
    names = ["lines", "th", "_lines", "_extra", "_c", "cls", "t", "d", "doc_id", "text"]
    rows = [(*"abcdefgh", i, t) for i, t in ((1, "one two three four\nown"), (2, "One two three four!\nfive"), (2, "six seven\nother"), (2, "six seven\nother"))]
    got = lines.dedup_lines(spark.createDataFrame(rows, names).withColumnRenamed("_lines", "_l"))
    assert sorted((r.doc_id, r.text, r.cls, r.lines) for r in got.collect()) == [(1, "one two three four\nown", "f", "a"), (2, "five", "f", "a"), (2, "six seven\nother", "f", "a"), (2, "six seven\nother", "f", "a")]


def test_lines_empty_table_null_id_repeated_rows(spark):
    assert lines.dedup_lines(frame(spark, [])).collect() == []
    got = lines.dedup_lines(frame(spark, [(None, "a b c"), (2, "a b c"), (2, "a b c"), (3, "a b c\nd")])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "a b c"), (2, "a b c"), (2, "a b c"), (3, "d")]


def test_packed_keeps_every_membership():
    keys = np.array([5, 9, 5, 2**63, 9, 5], np.uint64)
    rows = list(blocks.packed(keys, np.arange(6), 4))
    seen = {(k, v) for row in rows for ks, vs in zip(row["keys"], row["docs"]) for k, v in zip(np.frombuffer(ks, np.uint64).tolist(), np.frombuffer(vs, np.int64).tolist())}
    assert seen == set(zip(keys.tolist(), range(6)))


def test_edit_distance_within_a_bound():
    r = random.Random(6)
    for _ in range(300):
        a, b = ("".join(r.choice("abé ") for _ in range(r.randint(0, 90))) for _ in "ab")
        if r.random() < 0.5:
            b = a[: len(a) // 3] + b[:3] + a[len(a) // 2 :]
        d = edit(a, b)
        assert all(lines._within(a, b, k) == (d <= k) for k in (0, d - 1, d, d + 1, 100) if k >= 0)


def test_replaced_words_leave_a_block():
    """Fewer replaced words than half of the blocks leave a key in common, if its blocks have two words or more."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))).encode()
    for n in (2, 3, 5, 8, 9, 12, 20, 33, 50, 150, 700, 5000):
        for _ in range(20):
            a = [word() for _ in range(n)]
            b = list(a)
            for i in r.sample(range(n), max(1, n // 20) if n > 2 else 0):
                b[i] = b[i] + b"s" if n < 9 else word()
            keys, place = lines.line_keys([a, b], np.empty(0, np.uint64), lines.WordHasher())
            assert set(keys[place == 0].tolist()) & set(keys[place == 1].tolist()), n


def test_simhashes_take_majorities():
    r = np.random.default_rng(0)
    h = r.integers(0, 2**64, 2000, dtype=np.uint64)
    first = np.array([0, 1, 3, 10, 700])
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(int)
    for s, a, b in zip(lines.simhashes(h, first), first, [*first[1:], 2000]):
        assert (np.unpackbits(np.array([s]).view(np.uint8)) == (2 * bits[a:b].sum(0) > b - a)).all()


@pytest.mark.parametrize("common", [0, 30])
def test_recall_of_similar_lines(spark, common):
    """Edit similarity alone decides: one or two words of ten to twenty-four are replaced. With common, most words
    are from a few, which then don't count."""
    r = random.Random(12)
    rare = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
    few = [rare() for _ in range(common)]
    word = lambda: r.choice(few) if few and r.random() < 0.5 else rare()
    names = []
    for n in (10, 16, 24) * 4:
        base = [word() for _ in range(n)]
        names.append(" ".join(base))
        for edits in (1, 1, 2, 2):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(n)] = word()
            names.append(" ".join(w))
    names = list(dict.fromkeys(names))
    links = [(i, j) for j in range(len(names)) for i in range(j) if similar(names[i], names[j])]
    gone = {i for i, g in groups(range(len(names)), links).items() if i != g}
    got = {x.doc_id for x in lines.dedup_lines(frame(spark, list(enumerate(names)))).collect() if x.text == ""}
    assert got <= gone and len(got) >= 0.95 * len(gone)


def test_hot_lines(spark):
    """A line that a third of all documents have, and many lines that are near one and not each other."""
    r = random.Random(3)
    base = [f"word{j}" for j in range(40)]
    rows = [(i, "the very same line\nbut " + f"own{i} line{i}" * 3) for i in range(300)] + [(1000, " ".join(base))]
    for i in range(200):
        w = list(base)
        for j in r.sample(range(40), 4):
            w[j] = f"x{i}y{j}z"
        rows.append((1001 + i, " ".join(w)))
    got = {x.doc_id: x.text for x in lines.dedup_lines(frame(spark, rows)).collect()}
    assert sum("very same" in t for t in got.values()) == 1 and [i for i in got if i >= 1000 and got[i]] == [1000]
