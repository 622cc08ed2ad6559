"""Findings of the second round, taken up again."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import lines, quality
from riskloom.llm.common import drop_stored, stored


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def misspelt(count):
    """Lines of 30 words and copies in which every third word has a letter more: edit similarity is 90 % and more, but
    a third of the word pairs are the same; only those that agree in a block."""
    r = random.Random(8)
    out = []
    while len(out) < count:
        a = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(5, 8))) for _ in range(30)]
        b = [w + "z" if i % 3 == 0 else w for i, w in enumerate(a)]
        keys, place = lines.line_keys([[w.encode() for w in x] for x in (a, b)], np.empty(0, np.uint64), lines.WordHasher())
        if set(keys[place == 0].tolist()) & set(keys[place == 1].tolist()):
            out.append((" ".join(a), " ".join(b)))
    return out


def test_misspelt_lines_link(spark):
    """no bound on shared word pairs or SimHashes takes a link away."""
    pairs = misspelt(40)
    rows = [(i, "\n".join(p)) for i, p in enumerate(pairs)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(i, a) for i, (a, _) in enumerate(pairs)]


def test_block_in_parts(spark, monkeypatch):
    """lines of one block, which are near one another in twos; blocks of more than TILE lines are cut."""
    monkeypatch.setattr(lines, "TILE", 8)
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
    base = [word() for _ in range(9)]
    rows = []
    for i in range(60):  # the last word differs, and much: the others agree in a block
        w = base[:8] + ["".join(r.choice("qrstuvwxyz") for _ in range(40))]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w)[:-1] + "a")]
    got = {x.doc_id for x in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x.text}
    near = {i for i, a in rows if not any(100 * edit(a, b) <= 20 * max(len(a), len(b)) for j, b in rows if j < i)}
    assert got == near


def test_distances_taken_together():
    r = random.Random(3)
    xs, ys = [], []
    for n in (0, 1, 20, 63, 64, 65, 130, 300) * 30:
        a = "".join(r.choice("abcé ") for _ in range(n))
        b = list(a)
        for _ in range(r.randrange(n // 3 + 2)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randrange(2)] = r.choice(["", "d", "ü"])
        xs.append(a)
        ys.append("".join(b))
    for share in (0, 10, 20, 100):
        most = [share * max(len(a), len(b)) // 100 for a, b in zip(xs, ys)]
        assert lines.within(xs, ys, most).tolist() == [edit(a, b) <= m for a, b, m in zip(xs, ys, most)]


@pytest.mark.parametrize("words", [quality.WORDS, 0])
def test_chosen_documents(spark, words):
    """op6_quality_rules: documents with the ids, whatever these are, and no others."""
    ids = [0, 1, 63, 64, -1, -64, -65, 2**63 - 1, -(2**63), 12345678901]
    rows = [(i, f"t{i}") for i in [*ids, 2, 62, 65, -2, -63, 2**63 - 2, 5, 5]] + [(1, "again"), (None, "none"), (0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality._chosen(docs, spark.createDataFrame([(i,) for i in ids], "_ql_id long"), words=words).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in docs.where(F.col("doc_id").isin(ids)).withColumnRenamed("doc_id", "_ql_id").collect())


def test_trusted_ids_move_no_texts(spark):
    """op6_quality_rules: texts of trusted documents aren't shuffled, whatever the size at which joins broadcast."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('a b ', 50) AS text")
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        chosen = quality._chosen(docs, spark.range(0, 3000, 2).selectExpr("id AS _ql_id"))
        assert chosen.count() == 1500 and "SortMergeJoin" not in chosen._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)


def test_stored_frees_its_shuffle(spark):
    """op2_lm_scoring, pipeline: shuffles of steps that are stored don't pile up on the executors' disks."""
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    for _ in range(3):
        drop_stored(stored(spark.range(2000).repartition(4, "id"), "freed"))
    end = time.time() + 20
    while files() > before and time.time() < end:
        time.sleep(0.2)
    assert files() <= before
