"""Token files, packing, BPE by words, unigram tokenisation, chat formatting."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.llm import chat, packing, simple8b, tokenfile, unigram
from riskloom.llm.bpe import WordEncoder

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a\nb\n\nC", "\n", "a \n\nb  ", "don't  \tx it's", "<|endoftext|>", "a <|endoftext|> b", "x  y", "\x1c a \x1c!", "é  è\n\n c Œuvre", "!\x1c x", "1 \r\n 2", "日本 語", "😀 a,b.c", "x" * 3000, "A,\nB. c's\nD"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_words_give_the_ids_of_whole_texts(library):
    r = random.Random(4)
    more = ["".join(r.choice("ab, .\n'éZ1 ") for _ in range(r.randint(0, 40))) for _ in range(400)]
    for limit in (3, 1000):
        e = WordEncoder(BPE, limit)
        for t, ids in zip(ODD + more, e.encode(ODD + more)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70000) | st.integers(0, 1), max_size=300), st.sampled_from([7, 64, 2048]))
def test_simple8b_round_trip(values, block):
    v = np.array(values, np.uint64)
    words, offsets = simple8b.encode(v, block)
    assert (simple8b.decode(words, offsets, len(v), block) == v).all()
    for k in range(len(offsets)):
        assert (simple8b.decode_block(words, offsets, len(v), k, block) == v[k * block : (k + 1) * block]).all()


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, 1) for i, t in rows], "doc_id long, text string, start string, length long, shard int")


def test_token_files(spark, library):
    rows = [(5, "b b"), (3, None), (9, ""), (-4, "word " * 3000), (5, "b b"), *((100 + i, t) for i, t in enumerate(ODD))]
    manifest = tokenfile.write_tokens(docs(spark, rows), BPE, 2)
    got = sorted(tokenfile.read_tokens(manifest).collect(), key=lambda r: r.start)
    at = 0
    for (i, t), r in zip(sorted(rows, key=lambda x: x[0]), got, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)
    digest = {(r.doc_id, r.start): r.ids_crc32 for r in tokenfile.read_tokens(manifest, digest=True).collect()}
    assert digest == {(r.doc_id, r.start): zlib.crc32(r.ids) for r in got}
    reader = tokenfile.ShardReader(manifest.orderBy("shard").first().path)
    whole = np.concatenate([x for _, x in reader.ids()])
    assert (reader.block_of(len(whole) - 1) == whole[len(whole) - 1 - (len(whole) - 1) % reader.block :]).all()
    assert tokenfile.read_tokens(tokenfile.write_tokens(docs(spark, []), BPE, 2)).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=20))
def test_patterns_place_every_piece_once(histogram):
    packed = packing.patterns(histogram, 64)
    used = defaultdict(int)
    for p, n in packed:
        assert n > 0 and sum(k * m for k, m in p.items()) <= 64
        for k, m in p.items():
            used[k] += m * n
    assert used == histogram
    seen = defaultdict(set)
    for length, lo, hi, first, count, offset in packing.slots(packed):
        for rank in range(lo, hi):
            assert rank not in seen[length]
            seen[length].add(rank)


def test_packing(spark, library):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["ab", "cde", "é"]) for _ in range(r.choice([0, 1, 5, 700, 2500])))) for i in range(60)] + [(70, None), (71, "same"), (71, "same"), (None, "x")]
    cut = packing.pieces(docs(spark, rows), BPE, 0)
    got = packing.pack(cut).collect()
    per, seq = defaultdict(list), defaultdict(list)
    for p in got:
        per[p.doc_id].append(p)
        seq[p.sequence_id].append(p)
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        have = sorted(per[i], key=lambda p: p.start)
        if i != 71:
            assert np.frombuffer(b"".join(p.ids for p in have), "<u4").tolist() == ids
        assert all(p.doc_tokens == len(ids) and len(p.ids) == 4 * p.length for p in have)
    assert len(per[71]) == 2
    for s in seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    whole = packing.assemble(packing.pack(cut)).collect()
    assert sum(w.n_tokens for w in whole) == sum(p.length for p in got) and all(len(w.ids) == 4 * w.n_tokens for w in whole)
    empty = packing.pack(packing.pieces(docs(spark, []), BPE, 0))
    assert empty.collect() == [] and {"sequence_id", "offset"} <= set(empty.columns)


def test_unigram_against_the_library():
    import sentencepiece

    with open(PIECES, "rb") as f:
        model = unigram.as_unigram(f.read())
    sp, m = sentencepiece.SentencePieceProcessor(model_proto=model), unigram.Unigram.parse(model)
    r = random.Random(2)
    texts = ODD + ["▁a ▁▁b"] + ["".join(r.choice("ab ▁\né日the ") for _ in range(r.randint(0, 60))) for _ in range(300)]
    count, encode = unigram.Counter(m), unigram.Encoder(m)
    for t in texts:
        want = sp.encode(t)
        got = np.frombuffer(encode(t), "<i4").tolist()
        assert got == want, repr(t)
        assert count(t)[0] == len(want)
        assert m.decode(got) == sp.decode(want)
        s, n = unigram.Streaming(m), m.normalise(t)
        assert s.feed(n[:5]) + s.feed(n[5:]) + s.finish() == want
        assert s.peak <= 64


def test_unigram_without_byte_fallback_and_ties():
    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -2.0, 1), ("b", -2.0, 1), ("ab", -4.0, 1), ("ba", -4.0, 1), ("▁a", -4.0, 1), ("aba", -6.0, 1)]
    f = unigram._field
    model = b"".join(f(1, 2, f(1, 2, p.encode()) + f(2, 5, np.float32(s).tobytes()) + f(3, 0, k)) for p, s, k in pieces) + f(2, 2, f(3, 0, 1)) + f(3, 2, f(1, 2, b"identity"))
    sp, m = sentencepiece.SentencePieceProcessor(model_proto=model), unigram.Unigram.parse(model)
    encode, count = unigram.Encoder(m), unigram.Counter(m)
    for t in ("abab aba", "xxay", "", "  a  b ", "zz zz", "ba ab"):
        assert np.frombuffer(encode(t), "<i4").tolist() == sp.encode(t), t
        assert count(t)[0] == len(sp.encode(t)), t


def test_unigram_frames(spark):
    rows = [(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, "x")]
    got = unigram.token_counts(docs(spark, rows), PIECES).collect()
    assert [(r.doc_id, r.n_tokens) for r in got][:2] == [(1, 0), (2, 0)] and len(got) == 5
    back = unigram.decoded(unigram.encoded(docs(spark, rows), PIECES), PIECES).collect()
    assert all(r.same for r in back) and [r.n_ids for r in back] == [r.n_tokens for r in got]
    assert unigram.token_counts(docs(spark, []), PIECES).collect() == []


def test_chat_round_trip_and_spans(spark):
    said = ["</s>[INST] ok [/INST]", "", None, "a\\b <s> [ROLE x] \\", "<", "[/INST", "é😀\n"]
    r = random.Random(6)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool]x", None]), r.choice(said), 1) for c in range(8) for t in range(r.randint(1, 9))]
    df = spark.createDataFrame(rows + rows[:2], "conv_id long, turn long, role string, text string, nth int")
    out = chat.digests(chat.format_turns(df)).collect()
    by = defaultdict(list)
    for c, t, role, text, _ in rows + rows[:2]:
        by[c].append((t, role or "", text or ""))
    import hashlib

    for x in out:
        turns = [(role, text) for _, role, text in sorted(by[x.conv_id])]
        assert x.n_turns == len(turns) and not x.rewritten
        assert x.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {x.conv_id: x for x in chat.conversations(chat.format_turns(df)).collect()}
    for c, turns in by.items():
        text = whole[c].formatted
        assert [t for t in chat.parse(text)] == [(a, b) for _, a, b in sorted(turns)]
        assert [chat.unescape(text[s["from"] : s["to"]]) for s in whole[c].loss_spans] == [b for _, a, b in sorted(turns) if a == "assistant"]
    assert chat.digests(chat.format_turns(df.where("conv_id < 0"))).collect() == []


def test_black_box_templates():
    def last_only(turns):  # hides earlier answers: history changes
        return "".join(f"<{r}>{t if i == len(turns) - 1 or r == 'user' else '...'}" for i, (r, t) in enumerate(turns))

    seen = chat.Renderer(last_only)
    assert [seen.add(r, t)["rewritten"] for r, t in (("user", "q"), ("assistant", "yes"), ("user", "z"))] == [False, False, True]
    plain = chat.Renderer(lambda turns: "BOS" + "".join(f"|{r}:{t}" for r, t in turns))
    got = [plain.add("user", "hi"), plain.add("assistant", "x|y")]
    assert [(g["piece"], g["start"]) for g in got] == [("BOS|user:hi", 0), ("|assistant:x|y", 11)]
    assert got[1]["piece"][got[1]["text_from"] : got[1]["text_to"]] == "x|y"


def test_frames_compare_whole_prefixes_unless_a_context_is_named(spark):
    def closing(turns):  # the end moves: history changes
        return "BOS" + "".join(f"|{r}:{t}" for r, t in turns) + ("EOS" if len(turns) > 2 else "")

    df = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate("abcd")], "conv_id long, turn long, role string, text string")
    got = sorted(chat.format_turns(df, closing).collect(), key=lambda x: x.nth)
    assert [(x.piece, x.start, x.rewritten) for x in got] == [("BOS|user:a", 0, False), ("|user:b", 10, False), ("|user:cEOS", 17, False), ("|user:dEOS", 24, True)]
    assert [x.piece[x.text_from : x.text_to] for x in got] == list("abcd")
