"""Short batches, rows without an id, one id with many rows."""

import numpy as np
import pytest

from riskloom.llm import common, jaccard, queries, tokenfile, unigram


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_a_document_of_few_words_alone(k, num):
    for n in range(k + 2):
        text = " ".join("abcdefg"[:n])
        (got,) = jaccard.document_sets([text], k, common.WordHasher())
        assert len(got) == len(jaccard.shingle_set(text, k))
        assert len(jaccard.document_sets([text, "", text], k, common.WordHasher())) == 3


def test_token_files_keep_null_ids_and_split_a_hot_one(spark):
    rows = [(None, f"word {i}") for i in range(400)] + [(-1, "minus"), (3, None), (3, "x"), (7, "y" * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = tokenfile.write_tokens(docs, queries.tokenizer_path(queries.BPE), end_id=2, parts=4)
    assert max(r.n_docs for r in manifest.collect()) < 300
    got = sorted(tokenfile.read_tokens(manifest, digest=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 400 + [-1, 3, 3, 7]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_every_word_passes_the_window(monkeypatch):
    model = unigram._model(queries.tokenizer_path(queries.PIECES))
    fed, commits, feed, commit = [], [], unigram.Streaming.feed, unigram.Streaming._commit
    monkeypatch.setattr(unigram.Streaming, "feed", lambda self, t: fed.append(t) or feed(self, t))
    monkeypatch.setattr(unigram.Streaming, "_commit", lambda self, to: commits.append(to) or commit(self, to))
    text = "an ordinary text, and one word of more than a window: " + "abcdefghij" * 20
    encode = unigram.Encoder(model)
    encode(text)
    assert len(set(fed) - {"\n"}) == len(set(text.split(" "))) and len(commits) > len(fed)
    assert encode.stream.peak <= 3 * model.longest
