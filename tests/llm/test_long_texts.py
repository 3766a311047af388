"""Very long texts: runs of white space, lines of one letter, one line, through the functions and the queries."""

import random
import resource
import zlib

import numpy as np
import public_tokenizers
import pytest

from tracevale.llm import packing, quality_crf, queries

MANY = 1_000_000
ODD = [" " * MANY + "x", "\n" * MANY, "a\n" * MANY, "x " * MANY, "a" * MANY, None, "", "plain words in a line"]


def peak_mb():
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def test_encoder_on_long_white_space():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    for t in [*ODD[:2], "a" + " " * 2000 + "\n" * 1500 + "b  c", "\t" * 1200 + "<|endoftext|>  x", " " * 1500 + "<|endoftext|>" + " " * 1500, "x" + "　" * 2000 + "y", " " * 999 + "b", "\x85" * 3000 + "1", " \x1c" * 2000 + "q"]:
        assert encode(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t[:20])


def plain_shares(line):
    words = line.split()
    n = len(words) or 1
    return sum(x == y for x, y in zip(words, words[1:])) / n, len(set(words)) / n


def test_word_shares_are_those_of_the_words():
    rng = random.Random(4)
    texts = [" \n".join(" ".join(rng.choice(["a", "b", "é", "  c", ""]) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 9))).encode() for _ in range(40)]
    x, _, _ = quality_crf.line_features(texts)
    want = [plain_shares(line) for t in texts for line in t.split(b"\n")]
    assert x[:, 11:13].tolist() == [list(w) for w in want]


@pytest.mark.parametrize(("lines", "size"), [(7, 1 << 22), (1000, 50), (3, 40), (1, 1)])
def test_pieces_give_the_score_of_the_whole(monkeypatch, lines, size):
    rng, r = np.random.default_rng(1), random.Random(2)
    model = quality_crf.Model(rng.normal(size=40), rng.normal(size=(2, 2)), (1.1, 0.2))
    texts = ["\n".join(r.choice(["a good line of words here", "$$ BUY 1 | 2", "", "x" * 300, "é ß"]) for _ in range(r.randrange(1, 90))).encode() for _ in range(30)] + [b"", b"\n", b"\n\n"]
    want = 1 / (1 + np.exp(-(1.1 * quality_crf.logit(quality_crf.document_means(*model.lines(texts))) + 0.2)))
    monkeypatch.setattr(quality_crf, "LINES", lines)
    monkeypatch.setattr(quality_crf, "BYTES", size)
    assert np.abs(model.score(texts) - want).max() < 1e-12
    for t in texts:
        pieces = list(quality_crf.line_pieces(t))
        assert b"\n".join(t[a:b] for a, b in pieces) == t and all(t[a:b].count(b"\n") < lines for a, b in pieces)


def test_scores_of_many_lines_need_bounded_memory():
    model = quality_crf.Model(np.linspace(-1, 1, 40), np.zeros((2, 2)), (1.0, 0.0))
    model.score([b"warm up"])
    before = peak_mb()
    assert all(0 <= s <= 1 for s in model.score([b"\n" * (2 * MANY), b"a\n" * MANY]))
    assert peak_mb() - before < 400


def test_queries_on_long_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, 1), (1, 0), (2, 0), (3, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(ODD)}
    got = {}
    for r in queries.QUERIES["op5_packing"](spark, str(tmp_path)).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.offset + r.length <= 1024
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {i: len(x) for i, x in want.items()}
    scores = queries.QUERIES["op6_quality_classifier"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in scores) == list(range(len(ODD))) and all(0 <= r.score <= 1 for r in scores)
    lines = {r.doc_id: r for r in queries.QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()}
    assert lines[1].n_lines == MANY + 1 and lines[2].n_dropped == 0 and lines[5].n_lines == 1
