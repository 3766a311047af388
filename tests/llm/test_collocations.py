"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracevale.llm import collocations


def plain(rows, max_words=3, least=10, share=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = {}
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        if any(c >= least and len(x) > len(w) and m == lang and 100 * c >= share * a and any(x[i : i + len(w)] == w for i in range(len(x))) for (m, x), c in f.items()):
            continue
        score, k = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1))


def rows_of(seed, n=40, words=12):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "é", "É", "a", "of", "日本", "x-y", "it's", "𝄞", "#", "b"][:words]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ". ", " ! ", "\x0b", "\x0c", "\r"] if rng.random() < 0.2 else [" "]) for _ in range(rng.randrange(60)))
    return [(rng.choice(["en", "en", "en", "fr", None, "und", ""]), text()) for _ in range(n)]


ODD = [("en", None), (None, None), ("de", ""), ("en", " \t\n.,"), ("en", "one"), ("fr", "New York " * 12), ("fr", "new york;" * 12), ("en", "the " * 300), ("de", "w" * 100_000 + " q")]


@pytest.mark.parametrize(("seed", "shard", "partitions", "max_words"), [(1, 1 << 21, 4, 3), (2, 30, 9, 3), (3, 1, 3, 2), (4, 100, 16, 4)])
def test_collocations(spark, monkeypatch, seed, shard, partitions, max_words):
    for name, value in (("SHARD", shard), ("SAMPLE", 1), ("THIN", 1)):
        monkeypatch.setattr(collocations, name, value)
    rows = rows_of(seed) + ODD + [("en", "a fixed passage of some words")] * 30
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "lang string, text string").select("*", *(F.lit(0).alias(c) for c in ("f", "h", "of", "n", "depth", "word"))).repartition(5)
        got = collocations.collocations(df, max_words, least=4, share=60, top=25)
        assert sorted(tuple(r) for r in got.collect()) == plain(rows, max_words, 4, 60, 25)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([("en", "a b")], "lang string, text string")
    assert collocations.collocations(df.where("false")).count() == 0 and collocations.collocations(df).count() == 0


def test_scores_beyond_64_bits(spark, monkeypatch):
    """Counts are made large in the merged table; the score stays exact."""
    a, l, r = 10**13 + 7, 3 * 10**13 + 1, 5 * 10**13 + 9
    nodes = spark.createDataFrame([("en", 0, [], 10**15, [], None), ("en", 1, [1], l, [], "x"), ("en", 1, [2], r, [], "y"), ("en", 2, [1, 2], a, [l], None)], "lang string, depth int, h array<long>, f long, lefts array<long>, word string")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: nodes)
    assert [tuple(x) for x in collocations.collocations(None, 2).collect()] == [("en", 1, "x y", a, l, r, 10**15, 10**6 * a * a // (l * r))]


def test_a_serialised_trie_is_read_back():
    rng = np.random.default_rng(5)
    text = " ".join(rng.choice(list("abcdefg"), 3000)).replace("g", ",")
    (h, joined, _, _), = collocations.joined_words(pa.array([text]))
    levels = collocations.levels_of(h, joined, 3)
    names = [b"n%d" % i for i in range(len(levels[0][1]))]
    bounds = np.column_stack([rng.choice(h, 6) for _ in range(3)])
    bounds = bounds[np.lexsort(bounds.T[::-1])]
    total = [0, 0, 0]
    for _, raw in collocations.pieces_of(levels, names, bounds):
        read, size, own = collocations.read_piece(raw, 3)
        assert size.sum() == len(own)
        for k, (word, count, kids) in enumerate(read):
            total[k] += count.sum()
            assert (count == 0).sum() <= 1 and (kids is None or kids.sum() == len(read[k + 1][0]))
            assert len(word) == len(count)
    assert total == [c.sum() for _, _, c in levels]
