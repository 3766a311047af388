"""The pipeline's stages on nulls, empty and repeated rows, shared ids and clashing names, and planted near copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracevale.llm import packing

STAGES = dict(corpus_pipeline.STAGES)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sample(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 400").orderBy("doc_id").limit(40).collect()]


def frame(spark, rows):
    names = ["__score", "line_dedup", "leak", "row", "gone", "__copy", "_", "a.b", "n_chars", "component_id"]
    d = spark.createDataFrame([(i, t, *[k] * 9, 5) for k, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in [*names[:8], "n_chars", "component_id"]))
    return d.repartition(3)


def test_odd_rows_pass_through_every_stage(spark, sample):
    rows = [*sample[:6], (None, None), (None, sample[0][1]), (900, None), (901, ""), (902, " \n "), (903, "x"), sample[1], sample[1], (sample[2][0], sample[3][1] + " tail"), (None, sample[4][1])]
    d = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, d, SF)
        assert got.columns == d.columns and [t for _, t in got.dtypes] == [t for _, t in d.dtypes], name
        kept = got.collect()
        assert {r["line_dedup"] for r in kept} <= set(range(len(rows))) and len(kept) <= len(rows)
        assert all(r["component_id"] == 5 and (r["a.b"], r["_"]) == (r["__score"], r["row"]) for r in kept)
        assert stage(spark, d.where("false"), SF).count() == 0
    assert STAGES["packing"](spark, d, SF).select("doc_id").count() >= len(rows)


def test_near_duplicates_of_shared_and_missing_ids(spark, sample):
    a, b, c = (t for _, t in sample[:3])
    rows = [(1, a), (1, b), (2, a), (3, a), (3, a), (None, b), (None, c), (None, None), (4, None), (5, ""), (6, c), (7, "two words")]
    kept = sorted(((r.doc_id, r.text) for r in STAGES["ngram_jaccard_join"](spark, frame(spark, rows), SF).collect()), key=repr)
    assert kept == sorted([(1, a), (1, b), (6, c), (None, None), (4, None), (5, ""), (7, "two words")], key=repr)
    twice = STAGES["ngram_jaccard_join"](spark, frame(spark, [(3, a), (3, a), (8, a)]), SF).collect()
    assert [(r.doc_id, r.text) for r in twice] == [(3, a), (3, a)]


def test_planted_near_copies_go_and_others_stay(spark, sample):
    """Copies with a few words changed, dropped or added are found, every one; texts that share half stay."""
    rng, rows, planted = random.Random(1), [], []
    own = [(i, t) for i, t in sample if len(t.split()) > 150][:12]
    for k, (_, text) in enumerate(own):
        w = text.split()
        rows.append((k, " ".join(w)))
        for n in range(4):
            x = list(w)
            for _ in range(max(1, len(w) // 80)):
                at = rng.randrange(len(x))
                x[at : at + 1] = rng.choice([[f"new{rng.randrange(999)}"], [], [x[at], "more"]])
            planted.append(100 + 10 * k + n)
            rows.append((planted[-1], " ".join(x)))
        rows.append((1000 + k, " ".join(w[: len(w) // 2] + [f"z{k}{i}" for i in range(len(w) // 2)])))

    def alike(x, y):
        x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (x, y))
        return len(x & y) / len(x | y)

    texts = dict(rows)
    near = {i for i in planted if alike(texts[i], texts[(i - 100) // 10]) >= 0.8}
    assert len(near) > 40
    kept = {r.doc_id for r in STAGES["ngram_jaccard_join"](spark, frame(spark, rows), SF).collect()}
    assert not kept & near and {1000 + k for k in range(12)} <= kept and len(kept & set(range(12))) >= 10


def test_packing_stage_equals_a_plain_best_fit(spark, sample):
    got = STAGES["packing"](spark, frame(spark, sample), SF).collect()
    lengths = np.sort(np.array([r.length for r in got]))[::-1]
    room = []
    for n in lengths.tolist():
        able = [(r, i) for i, r in enumerate(room) if r >= n]
        i = min(able)[1] if able else len(room)
        if not able:
            room.append(1024)
        room[i] -= n
    used = {}
    for r in got:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert sorted(used.values()) == sorted(1024 - r for r in room) and packing.GROUP_PIECES > len(got)
