"""Operators whose plain form compares everything with everything, against that plain form and on one hot key."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tracevale.operators import code, evals, linking
from tracevale.sources import pages


@pytest.mark.parametrize(("terms_part", "names_part"), [(200_000, 1_000_000), (7, 20)])
def test_terms_in_names(spark, monkeypatch, terms_part, names_part):
    monkeypatch.setattr(linking, "TERMS", terms_part)
    monkeypatch.setattr(linking, "NAMES", names_part)
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abé ing") for _ in range(rng.randrange(n)))
    terms, names = sorted({word(6) for _ in range(60)}), sorted({word(15) for _ in range(120)})
    got = linking.contained_in_names(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(n,) for n in names], "name string"))
    want = sorted((t, n) for t in terms for n in names if t and t in n and t != n)
    assert sorted(map(tuple, got.collect())) == want
    none = spark.createDataFrame([], "term string")
    assert linking.contained_in_names(none, spark.createDataFrame([("a",)], "name string")).count() == 0


@pytest.mark.parametrize("bin_", [4096, 3])
def test_touched_spans(spark, monkeypatch, bin_):
    monkeypatch.setattr(code, "BIN", bin_)
    rng = random.Random(2)
    spans = [(rng.choice(["a", "b", None]), i, (s := rng.randrange(1, 60)), s + rng.choice([0, 2, 30])) for i in range(150)] + [("a", 900, 5, 7), ("a", 900, 5, 7), ("c", 1, 1, 99), ("a", 3, None, 4)]
    hunks = [(rng.choice(["a", "b", None]), rng.randrange(1, 70), rng.choice([0, 1, 4])) for _ in range(12)]
    got = code.touched(spark.createDataFrame(spans, "path string, bin long, line_start int, line_end int"), spark.createDataFrame(hunks, "path string, start int, count int"))
    want = [s for s in spans if s[0] and s[2] is not None and any(p == s[0] and s[2] <= start + max(n, 1) - 1 and start <= s[3] for p, start, n in hunks)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and got.columns == ["path", "bin", "line_start", "line_end"]


def test_touched_spans_of_one_large_file(spark):
    n = 300_000
    spans = spark.range(n).select(F.lit("f").alias("path"), "id", (F.col("id") * 3 + 1).alias("line_start"), (F.col("id") * 3 + 2).alias("line_end"))
    hunks = spark.range(n).select(F.lit("f").alias("path"), (F.col("id") * 6).alias("start"), F.lit(2).alias("count"))
    began = time.time()
    got = code.touched(spans, hunks).agg(F.count(F.lit(1)), F.min("id"), F.max("id")).first()
    want = [i for i in range(n) if (3 * i + 1) // 6 * 6 + 1 >= 3 * i + 1 or (3 * i + 2) // 6 * 6 >= 3 * i + 1]
    assert tuple(got) == (len(want), want[0], want[-1]) and time.time() - began < 60


@pytest.mark.parametrize(
    ("bases", "want"),
    [
        (["x", "x #2", "x"], ["x", "x #2", "x #3"]), (["x", "x", "x #2"], ["x", "x #2", "x #2 #2"]), (["x", "X ", "x #2", "x"], ["x", "X  #2", "x #2", "x #3"]),
        (["a"] * 4, ["a", "a #2", "a #3", "a #4"]), (["ß", "SS", ""], ["ß", "SS #2", ""]), ([], []),
    ],
)
def test_numbers_skip_taken_names(bases, want):
    assert pages.free_names([("link", b) for b in bases]) == want
    assert pages.free_names([("link", "a"), ("button", "a"), ("LINK ", "a")]) == ["a", "a", "a #2"]


def test_numbered_elements_of_a_page(spark):
    html = "".join(f"<a href='/{i}'>{t}</a>" for i, t in enumerate(["x", "x #2", "x", "y", "x"])) + "<button>x</button>"
    got = pages.page_elements(spark.createDataFrame([("s", html), ("t", html), ("u", None)], "screen string, html string")).orderBy("screen", "ord").collect()
    assert [r.name for r in got] == ["x", "x #2", "x #3", "y", "x #4", "x"] * 2 and len({r.id for r in got}) == 12


def test_stability_of_many_runs(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["p", "q", None]), r, rng.choice([*range(12), None])) for r in range(7) for _ in range(rng.randrange(1, 25))] + [("one", 1, 5), ("one", 1, 6), ("bare", 1, None), ("bare", 2, None), ("bare", 3, 1)]
    got = {r.category: r.stability for r in evals.stability(spark.createDataFrame(rows, "category string, run long, item long")).collect()}
    for c in {r[0] for r in rows}:
        sets = {}
        for k, run, i in rows:
            if k == c:
                sets.setdefault(run, set()).update({i} - {None})
        each = [len(x & y) / len(x | y) if x | y else 1.0 for a, x in sets.items() for b, y in sets.items() if a < b]
        assert got[c] == pytest.approx(min(each, default=1.0)), c


def test_stability_of_large_runs(spark):
    rows = spark.range(2_000_000).selectExpr("'c' as category", "id % 4 as run", "if(id % 40 = 0, id, id div 4) as item")
    assert 0.7 < evals.stability(rows).first().stability < 0.9


def test_locales_of_ten_levels(spark):
    text = "".join(f'{{"k{i}": ' for i in range(10)) + '"deep"' + "}" * 10
    rows = [(text,), ('{"a": "x", "b": {"c": "y", "n": 1, "l": ["z"], "o": {}}, "e": null}',), ("[1]",), ('"s"',), (None,), ("{",), ('{"a.b": "q", "": "r"}',), ("[" * 100_000,)]
    got = sorted(map(tuple, code.flat_locales(spark.createDataFrame(rows, "value string")).collect()))
    assert got == [("a", "x"), ("a.b", "q"), ("b.c", "y"), (".".join(f"k{i}" for i in range(10)), "deep")]


@pytest.mark.parametrize(
    ("href", "want"),
    [("/a", ("h.x", "/a")), ("b/../c", ("h.x", "/r/c")), ("?q", ("h.x", "/r/s")), ("#f", ("h.x", "/r/s")), ("//o/p", ("o", "/p")), ("HTTP://O:8/", ("o", "/")), ("https://o", ("o", "/")), ("mailto:a@b", ("", "a@b")), ("../../../z", ("h.x", "/z")), ("http://[", ("", "/")), ("", None), (None, None)],
)
def test_targets_of_links(spark, href, want):
    got = spark.createDataFrame([("https://h.x/r/s", href)], "b string, h string").select(pages.target(F.col("b"), F.col("h")).alias("t")).first().t
    assert (got and tuple(got)) == want
