"""Articles, segments and requirements of documentation pages."""

import hashlib
import json
import random
import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracevale import catalog
from tracevale.functions.text import fold
from tracevale.operators import docs


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>out</p><article><h1>A <b>b</b></h1><p>x</p></article><article>second</article>", "H1: A b\nx"),
        ("<article>one<article>two</article>three</article>four", "onetwothree"),
        ("<article><p>a<aside>no<p>no</p><nav>no</nav>no</aside>b</p>", "ab"),
        ("<article>never ends<li>item", "never ends item"),
        ("<article>&eacute;&#233;&#xe9;&amp;lt;&nbsp;&unknown;</article>", "ééé&lt; &unknown;"),
        ("<article><h2>a<b>b</b>  c</h2>text</article>", "H2: ab c\ntext"),
        ("<article><h2>lost<h3>kept</h2>too</h3>t</article>", "H3: kepttoo\nt"),
        ("<article><h2>never ends<p>x</p></article>", ""),
        ("<article>a<br/>b<br>c<DIV>d</DIV>e</article>", "a b c d\ne"),
        ("<article><script>if (a < b) '</p>'</script><style>p</style>x</article>", "x"),
        ("<!-- <article>no</article> --><article>y<!-- z --></article>", "y"),
        ("<article><aside><article></aside>a</article>b</article>c", "ab"),
        ("<article>a</b>b<![odd[", "a b"),
        ("no article", ""), ("", ""), (None, None),
    ],
)
def test_article(html, want):
    assert (None if html is None else docs.first_article(html)) == want


def test_article_column(spark):
    df = spark.createDataFrame([(1, "<article>a</article>"), (2, None), (3, "<article>" + "<div>x" * 50_000)], "i int, html string")
    got = {r.i: r.t for r in df.select("i", docs.article_text(F.col("html")).alias("t")).collect()}
    assert got[1] == "a" and got[2] is None and got[3] == " ".join(["x"] * 50_000)


@pytest.mark.parametrize(
    ("text", "read", "left"),
    [
        ("a &amp", "a &", "a &amp"), ("a&amp*** &lt;b&gt; &amp;lt;", "a&*** <b> &lt;", "a&amp*** <b> &lt;"), ("&eacute;&#233;&#xE9; &#233 &#xe9", "ééé é é", "ééé &#233 &#xe9"),
        ("&amp&lt;&&amp;&", "&<&&&", "&amp<&&&"), ("&notit; &not; &unknown; &;", "¬it; ¬ &unknown; &;", "&notit; ¬ &unknown; &;"), ("\ue000&copy", "\ue000©", "\ue000&copy"),
    ],
)
def test_references_without_a_semicolon(text, read, left):
    for at in ("<article><p>{}</p></article>", "<article>{}", "<article><p>{}<nav>&amp</nav></article>"):
        assert docs.first_article(at.format(text)) == read and docs.first_article(at.format(text), bare=False) == left


def pages_cut_in_a_reference(folder):
    """Pages of which one has a title that ends within a reference."""
    body = "<article><h1>cats &amp</h1><p>dogs &amp; birds</p></article>"
    pq.write_table(pa.table({"page_id": [1, 2, 3, 4], "url": ["https://a.example/b"] * 4, "html": [body] * 4}), f"{folder}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    return duck


@pytest.mark.parametrize("name", ["q04_article_text", "q27_segments", "q55_odd_articles"])
def test_queries_leave_a_cut_reference_as_their_sql_does(spark, tmp_path, name):
    rel = pages_cut_in_a_reference(tmp_path).sql(catalog.ORACLE_SQL[name])
    got = catalog.QUERIES[name](spark, str(tmp_path)).select(*rel.columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())


def plain_segments(text):
    path, held, out, at = [], [], [], 0
    for line in text.splitlines(keepends=True):
        bare = line.rstrip("\r\n")
        if m := re.fullmatch(r"H([1-4]):\s*(.*)", bare):
            if sum(len(x) for _, x in held) >= 200:
                out.append((path, held))
                held = []
            path = path[: int(m[1]) - 1] + [m[2].strip()]
        elif bare:
            held = [*held, (at, bare)]
        at += len(line)
    if held:
        out.append((path, held))
    return [(p, "\n".join(x for _, x in h), h[0][0], h[-1][0] + len(h[-1][1])) for p, h in out]


@pytest.mark.parametrize("seed", range(30))
def test_segments_equal_a_plain_segmenter(seed):
    rng = random.Random(seed)
    line = lambda: rng.choice(["", "short", "é" * rng.randrange(120), f"H{rng.randrange(1, 6)}: {rng.choice(['A', 'b c', ' ', ''])}", f"H{rng.randrange(1, 5)}:x", "H1 no", " H2: no", "x" * 200])
    text = rng.choice(["\n", "\n", "\r\n"]).join(line() for _ in range(rng.randrange(60)))
    assert list(docs.cut_segments(text)) == plain_segments(text)


def test_segments_of_long_texts(spark):
    rng = random.Random(5)
    long = "\n".join(rng.choice([f"H{rng.randrange(1, 5)}: t{i}", "w" * rng.randrange(300)]) for i in range(20_000))
    rows = [("a", long), ("b", None), ("c", ""), ("d", "H1: only"), ("e", "H1: A\nshort\nH2: B\nbody"), (None, "x")]
    got = docs.segments(spark.createDataFrame([(*r, 1) for r in rows], "uri string, text string, ordinal int")).collect()
    want = [(u, i, *s) for u, t in rows for i, s in enumerate(plain_segments(t or ""))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert ("e", 0, ["A", "B"], "short\nbody", 6, 22) in map(tuple, got) and not any(r.uri == "d" for r in got)


SCHEMA = '{"type": "OBJECT", "a": [1, "é"]}'


def stored(prompt, items, model="m"):
    key = hashlib.sha256(json.dumps({"model": model, "prompt": prompt, "schema": json.loads(SCHEMA)}, sort_keys=True).encode()).hexdigest()
    return key, json.dumps({"requirements": items})


def item(statement, quote):
    return {"statement": statement, "actor": "user", "action": "opens", "object": "issue", "acceptance_clues": ["New Issue"], "source_quote": quote}


def test_ingest(spark):
    body = "An owner opens  an ISSUE here. " + "x" * 200
    pages = spark.createDataFrame([("u", f"<article><h1>T</h1><p>{body}</p><h2>V</h2><p>rest {{text}}</p></article>"), ("v", "<article><p>alone</p></article>"), ("w", "<p>nothing</p>")], "uri string, html string")
    template = "U {uri}\nP {heading_path}\nT {text}"
    flat = re.sub(r"\s+", " ", body)
    cache = spark.createDataFrame(
        [
            stored(f"U u\nP T\nT {flat}", [item("One", "opens an issue"), item(" ONE ", "An owner"), item("Two", "not there"), item("Three", " "), item("Straße", "here")]),
            stored("U u\nP T > V\nT rest {text}", [item("One", "rest"), item("STRASSE", "REST")]),
            stored("unused", []),
        ],
        "cache_key string, response string",
    )
    records, counts = docs.ingest(pages, cache, template, SCHEMA, "m", "run-1", "rev")
    got = sorted(records.collect(), key=lambda r: r.statement)
    assert [(r.statement, r.source_span.quote, r.source_span.heading_path, r.run_id, r.acceptance_clues) for r in got] == [("One", "opens an issue", ["T"], "run-1", ["New Issue"]), ("Straße", "here", ["T"], "run-1", ["New Issue"])]
    assert got[0].id == "requirement:" + hashlib.sha256(b"u\x1fone").hexdigest()[:16]
    assert counts.first().asDict() == {"segments": 3, "requirements": 2, "rejects": 2, "missing": 1}
    for response in ("[1]", '{"requirements": 3}', "x", None):
        with pytest.raises(Exception, match="not a response"):
            docs.ingest(pages, cache.withColumn("response", F.lit(response)), template, SCHEMA, "m", "r", "v")[0].collect()
    assert docs.ingest(pages, cache.withColumn("response", F.lit("{}")), template, SCHEMA, "m", "r", "v")[1].first().asDict() == {"segments": 3, "requirements": 0, "rejects": 0, "missing": 1}


def test_full_case_fold(spark):
    names = [" Straße", "STRASSE", "ΟΔΟΣ", "οδος", "ﬁn", "İ", "ŉ", "ᾳ", "K", "plain", "", None, "𐐀"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", fold(F.col("n")).alias("f")).collect()
    assert [r.f for r in rows] == [n if n is None else n.strip().casefold() for n in names]
