import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracevale import catalog
from tracevale.functions import text, urls


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_stable_id_of_a_known_element_and_finding(spark):
    assert value(spark, text.stable_id("element", F.lit("screen:7533145bceed1baf"), F.lit(" LINK"), F.lit("\tnew issue "))) == "element:eb8bc46d98bc6f45"
    assert value(spark, text.list_repr(F.array(F.lit("b"), F.lit("a")))) == "['a', 'b']"


def test_stable_id_tells_null_from_missing(spark):
    ids = {value(spark, text.stable_id("x", *c)) for c in ([F.lit("a"), F.lit(None)], [F.lit("a")], [F.lit(None), F.lit("a")])}
    assert len(ids) == 3


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://Example.COM/a/?b=2&a=1#x", "http://example.com/a?a=1&b=2"),
        ("http://h/", "http://h/"),
        ("http://h", "http://h"),
        ("http://u:p@h:8080/x?t=1234567890&k=", "http://u:p@h:8080/x?k="),
        ("http://h/x?id=550e8400-e29b-41d4-a716-446655440000&q=a%20b", "http://h/x?q=a+b"),
    ],
)
def test_canonical_url(spark, url, want):
    assert value(spark, urls.canonical_url(F.lit(url))) == want


SHAPES = [("", ""), ("/issues", "/issues"), ("/issues/new", "/issues/new"), ("/issues/40", "/issues/{number}")]


@pytest.mark.parametrize("owner", ["someone", "x-y", "Issue", *urls.RESERVED, "Admin", "API"])
def test_route_of_an_owner_or_a_reserved_word(spark, owner):
    """Each shape of a path below an owner has its route; a reserved first word, in any case, only has its numbers replaced."""
    own = owner.lower() not in urls.RESERVED
    for path, route in SHAPES:
        got = value(spark, urls.route_pattern(F.lit(f"https://site.example/{owner}/thing{path}")))
        assert got == (f"/{{owner}}/{{repo}}{route}" if own else f"/{owner}/thing{route}")


def test_route_of_other_paths(spark):
    for path, want in {"": "/", "/": "/", "/user/login/": "/user/login", "/notifications/": "/notifications/", "/x/1/22/y3/": "/x/{number}/{number}/y3/", "/one": "/one"}.items():
        assert value(spark, urls.route_pattern(F.lit(f"https://site.example{path}"))) == want


def test_canonical_url_of_odd_ones(spark):
    for url, want in {"http://h/?a=100%": "http://h/?a=100%25", "some/path/?b=~*": "some/path?b=~%2A", "http://h/p?t=2020-01-02T03:04Z&u=1": "http://h/p?u=1"}.items():
        assert value(spark, urls.canonical_url(F.lit(url))) == want


def test_percent_rounds_half_to_even(spark):
    assert value(spark, text.percent(F.lit(0.845))) == 84


def test_shorten(spark):
    assert value(spark, text.shorten(F.lit("  ab \n cd  "), 4)) == "ab …"


def test_first_words_are_lower_cased_as_in_the_sql(spark, tmp_path):
    """The SQL folds an element's name but not a document's word: a word with ß is no name's."""
    html = "".join(f'<a href="/{i}">{n}</a>' for i, n in enumerate(["Straße", "GROSS", "Maß "]))
    pq.write_table(pa.table({"page_id": [1], "url": ["https://a.example/b"], "html": [html]}), f"{tmp_path}/pages.parquet")
    pq.write_table(pa.table({"doc_id": [1, 2, 3, 4, 5, 6], "text": ["Straße a", "STRASSE b", "groß", "Gross c", None, "mass"]}), f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    for name in ("pages", "documents"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    rel = duck.sql(catalog.ORACLE_SQL["q06_text_exact_links"])
    got = sorted(map(tuple, catalog.QUERIES["q06_text_exact_links"](spark, str(tmp_path)).select(*rel.columns).collect()))
    assert got == sorted(rel.fetchall()) and [r[1:] for r in sorted(got, key=lambda r: r[2])] == [("strasse", 2, 1), ("gross", 4, 1), ("mass", 6, 1)]
