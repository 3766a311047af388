import hashlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tracevale.operators import code, docs, evals, gold, graph, impact, linking, lookups, policy, report
from tracevale.sources import code_files, diffs, pages, records, sinks
from tracevale.streaming import replay

ELEMENTS = "id string, screen_id string, name string, attributes map<string,string>, locator_evidence map<string,string>"
SYMBOLS = "id string, kind string, file string, ui_anchors array<string>"


def links(spark, anchors, name="New Issue", kind="template"):
    e = spark.createDataFrame([("e", "s", name, {"href": "/new"}, {"css": "#b"})], ELEMENTS)
    s = spark.createDataFrame([("s", "/{owner}/{repo}")], "id string, route_pattern string")
    c = spark.createDataFrame([("c", kind, "x.tmpl", anchors)], SYMBOLS)
    return linking.score_links(linking.ui_code_signals(e, s, c)).collect()


@pytest.mark.parametrize(
    ("anchors", "confidence", "status"),
    [
        (["text: NEW issue"], 0.65, "needs_review"), (["text:New Issue", "href:/new"], 0.895, "auto_accepted"), (["css:#b"], 0.55, "needs_review"),
        (["text:New Issue", "css:#b"], 0.8425, "needs_review"),
    ],
)
def test_scores(spark, anchors, confidence, status):
    (r,) = links(spark, anchors)
    assert r.confidence == pytest.approx(confidence, abs=1e-12) and r.review_status == status


def test_anchors_that_match_nothing(spark):
    assert not links(spark, ["no colon", "css:.b", "route:/{owner}/{repo}", "text:"])
    (r,) = links(spark, ["route:/{owner}/{repo}"], kind="function")
    assert (r.source, r.link_type, r.confidence) == ("s", "handled_by", 0.75)


def test_requirement_signals(spark):
    e = spark.createDataFrame([("e1", "New Issue"), ("e2", "open the new issue form")], "id string, name string")
    r = spark.createDataFrame([("r", ["new issue", "x"], "the issue form"), ("q", [], "a of")], "id string, acceptance_clues array<string>, object string")
    got = {(x.target, x.kind) for x in linking.requirement_signals(r, e).collect()}
    assert got == {("e1", "clue-element-exact"), ("e2", "clue-element-sub"), ("e2", "object-words")}


def impact_tables(spark):
    changes = spark.createDataFrame([("p1", 1, "a.go", "modified", ["c1", "c2"]), ("p2", 1, "b.go", "added", []), ("p3", 1, "c.go", "added", ["c3"])], "id string, pr_number int, file string, change_type string, changed_symbol_ids array<string>")
    symbols = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "id string")
    ls = spark.createDataFrame(
        [("e1", "c1", "rendered_by", 0.9, "auto_accepted"), ("s1", "c2", "handled_by", 0.75, "needs_review"), ("e1", "c3", "rendered_by", 0.3, "unresolved"), ("r1", "e1", "implements", 0.6, "needs_review")],
        "source_entity_id string, target_entity_id string, link_type string, confidence double, review_status string",
    )
    elements = spark.createDataFrame([("e1", "n", "s1")], "id string, name string, screen_id string")
    screens = spark.createDataFrame([("s1", "/")], "id string, route_pattern string")
    it = spark.createDataFrame([("i1", "e1", "s1", "s2")], "id string, element_id string, source_state_id string, target_state_id string")
    flows = spark.createDataFrame([("f1", "g", ["i1"])], "id string, goal string, interaction_ids array<string>")
    req = spark.createDataFrame([("r1", "t", ["x"]), ("r2", "u", [])], "id string, statement string, acceptance_clues array<string>")
    return changes, symbols, ls, elements, screens, it, flows, req


def test_findings(spark):
    changes, symbols, ls, elements, screens, it, flows, req = impact_tables(spark)
    rows = impact.impact_rows(changes, symbols, ls, elements, screens, it, flows, req)
    got = {r.changed_symbol_id: r for r in impact.ranked(impact.findings(rows)).collect()}
    assert set(got) == {"c1", "c2"}
    assert got["c1"].severity == "high" and got["c1"].affected_entity_ids == ["e1", "f1", "r1", "s1"] and got["c1"].path_entity_ids == [["p1", "c1", "e1", "s1", "f1"]]
    assert got["c2"].severity == "low" and got["c2"].affected_entity_ids == ["f1", "s1"]
    un = {(r.file, r.reason) for r in impact.unmapped(changes, symbols, ls).collect()}
    assert un == {("b.go", "no symbols extracted")}
    assert {r.file for r in impact.unmapped(changes, symbols, ls, viable_only=True).collect()} == {"b.go", "c.go"}


def test_absence_and_coverage(spark):
    *_, req = tables = impact_tables(spark)
    a = impact.absences(req, tables[2], "run")
    assert [(r.requirement_id, r.expected_evidence) for r in a.collect()] == [("r2", ["u"])]
    got = {r.requirement_id: (r.accepted, r.pending, r.absent) for r in impact.coverage(req, tables[2], a).collect()}
    assert got == {"r1": (False, True, False), "r2": (False, False, True)}


def test_merge_is_idempotent(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, seq int, v string")
    once = graph.merge_latest(rows, ["id"], "seq")
    assert sorted(once.collect()) == sorted(graph.merge_latest(once.unionByName(once), ["id"], "seq").collect()) == [("a", 2, "y"), ("b", 1, "z")]
    assert graph.duplicate_keys(rows, "id").collect() == [("a", 2)]
    new = spark.createDataFrame([("b", None, "w")], "id string, seq int, v string")
    assert sorted(graph.overlay(once, new, ["id"]).collect()) == [("a", 2, "y"), ("b", None, "w")]  # a null removes


DIFF = """diff --git a/x.go b/x.go
--- a/x.go
+++ b/x.go
@@ -3 +3,2 @@ func A() {
-a
+b
+c
diff --git a/old.ts b/new.ts
similarity index 90%
rename from old.ts
rename to new.ts
diff --git a/gone.go b/gone.go
deleted file mode 100644
--- a/gone.go
+++ /dev/null
@@ -1,2 +0,0 @@
"""


def test_diffs(spark):
    d = diffs.file_diffs(spark.createDataFrame([(DIFF,)], "value string"))
    got = [(r.path, r.old_path, r.change_type, [tuple(h) for h in r.hunks]) for r in d.orderBy("ordinal").collect()]
    assert got == [("x.go", None, "modified", [(3, 1, 3, 2)]), ("new.ts", "old.ts", "renamed", []), ("gone.go", None, "deleted", [(1, 2, 0, 0)])]
    r = diffs.change_records(d, {"pr_number": 7}).first()
    assert r.id.startswith("pr_change:") and r.changed_symbol_ids == []


def test_symbols_and_changes(spark):
    go = "package x\nfunc A() {\n}\nvar q = 1\nfunc (r *T) B() {\n}\ntype C struct {\n}"
    files = spark.createDataFrame([("x.go", go), ("t.tmpl", 'a\n{{define "b"}}\nc'), ("m.ts", "export const f = (a) => 1\n")], "path string, content string")
    got = {(r.qualified_name, r.kind, r.line_start, r.line_end) for r in code.symbols(files).collect()}
    assert got == {("A", "function", 2, 3), ("T.B", "method", 5, 6), ("C", "type", 7, 8), ("t", "template", 1, 3), ("b", "template_block", 2, 3), ("m.ts", "ts_module", 1, 1), ("f", "function", 1, 1)}
    d = diffs.file_diffs(spark.createDataFrame([(DIFF,)], "value string"))
    s = code.symbols(files)
    assert [r.qualified_name for r in code.changed_symbols(s, s, d).collect()] == ["A"]


def test_anchors(spark):
    rows = spark.createDataFrame([("a.tmpl", "q", '{{ctx.Locale.Tr "repo.new"}} <a href="/x"> <a href="/{{.L}}"> id="b" id="b"'), ("routers/r.go", "q", 'm.Get("/p", f)'), ("a.ts", "q", "document.querySelector('#z')")], "path string, qualified_name string, text string")
    got = {r.path: r.anchors for r in code.anchors(rows).collect()}
    assert got == {"a.tmpl": ["locale:repo.new", "href:/x", "css:#b", "template:a.tmpl"], "routers/r.go": ["route:/p"], "a.ts": ["css:#z"]}
    texts = spark.createDataFrame([("repo.new", "New")], "key string, text string")
    assert {r.path: r.anchors for r in code.anchors(rows, texts).collect()}["a.tmpl"][:2] == ["locale:repo.new", "text:New"]
    many = spark.createDataFrame([("b.tmpl", "q", " ".join(f'Locale.Tr "k{i}"' for i in range(30))), ("c.go", "q", 'm.Get("/p")'), ("d.ts", "q", "x = '.a' + \"#b\"")], "path string, qualified_name string, text string")
    got = {r.path: r.anchors for r in code.anchors(many, spark.createDataFrame([(f"k{i}", f"t{i}") for i in range(30)], "key string, text string")).collect()}
    assert len(got["b.tmpl"]) == 40 and got["b.tmpl"][:4] == ["locale:k0", "text:t0", "locale:k1", "text:t1"] and got["c.go"] == [] and got["d.ts"] == ["css:.a", "css:#b"]
    flat = code.flat_locales(spark.createDataFrame([('{"repo": {"new": "New"}, "n": 1, "a": "b"}',), ("bad",)], "value string"))
    assert sorted(flat.collect()) == [("a", "b"), ("repo.new", "New")]
    assert ("a.tmpl", "q", "text:New") in code.resolve_locales(code.anchors(rows), flat).collect()


def test_segments(spark):
    body = "x" * 150
    t = f"H1: A\n{body}\nH3: B\n{body}\nH2: C\nend"
    got = docs.segments(spark.createDataFrame([("u", t)], "uri string, text string")).orderBy("ordinal").collect()
    assert [(r.heading_path, r.text, r.start_offset, r.end_offset) for r in got] == [(["A", "B"], f"{body}\n{body}", 6, 313), (["A", "C"], "end", t.index("end"), len(t))]
    kept, rejected = docs.gate_quotes(spark.createDataFrame([("A  quote.", "a QUOTE"), ("x", ""), ("x", "y")], "text string, quote string"))
    assert (kept.count(), rejected.count()) == (1, 2)


def test_page_elements_and_safety(spark):
    html = '<a href="/x">A</a><a href="/y"> a </a><button type="submit">Delete all</button><input type="text" name="t"><form action="/f"></form>'
    e = pages.page_elements(spark.createDataFrame([("s", html)], "screen string, html string")).orderBy("ord").collect()
    assert [(r.role, r.name) for r in e] == [("link", "A"), ("link", "a #2"), ("button", "Delete all"), ("textbox", "t"), ("form", "form")]
    assert e[3].locator["css"] == "input[name=t]"
    rows = spark.createDataFrame([("form", "x", None, None, False), ("link", "x", "o", "/", False), ("link", "x", "h", "/admin/a", False), ("link", "x", "h", "/q", False), ("button", "Archive it", None, None, False), ("link", "x", "h", "/issues", True), ("link", "x", "h", "/demo/a", False)], "r string, n string, h string, p string, s boolean")
    got = [x[0] for x in rows.select(pages.blocked_reason(F.col("r"), F.col("n"), F.col("h"), F.lit("h"), F.col("p"), F.col("s"))).collect()]
    assert got == ["not-actionable", "external-host", "prohibited-route", "out-of-scope", "destructive-action", "already-executed", None]


def test_stability_and_recall(spark):
    s = spark.createDataFrame([(1, "screens", "a"), (2, "screens", "b"), (1, "links", "x"), (2, "links", "x"), (1, "flows", "f")], "run int, category string, item string")
    assert {r.category: r.stability for r in evals.stability(s).collect()} == {"screens": 0.0, "links": 1.0, "flows": 1.0}
    none = spark.createDataFrame([], "k int")
    assert evals.recall(none, none, ["k"]).first().recall == 1.0
    checks = spark.createDataFrame([("a", 1.0, 0.8), ("b", None, 0.8)], "name string, value double, least double")
    assert evals.verdicts(checks).first().passed and not evals.verdicts(checks.withColumn("value", F.lit(0.1))).first().passed


def test_records(spark, tmp_path):
    assert records.read_records(spark, str(tmp_path / "none"), "trace_links").count() == 0
    (tmp_path / "a.json").write_text('{"id": "x", "odd": 1, "confidence": 2.0, "link_type": "likes"}')
    assert [r.field for r in records.unknown_fields(spark, str(tmp_path), "trace_links").collect()] == ["odd"]
    found = {r.problem for r in records.violations(records.read_records(spark, str(tmp_path), "trace_links"), "trace_links").collect()}
    assert {"confidence is out of range", "link_type: likes", "method is missing"} <= found


def test_stream_counts_like_a_table(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 3.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = replay.windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(spark.table("counted").collect()) == sorted(replay.windowed_counts(rows).collect())


CANDIDATES = "state string, ord int, element_id string, role string, name string, href string, action string, reason_blocked string, fill_value_key string"


def test_recipes(spark):
    s = spark.createDataFrame(
        [("a", "Sign in as x", "http://h/user/login", "/user/login"), ("b", "Create a new issue", "http://h/user/login", "/user/login"), ("c", "please WATCH it", "http://h/", "/"),
         ("d", "watch", "http://h/demo/demo-repo/issues/1", "/x"), ("e", None, None, None), ("f", "other", "http://h/", "/")],
        "state string, goal string, url string, route_pattern string",
    )
    form = [("link", "Sign In", "/user/login", "click", "already-executed"), ("textbox", "user_name", None, "fill", None), ("textbox", "password", None, "fill", None), ("button", "Sign In", None, "submit", None)]
    rows = [(k, i, f"{k}{i}", r, n, h, a, b, "key" if a == "fill" else None) for k in "ab" for i, (r, n, h, a, b) in enumerate(form)]
    rows += [("d", 0, "d0", "button", "Unsubscribe", None, "click", None, None), ("d", 1, "d1", "button", "Watch", None, "click", None, None), ("f", 0, "f0", "button", "x", None, "click", None, None), ("f", 1, "f1", "LINK", "y", "/y", "click", None, None)]
    c = spark.createDataFrame(rows, CANDIDATES)
    got = {r.state: (r.element_id, r.action, r.source, r.fill_value_key, r.navigate_to) for r in policy.decide(s, c).collect()}
    assert got == {
        "a": ("a1", "fill", "deterministic", "key", None), "b": ("b1", "fill", "deterministic", "key", None), "c": (None, "navigate", "deterministic", None, "/demo/demo-repo/issues/1"),
        "d": ("d1", "click", "deterministic", None, None), "e": (None, None, "stop", None, None), "f": ("f1", "click", "deterministic", None, None),
    }
    answers = spark.createDataFrame([("a", -1, "done"), ("b", 2, "go"), ("d", 9, "?"), ("f", None, None)], "state string, index int, rationale string")
    said = {r.state: (r.element_id, r.source, r.rationale) for r in policy.decide_by_answers(s, c, answers).collect()}
    assert said["a"] == (None, "stop", "done") and said["b"] == ("b3", "llm", "go") and said["d"][:2] == ("d1", "deterministic")
    assert said["d"][2] == "llm-out-of-range: ?; deterministic-fallback: recipe keyword 'watch' matched candidate 'Watch'" and said["f"][0] == "f1" and said["e"][1] == "stop"


def test_success(spark):
    p = spark.createDataFrame([("http://h/", '<i class="ui avatar">'), ("http://h/user/login", "demo-user"), ("http://h/demo/demo-repo/issues/1", "demo-user Unwatch"), ("http://h/demo/demo-repo/issues/7", "Crawler-created issue for flow F2"), (None, None)], "url string, html string")
    got = [tuple(r) for r in p.select(*(f(F.col("url"), F.col("html")) for f in (policy.signed_in, policy.issue_created, policy.issue_watched))).collect()]
    assert got == [(True, False, False), (False, False, False), (True, False, True), (False, True, False), (False, False, False)]


def test_flat_locales_of_any_depth(spark):
    value = '{"a": ' * 11 + '"deep"' + "}" * 11
    got = code.flat_locales(spark.createDataFrame([(value,), ('{"b": "x"}',), ("bad",)], "value string"))
    assert sorted(tuple(r) for r in got.collect()) == [(".".join("a" * 11), "deep"), ("b", "x")]
    assert code.flat_locales(spark.createDataFrame([("bad",)], "value string")).count() == 0


def test_symbols_of_several_blocks_in_a_line(spark):
    files = spark.createDataFrame([("templates/a/b.tmpl", '{{define "x"}}{{define "y"}}\nq\n{{- define "z"}}\n'), ("e.ts", "")], "path string, content string")
    got = {(r.qualified_name, r.line_start, r.line_end) for r in code.symbols(files).collect()}
    assert got == {("a/b", 1, 3), ("x", 1, 0), ("y", 1, 3), ("e.ts", 1, 1)}


def test_declarations_that_name_nothing_end_spans(spark):
    go = "type A struct {\n}\ntype (\n\tB int\n)\nfunc G[T any](x T) {}\nfunc (w *A) Ünder(a int) {\n}\nfunc (A) lone() {}\nconst c = 1\nfunc z() {}\x0c\n"
    ts = "const f = (\n a,\n) => {\n}\nconst g = x => 1\nexport const h = async (a) => 2\nexport default function d() {}\nfunction e () {}"
    files = spark.createDataFrame([("a.go", go), ("b.ts", ts), ("c.tmpl", '{{ define "p" }}\n{{define "q"-}}\n{{define "r"}}')], "path string, content string")
    got = sorted((r.path, r.line_start, r.line_end, r.qualified_name, r.kind) for r in code.symbols(files).collect())
    assert got == [
        ("a.go", 1, 2, "A", "type"), ("a.go", 7, 8, "A.Ünder", "method"), ("a.go", 11, 12, "z", "function"),
        ("b.ts", 1, 5, "f", "function"), ("b.ts", 1, 8, "b.ts", "ts_module"), ("b.ts", 6, 7, "h", "function"), ("b.ts", 8, 8, "e", "function"),
        ("c.tmpl", 1, 2, "p", "template_block"), ("c.tmpl", 1, 3, "c", "template"), ("c.tmpl", 3, 3, "r", "template_block"),
    ]


def test_index_of_changed_code(spark):
    text = "package x\nfunc A() {\n{q}\n}\n"
    files = spark.createDataFrame([("b", "x.go", text.replace("{q}", "a")), ("h", "x.go", text.replace("{q}", 'm.Get("/p", f)')), ("b", "gone.go", "func G() {}\n")], "sha string, path string, content string")
    d = diffs.file_diffs(spark.createDataFrame([(DIFF,)], "value string"))
    s = code_files.index(d, files, spark.createDataFrame([], "key string, text string"), "b", "h")
    assert {(r.file, r.qualified_name, r.kind, r.repo_sha) for r in s.collect()} == {("x.go", "A", "function", "b"), ("gone.go", "G", "function", "b")}
    c = code_files.with_symbols(diffs.change_records(d, {"pr_number": 7}), s)
    assert {r.file: len(r.changed_symbol_ids) for r in c.collect()} == {"x.go": 1, "gone.go": 1, "new.ts": 0}
    assert {r.path: r.content is None for r in code_files.contents(d, files, "b", "h").collect()} == {"x.go": False, "gone.go": False, "new.ts": True}


def test_a_files_symbols_as_one_text(spark):
    """The text is put together before it is joined, once a file and not once a change."""
    changes = spark.createDataFrame([("h1", "a", ["old"]), ("h2", "a", None), ("h3", "b", []), ("h4", None, [])], "id string, file string, changed_symbol_ids array<string>")
    symbols = spark.createDataFrame([("c2", "a", 5), ("c1", "a", 5), ("c9", "a", 1), ("c9", "a", 1), ("c3", "z", 1), ("c4", None, 1)], "id string, file string, line_start int")
    arrays, texts = code_files.with_symbols(changes, symbols), code_files.with_symbols(changes, symbols, ", ")
    assert {r.id: r.changed_symbol_ids for r in arrays.collect()} == {"h1": ["c9", "c1", "c2"], "h2": ["c9", "c1", "c2"], "h3": [], "h4": []}
    assert {r.id: r.changed_symbol_ids for r in texts.collect()} == {"h1": "c9, c1, c2", "h2": "c9, c1, c2", "h3": "", "h4": ""}
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("array_join(")


def test_a_files_text_is_written_once(spark, tmp_path):
    """Twelve texts of 0.3 MB, changes of all files in turn: whoever writes them with Parquet's defaults writes each text once or a few times, not once a change."""
    files, ids, changes = 12, 40_000, 300
    symbols = spark.range(files * ids).selectExpr("concat('c', id) as id", f"concat('f', id % {files}) as file", "1 as line_start")
    c = spark.range(0, changes, 1, 1).selectExpr("concat('h', id) as id", f"concat('f', id % {files}) as file", "cast(null as array<string>) as changed_symbol_ids")
    code_files.with_symbols(c, symbols, ",").select("id", "changed_symbol_ids").write.parquet(f"{tmp_path}/a")
    assert sum(x.stat().st_size for x in (tmp_path / "a").glob("*.parquet")) < 12e6
    got = spark.read.parquet(f"{tmp_path}/a").selectExpr("id", "md5(changed_symbol_ids) as h").collect()
    want = {f: hashlib.md5(",".join(sorted(f"c{i}" for i in range(f, files * ids, files))).encode()).hexdigest() for f in range(files)}
    assert {r.id: r.h for r in got} == {f"h{i}": want[i % files] for i in range(changes)} and len(got) == changes


def test_long_texts_of_changes_are_saved_once(spark, tmp_path):
    """A text of over 1 MB, up to which Parquet writes equal texts once by default."""
    text = ",".join(f"c{i}" for i in range(200_000))
    changes = spark.range(0, 300, 1, 1).select("id", F.lit(text).alias("changed_symbol_ids"))
    sinks.save_changes(changes, f"{tmp_path}/a")
    assert len(text) > 1 << 20 and sum(x.stat().st_size for x in (tmp_path / "a").glob("*.parquet")) < len(text)
    assert spark.read.parquet(f"{tmp_path}/a").where(F.col("changed_symbol_ids") == text).count() == 300


@pytest.mark.parametrize("seed", [1, 2])
def test_requirements_hold_all_keywords_of_a_wanted_one(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "ab", "B", " bc ", "Straße", "STRASSE", "c", "", "zz"])
    req = [(f"r{i}", rng.choice([None, " ".join(word() for _ in range(rng.randrange(4)))]), rng.choice([None, [], [word(), None], [word()]]), (rng.choice(["u", "v", None]),)) for i in range(60)]
    wanted = [(f"g{i}", rng.choice(["u", "v", None, "", "w"]), rng.choice([None, [word() for _ in range(rng.randrange(4))], [word(), None]])) for i in range(80)] + [("g1", "u", ["a"]), ("g1", "u", ["a"])]
    r = spark.createDataFrame([*req, req[0]], "id string, statement string, acceptance_clues array<string>, source_span struct<uri:string>")
    w = spark.createDataFrame(wanted, "id string, source_uri string, keywords array<string>")
    text = {i: " ".join([s or "", *(c for c in clues or [] if c is not None)]).strip().casefold() for i, s, clues, _ in req}
    holds = lambda i, words: all(x is not None and x.strip().casefold() in text[i] for x in words or [])
    want = [(g, i) for g, uri, words in wanted for i, _, _, (at,) in [*req, req[0]] if (at or "") == (uri or "") and holds(i, words)]
    assert sorted(map(tuple, gold.requirement_matches(r, w).collect())) == sorted(want)
    hit = {g for g, _ in want}
    assert sorted(map(tuple, gold.requirement_recall(r, w).collect())) == sorted((g, g in hit) for g, _, _ in wanted)


def test_recall_over_one_document_of_many_requirements(spark):
    req = spark.range(40_000).selectExpr("concat('r', id) as id", "concat('Large item ', id % 5000, '.') as statement", "array('of STANDARD size') as acceptance_clues", "named_struct('uri', 'u') as source_span")
    wanted = spark.range(200).selectExpr("concat('g', id) as id", "'u' as source_uri", "array('Standard', concat('item ', id * 50, '.')) as keywords")
    began = time.time()
    got = dict(gold.requirement_recall(req, wanted).collect())
    assert got == {f"g{i}": i < 100 for i in range(200)} and time.time() - began < 90


def test_gold_set(spark, tmp_path):
    (tmp_path / "gold.json").write_text(json.dumps({
        "requirements": {"must_extract": [{"id": "g1", "source_uri": "u", "keywords": ["New", "issue"]}, {"id": "g2", "source_uri": "v", "keywords": []}], "expected_absent_in_crawl": [{"gold_id": "g1"}, {"gold_id": "g2"}]},
        "links": {"must_link": [{"element_name": "A", "route": "/", "symbol_file": "f"}], "must_not_link": []},
        "impacts": {"required_affected_routes": ["/", "/q"], "required_affected_flow_goal_keywords": [["sign", "in"], ["buy"]], "required_unmapped_files": ["z"], "min_findings": 1}, "thresholds": {"x": 0.8},
    }))
    g = gold.read_gold(spark, str(tmp_path / "gold.json"))
    req = spark.createDataFrame([("r1", "A NEW thing", ["an issue"], ("u",)), ("r2", None, None, ("w",))], "id string, statement string, acceptance_clues array<string>, source_span struct<uri:string>")
    wanted = gold.expected(g, "requirements.must_extract")
    got = gold.requirement_recall(req, wanted)
    assert dict(got.collect()) == {"g1": True, "g2": False} and gold.share(got, "recalled").first().recall == 0.5
    assert gold.share(got.where("false"), "recalled").first().recall == 1.0
    absent = gold.absence_verdicts(spark.createDataFrame([("r1",)], "requirement_id string"), req, wanted, gold.expected(g, "requirements.expected_absent_in_crawl"))
    assert dict(absent.collect()) == {"g1": True, "g2": False}
    el, sc = spark.createDataFrame([("e", "a", "s")], "id string, name string, screen_id string"), spark.createDataFrame([("s", "/")], "id string, route_pattern string")
    links, sy = spark.createDataFrame([("e", "c", "needs_review")], "source_entity_id string, target_entity_id string, review_status string"), spark.createDataFrame([("c", "f")], "id string, file string")
    triples = gold.link_triples(links, el, sc, sy)
    assert [r.verdict for r in gold.link_verdicts(triples, gold.expected(g, "links.must_link"), gold.expected(g, "links.must_not_link")).collect()] == ["matched"]
    f = spark.createDataFrame([("i", "c", ["e", "w"])], "id string, changed_symbol_id string, affected_entity_ids array<string>")
    flows = spark.createDataFrame([("w", "Sign In now")], "id string, goal string")
    reached = gold.affected(f, el, sc, flows)
    lists = [gold.expected(g, f"impacts.{x}") for x in ("required_affected_routes", "required_affected_flow_goal_keywords", "required_unmapped_files")]
    checks = gold.impact_checks(reached, spark.createDataFrame([("z",)], "file string"), 1, *lists, 1)
    assert {(r.check, r.item): r.passed for r in checks.collect()} == {("route", "/"): True, ("route", "/q"): False, ("goal", "sign,in"): True, ("goal", "buy"): False, ("unmapped", "z"): True, ("findings", "1"): True}
    assert not gold.passed(checks).first().passed and gold.passed(checks.where("passed")).first().passed
    sig = {(r.category, r.item) for r in gold.run_signature(sc, el, flows, triples, f, sy, reached).collect()}
    assert sig == {("screens", "/"), ("elements", '["a","/"]'), ("flows", "Sign In now"), ("links", '["a","/","f"]'), ("impacts", '{"file":"f","routes":["/"]}')}


def test_labels_in_a_report(spark):
    el = spark.createDataFrame([("e1", "x"), ("e2", "x"), ("e3", "")], "id string, name string")
    labels = lookups.entity_labels({"element": el, "flow": spark.createDataFrame([("w", "go", ["a", "b"])], "id string, goal string, interaction_ids array<string>")})
    assert {r.id: (r.label, r.step_count) for r in lookups.looked_up(el, labels).collect()} == {"e1": ("x", None), "e2": ("x", None), "e3": ("Unnamed element", None)}
    f = spark.createDataFrame([("i", [["h", "e3"]], ["e1", "e2", "e3", "w"])], "id string, path_entity_ids array<array<string>>, affected_entity_ids array<string>")
    assert [tuple(r) for r in lookups.shown(f, labels, "element", 1).collect()] == [("i", ["Unnamed element"], 1)]
    assert [tuple(r) for r in lookups.shown(f, labels, "element", 6).collect()] == [("i", ["Unnamed element", "x (2 places)"], 0)]
    assert lookups.affected_totals(f, labels).first().asDict() == {"elements": 3, "screens": 0, "flows": 1, "requirements": 0}
    local = labels.where("id = 'w'").withColumn("label", F.lit("own"))
    assert {r.label for r in lookups.overlaid(labels, local).collect()} == {"x", "Unnamed element", "own"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", {"z": "1", "b": "2"}, (2, 1), ["x"])], "id string, m map<string,string>, s struct<q:int,c:int>, l array<string>")
    assert tuple(sinks.properties(rows).first()) == ("a", '{"b":"2","z":"1"}', '{"c":1,"q":2}', ["x"])
    path = f"{tmp_path}/snap"
    assert sinks.save_snapshot(rows.select("id"), path) and not sinks.save_snapshot(rows.select("id"), path)
    with pytest.raises(ValueError):
        sinks.save_snapshot(rows.select(F.lit("b").alias("id")), path)
    sinks.append_decisions(rows.select("id"), f"{tmp_path}/d")
    sinks.append_decisions(rows.select("id"), f"{tmp_path}/d")
    assert spark.read.json(f"{tmp_path}/d").count() == 2
    assert sinks.read_flow_results(spark, f"{tmp_path}/none").count() == 0
    sinks.save_flow_results(spark.createDataFrame([("w", "k", True, 3)], sinks.FLOW_RESULT), f"{tmp_path}/flows")
    assert tuple(sinks.read_flow_results(spark, f"{tmp_path}/flows").select("flow_id", "actions_used").first()) == ("w", 3)
    named = spark.createDataFrame([("a.html",), ("b.html",)], "name string")
    assert sinks.original_uris(named.where("name = 'a.html'"), {"a.html": "u"}).first().uri == "u"
    with pytest.raises(Exception, match="unknown document"):
        sinks.original_uris(named, {"a.html": "u"}).collect()
    assert sinks.goals(" f1, F2", {"F1": "a", "F2": "b"}) == ["a", "b"]
    with pytest.raises(ValueError):
        sinks.goals("x", {})
    n, e = sinks.graph_load({"A": rows, "B": rows.select("id")}, {"T": (spark.createDataFrame([("a", "a", 1), ("a", "q", 1)], "src string, dst string, w int"), "A", "B")})
    assert n["A"].count() == 1 and [tuple(r) for r in e["T"].collect()] == [("a", "a", 1)]
    assert tuple(sinks.documents_summary(rows, rows, rows.where("false")).first()) == (1, 1, 0)


def test_replay_parts(spark):
    steps = spark.createDataFrame([("s", 0, "e", "Link", "Go #2", None, None), ("s", 1, "f", "button", "x", "/h", "blocked")], "state string, ord int, element_id string, role string, name string, href string, reason_blocked string")
    lines = steps.select(replay.trajectory_line(F.lit("/r"), F.lit("click"), F.col("element_id"), F.col("role"), F.col("name"), F.col("href")).alias("line"))
    assert lines.first().line == "/r: click e | role=Link | name=Go | href="
    assert {tuple(r) for r in replay.executed_pairs(lines).collect()} == {("link", "go"), ("button", "x")}
    assert [tuple(r) for r in replay.blocked_counts(steps).collect()] == [("s", 1)]
    assert replay.chosen_elements(spark.createDataFrame([("s", "e")], "state string, element_id string"), steps).first().c.name == "Go #2"
    r = replay.navigation_elements(spark.createDataFrame([("s", "/to")], "screen_id string, navigate_to string")).first()
    assert (r.role, r.name, r.attributes) == ("navigation", "/to", {"href": "/to"}) and r.id.startswith("element:")
    keys = spark.createDataFrame([({"name": "title"},), ({"placeholder": "A Title"},), ({"name": "q"},)], "a map<string,string>").select(pages.fill_key(F.col("a")))
    assert [x[0] for x in keys.collect()] == ["issue_title", "issue_title", None]


def test_orders_and_checks(spark):
    links = spark.createDataFrame([("b", "x", "t"), ("a", "y", "t"), ("a", "x", "u")], "source_entity_id string, target_entity_id string, link_type string")
    assert [r[0] + r[1] for r in linking.in_order(links).collect()] == ["ax", "ay", "bx"]
    rows = spark.createDataFrame([("c", "s", None, "n", None, None), ("c", "s", "e", None, None, None)], "change_id string, symbol_id string, element_id string, screen_id string, flow_id string, requirement_id string")
    assert [r.element_id for r in impact.in_order(rows).collect()] == ["e", None]
    checks = spark.createDataFrame([("a", 1.0, 0.8), ("b", None, 0.8), ("c", 0.1, 0.8)], "name string, value double, least double")
    assert [r.status for r in evals.check_rows(checks).collect()] == ["passed", "skipped", "failed"]
    assert spark.range(1).select(replay.default_run_id()).first()[0].startswith("run-2")
    req = spark.createDataFrame([("r", "s", [])], "id string, statement string, acceptance_clues array<string>")
    none = spark.createDataFrame([], "source_entity_id string, review_status string, link_type string")
    a = impact.absences(req, none, "run-1").first()
    assert a.search_scope == "crawl-run:run-1;screens+elements+links" and a.expected_evidence == ["s"]


def test_edges_keep_one_row_by_rule(spark):
    rows = spark.createDataFrame([("a", "b", 0.1), ("a", "b", 0.9)], "src string, dst string, confidence double").repartition(2)
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [tuple(r) for r in graph.edges(rows, nodes, nodes).collect()] == [("a", "b", 0.9)]
