"""Each operator against a plain version, on small tables with nulls, empty and repeated rows, ties and clashing names."""

import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracevale.llm import components, decontaminate, html_extract, license_scan, line_dedup, ngram_join, packing, quality_crf, queries, substring_dedup, topk, warc

WORDS = [f"w{i}" for i in range(400)]


def text(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


BASE = text(1, 60)
ROWS = [
    (1, BASE), (2, BASE), (3, BASE.replace(" ", "\n", 3)), (4, text(2, 30) + " " + BASE[:200]), (5, None), (6, ""), (7, "one"), (8, "one two"), (9, "ONE Two"),
    (10, text(3, 80) + " x"), (11, text(3, 80) + " y"), (12, "a b " * 40), (13, "  \n\n"), (None, BASE), (14, "é ß Ç\n" + "Long enough line to count here\n" * 3), (15, "long enough LINE to count here \nb"),
    (16, "\tlong enough line to count here"), (17, text(9, 3000)), (17, text(9, 3000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "k", "w", 0) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, row string, class int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=repr)


# 1
def leaks(rows, items, window):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for item, it in items:
            v = words(it)
            n = min(window, len(v))
            for s in range(len(w) - n + 1 if n else 0):
                if any(w[s : s + n] == v[o : o + n] for o in range(len(v) - n + 1)):
                    hit |= set(range(s, s + n))
                    ids |= {str(item)} - {"None"}
        out.append((i, len(w), sorted(hit), sorted(ids)))
    return sorted(out, key=repr)


def test_decontamination(spark, docs, empty):
    items = [(1, BASE[20:180]), (2, "two"), (2, "Two"), (3, None), (4, "!!"), (None, "ONE"), (5, "a b a b a b a b a b a b"), (6, "zz yy")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.phrase_matches(docs, table)
    assert got.columns == [*docs.columns, "leak"]
    assert sorted(((r.doc_id, r.leak.n_words, r.leak.hit, r.leak.item_ids) for r in got.collect()), key=repr) == leaks(ROWS, items, 10)
    assert decontaminate.phrase_matches(empty, table).count() == 0
    assert decontaminate.phrase_matches(docs, table.where("false")).where("size(leak.hit) > 0").count() == 0


def test_decontamination_of_many_terms(spark, docs, monkeypatch):
    """Beyond what is broadcast, words are counted before they meet the terms."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    items = [(1, BASE[20:180]), (2, "two"), (5, "a b a b a b a b a b a b")]
    got = decontaminate.phrase_matches(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((r.doc_id, r.leak.n_words, r.leak.hit, r.leak.item_ids) for r in got.collect()), key=repr) == leaks(ROWS, items, 10)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "rare1 x y rare2 z"), (2, "rare2 rare1")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "rare1 y rare2")], "item_id long, text string")
    assert [r.doc for r in decontaminate.proximity_matches(d, items, slop=1).collect()] == [1]
    assert decontaminate.proximity_matches(d, items, slop=0).count() == 0


def near(rows, items, window, slop, percent):
    out = set()
    for d, t in rows:
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        for item, it in items:
            v = re.findall(r"[a-z0-9]+", (it or "").lower())
            n = min(window, len(v))
            for o in range(len(v) - n + 1 if n else 0):
                x = v[o : o + n]
                for s in range(-n, len(w)):
                    there = [x[k] in w[max(0, s + k - slop) : max(0, s + k + slop + 1)] for k in range(n)]
                    out |= {(d, item)} if 100 * sum(there) >= percent * n and any(0 <= s + k < len(w) and w[s + k] == x[k] for k in range(n)) else set()
    return out


def test_proximity_checks_all_terms_and_keeps_missing_ones(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [
        (1, "so " + passage), (2, passage.replace("alpha", "changed")), (3, passage.replace("alpha", "changed").replace("theta", "rho")), (4, passage.replace("gamma", "x").replace("eta ", "y ").replace("iota", "z")),
        (5, "alpha beta q q q q q q q q"), (6, passage.replace("delta", "delta q r")), (7, " ".join(reversed(passage.split()))), (8, "gamma delta epsilon zeta eta theta iota kappa"), (9, None), (10, "theta " * 20 + "alpha"),
    ]
    items = [(1, passage), (2, passage.replace("beta", "nowhere")), (3, passage.replace("beta", "nowhere").replace("zeta", "never")), (4, "alpha"), (5, ""), (6, "nowhere"), (7, "alpha nowhere beta")]
    d, i = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for slop, percent in ((0, 80), (2, 80), (2, 100), (3, 50)):
        got = {(r.doc, r.item_id) for r in decontaminate.proximity_matches(d, i, slop=slop, percent=percent).collect()}
        assert got == near(rows, items, 10, slop, percent), (slop, percent)
    at_default = {(r.doc, r.item_id) for r in decontaminate.proximity_matches(d, i).collect()}
    assert {(1, 1), (2, 1), (3, 1), (1, 2), (1, 3)} <= at_default and not {(5, 1), (10, 1)} & at_default


# 2
def groups(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                n = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    root[a] = min(root[a], root[b])
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    return sorted(((i, len(s), least[r]) for (i, _), s, r in zip(rows, sets, root, strict=True)), key=repr)


def links_of(rows, k, percent):
    """For each row the number of other sets that its set links with, and of other rows with the same set."""
    sets = []
    for _, t in rows:
        w = (t or "").translate({i: i + 32 for i in range(65, 91)}).split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    alike = lambda a, b: a and b and a != b and 100 * len(a & b) >= percent * len(a | b)
    return sorted(((i, sum(bool(alike(s, x)) for x in set(sets)), sets.count(s) - 1 if s else 0) for (i, _), s in zip(rows, sets, strict=True)), key=repr)


NEAR = [(100 + i, " ".join(f"n{j}" if j != i else "other" for j in range(40))) for i in range(12)]


@pytest.mark.parametrize("block", [256, 3])
def test_products_give_every_link(spark, docs, monkeypatch, block):
    """Whether columns are short or cut into blocks of rows, all links come from the products."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    d = spark.createDataFrame(NEAR + ROWS, "doc_id long, text string").repartition(3)
    got = ngram_join.near_duplicates(d, 2, 60)
    assert by_id(got, "n_shingles", "component_id") == groups(NEAR + ROWS, 2, 60)
    assert by_id(got, "n_links", "n_copies") == links_of(NEAR + ROWS, 2, 60)


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 90, 256), (5, 80, 256), (2, 50, 2)])
def test_ngram_join(docs, empty, monkeypatch, k, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    assert by_id(ngram_join.near_duplicates(docs, k, percent), "n_shingles", "component_id") == groups(ROWS, k, percent)
    assert ngram_join.near_duplicates(empty, k, percent).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (9, 8), (20, 21), (7, 7)], "a long, b long")
    assert dict(components.components(e).collect()) == {3: 3, 4: 3, 5: 3, 8: 3, 9: 3, 20: 20, 21: 20}


def test_components_with_hubs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(500, 500 + i) for i in range(1, 60)] + [(700, 700 - i) for i in range(1, 60)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert dict(components.components(spark.createDataFrame(edges, "a long, b long"), many=3).collect()) == root


# 3
def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_VALUES", 240)
    monkeypatch.setattr(topk, "PACK_ROWS", 4)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(100)] + [(100, [0.1] * 8), (101, [0.1] * 8), (102, None), (103, [float("nan")] * 8), (104, [None] * 8), (105, []), (None, [0.1] * 8), (106, [0.0] * 8), (107, [1e9] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = {i: np.floor(64 * np.float32(e).astype(float)).astype(int) for i, e in rows if i is not None and e and None not in e and not np.isnan(e).any()}
    want = []
    for q in sorted(i for i in v if i % 20 == 0):
        best = sorted(((-int(v[q] @ v[c]), c) for c in v if c != q))[:20]
        want += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()) == want
    clash = df.select("*", F.lit(1).alias("n"), F.lit("x").alias("block"), F.lit(0).alias("score"))
    assert sorted(tuple(r) for r in topk.top_k(clash, F.col("vec_id") % 20 == 0).collect()) == want
    assert topk.top_k(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).count() == 4
    assert topk.top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


# 4
def removals(rows, window):
    first, out = {}, []
    w = [(i, (t or "").encode().split()) for i, t in rows]
    starts = sorted(((-(2**63) if i is None else i, s, tuple(x[s : s + window])) for i, x in w for s in range(len(x) - window + 1)))
    for i, s, g in starts:
        first.setdefault(g, (i, s))
    for i, x in w:
        gone = set()
        for s in range(len(x) - window + 1):
            if first[tuple(x[s : s + window])] != (-(2**63) if i is None else i, s):
                gone |= set(range(s, s + window))
        out.append((i, len(x), len(gone), b" ".join(y for n, y in enumerate(x) if n not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("large", "window"), [(4000, 20), (1, 20), (1, 7), (1, 3)])
def test_substring_dedup(docs, empty, monkeypatch, large, window):
    monkeypatch.setattr(substring_dedup, "GROUP_ROWS", large)
    monkeypatch.setattr(substring_dedup, "SAMPLE", 16 if large > 1 else 1)
    got = substring_dedup.remove_repeats(docs, window)
    assert by_id(got, "n_words", "n_removed", "kept") == removals(ROWS, window)
    assert all(r.n_removed == sum(x.end - x.start for x in r.repeats) for r in got.collect())
    assert substring_dedup.remove_repeats(empty).count() == 0


# 5
def test_best_fit():
    lengths = np.array([700, 600, 400, 300, 24, 24])
    sequence, offset = packing.best_fit(lengths, 1024)
    assert sequence.tolist() == [0, 1, 1, 0, 0, 1] and offset.tolist() == [0, 0, 600, 700, 1000, 1000]


def test_best_fit_matches_a_plain_one():
    lengths = np.sort(np.random.default_rng(5).integers(1, 1025, 600))[::-1]
    sequence, offset = packing.best_fit(lengths, 1024)
    room, where = [], []
    for n in lengths.tolist():
        able = [(r, i) for i, r in enumerate(room) if r >= n]
        i = min(able)[1] if able else len(room)
        if not able:
            room.append(1024)
        where.append(1024 - room[i])
        room[i] -= n
    assert sorted(np.bincount(sequence, lengths).astype(int).tolist()) == sorted(1024 - r for r in room)
    assert (offset + lengths <= 1024).all() and sorted(offset.tolist()) == sorted(where)


def test_packing_of_much_repeated_rows(spark):
    d = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    got = packing.pack(d, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert len(got) == 3000 == len({(r.sequence_id, r.offset) for r in got})


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in ROWS}
    per_doc, per_sequence = {}, {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        per_doc[r.doc_id] = per_doc.get(r.doc_id, 0) + r.length
        per_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in ids.items():
        assert per_doc[i] == len(x) * sum(j == i for j, _ in ROWS)
    for parts in per_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty, public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def test_encoder_on_odd_texts():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    for t in ["a  b", " a", "a ", "a\n\nb", "x\ty", "it's <|endoftext|> I'LL we'll", "", "\n", "½ ² a_b", "日本 é é"]:
        assert encode(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_of_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "a  <|endoftext|>  b\n\n", "<|endoftext|><|endoftext|>", "<|endoftext|", "it's <|ENDOFTEXT|>", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)))
    stage = corpus_pipeline.STAGES[-1][1](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "")
    for got in (queries.QUERIES["op5_packing"](spark, str(tmp_path)), stage):
        assert sorted((r.doc_id, r.ids_crc32, r.doc_tokens) for r in got.collect()) == want


# 6
def test_marginals_match_brute_force():
    rng = np.random.default_rng(3)
    good, change = rng.normal(size=4), rng.normal(size=(2, 2))
    weight = {s: np.exp(sum(good[i] * s[i] for i in range(4)) + sum(change[s[i], s[i + 1]] for i in range(3))) for s in np.ndindex(2, 2, 2, 2)}
    z = sum(weight.values())
    p, pairs, log_z = quality_crf.marginals(np.append(good, 0.3), change, np.array([4, 1]))
    for i in range(4):
        assert p[i] == pytest.approx(sum(w for s, w in weight.items() if s[i]) / z)
    assert pairs[0, 1] == pytest.approx(sum(w * sum(s[i : i + 2] == (0, 1) for i in range(3)) for s, w in weight.items()) / z)
    assert log_z == pytest.approx(np.log(z) + np.log1p(np.exp(0.3)))


def test_quality_held_out(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality_crf.fit(d, labels.where(~out))
    got = quality_crf.score(d, model).where(out).join(labels, "doc_id")
    assert got.where((F.col("score") >= 0.3).cast("int") == F.col("quality")).count() >= 0.95 * got.count()


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (12, 0), (99, 1), (2, None)], "doc_id long, quality int")
    model = quality_crf.fit(docs, labels)
    got = quality_crf.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality_crf.score(empty, model).count() == 0
    assert {r.score for r in quality_crf.score(docs, quality_crf.fit(docs, labels.where("false"))).collect()} == {0.5}


def test_quality_passes_over_long_documents(spark):
    good, bad = "A plain line of words that read well.", "$$$ CLICK!!! 123 | 456 | $$$ BUY"
    rows = [(i, "\n".join([good if i % 2 else bad] * (1001 if i < 40 else 5))) for i in range(240)]
    d, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(240)], "doc_id long, quality int")
    for lines, kept in ((1000, d), (100, d.where("doc_id < 40"))):
        got = quality_crf.score(kept.withColumn("score", F.lit("old")), quality_crf.fit(kept, labels, sample_lines=lines))
        assert got.columns == ["doc_id", "text", "score"]
        assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in got.collect())


# 7
def lines_kept(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    where = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            where.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(w := where[key(x)]) < 3 or max(w, key=lambda j: -1 if j is None else j) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(docs, empty):
    got = line_dedup.apply_keep(docs, line_dedup.keep_bitmaps(docs))
    assert got.columns == [*docs.columns, "line_dedup"]
    assert sorted(((r.doc_id, r.line_dedup.n_lines, r.line_dedup.n_dropped, r.line_dedup.kept) for r in got.collect()), key=repr) == lines_kept(ROWS)
    assert line_dedup.apply_keep(empty, line_dedup.keep_bitmaps(empty)).count() == 0


def test_clashing_names_of_native_operators(spark, docs):
    items = spark.createDataFrame([(1, BASE[20:180])], "item_id long, text string")
    names = ["__doc", "__hash", "__lines", "__words", "key", "lines", "bits", "r", "a.b"]
    d = docs.select("doc_id", "text", *(F.lit(n).alias(n) for n in names), F.lit(1).alias("leak"), F.lit(1).alias("line_dedup"))
    for got, own, other in ((decontaminate.phrase_matches(d, items), "leak", "line_dedup"), (line_dedup.apply_keep(d, line_dedup.keep_bitmaps(d)), "line_dedup", "leak")):
        assert sorted(got.columns) == sorted(d.columns) and got.count() == len(ROWS)
        assert all(r[n] == n for r in got.collect() for n in names) and dict(got.dtypes)[own].startswith("struct") and dict(got.dtypes)[other] == "int"


def test_line_dedup_of_many_lines(spark):
    rows = [(i, "\n".join(f"a line that is long enough {n % 150}" for n in range(200))) for i in range(3)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.apply_keep(d, line_dedup.keep_bitmaps(d))
    assert sorted((r.doc_id, r.line_dedup.n_lines, r.line_dedup.n_dropped, r.line_dedup.kept) for r in got.collect()) == lines_kept(rows)


@pytest.mark.parametrize("partitions", [1, 2, 4, 16])
def test_line_dedup_of_lines_repeated_inside_documents(spark, partitions):
    """A document that holds a line often is one document, however lines are dealt."""
    line, other = "a line of more than twenty points", "another line of more than twenty"
    cases = [[(1, line), (2, line), (3, "\n".join([line] * 3))], [(1, line), (3, "\n".join([line] * 5)), (3, line)], [(79, f"x\n{line}"), (315, line), (659, f"{line}\ny\n{line}"), (744, "\n".join([line, other] * 4)), (None, line), (800, other)]]
    rng = random.Random(partitions)
    cases.append([(i, "\n".join(rng.choice([line, other, line.upper(), "short", f" {other}\t", f"{line} {rng.randrange(30)}"]) for _ in range(rng.randrange(1, 40)))) for i in range(60)])
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for rows in cases:
            d = spark.createDataFrame(rows, "doc_id long, text string")
            got = line_dedup.apply_keep(d, line_dedup.keep_bitmaps(d))
            assert sorted(((r.doc_id, r.line_dedup.n_lines, r.line_dedup.n_dropped, r.line_dedup.kept) for r in got.collect()), key=repr) == lines_kept(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


# 8
def test_warc_round_trip(spark):
    rows = [(1, "http://a/\n", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 70_000), (None, "u", "<p>x</p>"), (2, "v", "<p>x</p>"), (None, "w", "lone")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, key int").repartition(3)
    got = warc.read_archives(warc.write_archives(pages)).collect()
    last = {}
    for i, _, h in rows:
        last[h or ""] = max([x for x in (last.get(h or ""), i) if x is not None], default=None)
    want = []
    for i, u, h in rows:
        raw = (h or "").encode()
        refers = None if i == last[h or ""] else last[h or ""]
        want.append((i, u and u.replace("\n", "%0A"), len(raw), warc.base32_sha1(raw), "response" if refers is None else "revisit", refers, raw if refers is None else None))
    assert sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in got), key=repr) == sorted(want, key=repr)
    assert warc.round_trip(spark, pages.where("false")).count() == 0


def test_warc_rejects_what_is_wrong():
    raw = warc._record(1, "u", b"abc", None, "2020-01-01T00:00:00Z")
    assert warc.parse_record(raw)["payload"] == b"abc"
    for bad in (raw.replace(b"abc", b"abd"), raw[:-1], raw.replace(b"WARC/1.1", b"WARC/9"), raw.replace(b"WARC-Date", b"X-Date"), raw.replace(b"response\r\n", b"revisit\r\n", 1)):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


# 9
PAGE = '<html><head><title>t</title></head><body><nav><a href="/">menu one</a></nav><div class="top ad">buy this now</div><article><h1>Head &amp; tail</h1><p><b>One.<br><p>a &lt;\n b &#233; 1 < 2<script>x="</p>"</script></p><aside>side</aside><div class="comments"><p>no</p></div></article><div>plain outside words here and more</div><footer>&copy; f</footer></body></html>'


def test_html(spark):
    weights = html_extract.learn([PAGE] * 5)
    want = "Head & tail\n\nOne.\n\na < b é 1 < 2"
    assert html_extract.extract(PAGE, weights) == want
    assert html_extract.extract(PAGE[: PAGE.index("</article>")], weights) == want
    for x in (None, "", "<nav>menu</nav>", "<", "<p", "<!-- a"):
        assert html_extract.extract(x, weights) in ("", "<")
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x")], "page_id long, url string, html string, text string")
    assert sorted((r.n_chars, r.text) for r in html_extract.main_texts(pages).collect()) == [(0, ""), (len(want), want), (len(want), want)]
    assert html_extract.main_texts(pages.where("false")).count() == 0


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "ad-free", "modal-open", "social-science", "post-header"])
def test_html_of_wrappers_with_marked_words_in_longer_names(name):
    words = "some text that is long enough to be a page's main text by any measure"
    for weights in ({}, html_extract.learn([PAGE] * 5)):
        assert html_extract.extract(f"<html><body><div class='{name}'><div><p>{words}</p></div></div></body></html>", weights) == words
        assert html_extract.extract(f"<html><body><article><p>{words}</p><div id={name.split()[-1]}>{words}</div><p>{words}</p></article></body></html>", weights) == "\n\n".join([words] * 3)
        assert html_extract.extract(f"<body><div class='x sidebar'>menu</div><div class='{name}'><p>{words}</p><div role=navigation>menu</div></div></body>", weights) == words


def test_html_without_labelled_pages(spark):
    text = "a plain text that goes on for some words"
    page = f"<body><div><a href=/>Home</a><a href=/a>About us</a></div><p>{text}</p><ul><li><a href=/b>One</a><li><a href=/c>Two more</a></ul></body>"
    pages = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert html_extract.main_texts(pages).first().text == text


@pytest.mark.parametrize("weights", [{}, html_extract.DEFAULT, html_extract.learn([PAGE] * 5)])
def test_html_of_comments_teasers_and_notices(weights):
    words = "some words of a page's own text that go on for a while and then a little more"
    other = "words by somebody else that are long enough to be taken for text by any count of words " * 3
    cases = [
        f'<body><article><p>{words}</p></article><div id="comments"><article class="comment-body"><p>{other}</p></article><article><p>{other}</p></article></div></body>',
        f'<body><article><p>{words}</p><section id="comments"><article class="comment"><p>{other}</p></article></section></article></body>',
        f'<body><article><p>{words}</p></article><aside><article>{other}</article></aside></body>',
        f'<body><aside><article>{other}</article></aside><article><p>{words}</p></article></body>',
        f'<body><div class="gdpr-consent"><p>{other}</p></div><article><p>{words}</p></article></body>',
        f'<body><article class="teaser">{other}</article><article><p>{words}</p></article><div class="cookie-notice">{other}</div></body>',
        f'<body><article><div class="social"><p>{words}</p></div></article></body>',
        f'<body><article><div class="social"><a href=/>Share</a> <a href=/>Send on</a></div><p>{words}</p></article></body>',
        f'<body><nav><a href=/>menu</a><article><p>{words}</p></article></body>',
        f'<body><ul><li class="menu"><a href=/>x</a><li class="menu">y</ul><article><p>{words}</p></article></body>',
    ]
    for case in cases:
        assert html_extract.extract(case, weights) == words, case


def test_html_of_long_and_deep_pages(spark):
    deep = "<article>" + "<div class='x social'>" * 300 + "deep text here" + "</div>" * 300 + "</article>"
    long = "<article>" + "<p>word and word</p>" * 20_000 + "</article>"
    pages = spark.createDataFrame([(1, "u", deep, 1, 2), (2, "u", long, 1, 2)], "page_id long, url string, html string, n_chars int, text int")
    got = {r.page_id: r.text for r in html_extract.main_texts(pages).collect()}
    assert got == {1: "deep text here", 2: "\n\n".join(["word and word"] * 20_000)}


def test_html_learns_scores_of_marked_names():
    page = "<body><div class='post-header'>three words here</div><article><p>text</p><section id=ad-free>a</section></article></body>"
    weights = html_extract.learn([page])
    assert weights["div."] == -7.0 and weights["section."] == 0


# 10
def test_license_scan(spark):
    mit = license_scan.TEXTS["MIT"]
    rows = [(1, "Copyright (c) 2020 Me\n" + mit.upper().replace(",", " ;")), (2, mit + " more"), (3, "a\nRELEASED under the MIT licence\nx"), (4, None), (5, ""), (6, "© only"), (7, "Licensed under CC BY-NC 4.0."), (7, "Licensed under CC BY-NC 4.0.")]
    got = license_scan.scan(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, digest int"))
    want = [(1, "MIT", "", 0), (2, None, "", 0), (3, None, "MIT", 1), (4, None, "", 0), (5, None, "", 0), (6, None, "", 0), (7, "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1), (7, "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1)]
    assert by_id(got, "license_id", "notice_ids", "n_notices") == sorted(want, key=repr)
    for r in got.collect():
        assert r.canonical_sha256 == hashlib.sha256(license_scan.canonical(dict(rows)[r.doc_id] or "").encode()).hexdigest()


def test_license_scan_of_whole_texts(spark):
    known = license_scan.TEXTS
    mit, apache, gpl2, gpl3 = (known[x] for x in ("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-only"))
    bare = mit.removeprefix("MIT License\n")
    cases = [(t, name) for name, t in known.items()] + [
        ("Copyright 2001 Me\n\n" + bare, "MIT"), ("The MIT License (MIT)\n\nCopyright (c) 2001 Me\n\n" + bare, "MIT"),
        ("\n\n".join(textwrap.fill(x, 70) for x in mit.split("\n")), "MIT"), ("\n\n".join(textwrap.fill(x, 63) for x in mit.split("\n")), "MIT"),
        (apache[: apache.index("APPENDIX")], "Apache-2.0"), (apache[apache.index("TERMS AND CONDITIONS") :].replace("http:", "https:"), "Apache-2.0"),
        (gpl2.replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA"), "GPL-2.0-only"),
        (gpl3[: gpl3.index("How to Apply")], "GPL-3.0-only"), (known["MPL-2.0"].replace("http:", "https:"), "MPL-2.0"), ("All rights reserved.\n" + known["BSD-3-Clause"].replace("1. R", "* R").replace("2. R", "* R").replace("3. N", "* N"), "BSD-3-Clause"),
        (gpl3[: len(gpl3) // 2], None), (apache + gpl3, None),
    ]
    got = license_scan.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string"))
    assert by_id(got, "license_id") == sorted(((i, name) for i, (_, name) in enumerate(cases)), key=repr)
    digests = [d for d, _ in license_scan.digests(known)]
    assert len(digests) == len(set(digests))
