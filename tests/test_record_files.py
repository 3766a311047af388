"""Records as files: names, order, checks, and what a failed write leaves."""

import json
import os
import pickle
import random

import pytest
from pyspark.sql import functions as F

from tracevale.sources import record_files


def flows(spark, rows):
    return spark.createDataFrame([(i, "1.0.0", run, "crawler", "rev", goal, ["a:1", "a:2"], "s:1", "s:2", "manual") for i, run, goal in rows], record_files.schema("flows"))


def test_records_are_files_by_id_in_order(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert record_files.read(spark, root, "flows").count() == 0
    record_files.save(flows(spark, [(f"flow:{i:03}", "r1", f"goal é {i}") for i in range(50)]).repartition(6), root, "flows")
    names = sorted(os.listdir(f"{tmp_path}/records/flows"))
    assert names == [f"flow_{i:03}.json" for i in range(50)]
    assert open(f"{tmp_path}/records/flows/flow_003.json", encoding="utf-8").read().startswith('{\n  "id": "flow:003",\n  "schema_version"')
    got = record_files.read(spark, root, "flows").collect()
    assert [r.id for r in got] == [f"flow:{i:03}" for i in range(50)] and got[3].goal == "goal é 3" and got[3].interaction_ids == ["a:1", "a:2"]
    record_files.save(flows(spark, [("flow:003", "r1", "old"), ("flow:003", "r2", "new"), ("flow:900", "r1", None)]), str(tmp_path), "flows")
    again = {r.id: r.goal for r in record_files.read(spark, root, "flows").collect()}
    assert len(again) == 51 and again["flow:003"] == "new" and again["flow:900"] is None and again["flow:004"] == "goal é 4"
    assert record_files.counts(spark, root, ["screens", "flows"]) == {"flows": 51, "screens": 0}


def test_many_files_are_read_in_order_by_several_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "records" / "flows").mkdir(parents=True)
    for i in range(30):
        (tmp_path / "records" / "flows" / f"{i:02}.json").write_text(json.dumps({"id": f"f{i}", "goal": "g"}))
    (tmp_path / "records" / "flows" / "notes.txt").write_text("no record")
    monkeypatch.setattr(record_files, "FILES", 7)
    assert [r.id for r in record_files.read(spark, str(tmp_path), "flows").collect()] == [f"f{i}" for i in range(30)]
    (tmp_path / "records" / "flows" / "bad.json").write_text('{"id": 5, "goal": [}')
    with pytest.raises(Exception):
        record_files.read(spark, str(tmp_path), "flows").collect()


def test_the_driver_keeps_few_bytes_of_each_name(tmp_path, monkeypatch):
    """Neither what tasks say of their writes nor what is planned for a read has a list of names."""
    monkeypatch.setattr(record_files, "SAMPLE", 500)
    rng = random.Random(3)
    ids = [f"element:{rng.getrandbits(64):016x}" for _ in range(5_000)]
    writer = record_files._Writer(str(tmp_path), "elements")
    said = [writer.write(iter([{"id": i, "value": json.dumps({"id": i})} for i in part])) for part in (ids[:4_500], ids[4_500:], [])]
    assert sum(len(pickle.dumps(x)) for x in said) < 1_000 and [x.folders for x in said] == [3, 1, 0]
    writer.commit([*said, None])
    assert sorted(os.listdir(tmp_path / "records" / "elements")) == sorted(record_files.file_name(i) for i in ids)
    monkeypatch.setattr(record_files, "FILES", 100)
    reader = record_files._Reader(str(tmp_path), "elements")
    chunks = reader.partitions()
    assert sum(len(pickle.dumps(c)) for c in chunks) < 20 * len(ids) and 40 <= len(chunks) <= 51 and max(len(c.names()) for c in chunks) < 400
    assert [r[0] for c in chunks for r in reader.read(c)] == sorted(ids)


def test_pieces_of_names(tmp_path, monkeypatch):
    monkeypatch.setattr(record_files, "PIECE", 30)
    names = sorted(f"é{'x' * (i % 20)} {i}\n.json" for i in range(200))
    for name in names:
        (tmp_path / name).touch()
    (tmp_path / "d.json").mkdir()
    for files, sample in ((7, 1 << 16), (7, 20), (1, 50), (1_000, 10)):
        monkeypatch.setattr(record_files, "FILES", files)
        monkeypatch.setattr(record_files, "SAMPLE", sample)
        monkeypatch.setattr(record_files, "folder", lambda root, kind: (record_files.fs.LocalFileSystem(), root))
        assert [n for c in record_files._Reader(str(tmp_path), "").partitions() for n in c.names()] == names


@pytest.mark.parametrize("kind", ["/etc", "..", "a/../../b", "", "../flows"])
def test_kinds_stay_within_the_records(spark, tmp_path, kind):
    with pytest.raises(ValueError):
        record_files.folder(str(tmp_path), kind)
    spark.dataSource.register(record_files.RecordFiles)
    with pytest.raises(Exception):
        spark.createDataFrame([("a", "{}")], "id string, value string").write.format("record_files").option("kind", kind).mode("append").save(str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    root = str(tmp_path)
    record_files.save(flows(spark, [("flow:1", "r", "kept")]), root, "flows")
    rows = flows(spark, [(f"flow:{i}", "r", "lost") for i in range(20)]).repartition(4)
    bad = rows.withColumn("goal", F.when(F.col("id") == "flow:7", F.raise_error(F.lit("lost"))).otherwise(F.col("goal")))
    with pytest.raises(Exception):
        record_files.save(bad, root, "flows")
    with pytest.raises(Exception):
        record_files.save(flows(spark, [("flow:2", "r", "x"), ("a/b", "r", "x")]), root, "flows")
    assert os.listdir(f"{root}/records/flows") == ["flow_1.json"]
    assert [r.goal for r in record_files.read(spark, root, "flows").collect()] == ["kept"]


def test_a_run_is_linked_from_its_files(spark, tmp_path):
    from tracevale.operators import linking

    base = ("1.0.0", "run", "crawler", "rev")
    rows = {
        "elements": [("element:1", *base, "screen:1", "button", "New Issue", {"css": "#new"}, {"href": "/new"}, None), ("element:2", *base, "screen:1", "link", "Straße", {}, {}, None)],
        "screens": [("screen:1", *base, "http://h/", "/issues", "t", "d", "s", "v")],
        "requirements": [("requirement:1", *base, "s", "user", "opens", "issue list", ["new issue", "strasse"], None, True)],
        "code_symbols": [("symbol:1", *base, "sha", "a.go", "f", "function", 1, 2, ["text:NEW issue", "href:/new", "css:#new", "route:/issues"])],
    }
    for kind, records in rows.items():
        record_files.save(spark.createDataFrame(records, record_files.schema(kind)), f"{tmp_path}/{'code' if kind == 'code_symbols' else 'run'}", kind)
    counts = linking.link_run(spark, f"{tmp_path}/run", "run-2", code_root=f"{tmp_path}/code")
    got = {(r.source_entity_id, r.target_entity_id): r for r in record_files.read(spark, f"{tmp_path}/run", "trace_links").collect()}
    assert set(got) == {("element:1", "symbol:1"), ("screen:1", "symbol:1"), ("requirement:1", "element:1"), ("requirement:1", "element:2")}
    link = got["element:1", "symbol:1"]
    assert link.method == "css-id+href-exact+text-exact" and link.confidence == pytest.approx(1 - 0.3 * 0.35 * 0.45) and link.review_status == "auto_accepted"
    assert (link.run_id, link.source, link.source_revision, link.schema_version) == ("run-2", "linking", "rev", "1.0.0")
    assert counts == {"auto_accepted": 1, "needs_review": 3, "unresolved": 0}
