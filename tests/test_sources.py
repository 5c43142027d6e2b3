import json
import os
import subprocess

import pytest
from corpus import DOCS

from corpusloom.sources import history, index, logs, markdown
from corpusloom.streaming import incremental


@pytest.fixture()
def folder(tmp_path):
    for path, text in DOCS.items():
        (tmp_path / "c" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / path).write_text(text)
    (tmp_path / "c/.hidden").mkdir()
    (tmp_path / "c/.hidden/a.md").write_text("x")
    (tmp_path / "c/UP.MD").write_text("x")
    (tmp_path / "c/.dot.md").write_text("x")
    os.symlink(tmp_path / "c/plan.md", tmp_path / "c/link.md")
    os.symlink(tmp_path / "c/dec", tmp_path / "c/linked")
    return tmp_path / "c"


def test_scan(spark, folder):
    assert markdown.markdown_files(str(folder)) == ["dec/DEC-1-old.md", "dec/DEC-2-new.md", "link.md", "notes/_x.md", "plan.md", "req/req-1.md"]
    assert markdown.markdown_files(str(folder), recursive=False) == ["link.md", "plan.md"]
    rows = {r.path: bytes(r.content).decode() for r in markdown.read_corpus(spark, str(folder)).collect()}
    assert rows == DOCS | {"link.md": DOCS["plan.md"]}
    assert {r.path for r in markdown.read_store(spark, str(folder)).collect()} >= {"plan.md", "dec/DEC-1-old.md"}
    assert markdown.one_document(spark, b"# x").first().path == "-"


def test_history_and_revisions(spark, folder):
    git = lambda *a, when="2024-01-01T00:00:00+02:00": subprocess.run(
        ["git", "-C", str(folder), *a], check=True, capture_output=True,
        env=os.environ | {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "GIT_AUTHOR_NAME": "t", "GIT_AUTHOR_EMAIL": "t@t", "GIT_COMMITTER_NAME": "t", "GIT_COMMITTER_EMAIL": "t@t"})
    git("init", "-q")
    git("add", "plan.md", "dec")
    git("commit", "-qm", "one")
    (folder / "plan.md").write_text("# changed")
    git("commit", "-qam", "two", when="2024-02-01T00:00:00+00:00")
    times = {r.path: r for r in history.commit_times(history.read_history(spark, str(folder))).collect()}
    assert times["plan.md"].stamp.startswith("2024-02-01") and times["plan.md"].first_stamp == "2024-01-01T00:00:00+02:00"
    assert times["dec/DEC-1-old.md"].epoch == 1704060000
    old = {r.path: bytes(r.content).decode() for r in markdown.read_revision(spark, str(folder), "HEAD~1").collect()}
    assert old == {k: v for k, v in DOCS.items() if k == "plan.md" or k.startswith("dec")}
    assert {r.path for r in markdown.read_revision(spark, str(folder), "HEAD", "dec").collect()} == {"DEC-1-old.md", "DEC-2-new.md"}
    assert markdown.read_revision(spark, str(folder), "HEAD", "nowhere").collect() == []


def test_logs_config_and_cases(spark, tmp_path):
    event = {"schema_version": 1, "ts": "2024-01-01T00:00:00Z", "session": "s", "tool": "t", "outcome": "ok", "duration_ms": 5, "truncated": False}
    (tmp_path / "log.jsonl").write_text("\n".join([json.dumps(event), "", "{broken", "[1]", json.dumps(event | {"outcome": "error"})]))
    events, skipped = logs.read_events(spark, str(tmp_path / "log.jsonl"))
    assert events.count() == 2 and skipped.first().skipped == 2
    logs.append_events(events, str(tmp_path / "out"))
    logs.append_events(events, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "conf.yaml").write_text("enforcement:\n  off: [x]\n  blocking: [y]\n")
    config = logs.read_config(str(tmp_path / "a/b"), "conf.yaml")
    assert logs.policy(config) == {"off": ["x"], "blocking": ["y"], "advisory": []} and logs.read_config(str(tmp_path), "none.yaml") == {}
    with pytest.raises(ValueError):
        logs.policy({"enforcement": {"off": "x"}})
    (tmp_path / "cases.json").write_text(json.dumps({"cases": [{"id": "1", "query": "q", "relevant": ["a"], "must_not_return": ["b"]}]}))
    cases, relevant, forbidden = logs.read_cases(spark, str(tmp_path / "cases.json"))
    assert cases.first().tool == "search_artifacts" and relevant.first().doc == "a" and forbidden.first().doc == "b"
    (tmp_path / "bad.json").write_text("[]")
    with pytest.raises(ValueError):
        logs.read_cases(spark, str(tmp_path / "bad.json"))


def test_index_versions(spark, tmp_path):
    root = str(tmp_path / "index")
    assert index.current(spark, root) is None
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content_hash string")
    index.publish(root, {"manifest": df}, "f1")
    assert index.current(spark, root, "f1")["manifest"].count() == 2 and index.current(spark, root, "f2") is None
    index.publish(root, {"manifest": df.limit(1)}, "f1")
    assert index.current(spark, root, "f1")["manifest"].count() == 1
    assert index.corpus_hash(df) == index.corpus_hash(df.orderBy("content_hash")) != index.corpus_hash(df.limit(1))
    found, missing = index.reuse(df, df.limit(1).selectExpr("content_hash", "1 as result"), ["content_hash"])
    assert found.count() == 1 and missing.count() == 1


def test_incremental_equals_rebuild(spark):
    row = "path string, content_hash string, length long, modified_ns long"
    old = spark.createDataFrame([("a", "1", 1, 1), ("b", "2", 2, 2), ("c", "3", 3, 3), ("e", "5", 5, 5)], row)
    new = spark.createDataFrame([("a", "1", 1, 9), ("b", "9", 2, 3), ("d", "4", 4, 4), ("e", "6", 5, 5)], row)
    assert {(r.path, r.change) for r in incremental.manifest_diff(old, new).collect()} == {("b", "modified"), ("c", "removed"), ("d", "added")}
    assert {(r.path, r.change) for r in incremental.manifest_diff(old, new, verify=True).collect()} == {("b", "modified"), ("c", "removed"), ("d", "added"), ("e", "modified")}
    diff = incremental.manifest_diff(old, new, verify=True)
    up = new.join(diff.where("change <> 'removed'").select("path"), "path", "left_semi")
    now = incremental.overlay(old, up, diff.where("change = 'removed'").select("path"))
    assert {(r.path, r.content_hash) for r in now.collect()} == {(r.path, r.content_hash) for r in new.collect()}
    dead = spark.createDataFrame([("c",)], "path string")
    kept, gone = incremental.merge_delta(up, dead, new.where("path = 'd'"), spark.createDataFrame([("b",)], "path string"))
    assert {r.path for r in kept.collect()} == {"d", "e"} and {r.path for r in gone.collect()} == {"b", "c"}
    assert incremental.needs_compaction(100, 10_000) and not incremental.needs_compaction(10**7, 10_000)


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("cast(ts as timestamp) as ts", "event_type as tool", "'ok' as outcome")
    events.write.parquet(str(tmp_path / "in"))
    stream = incremental.stream_summary(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("summary").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("summary").selectExpr("sum(calls)").first()[0] == events.count()
    seen = []
    incremental.follow(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), lambda b, i: seen.append(b.count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(seen) == events.count()
