import datetime as dt
import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscope.operators.records import pending
from folioscope.plans.update import run_update
from folioscope.sources import files, manifest
from folioscope.sources.sinks import read_snapshot, write_snapshot
from folioscope.streaming import logs


def lines(path, *rows):
    path.write_text("\n".join(row if isinstance(row, str) else json.dumps(row, ensure_ascii=False) for row in rows) + "\n", encoding="utf-8")


def test_manifest_keeps_the_last_record(spark, tmp_path):
    log = tmp_path / "manifest.jsonl"
    lines(log, {"sha256": "a", "status": "submitted", "batch_id": "b1"}, "{broken", "", {"sha256": "a", "status": "failed"},
          {"sha256": "b", "status": "submitted", "batch_id": "b2"}, {"sha256": "a", "status": "success"}, {"sha256": "c", "status": "failed"})
    latest = manifest.latest_by_hash(manifest.read_manifest(spark, str(log)))
    assert {r.sha256: r.status for r in latest.collect()} == {"a": "success", "b": "submitted", "c": "failed"}
    scanned = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "sha256 string")
    assert sorted(r.sha256 for r in pending(scanned, latest).collect()) == ["c", "d"]


def test_scan_hashes_contents_once(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for name, body in (("b.pdf", b"one"), ("x/a.pdf", b"one"), ("x/c.pdf", b"two"), ("n.txt", b"no")):
        (tmp_path / name).write_bytes(body)
    found = {r.sha256: r for r in files.scan_files(spark, str(tmp_path)).collect()}
    one = found[hashlib.sha256(b"one").hexdigest()]
    assert len(found) == 2 and one.copies == 2 and one.path.endswith("/b.pdf")
    cache = files.list_files(spark, str(tmp_path), "*.pdf").withColumn("sha256", F.lit("known"))
    assert [r.sha256 for r in files.scan_files(spark, str(tmp_path), cache).collect()] == ["known"]


def test_archives_refuse_escapes(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name in ("out/full.md", "out/images/a.jpg", "../evil.md", "out/data.json"):
            archive.writestr(name, name)
    (tmp_path / "r.zip").write_bytes(buffer.getvalue())
    members = files.extract_archives(spark, str(tmp_path)).collect()
    assert sorted((r.member, r.is_image) for r in members) == [("out/full.md", False), ("out/images/a.jpg", True)]


def test_missing_inputs_are_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nowhere"):
        files.require_inputs(spark, str(tmp_path), str(tmp_path / "nowhere"))


def extractor():
    class Extractor:
        """Defined here so that it travels to the workers by value."""

        model = "fake"

        def extract(self, meta, body):
            if "bad" in body:
                raise ValueError("no answer")
            fact = {"entity": "甲", "metric": "营收", "value_num": 3, "value_text": "3亿元", "quote": "q"}
            return '{"facts": [' + str(fact).replace("'", '"') + '], "themes": [" 光模块 ", ""]}'

    return Extractor()


def test_update_is_incremental(spark, tmp_path):
    canonical, log = tmp_path / "canonical", tmp_path / "manifest.jsonl"

    def add(body):
        digest = hashlib.sha256(body.encode()).hexdigest()
        folder = canonical / digest[:32]
        (folder / "images").mkdir(parents=True)
        (folder / "full.md").write_text(body, encoding="utf-8")
        (folder / "images" / "a.jpg").write_bytes(b"x")
        return {"sha256": digest, "status": "success", "source": f"甲证券-周报-2606{len(body) % 20 + 1:02d}.pdf", "source_relative": "国内券商报告\\x.pdf"}

    rows = [add("# T\n\n" + "正文 " * 60), add("bad " * 60)]
    lines(log, *rows, {"sha256": "f" * 64, "status": "success", "source": "x.pdf"})
    store = str(tmp_path / "store")
    first = run_update(spark, str(log), str(canonical), store, dt.date(2026, 7, 1), extractor())
    documents = first["documents"].collect()
    assert len(documents) == 2 and {d.institution for d in documents} == {"甲证券"} and {d.image_count for d in documents} == {1}
    assert first["facts"].count() == 1 and [r.theme for r in first["doc_themes"].collect()] == ["光模块"]
    assert first["extraction_log"].count() == 1
    rows.append(add("另一篇 " * 50))
    lines(log, *rows)
    second = run_update(spark, str(log), str(canonical), store, dt.date(2026, 7, 1), extractor())
    assert second["documents"].count() == 3 and second["chunks"].select("doc_id").distinct().count() == 3
    assert second["facts"].count() == 2 and second["extraction_log"].count() == 2


def test_snapshots_survive_reading_their_own_source(spark, tmp_path):
    root = str(tmp_path / "snap")
    assert read_snapshot(spark, root) is None
    write_snapshot(spark.range(3), root)
    write_snapshot(read_snapshot(spark, root).where("id > 0"), root)
    assert read_snapshot(spark, root).count() == 2


def test_manifest_stream_keeps_latest(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines(source / "1.json", {"sha256": "a", "status": "submitted", "started_at": "2026-01-01"}, {"sha256": "b", "status": "failed", "started_at": "2026-01-01"})
    store, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    logs.maintain_latest(logs.read_manifest_stream(spark, str(source)), store, checkpoint).awaitTermination()
    lines(source / "2.json", {"sha256": "a", "status": "success", "started_at": "2026-01-02"})
    logs.maintain_latest(logs.read_manifest_stream(spark, str(source)), store, checkpoint).awaitTermination()
    assert {r.sha256: r.status for r in read_snapshot(spark, store).collect()} == {"a": "success", "b": "failed"}
