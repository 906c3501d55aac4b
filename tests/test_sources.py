import io
import zipfile

from pyspark.sql import functions as F

from paperloom.sources import files, replies, sinks
from paperloom.streaming import registry_stream


def test_decoding():
    for name in ("utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "cp1251"):
        assert files.decoded("Привет, hello мир 123".encode(name)) == "Привет, hello мир 123", name
    assert files.decoded(b"") == ""


def test_rtf():
    raw = r"{\rtf1\ansi\ansicpg1251{\fonttbl{\f0 Arial;}}{\*\generator x;}\uc1 \'cf\'f0\u1080?\u1074?\'e5\'f2\par two\tab x \{y\}}"
    assert files.rtf_text(raw) == "Привет\ntwo\tx {y}"
    assert files.rtf_text("") == ""


def docx(xml: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{xml}</w:body></w:document>')
    return out.getvalue()


def test_docx_and_sniffing():
    cell = "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
    body = docx(f"<w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr>{cell.format('a')}{cell.format('b')}</w:tr></w:tbl>")
    assert files.docx_text(body) == "One\na | b" and files.text_of("doc", body) == "One\na | b"
    assert files.docx_text(b"broken") == "" and files.text_of("doc", b"\xd0\xcf\x11\xe0") == ""
    assert files.text_of("doc", rb"{\rtf1 hi}") == "hi"


def test_discovery_and_texts(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("текст")
    (tmp_path / "a" / "y.xyz").write_text("?")
    (tmp_path / "b.docx").write_bytes(b"broken")
    found = files.discovered(spark, str(tmp_path))
    assert sorted((r["ext"], r["supported"]) for r in found.collect()) == [("docx", True), ("txt", True), ("xyz", False)]
    assert [tuple(r) for r in files.skipped(found).collect()] == [("xyz", 1)]
    assert sorted((r["ext"], r["text"], r["error"]) for r in files.texts(spark, str(tmp_path)).collect()) == [("docx", "", None), ("txt", "текст", None)]


def test_replies():
    assert replies.salvaged('<think>{"a":0}</think> text ```json\n{"a": NaN}\n``` end') == '{"a": null}'
    assert replies.salvaged('x {"broken": } y {"ok": {"z": 1}} w') == '{"ok": {"z": 1}}'
    assert replies.salvaged('[1, {"a": 1}]') == '{"a": 1}'
    assert replies.salvaged("none") is None and replies.salvaged(None) is None and replies.salvaged("") is None


def test_registry_on_disk_and_stream(spark, tmp_path):
    schema = "file_path string, doc_type string, status string, extraction_failed boolean, v int, seq int"
    path, key = str(tmp_path / "registry"), ["file_path", "doc_type"]
    sinks.write_registry(spark.createDataFrame([("a", "t", "OK", False, 1, 1), ("b", "t", "FAILED", False, 2, 1)], schema), path, key, "seq")
    feed = tmp_path / "feed"
    spark.createDataFrame([("a", "t", "OK", False, 9, 2), ("c", "t", "OK", False, 3, 2)], schema).write.parquet(str(feed))
    for _ in range(2):  # the second run finds nothing new
        registry_stream.upsert_stream(spark.readStream.schema(schema).parquet(str(feed)), path, key, "seq", str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted((r["file_path"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 9), ("c", 3)]


def test_streamed_totals_equal_batch_totals(spark, tiny, tmp_path):
    events = spark.read.parquet(f"{tiny}/events.parquet")
    (tmp_path / "in").mkdir()
    events.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = registry_stream.running_totals(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["event_type"], r["n"]) for r in spark.table("totals").collect()}
    assert got == {(r["event_type"], r["n"]) for r in events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    windows = registry_stream.windowed_calls(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "1 day", "1 hour")
    w = windows.writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "w")).trigger(availableNow=True).start()
    w.awaitTermination()
    assert spark.table("windows").count() > 0


def test_atomic_file_and_report(spark, tmp_path):
    target = tmp_path / "x.md"
    sinks.write_text(str(target), sinks.report(spark.createDataFrame([("a", None)], "t string, n int"), "Run"))
    assert target.read_text().startswith("# Run") and "| a |" in target.read_text() and len(list(tmp_path.iterdir())) == 1


def test_a_registry_survives_broken_runs_and_unreadable_files(spark, tmp_path):
    path, key, schema = str(tmp_path / "registry"), ["file_path"], "file_path string, doc_type string, status string, extraction_failed boolean, seq int, n int"
    rows = lambda *xs: spark.createDataFrame([(x, "t", "OK", False, q, q) for x, q in xs], schema)
    sinks.write_registry(rows(*((f"f{i}", 1) for i in range(100))), path, key, "seq")
    sinks.write_registry(rows(("f1", 2), ("new", 2)), path, key, "seq")
    read = lambda: {r["file_path"]: r["seq"] for r in sinks.read_registry(spark, path).collect()}
    want = {f"f{i}": 1 for i in range(100)} | {"f1": 2, "new": 2}
    assert read() == want
    # a run that broke off between taking a folder away and putting the new one there
    folder = next(p for p in sorted((tmp_path / "registry").iterdir()) if p.name.startswith("_bucket="))
    (tmp_path / "registry.old").mkdir()
    folder.rename(tmp_path / "registry.old" / folder.name)
    assert len(read()) < len(want)
    sinks.write_registry(rows(("f1", 3)), path, key, "seq")
    assert read() == want | {"f1": 3} and not (tmp_path / "registry.old").exists()
    sinks.write_registry(rows().limit(0), path, key, "seq")
    assert read() == want | {"f1": 3}
    # a registry that can't be read is put aside
    for f in (tmp_path / "registry").rglob("*.parquet"):
        f.write_bytes(b"no parquet")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    sinks.write_registry(rows(("f1", 4)), path, key, "seq")
    assert read() == {"f1": 4} and (tmp_path / "registry.unreadable1").exists()
