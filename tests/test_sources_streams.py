"""Files of a folder, and streams."""

import json
import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from korrel.sources import files as S
from korrel.streaming import jobs


def test_walk_reads_plain_and_office_files(spark, tmp_path):
    (tmp_path / "Documents").mkdir()
    (tmp_path / ".cache").mkdir()
    (tmp_path / "Documents/a.txt").write_text("héllo   wörld")
    (tmp_path / "Documents/b.html").write_text("<html><script>x()</script><p>One &amp; two</p></html>")
    (tmp_path / ".cache/c.txt").write_text("hidden")
    (tmp_path / "d.bin").write_bytes(b"\0")
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>Hi &lt;you&gt;</w:t></w:p><w:p>there</w:p>")
    (tmp_path / "broken.docx").write_bytes(b"PK no archive")
    found = S.walk(spark, str(tmp_path))
    got = {r.name: r.content_raw for r in S.with_text(found).collect()}
    assert got == {"a.txt": "héllo wörld", "b.html": "One & two", "e.docx": "Hi <you> there", "broken.docx": None}
    assert [r.name for r in S.in_scan_order(found).collect()][0] == "a.txt"
    assert S.digest(found).where("length(sha256) = 64").count() == 4


def test_streams(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    schema = "device_id string, path string, last_modified long, event_id string, event_ts timestamp, query string"
    row = lambda i, p, t: json.dumps({"device_id": "d", "path": p, "last_modified": t, "event_id": str(i), "event_ts": "2025-01-01T10:00:00", "query": "q"})
    (folder / "1.json").write_text("\n".join([row(1, "/a", 1), row(1, "/a", 1), row(2, "/b", 1)]))
    stream = jobs.event_stream(spark, str(folder), schema)
    jobs.keep_index(stream, table, str(tmp_path / "cp"), jobs.newest_of_key).awaitTermination(120)
    (folder / "2.json").write_text(row(3, "/a", 9))
    jobs.keep_index(stream, table, str(tmp_path / "cp"), jobs.newest_of_key).awaitTermination(120)
    assert {(r.path, r.last_modified) for r in spark.read.parquet(f"{table}/v=1").collect()} == {("/a", 9), ("/b", 1)}
    out = jobs.once_in_time(stream).writeStream.format("memory").queryName("once_rows").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert spark.table("once_rows").count() == 3
    hours = jobs.searches_per_window(stream).writeStream.outputMode("update").format("memory").queryName("hour_rows").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    hours.awaitTermination(120)
    assert spark.table("hour_rows").agg(F.sum("n")).first()[0] == 4
    assert datetime(2025, 1, 1, 10) in {r.window.start for r in spark.table("hour_rows").collect()}
