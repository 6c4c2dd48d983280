import os
import time
from datetime import datetime

from palimpsest.streaming.recompare import edits_by_window, editing_sessions, version_changes


def test_versions(spark, tmp_path):
    schema = "doc_id long, version long, text string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[(1, 1, "a\nb"), (2, 1, "x")], [(1, 2, "a\nb\nc"), (1, 3, "a\nc"), (2, 1, "late")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = version_changes(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination(120)
    got = {(r.doc_id, r.was, r.version): (r.changed, r.added, r.removed) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 1, 2): (0, 1, 0), (1, 2, 3): (0, 0, 1)}


def test_windows_and_sessions(spark, tmp_path):
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    batches = [[(1, 1, at(9, 0)), (1, 2, at(9, 4)), (2, 1, at(9, 5)), (1, 3, at(9, 40)), (3, 1, None)], [(1, 4, at(13, 0))], [(5, 1, at(13, 2))], [(1, 5, at(9, 1)), (2, 2, at(13, 5))], [(9, 1, at(20, 0))]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "doc_id long, version long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        for f in os.listdir(f"{tmp_path}/in/{k}"):
            if f.endswith(".parquet"):
                os.makedirs(f"{tmp_path}/all", exist_ok=True)
                os.rename(f"{tmp_path}/in/{k}/{f}", f"{tmp_path}/all/{k}-{f}")
                os.utime(f"{tmp_path}/all/{k}-{f}", (time.time() - 100 + k, time.time() - 100 + k))

    def run(make, name):
        stream = spark.readStream.schema("doc_id long, version long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/all")
        query = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name)

    windows = {(r.doc_id, r.start, r.versions, r.latest) for r in run(edits_by_window, "windows").collect()}
    assert windows == {(1, at(9, 0), 2, 2), (2, at(9, 0), 1, 1), (1, at(9, 40), 1, 3), (1, at(13, 0), 1, 4), (5, at(13, 0), 1, 1), (2, at(13, 0), 1, 2)}  # the version of 9:01 comes too late
    sessions = {(r.doc_id, r.start, r.versions) for r in run(editing_sessions, "sessions").collect()}
    assert sessions == {(1, at(9, 0), 2), (2, at(9, 5), 1), (1, at(9, 40), 1), (1, at(13, 0), 1), (5, at(13, 2), 1), (2, at(13, 5), 1)}
