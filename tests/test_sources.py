"""File sources and sinks of the store, and the event log on disk."""

import json

from tessera.sources import event_log, files


def test_blobs_are_appended_and_read_by_id(spark, tmp_path):
    path = str(tmp_path / "blobs")
    rows = [(f"id-{k:02x}", bytearray([k, 255]), 2, k) for k in range(40)]
    files.write_blobs(spark.createDataFrame(rows[:30], files.BLOBS), path)
    files.write_blobs(spark.createDataFrame(rows[30:], files.BLOBS), path)
    assert sorted((r.cid, bytes(r.bytes), r.size, r.created_at) for r in files.read_blobs(spark, path).collect()) == [(c, bytes(b), s, t) for c, b, s, t in rows]
    some = files.read_blobs(spark, path, ["id-03", "id-25", "id-ff"])
    assert sorted(r.cid for r in some.collect()) == ["id-03", "id-25"]
    assert "PartitionFilters: [prefix" in some._jdf.queryExecution().toString()


def test_files_in_two_levels_of_folders(spark, tmp_path):
    for cid, content in (("abcdef01", b"one"), ("00123456", b"\x00\xff"), ("abcd9", b"")):
        folder = tmp_path / cid[:2] / cid[2:4]
        folder.mkdir(parents=True, exist_ok=True)
        (folder / cid[4:]).write_bytes(content)
    got = {r.cid: (bytes(r.bytes), r.size) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got == {"abcdef01": (b"one", 3), "00123456": (b"\x00\xff", 2)}  # the empty file is passed over


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"x": 1}\r\n\r\n  {"x": 2}  \n   \n{"x": 3}')
    got = [json.loads(r.line)["x"] for r in files.read_lines(spark, str(tmp_path / "a.jsonl")).collect()]
    assert sorted(got) == [1, 2, 3]
    path = str(tmp_path / "history")
    rows = [(3, "user", "c\nd"), (1, "user", "a"), (2, "assistant", 'b "q"')]
    for _ in range(2):  # a second dump replaces the first
        files.write_lines(spark.createDataFrame(rows, "position long, role string, content string"), path)
    lines = [json.loads(r.line) for r in files.read_lines(spark, path).collect()]
    assert lines == [{"role": r, "content": c} for _, r, c in sorted(rows)]


def test_event_log_on_disk(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(k, "ab"[k % 2], "{}", f"s{k % 3}", 10 * k) for k in range(25)]
    event_log.append(spark.createDataFrame(rows[:20], event_log.SCHEMA), path)
    event_log.append(spark.createDataFrame(rows[20:], event_log.SCHEMA), path)
    log = event_log.read_log(spark, path)
    assert sorted(map(tuple, log.collect())) == rows
    # A consumer that polls from its last offset sees every event of its topics once, in order.
    seen, offset = [], -1
    while batch := [r.event_id for r in event_log.poll(log, ["a"], offset).collect()]:
        seen, offset = seen + batch, batch[-1]
    assert seen == [k for k in range(25) if k % 2 == 0]
    views = spark.createDataFrame([("v", "a"), ("v", "b"), ("w", "a"), ("z", "none")], "view string, topic string")
    assert {r.view: r.last_event_id for r in event_log.offsets(log, views).collect()} == {"v": 24, "w": 24, "z": None}
    stream = event_log.stream_log(spark, path).writeStream.format("memory").queryName("seen_events").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    stream.awaitTermination(60)
    assert spark.table("seen_events").count() == 25
