"""Event replay: given events, expect view rows; a stream agrees with a batch."""

import json

import pytest

from tessera.streaming import views as v


def log(spark, rows):
    return spark.createDataFrame([(k, t, json.dumps(p), s, at) for k, (t, p, s, at) in enumerate(rows, 1)], "event_id long, topic string, payload string, session_id string, created_at long")


def test_sessions(spark):
    events = log(spark, [
        (v.CLOSE, {}, "a", 1), (v.REQUEST, {}, "a", 2), (v.INIT, {"harness": "h1", "pid": 7}, "a", 3), (v.INIT, {"harness": "h2"}, "a", 4), (v.CLOSE, {}, "a", 5), (v.CLOSE, {}, "a", 6),
        (v.REQUEST, {}, "b", 7), (v.CLOSE, {}, "c", 8), (v.INIT, {}, "d", 9), (v.REQUEST, {}, None, 10),
    ])
    got = {r.session_id: r for r in v.sessions(events).collect()}
    assert set(got) == {"a", "b", "d"}
    assert (got["a"].created_at, got["a"].ended_at, got["a"].pid, got["a"].harness) == (2, 5, 7, "h1")
    assert (got["b"].harness, got["b"].ended_at, got["d"].harness) == ("orphan", None, "unknown")
    actors = spark.createDataFrame([("a", "me")], "session_id string, actor string")
    assert {r.session_id: r.actor for r in v.sessions(events, actors).collect()}["a"] == "me"


def test_revisions(spark):
    events = log(spark, [
        (v.REQUEST, {}, "s", 10), (v.COMPLETED, {"request_event_id": 1, "stop_reason": "end_turn"}, "s", 20), (v.REQUEST, {}, "s", 20), (v.FAILED, {"request_event_id": 3}, "s", 25),
        (v.REQUEST, {}, "s", 22), (v.COMPLETED, {"request_event_id": 5, "stop_reason": "tool_use"}, "s", 40), (v.COMPLETED, {"request_event_id": 5, "stop_reason": "max_tokens"}, "s", 41), (v.REQUEST, {}, "t", 50),
    ])
    got = {r.id: r for r in v.revisions(events).collect()}
    assert [got[k].classification for k in (1, 3, 5, 8)] == ["closed_forkable", "dangling_unforkable", "dangling_unforkable", "in_flight"]
    assert got[3].parent_id == 1  # sealed in the same millisecond
    assert got[5].parent_id == 1  # the failure was sealed later than this request's time
    assert got[1].parent_id is None and got[8].parent_id is None and got[5].sealed_at == 41


def test_branch_views_move_together(spark):
    rows = [("t", 1, v.CREATED, "x", "r1", None, "l", "a", 1), ("t", 2, v.CREATED, "y", "r1", None, None, "fork@r1", 2), ("t", 3, v.COMPLETED, None, "r2", "r1", None, None, 3), ("t", 4, v.LABELLED, "x", None, None, "new", None, 4), ("t", 5, v.DELETED, "y", None, None, None, None, 5), ("u", 1, v.COMPLETED, None, "r2", "r1", None, None, 6)]
    changes = spark.createDataFrame(rows, "task_id string, position long, topic string, view_id string, head string, parent string, label string, auto_label string, created_at long")
    got = v.branch_views(changes).collect()
    assert [(r.view_id, r.head, r.label, r.updated_at) for r in got] == [("x", "r2", "new", 4)]
    before = v.branch_views(changes.where("position <= 3")).collect()
    assert {(r.view_id, r.head) for r in before} == {("x", "r2"), ("y", "r2")}


def test_branch_views_against_brute_force(spark, sf_dir):
    from tessera.catalog.events import _branch_changes

    changes = _branch_changes(spark, sf_dir)
    want = {}
    for r in sorted(changes.collect(), key=lambda r: (r.task_id, r.position)):
        own = want.setdefault(r.task_id, {})
        if r.topic == v.CREATED:
            own.setdefault(r.view_id, [r.head, r.label])
        elif r.topic == v.LABELLED and r.view_id in own:
            own[r.view_id][1] = r.label
        elif r.topic == v.DELETED:
            own.pop(r.view_id, None)
        elif r.topic == v.COMPLETED:
            for x in own.values():
                if x[0] == r.parent:
                    x[0] = r.head
    got = {}
    for r in v.branch_views(changes).collect():
        got.setdefault(r.task_id, {})[r.view_id] = [r.head, r.label]
    assert got == {k: x for k, x in want.items() if x}


def test_a_failing_view_does_not_stop_the_others(spark):
    def bad(events, done):
        raise RuntimeError("no")

    engine = v.Engine([v.View("late", (v.INIT,), lambda e, d: e, needs=("good",)), v.View("bad", (v.INIT,), bad), v.View("good", (v.INIT,), lambda e, d: e)])
    assert [x.name for x in engine.order()] == ["good", "late", "bad"]
    assert engine.topic_index() == {v.INIT: ["good", "late", "bad"]}
    wrote = {}
    engine.process(log(spark, [(v.INIT, {}, "a", 1)]), 3, lambda name, rows: wrote.setdefault(name, rows.count()))
    assert wrote == {"good": 1, "late": 1} and engine.failures == [(3, "bad", "no")]


@pytest.fixture
def log_dir(spark, sf_dir, tmp_path):
    from tessera.catalog.events import session_log

    events = session_log(spark, sf_dir)
    for k in range(3):
        events.where(f"event_id between {k * 400} and {k * 400 + 399}").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    return str(tmp_path / "log")


def test_stream_agrees_with_batch(spark, log_dir, tmp_path):
    from tessera.sources.event_log import read_log, stream_log

    out = {}
    engine = v.Engine([v.View("sessions", (v.INIT, v.CLOSE, v.REQUEST), lambda e, d: e.select("event_id"))])
    query = engine.start(stream_log(spark, log_dir, 1), str(tmp_path / "c1"), lambda name, rows, epoch: out.setdefault(name, []).extend(r.event_id for r in rows.collect()))
    query.awaitTermination()
    want = read_log(spark, log_dir).where(f"topic in ('{v.INIT}', '{v.CLOSE}', '{v.REQUEST}')")
    assert sorted(out["sessions"]) == sorted(r.event_id for r in want.collect()) and not engine.failures


def test_stateful_sessions_agree_with_batch(spark, log_dir, tmp_path):
    from tessera.sources.event_log import read_log, stream_log

    last = {}

    def keep(rows, epoch):
        for r in rows.collect():
            last[r.session_id] = (r.created_at, r.ended_at, r.pid, r.harness)

    query = v.stream_sessions(stream_log(spark, log_dir, 10)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = {r.session_id: (r.created_at, r.ended_at, r.pid, r.harness) for r in v.sessions(read_log(spark, log_dir)).collect()}
    assert last == want
