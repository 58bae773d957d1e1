"""Streams with events out of order against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from evispark.operators import events as B
from evispark.streaming import jobs as J
from evispark.streaming import ordered as O


def run(df, checkpoint):
    rows = []
    J.run_available(df, lambda batch, _: rows.extend(batch.collect()), checkpoint, "append")
    return rows


SESSION = "session_id string, seq int, event string, payload string, ts timestamp"


def written(spark, rows, schema, folder, parts):
    """One file, and so one micro-batch, for each list of rows, oldest file first."""
    for k in range(parts):
        part = [r[:-1] for r in rows if r[-1] == k]
        if part:
            df = spark.createDataFrame(part, schema.replace("ts timestamp", "ms long")).withColumn("ts", F.timestamp_millis("ms")).drop("ms")
            df.coalesce(1).write.mode("append").parquet(folder)
    return J.read_events(spark, folder, spark.read.parquet(folder).schema, 1)


def test_shuffled_frames_come_out_in_order(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for s in range(12):
        n = rng.randrange(3, 25)
        end = rng.randrange(2, n + 1)
        for seq in range(1, n + 1):
            event = ("final" if s % 2 else "error") if seq == end and s % 3 else rng.choice(["delta", "delta", "progress"])
            rows.append((f"s{s}", seq, event, f"<{seq}>", 1_700_000_000_000 + seq * 1000, rng.randrange(4)))
    rng.shuffle(rows)
    again = [(*r[:-1], 3) for r in rows[:9]]
    out = run(O.session_frames(written(spark, rows + again, SESSION, str(tmp_path / "in"), 4)), str(tmp_path / "ck"))
    frames, duplicates = {}, 0
    for r in out:
        if r.kind == "duplicate":
            duplicates += 1
        else:
            frames.setdefault(r.session_id, []).append(r)
    assert duplicates == 9 and {r.kind for r in out} <= {"frame", "after_end", "duplicate"}
    batch = spark.createDataFrame([r[:4] for r in rows], "session_id string, seq int, event string, payload string")
    for want in B.session_answers(batch).collect():
        got = frames[want.session_id]
        assert [r.seq for r in got] == list(range(1, len(got) + 1))
        assert "".join(r.payload for r in got if r.event == "delta") == want.answer
        assert (next((r.event for r in got if r.event in O.ENDS), "open"), any(r.kind == "after_end" for r in got)) == (want.outcome, bool(want.after_end))


def test_gaps_are_reported_after_patience(spark, tmp_path):
    t = 1_700_000_000_000
    rows = [("a", 1, "delta", "1", t, 0), ("a", 4, "delta", "4", t + 1, 0), ("a", 6, "final", "6", t + 2, 0), ("b", 2, "delta", "2", t, 0)]
    # Time goes on with another session: the timers of a batch follow its rows.
    rows += [("z", 1, "delta", "z", t + 3_600_000, 1), ("z", 2, "delta", "z", t + 3_600_001, 2), ("a", 7, "delta", "7", t + 3_600_002, 3), ("a", 4, "delta", "4", t + 3_600_003, 3)]
    out = run(O.session_frames(written(spark, rows, SESSION, str(tmp_path / "in"), 4)), str(tmp_path / "ck"))
    got = [(r.kind, r.seq, r.until) for r in out if r.session_id == "a"]
    assert got == [("frame", 1, 1), ("gap", 2, 3), ("gap", 5, 5), ("frame", 4, 4), ("frame", 6, 6), ("duplicate", 4, 4), ("after_end", 7, 7)]
    assert [(r.kind, r.seq, r.until) for r in out if r.session_id == "b"] == [("gap", 1, 1), ("frame", 2, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_status_stream_equals_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        at = 1_700_000_000_000 + i * 20_000
        # Up to eight minutes late: within the watermark.
        rows.append((rng.randrange(15), i, rng.choice(B.TASK_STATES), at + rng.randrange(-240_000, 240_000), min(i // 100 + (i % 100 > 90), 3)))
    end = [(99, 10_000, "queued", 1_700_000_000_000 + 30 * 24 * 3_600_000, 4)]
    schema = "task_id long, seq long, status string, ts timestamp"
    source = written(spark, rows + end, schema, str(tmp_path / "in"), 5)
    out = run(O.status_changes(source), str(tmp_path / "ck"))
    batch = spark.read.parquet(str(tmp_path / "in")).where("task_id < 99")
    illegal = {(r.task_id, r.seq, r.from_status, r.to_status) for r in out if r.kind == "illegal"}
    assert illegal == {tuple(r) for r in B.illegal_transitions(batch).collect()}
    latest = {}
    for r in out:
        if r.kind == "latest":
            latest[r.task_id] = (r.to_status, r.n_events)
    assert latest == {r.task_id: (r.status, r.n_events) for r in B.latest_status(batch).collect()}
    assert sum(r.kind == "illegal" for r in out) == len(illegal)


def test_a_silent_task_is_forgotten(spark, tmp_path):
    t, day = 1_700_000_000_000, 24 * 3_600_000
    rows = [(1, 1, "queued", t, 0), (2, 2, "queued", t + 3 * day, 1), (2, 3, "running", t + 3 * day + 1, 2), (1, 4, "queued", t + 4 * day, 3), (2, 5, "running", t + 8 * day, 4)]
    out = run(O.status_changes(written(spark, rows, "task_id long, seq long, status string, ts timestamp", str(tmp_path / "in"), 5)), str(tmp_path / "ck"))
    assert [(r.seq, r.kind, r.n_events) for r in out if r.task_id == 1] == [(1, "latest", 1), (4, "latest", 1)]
